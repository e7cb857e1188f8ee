"""Suffix-array removal of repeated passages over a whole corpus.

Every byte covered by a ``length``-byte string that also starts anywhere else (other documents or the same
one, overlaps included) is removed; strings are judged on the input.

How it spreads over a cluster.  Every window of ``length`` bytes picks an anchor: the leftmost smallest hash
among its first WINDOW short substrings.  Equal windows pick equal anchors at equal offsets, so windows can
only be equal inside the group of their anchor's key (the bytes that all windows of an anchor share).  Keys
that occur once are dropped after a map-side combined count.  Equal contexts (all windows of an anchor
occurrence) are merged before any text moves; keys whose contexts still differ are decided by suffix arrays
(`gsaca`): the shared bytes become one symbol, so windows are equal exactly if neighbours in suffix order
share ``length - key + 1`` symbols.  Keys with more than HOT contexts are cut finer: the same groups are made
for ranges of STEP windows, and where these are still too many for every single window, where a group's strings are all
equal and merge before the shuffle, so no task holds an unbounded group.  Texts are hashed in both passes on purpose: the anchors
written out once would be as large as the text.

Defined results: null or empty text: 0 bytes, nothing removed; repeated rows: each result row stands for one
input row, and texts of ``length`` bytes or more that occur twice are removed whole; texts shorter than
``length`` are kept; very long texts are taken whole, in blocks that hold every window once; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import CHUNK_BYTES, PrefixHash, mix64, parts, row_key, text_chunks, written
from quarrylens.llm.gsaca import suffix_array

LENGTH = 200
GRAM = 24
HOT = 2048
STEP = 16
SA_SYMBOLS = 150_000
_POS = np.uint64((1 << 24) - 1)


def _window(length: int) -> int:
    return max(1, 1 << max(0, (length - GRAM).bit_length() - 1)) if length > GRAM else 1


def _plan(length: int) -> tuple[int, int, int]:
    """(gram, anchors per window, key bytes) for a window length."""
    gram = min(GRAM, length)
    window = _window(length)
    return gram, window, length - window + 1


def anchor_rows(buf: np.ndarray, offs: np.ndarray, length: int):
    """Anchors of all windows: arrays doc index, first window, last window, anchor (all in buf), key, context."""
    gram, window, key_len = _plan(length)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(buf) < length:
        return none
    one, two = PrefixHash(buf, 11), PrefixHash(buf, 29)
    low = (one.fixed(gram) & ~_POS) | np.arange(len(buf) - gram + 1, dtype=np.uint64)
    step = 1
    while step < window:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    starts, ends = offs[:-1], offs[1:]
    many = np.maximum(ends - starts - length + 1, 0)
    docs = np.repeat(np.arange(len(many)), many)
    shift = np.cumsum(many) - many
    at = np.arange(len(docs)) - np.repeat(shift, many) + np.repeat(starts, many)
    if not len(at):
        return none
    anchor = (low[at] & _POS).astype(np.int64)
    cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])))
    end = np.append(cut[1:], len(at)) - 1
    lo, hi, a, d = at[cut], at[end], anchor[cut], docs[cut]
    key = one.of(a, a + key_len)
    ctx = mix64(two.of(lo, hi + length) ^ ((a - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - lo).astype(np.uint64))
    return d, lo, hi, a, key, ctx


def _blocks(buf: np.ndarray, offs: np.ndarray, length: int, limit: int = 4 * CHUNK_BYTES):
    """Split a text beyond the limit so that each window lies in one block; yields (bytes, offsets, start of block)."""
    if len(buf) <= limit or len(offs) > 2:
        yield buf, offs, 0
        return
    for at in range(0, len(buf) - length + 1, limit):
        part = buf[at : at + limit + length - 1]
        yield part, np.array([0, len(part)], np.int64), at


def _anchors(length: int, full: bool):
    def run(batches):
        for batch in batches:
            rid = batch.column(batch.schema.get_field_index("rid")).to_numpy(zero_copy_only=False)
            for row, buf, offs in text_chunks(batch):
                for part, cuts, at in _blocks(buf, offs, length):
                    d, lo, hi, a, key, ctx = anchor_rows(part, cuts, length)
                    cols = [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))]
                    if full:
                        loc = ((lo - cuts[d] + at) << 20) | ((hi - lo) << 10) | (a - lo)
                        cols += [pa.array(rid[row + d]), pa.array(loc)]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "ctx", "rid", "loc"][: len(cols)])

    return run


def _fields(loc: np.ndarray):
    """first window, number of windows less one, anchor's distance from the first window."""
    return loc >> 20, (loc >> 10) & 1023, loc & 1023


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    m = min(len(a), len(b))
    return m - ((int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")).bit_length() + 7 >> 3)


def shared_bytes(strings: list, aoffs: list, gids: np.ndarray, key_len: int) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes left and right of the key each context shares with any other of its group.

    The most common neighbour of a string is next to it in sorted order.
    """
    n = len(strings)
    out = [0] * n, [0] * n
    cuts = [0, *(np.flatnonzero(gids[1:] != gids[:-1]) + 1).tolist(), n]
    for b, e in zip(cuts[:-1], cuts[1:]):
        if e - b < 2:
            continue
        for side, most in enumerate(out):
            parts = [s[a + key_len :] if side else s[:a][::-1] for s, a in zip(strings[b:e], aoffs[b:e])]
            order = sorted(range(e - b), key=parts.__getitem__)
            for x, y in zip(order, order[1:]):
                k = _common(parts[x], parts[y])
                if k > most[b + x]:
                    most[b + x] = k
                if k > most[b + y]:
                    most[b + y] = k
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def repeated_in_groups(strings: list, aoffs: np.ndarray, plens: np.ndarray, counts: np.ndarray, gids: np.ndarray, length: int):
    """Which windows of each context repeat, by one suffix array over all of them.

    strings: context bytes; gids: group number of each.  Bytes that a context shares with no other of its group cannot lie in a
    repeated window and are cut off first.  Returns arrays: context, first window, last window of each run.
    """
    _, _, key_len = _plan(length)
    left, right = shared_bytes(strings, aoffs.tolist(), gids, key_len)
    whole = np.flatnonzero(counts > 1)
    used = np.flatnonzero(left + key_len + right >= length)
    # a group needs no suffix array once all its contexts are known to repeat
    open_groups = np.unique(gids[used[counts[used] == 1]])
    used = used[np.isin(gids[used], open_groups)]
    results = [(whole, np.zeros(len(whole), np.int64), plens[whole])]
    if len(used):
        seqs = []
        for k in used.tolist():
            a = int(aoffs[k])
            raw = np.frombuffer(strings[k], np.uint8)
            lo, hi = a - int(left[k]), a + key_len + int(right[k])
            seqs.append(np.concatenate([raw[lo:a].astype(np.int64) + 2, [300 + gids[k]], raw[a + key_len : hi].astype(np.int64) + 2, [1]]))
        sizes = np.array([len(x) for x in seqs])
        text = np.concatenate(seqs)
        span = length - key_len + 1
        owner = np.repeat(np.arange(len(used)), sizes)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        shift = aoffs[used] - left[used]  # of a window's number, by the bytes cut off
        valid = (inside + shift[owner] <= plens[used][owner]) & (inside + span <= sizes[owner] - 1)
        sa = suffix_array(text)
        sa = sa[valid[sa]]
        equal = np.zeros(len(sa), bool)
        if len(sa) > 1:
            grams = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(span, np.int64)).astype(np.int32), span)
            for b in range(0, len(sa) - 1, 20_000):
                x, y = sa[b : b + 20_000], sa[b + 1 : b + 20_001]
                m = min(len(x), len(y))
                equal[b : b + m] = (grams[x[:m]] == grams[y[:m]]).all(axis=1)
        hit = np.zeros(len(text), bool)
        hit[sa[equal]] = True
        hit[sa[1:][equal[:-1]]] = True
        hit &= (counts[used] == 1)[owner]  # the others are whole already
        on = np.flatnonzero(hit)
        if len(on):
            new = np.append(True, (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]]))
            first, final = on[new], on[np.append(np.flatnonzero(new)[1:], len(on)) - 1]
            results.append((used[owner[first]], inside[first] + shift[owner[first]], inside[final] + shift[owner[final]]))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*results))


def _sort_groups(length: int):
    """Over rows sorted by key: (key, ctx, n, aoff, plen, bytes) to (key, ctx, first, last)."""

    def flush(rows):
        key, ctx, n, loc, raw = (np.concatenate(x) if k < 4 else [s for part in x for s in part] for k, x in enumerate(zip(*rows)))
        _, plen, aoff = _fields(loc)
        gid = np.cumsum(np.append(0, key[1:] != key[:-1]))
        owner, first, last = repeated_in_groups(raw, aoff, plen, n, gid, length)
        return pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array(ctx[owner]), pa.array(first), pa.array(last)], names=["key", "ctx", "first", "last"])

    def run(batches):
        held, symbols = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ctx, n, loc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            raw = batch.column(4).to_pylist()
            sizes = np.cumsum([len(s) for s in raw])
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            done = 0
            if held and held[-1][0][-1] != key[0] and symbols > SA_SYMBOLS:
                yield flush(held)
                held, symbols = [], 0
            for c in cuts.tolist():
                if symbols + sizes[c - 1] - (sizes[done - 1] if done else 0) > SA_SYMBOLS:
                    held.append((key[done:c], ctx[done:c], n[done:c], loc[done:c], raw[done:c]))
                    yield flush(held)
                    held, symbols, done = [], 0, c
            held.append((key[done:], ctx[done:], n[done:], loc[done:], raw[done:]))
            symbols += int(sizes[-1] - (sizes[done - 1] if done else 0))
        if held:
            yield flush(held)

    return run


def _cut_texts(batches):
    """Bytes of the wanted contexts of each document row."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
        wants = batch.column(batch.schema.get_field_index("want"))
        out = ([], [], [], [], [])
        size = 0
        for k in range(batch.num_rows):
            raw = text[k].as_py()
            for w in wants[k].as_py():
                lo, plen = w["loc"] >> 20, (w["loc"] >> 10) & 1023
                piece = raw[lo : lo + plen + w["length"]]
                size += len(piece)
                for c, v in zip(out, (w["key"], w["ctx"], w["n"], w["loc"], piece)):
                    c.append(v)
            if size > CHUNK_BYTES:
                yield _pieces(out)
                out, size = ([], [], [], [], []), 0
        yield _pieces(out)


def _pieces(out):
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["key", "ctx", "n", "loc", "piece"])


def _parts(step: int, length: int):
    """Contexts cut into ranges of ``step`` windows, by their distance from the anchor.

    The key of a range is the bytes that all its windows share, so equal windows of any contexts stay in one group.
    """

    def run(batches):
        for batch in batches:
            tkey, tctx, shift, n, loc = (batch.column(k).to_pylist() for k in range(5))
            raws = batch.column(5).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for k, raw in enumerate(raws):
                plen, a = (loc[k] >> 10) & 1023, loc[k] & 1023
                for q in range((a - plen) // step, a // step + 1):
                    w0, w1 = a - min(a, q * step + step - 1), a - max(a - plen, q * step)
                    shared = raw[a - q * step : a - q * step - step + 1 + length]
                    piece = raw[w0 : w1 + length]
                    key = xxhash.xxh64_intdigest(shared, tkey[k] + q & (1 << 64) - 1)
                    ctx = xxhash.xxh64_intdigest(piece, (a - w0) * 1024 + w1 - w0)
                    row = (tkey[k], tctx[k], shift[k] + w0, n[k], key - (1 << 63), ctx - (1 << 63), (w1 - w0) << 10 | (a - w0), piece)
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], names=["tkey", "tctx", "shift", "n", "key", "ctx", "loc", "piece"])

    return run


def _strip(length: int):
    """Remove the marked bytes of each document row."""

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            marks = batch.column(batch.schema.get_field_index("marks"))
            out = ([], [], [], [])
            for k in range(batch.num_rows):
                raw = text[k].as_py() or b""
                pairs = marks[k].values if marks[k].is_valid else None
                if pairs is None or not len(pairs):
                    removed, spans, kept = 0, 0, raw
                else:
                    lo = pairs.field(0).to_numpy(zero_copy_only=False)
                    hi = pairs.field(1).to_numpy(zero_copy_only=False) + length
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.append(True, lo[1:] > hi[:-1])
                    b = lo[new]
                    e = hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
                    removed, spans = int((e - b).sum()), len(b)
                    kept = b"".join(raw[x:y] for x, y in zip(np.append(0, e).tolist(), np.append(b, len(raw)).tolist()))
                for c, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    n = parts(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", row_key())

    keys = (
        base.select("rid", "text").mapInArrow(_anchors(length, False), "key long, ctx long")
        .groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
        .filter("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed"))
    )
    keys = written(keys, "op1-keys")
    found = written(base.select("rid", "text").mapInArrow(_anchors(length, True), "key long, ctx long, rid long, loc long").join(keys, "key"), "op1-anchors")

    mixed = found.filter("mixed").drop("mixed")
    contexts = mixed.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "loc")).alias("one"))
    contexts = written(contexts.select("key", "ctx", "n", "one.rid", "one.loc"), "op1-contexts")
    hot = written(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("key"), "op1-hot")
    wanted = (
        contexts.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        .groupBy("rid").agg(F.collect_list(F.struct("key", "ctx", F.when(F.col("hot"), -F.col("n")).otherwise(F.col("n")).alias("n"), "loc", F.lit(length).alias("length"))).alias("want"))
    )
    # rid stands for (doc_id, text), so one row of each rid is enough; base is shuffled once for both uses
    pieces = (
        base.join(wanted, "rid").select("rid", "doc_id", "text", "want").mapInArrow(_cut_texts, "key long, ctx long, n long, loc long, piece binary")
    )
    pieces = written(pieces, "op1-pieces")
    grouped = pieces.filter("n > 0").repartition(n, "key").sortWithinPartitions("key", "ctx")
    runs = grouped.mapInArrow(_sort_groups(length), "key long, ctx long, first long, last long").distinct()

    places = mixed.join(runs, ["key", "ctx"]).select("rid", (F.shiftright("loc", 20) + F.col("first")).alias("s"), (F.shiftright("loc", 20) + F.col("last")).alias("e"))
    whole = found.filter("not mixed").select("rid", F.shiftright("loc", 20).alias("s"), (F.shiftright("loc", 20) + F.shiftright("loc", 10).bitwiseAND(1023)).alias("e"))
    marks = places.unionByName(whole)
    if hot.limit(1).count():
        marks = marks.unionByName(_hot_marks(mixed, pieces, length))
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("marks"))
    return base.join(marks, "rid", "left").select("doc_id", "text", "marks").mapInArrow(_strip(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _hot_marks(mixed: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """Marks of the keys with very many contexts: ranges of STEP windows, which merge where they are equal and go through suffix
    arrays in groups of their own; ranges that are still too many, window by window, where equal strings are all that is left."""
    level = pieces.filter("n < 0").dropDuplicates(["key", "ctx"]).select(F.col("key").alias("tkey"), F.col("ctx").alias("tctx"), F.lit(0).cast("long").alias("shift"), (-F.col("n")).alias("n"), "loc", "piece")
    hits = None
    for step in (STEP, 1):
        subs = written(level.mapInArrow(_parts(step, length), "tkey long, tctx long, shift long, n long, key long, ctx long, loc long, piece binary"), "op1-hot-parts")
        merged = subs.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.first("loc").alias("loc"), F.first("piece").alias("piece"))
        if step == 1:
            runs = merged.filter("n > 1").select("key", "ctx", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
        else:
            merged = written(merged, "op1-hot-merged")
            big = written(merged.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT).select("key"), "op1-hot-big")
            grouped = merged.join(big, "key", "left_anti").select("key", "ctx", "n", "loc", "piece").repartition(parts(mixed.sparkSession), "key").sortWithinPartitions("key", "ctx")
            runs = grouped.mapInArrow(_sort_groups(length), "key long, ctx long, first long, last long").distinct()
        found = subs.join(runs, ["key", "ctx"]).select("tkey", "tctx", (F.col("shift") + F.col("first")).alias("from"), (F.col("shift") + F.col("last")).alias("to"))
        hits = found if hits is None else hits.unionByName(found)
        if step == 1 or not big.limit(1).count():
            break
        level = subs.join(big, "key", "left_semi").select("tkey", "tctx", "shift", "n", "loc", "piece")
    places = mixed.join(hits.withColumnsRenamed({"tkey": "key", "tctx": "ctx"}), ["key", "ctx"])
    return places.select("rid", (F.shiftright("loc", 20) + F.col("from")).alias("s"), (F.shiftright("loc", 20) + F.col("to")).alias("e"))

"""MinHash near-duplicates through a multi-index Hamming join.

Each document's distinct word shingles give COMPONENTS min-hashes, kept as 16-bit values.  The signature is
split into CHUNKS chunks of CHUNK components.  Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` components have, by pigeonhole, a chunk with at most ERRORS differing components;
each chunk is entered once for every choice of ERRORS components left out, so any such pair meets in a
bucket.  (A pair at exactly the link threshold misses all buckets with probability 4e-10 at 0.85 and 1.1e-7 at
0.80.)  Pairs of a bucket whose signatures differ in more components than such a pair does with probability
TAIL are dropped unconfirmed; together the loss stays below 2e-9 at 0.85 and 1.2e-7 at 0.80.

Documents with equal shingle sets form one class first.  In a bucket the classes are held against the one
nearest to the bucket's majority signature, so a group of n copies gives n candidate pairs, not n squared;
buckets whose members are still in several components after that are opened again, and the pairs across
components are tried inside the task: those within the signature threshold and an upper bound of their
intersection become candidates too.  All candidates are confirmed on full
shingle sets.  Components are found with joins; nothing is collected.

Defined results: null or blank text: empty set, linked with nothing, component its own id; fewer words than
a shingle: the whole sequence is the one shingle; very long texts are taken whole, each a slice of its own; repeated rows: one class; null doc_id: never chosen as a
component's id while another is there; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarrylens.llm._common import BROADCAST_ROWS, SPACE, PrefixHash, Scratch, discard, lower_ascii, mix64, parts, spread_join, text_chunks, whole_row, word_bounds, written
from quarrylens.llm.components import components

WORDS = 5
CHUNK, CHUNKS, ERRORS = 5, 12, 1
COMPONENTS = CHUNK * CHUNKS
TAIL = 1e-9
BLOCK = 1 << 16
OPEN_BLOCK = 2048
HOT_BUCKET = 1 << 15
HUB = 256
#: A text of more bytes goes block by block.
LONG = 1 << 20
_KEPT = [list(c) for c in itertools.combinations(range(CHUNK), CHUNK - ERRORS)]
_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**62, COMPONENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COMPONENTS, dtype=np.uint64)
_SALT = mix64(np.arange(1, CHUNKS * len(_KEPT) + 1, dtype=np.uint64))


def _shingles(word: np.ndarray, at: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the shingles of ``size`` words from the words at ``at`` on."""
    got = np.zeros(len(at), np.uint64)
    padded = np.append(word, np.zeros(words, np.uint64))
    for k in range(words):
        got = np.where(k < size, mix64(got * np.uint64(0x9E3779B97F4A7C15) + padded[at + k] + np.uint64(k + 1)), got)
    return got


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS):
    """Sorted distinct shingle hashes of each document, one after another, and how many each has."""
    if len(offs) == 2 and len(buf) > LONG:
        return _long_set(buf, words)
    starts, ends, counts = word_bounds(buf, offs)
    word = PrefixHash(lower_ascii(buf), 43).of(starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(word)) - np.repeat(first, counts)
    many = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    at = np.flatnonzero(place < many[doc])
    got = _shingles(word, at, np.minimum(counts, words)[doc[at]], words)
    owner = doc[at]
    order = np.lexsort((got, owner))
    got, owner = got[order], owner[order]
    new = np.append(True, (got[1:] != got[:-1]) | (owner[1:] != owner[:-1]))[: len(got)]
    return got[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def _word_hashes(buf: np.ndarray):
    """Hashes of the words of a long text, block by block; a word beyond a block is hashed piece by piece."""
    at = 0
    while at < len(buf):
        end = at + LONG
        if end < len(buf):
            space = _gap(buf, end)
            if space > end + LONG:  # the word around the end is a very long one
                before = np.flatnonzero(SPACE[buf[at:end]])
                begin = at + int(before[-1]) + 1 if len(before) else at
                if begin > at:
                    starts, ends, _ = word_bounds(buf[at:begin], np.array([0, begin - at]))
                    yield PrefixHash(lower_ascii(buf[at:begin]), 43).of(starts, ends)
                yield PrefixHash.whole(lower_ascii(buf[begin:space]), 43)
                at = space
                continue
            end = space
        part = buf[at:end]
        starts, ends, _ = word_bounds(part, np.array([0, len(part)]))
        yield PrefixHash(lower_ascii(part), 43).of(starts, ends)
        at = end


def _gap(buf: np.ndarray, at: int) -> int:
    """The first white space from a place on, or the end."""
    while at < len(buf):
        found = np.flatnonzero(SPACE[buf[at : at + LONG]])
        if len(found):
            return at + int(found[0])
        at += LONG
    return len(buf)


def _long_set(buf: np.ndarray, words: int):
    """shingle_sets of one long text; what is held at a time is a block, and eight bytes a shingle."""
    kept, last = [], np.zeros(0, np.uint64)
    for word in _word_hashes(buf):
        word = np.concatenate([last, word])
        many = len(word) - words + 1
        if many > 0:
            kept.append(np.unique(_shingles(word, np.arange(many), np.full(many, words), words)))
        last = word[-(words - 1) :]
    if not kept and len(last):
        kept.append(_shingles(last, np.zeros(1, np.int64), np.full(1, len(last)), words))
    got = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    return got, np.array([len(got)], np.int64)


def _reduce(op, values, sizes, filled):
    out = np.zeros(len(sizes), np.uint64)
    begins = (np.cumsum(sizes) - sizes)[filled]
    if len(begins):
        out[filled] = op.reduceat(values, begins)
    return out


def set_ids(sets, sizes):
    filled = sizes > 0
    one = _reduce(np.add, mix64(sets), sizes, filled)
    two = _reduce(np.add, mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), sizes, filled)
    return mix64(one + mix64(two + sizes.astype(np.uint64)))


def _signatures(batches):
    for batch in batches:
        ids = batch.column(0)
        for row, buf, offs in text_chunks(batch):
            sets, sizes = shingle_sets(buf, offs)
            filled = sizes > 0
            sig = np.zeros((len(sizes), COMPONENTS), np.uint16)
            for k in range(COMPONENTS):
                sig[:, k] = mix64(_reduce(np.minimum, sets * _MUL[k] + _ADD[k], sizes, filled)) & np.uint64(0xFFFF)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * COMPONENTS), len(sizes), [None, pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(row, len(sizes)), pa.array(sizes), pa.array(set_ids(sets, sizes).view(np.int64)), raw.cast(pa.binary())], names=["doc_id", "n", "cid", "sig"]
            )


def _sig_array(column, width, dtype):
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(-1, width)


def _binary(rows: np.ndarray):
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _buckets(batches):
    """Bucket keys of each class, with a signature of 4 bits a component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _sig_array(batch.column(2), COMPONENTS, np.uint16).astype(np.uint64)
        small = (sig & np.uint64(15)).astype(np.uint8)
        packed = _binary(small[:, ::2] * 16 + small[:, 1::2])
        for c in range(CHUNKS):
            for v, kept in enumerate(_KEPT):
                key = np.zeros(len(sig), np.uint64)
                for k in kept:
                    key = (key << np.uint64(16)) | sig[:, c * CHUNK + k]
                key = mix64(key) ^ _SALT[c * len(_KEPT) + v]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1), packed], names=["key", "cid", "n", "sig"])


def _nibbles(packed):
    rows = _sig_array(packed, COMPONENTS // 2, np.uint8)
    out = np.empty((len(rows), COMPONENTS), np.uint8)
    out[:, ::2], out[:, 1::2] = rows >> 4, rows & 15
    return out


def distance(percent: int) -> int:
    """Components in which a pair at the similarity differs at most, but for a probability below TAIL."""
    p = 1 - percent / 100
    left, d = 1.0 - (1 - p) ** COMPONENTS, 0
    while left >= TAIL and d < COMPONENTS:
        d += 1
        left = sum(math.comb(COMPONENTS, k) * p**k * (1 - p) ** (COMPONENTS - k) for k in range(d + 1, COMPONENTS + 1))
    return d


def _near(sig, n, center_sig, center_n, percent, most):
    close = (sig != center_sig).sum(axis=1) <= most
    return close & (100 * np.minimum(n, center_n) >= percent * np.maximum(n, center_n))


def _groups(batches):
    """Runs of rows with equal first column, joined over batch ends, in blocks of at most BLOCK rows; (rows, same group as before)."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        sizes = np.diff(np.append(cuts, len(key)))
        for b, s in zip(cuts[:-1].tolist(), sizes[:-1].tolist()):
            if s > 1 or key[b] == before:
                yield batch.slice(b, s), key[b] == before
        if len(cuts) > 1:
            before = None
        held = batch.slice(int(cuts[-1]))
        if held.num_rows >= BLOCK:
            yield held, key[-1] == before
            before = key[-1]
            held = held.slice(held.num_rows)
    if held is not None and held.num_rows and (held.num_rows > 1 or held.column(0)[0].as_py() == before):
        yield held, held.column(0)[0].as_py() == before


class _Out:
    def __init__(self):
        self.rows = []
        self.size = 0

    def add(self, *cols):
        self.rows.append(cols)
        self.size += len(cols[1])

    def take(self):
        kind = np.concatenate([np.full(len(r[1]), r[0], np.int32) for r in self.rows])
        cols = [np.concatenate([r[k] for r in self.rows]) for k in range(1, 5)]
        sig = pa.array([s for r in self.rows for s in r[5]], pa.binary())
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols), sig], names=["kind", "key", "a", "b", "n", "sig"])


def _stars(percent):
    """kind 0: candidate pairs (a, b) of a bucket's centre and a member; kind 1: members (a) of a bucket left for the second look."""

    most = distance(percent)

    def run(batches):
        out, center = _Out(), None
        for rows, more in _groups(batches):
            cid = rows.column(1).to_numpy(zero_copy_only=False)
            n = rows.column(2).to_numpy(zero_copy_only=False)
            sig = _nibbles(rows.column(3))
            if more and center is not None:
                c_id, c_n, c_sig = center
            else:
                if len(cid) == 2:
                    at = 0
                else:
                    votes = np.zeros((16, COMPONENTS), np.int64)
                    for v in range(16):
                        votes[v] = (sig == v).sum(axis=0)
                    off = (sig != votes.argmax(axis=0).astype(np.uint8)).sum(axis=1)
                    at = int(np.lexsort((cid, off))[0])
                c_id, c_n, c_sig = center = cid[at], n[at], sig[at]
            hit = _near(sig, n, c_sig, c_n, percent, most) & (cid != c_id)
            if hit.any():
                m = int(hit.sum())
                key = np.full(m, rows.column(0)[0].as_py(), np.int64)
                out.add(0, key, np.minimum(cid[hit], c_id), np.maximum(cid[hit], c_id), n[hit], [b""] * m)
            if len(cid) > 2 or more:
                key = np.full(len(cid), rows.column(0)[0].as_py(), np.int64)
                out.add(1, key, cid, np.full(len(cid), c_id), n, rows.column(3).to_pylist())
            if out.size > 20_000:
                yield out.take()
        if out.size:
            yield out.take()

    return run


def _across(percent):
    """Pairs of a group whose ends lie in different components and that can reach the similarity; pairs with a centre are known already.

    A group holds a block of the bucket's members outside its largest component (``left``) and a block of all its members
    (see `_block_pairs`).  Besides the signature threshold each pair passes an upper bound of its intersection: shingle hashes
    cut to 16 bits, plus the number of shingles that share a cut hash.  Pairs are tried here and only the passing ones leave.
    """

    apart = distance(percent)

    def run(batches):
        for rows, _ in _groups(batches):
            cid, center, n, root, lost = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 5, 7))
            left, minor = (np.asarray(rows.column(k)).astype(bool) for k in (8, 9))
            right = np.flatnonzero(~left)
            if not len(right) or len(right) == len(cid):
                continue
            sig = _nibbles(rows.column(4))
            raw = rows.column(6).to_pylist()
            sizes = np.array([len(r) // 2 for r in raw])
            values = np.frombuffer(b"".join(raw), np.uint16)
            ends = np.cumsum(sizes)
            found = []
            present = np.zeros(1 << 16, bool)
            for i in np.flatnonzero(left).tolist():
                # both ends outside the largest component: the pair is met from either side, and tried from the lesser id
                other = (root[right] != root[i]) & (center[right] != cid[i]) & (cid[right] != center[i]) & (~minor[right] | (cid[right] > cid[i]))
                j = right[other]
                j = j[_near(sig[j], n[j], sig[i], n[i], percent, apart)]
                if not len(j):
                    continue
                own = values[ends[i] - sizes[i] : ends[i]]
                present[own] = True
                at = np.repeat(ends[j] - np.cumsum(sizes[j]), sizes[j]) + np.arange(sizes[j].sum())
                common = np.add.reduceat(present[values[at]], np.cumsum(sizes[j]) - sizes[j], dtype=np.int64)
                present[own] = False
                most = np.minimum(common + np.minimum(lost[j], lost[i]), np.minimum(n[j], n[i]))
                j = j[100 * most >= percent * (n[j] + n[i] - most)]
                if len(j):
                    found.append((np.minimum(cid[j], cid[i]), np.maximum(cid[j], cid[i])))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _open_buckets(placed: DataFrame) -> DataFrame:
    """key, its most frequent root, and numbers of blocks, of the buckets whose members lie in several components."""
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    whole = by_root.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("most"))
    blocks = lambda n: F.ceil(n / OPEN_BLOCK).cast("int")
    return whole.filter(F.col("m") > F.col("most.m")).select("key", F.col("most.root").alias("main"), blocks(F.col("m") - F.col("most.m")).alias("lefts"), blocks(F.col("m")).alias("rights"))


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Open buckets split for many tasks: each block of members outside the largest component meets each block of all members.

    Members of the largest component are copied once for each left block, and only the others once for each right block.
    """
    minor = F.col("root") != F.col("main")
    block = lambda blocks: F.pmod(F.xxhash64("cid", F.lit(5)), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    one = placed.filter(minor).withColumn("l", block("lefts")).withColumn("r", F.explode(every("rights"))).withColumns({"left": F.lit(True), "minor": F.lit(True)})
    two = placed.withColumn("r", block("rights")).withColumn("l", F.explode(every("lefts"))).withColumns({"left": F.lit(False), "minor": minor})
    return one.unionByName(two).withColumn("key", F.xxhash64("key", "l", "r")).drop("l", "r", "main", "lefts", "rights")


def _cut_sets(batches):
    """cid, its distinct shingle hashes cut to 16 bits, and how many shingles that merges."""
    for batch in batches:
        for row, buf, offs in text_chunks(batch):
            sets, sizes = shingle_sets(buf, offs)
            cid = set_ids(sets, sizes).view(np.int64)
            ends = np.cumsum(sizes)
            cut = (mix64(sets) & np.uint64(0xFFFF)).astype(np.uint16)
            small = [np.unique(cut[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())]
            lost = sizes - np.array([len(x) for x in small], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array([x.tobytes() for x in small], pa.binary()), pa.array(lost)], names=["cid", "cut", "lost"])


def _full_sets(batches):
    for batch in batches:
        for row, buf, offs in text_chunks(batch):
            sets, sizes = shingle_sets(buf, offs)
            cid = set_ids(sets, sizes).view(np.int64)
            values = pa.array(sets.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(cid), lists], names=["cid", "shingles"])


def _sets_of(ends: DataFrame, classes: DataFrame, docs: DataFrame, make, schema: str) -> DataFrame:
    """One row for each class in ends(cid), made from the whole text of one of its documents."""
    need = written(ends.distinct().join(classes, "cid").select(F.col("doc").alias("doc_id"), "cid"), "op7-need")
    small = need.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    wanted = need.select("doc_id").distinct()
    texts = docs.join(hint(wanted), docs.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text")
    return texts.mapInArrow(make, schema).join(hint(need.select("cid")), "cid", "left_semi").dropDuplicates(["cid"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full shingle sets reach the similarity.

    A class with more than HUB pairs has copies of its set, over which its pairs are dealt.
    """
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))
    sets = _sets_of(ends, classes, docs, _full_sets, "cid long, shingles array<long>")
    hubs = ends.groupBy("cid").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts")).filter("salts > 1")
    hubs = written(hubs, "op7-hubs")
    many = hubs.count()
    if many:
        for end, far in (("a", "b"), ("b", "a")):
            pairs = spread_join(pairs, hubs.select(F.col("cid").alias(end), "salts"), [end], "left", many)
            pairs = pairs.withColumn(f"s{end}", F.coalesce(F.pmod(F.xxhash64(far, F.lit(3)), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        copies = spread_join(sets, hubs, ["cid"], "left", many)
        sets = copies.withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    else:
        pairs = pairs.withColumns({"sa": F.lit(0), "sb": F.lit(0)})
        sets = sets.withColumn("s", F.lit(0))
    left = sets.select(F.col("cid").alias("a"), F.col("s").alias("sa"), F.col("shingles").alias("one"))
    right = sets.select(F.col("cid").alias("b"), F.col("s").alias("sb"), F.col("shingles").alias("two"))
    both = F.size(F.array_intersect("one", "two"))
    full = F.size("one") + F.size("two") - both
    return pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"]).filter(100 * both >= percent * full).select("a", "b")


_MET = "kind int, key long, a long, b long, n long, sig binary"


def _met(classes: DataFrame, percent: int) -> DataFrame:
    """Star pairs and members of all buckets.

    A bucket of more than HOT_BUCKET classes is dealt to several tasks by salt; the centres of its parts then form a star of
    their own, so that parts of one component are joined without a task that holds the bucket.
    """
    n = parts(classes.sparkSession, classes.count() * CHUNKS * len(_KEPT) * (40 + COMPONENTS // 2))
    bucketed = "key long, cid long, n long, sig binary"
    rows = classes.select("cid", "n", "sig").mapInArrow(_buckets, bucketed)
    salts = F.ceil(F.col("m") / HOT_BUCKET).cast("int")
    hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT_BUCKET).select("key", salts.alias("salts")), "op7-hot")
    many = hot.count()
    if not many:
        return written(rows.repartition(n, "key").sortWithinPartitions("key", "cid").mapInArrow(_stars(percent), _MET), "op7-met")
    salted = spread_join(rows, hot, ["key"], "left", many)
    part = F.when(F.col("salts").isNotNull(), F.xxhash64("key", F.pmod(F.xxhash64("cid", F.lit(9)), F.col("salts")))).otherwise(F.col("key"))
    salted = salted.select(part.alias("key"), "cid", "n", "sig")
    first = written(salted.repartition(n, "key").sortWithinPartitions("key", "cid").mapInArrow(_stars(percent), _MET), "op7-met-parts")
    whole = hot.select(F.col("key").alias("whole"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1).cast("array<bigint>")).alias("salt"))
    whole = written(whole.select("whole", F.xxhash64("whole", "salt").alias("key")), "op7-hot-parts")
    named = first.join(whole, "key", "left").select("kind", F.coalesce("whole", "key").alias("key"), "a", "b", "n", "sig", F.col("whole").isNotNull().alias("split"))
    named = written(named, "op7-met-named")
    centres = named.filter("split and kind = 1").select("key", F.col("b").alias("cid")).distinct()
    small = named.filter("kind = 1").select(F.col("a").alias("cid"), "n", "sig").dropDuplicates(["cid"])
    centres = centres.join(small, "cid").select("key", "cid", "n", "sig")
    second = centres.repartition(n, "key").sortWithinPartitions("key", "cid").mapInArrow(_stars(percent), _MET).filter("kind = 0")
    return written(named.drop("split").unionByName(second), "op7-met")


def minhash_near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    return _linked(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _linked(docs: DataFrame, percent: int) -> DataFrame:
    """The same with cid, the id of the row's shingle set, and root, the least of its component (null for an empty set)."""
    with Scratch() as scratch:
        base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        signed = written(base.mapInArrow(_signatures, "doc_id long, n long, cid long, sig binary"), "op7-signed")
        filled = signed.filter("n > 0")
        classes = written(filled.groupBy("cid").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sig").alias("sig")), "op7-classes")
        signed = written(signed.drop("sig"), "op7-named")
        named = written(_named(base, classes, percent), "op7-owned")
        scratch.discard(signed, named)
    out = signed.select("doc_id", "n", "cid").join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "cid", "root")


def _named(base: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cid, component (least doc_id) and root (least cid) of every class."""
    met = _met(classes, percent)
    stars = written(met.filter("kind = 0").select("a", "b").distinct(), "op7-stars")
    links = written(confirm(stars, classes, base, percent), "op7-links")
    roots = components(links, "op7-one")

    members = met.filter("kind = 1").select("key", F.col("a").alias("cid"), F.col("b").alias("center"), "n", "sig")
    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "center", "n", "sig", F.coalesce("root", "cid").alias("root"))
    placed = written(placed, "op7-placed")
    discard(met)
    opened = written(_open_buckets(placed), "op7-opened")
    open_rows = written(spread_join(placed, opened, ["key"]), "op7-open")
    discard(placed)
    cuts = _sets_of(open_rows.select("cid"), classes, base, _cut_sets, "cid long, cut binary, lost long")
    tried = _block_pairs(open_rows.join(cuts, "cid")).select("key", "cid", "center", "n", "sig", "root", "cut", "lost", "left", "minor")
    tried = tried.repartition("key").sortWithinPartitions("key", "cid")
    more = written(tried.mapInArrow(_across(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti"), "op7-across")
    discard(open_rows)
    if more.limit(1).count():
        added = written(confirm(more, classes, base, percent), "op7-added")
        if added.limit(1).count():
            tops = roots.withColumnRenamed("root", "top")
            lifted = (
                added.join(tops.withColumnRenamed("node", "a").withColumnRenamed("top", "ta"), "a", "left")
                .join(tops.withColumnRenamed("node", "b").withColumnRenamed("top", "tb"), "b", "left")
                .select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")).distinct()
            )
            above = components(lifted, "op7-two").select(F.col("node").alias("mid"), F.col("root").alias("top"))
            ends = added.select(F.col("a").alias("node")).unionByName(added.select(F.col("b").alias("node"))).distinct()
            known = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
            roots = known.join(above, known.root == above.mid, "left").select("node", F.coalesce("top", "root").alias("root"))
            roots = written(roots, "op7-roots")
    owned = classes.select("cid", "doc").join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "doc", F.coalesce("root", "cid").alias("root"))
    owned = written(owned, "op7-owned")
    lowest = owned.groupBy("root").agg(F.min("doc").alias("component"))
    return owned.join(lowest, "root").select("cid", "component", "root")


def _with_cid(batches):
    """The rows with the id of their text's shingle set in place of the text."""
    for batch in batches:
        for row, buf, offs in text_chunks(pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1)], names=["text"])):
            cid = set_ids(*shingle_sets(buf, offs)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(c.slice(row, len(cid)) for c in batch.columns[:-1]), pa.array(cid)], names=[*batch.schema.names[:-1], "cid"])


def near_dedup_filter(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that stay: one of each component, of its smallest doc_id.

    Rows without a doc_id cannot be named as a copy's original and all stay.  Rows that share a doc_id are one document
    where their shingle sets are equal, else each stands for itself: those in different components all stay.
    """
    found = _linked(docs, percent).filter("doc_id is not null")
    sets = found.groupBy("doc_id").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
    torn = written(sets.filter("lo <> hi").select("doc_id"), "op7-torn")
    kept = found.filter("kept").select(F.col("doc_id").alias("_keep")).distinct()
    some = torn.limit(1).count() > 0
    if some:
        kept = kept.join(torn, F.col("_keep") == torn.doc_id, "left_anti")
    held = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    out = held.join(kept, F.col("id") == F.col("_keep"), "left_semi").dropDuplicates(["id"]).select("row")
    if some:
        own = found.filter("kept").join(torn, "doc_id", "left_semi")
        own = own.groupBy("doc_id", F.coalesce("root", "cid").alias("root")).agg(F.min("cid").alias("cid")).select(F.col("doc_id").alias("id"), "cid")
        rows = held.join(torn.select(F.col("doc_id").alias("id")), "id", "left_semi").select("row", "id", "text")
        rows = rows.mapInArrow(_with_cid, StructType([*rows.schema.fields[:2], StructField("cid", LongType())]))
        out = out.unionByName(rows.join(own, ["id", "cid"], "left_semi").dropDuplicates(["id", "cid"]).select("row"))
    return out.unionByName(held.filter("id is null").select("row")).select("row.*")

"""Ranked lexical search over documents that recursive graph bisection has put in order.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII of a whole text, only A-Z lower-cased.  A term's weight is
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``, a document's measure ``m = 10 + (90 n N) div L``, and a term that occurs tf times in it adds
``w * ((10**9 tf) div (1000 tf + 8 m))``, once an item.  N counts documents with a term, L their terms with repeats, n those of one document.

Order.  The graph joins documents and terms; a bisection parts documents so that the logarithmic gap cost
``sum over terms of d1 log(n1 / (d1 + 1)) + d2 log(n2 / (d2 + 1))`` falls, by swaps of documents with the greatest gains.  The upper LEVELS are fitted on a
bounded sample of SAMPLE documents; every document of the table then goes down by the cost that its terms add on either side.  A leaf is a shard, or
several by hash, so that a shard holds about SHARD documents and EDGES postings at most.  Inside a shard all its documents are bisected further, down to blocks of
BLOCK documents.  The bisection steers the search only; no result depends on it.

Search.  A cluster's bound for an item is the sum of the greatest addends of the item's terms in it.  Each item visits its shards in falling order of bound, in waves that
grow, and its blocks inside a shard likewise, and stops when no bound left reaches its k-th score.  A bound equal to that score is still visited, as equal
scores go to the lesser doc_id: blocks hold doc_ids, not places.  Scores are exact integers.

Rows: the index holds every document, and of its terms those that an item asks for; statistics cover all terms of all documents.  Items with over VOCABULARY different
terms together are answered in slices, each with an index of its own.  Of documents with the same terms only the k of least doc_id can be results, so only
those are indexed; both that window and all counts work before rows shuffle.

Defined results: a null text has no terms; documents without a term take no part, rows without a doc_id count in N, L and df but are no results; repeated rows are documents each; rows with the same
item_id and the same terms are one item, those with other terms an item of its own; null item_ids are passed on; an item without terms or hits has no rows; an empty table on
either side gives an empty result; texts are read whole, long ones block by block; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import BROADCAST_ROWS, SALTS, discard, spread_join, written

K = 10
VOCABULARY = 500_000
SAMPLE = 8192
MODEL_TERMS = 4096
LEVELS = 8
SHARD = 8192
EDGES = 2_000_000
BLOCK = 64
ROUNDS = 6
QUERIES = 4096
#: Shards of an item in the first wave, and how much larger each further wave is.
FIRST, GROWTH = 2, 8
#: Blocks visited between two looks at the bound.
STRIDE = 4
TEXT_BYTES = 1 << 20
#: Documents whose counts leave a task together.
COUNTED = 512

_TERM, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def term_counts(raw: bytes) -> Counter[bytes]:
    """How often each term occurs; long texts go block by block, cut between terms."""
    counts: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + TEXT_BYTES) if len(raw) - at > TEXT_BYTES else None
        end = gap.start() if gap else len(raw)
        counts.update(_TERM.findall(raw[at:end].lower()))
        at = end
    return counts


def _raw(column):
    for value in column.cast(pa.large_binary()):
        raw = value.as_buffer()
        yield b"" if raw is None else raw.to_pybytes()


def _item_terms(batches):
    for batch in batches:
        terms = [sorted(term_counts(raw)) for raw in _raw(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])


def _count(shared):
    """(doc_id, text) to (doc_id, n, terms, tfs), of the terms in the vocabulary."""

    def run(batches):
        number = shared.value
        for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
            n, terms, tfs = [], [], []
            for raw in _raw(batch.column(1)):
                counts = term_counts(raw)
                known = sorted((number[t], tf) for t, tf in counts.items() if t in number)
                n.append(counts.total())
                terms.append([t for t, _ in known])
                tfs.append([tf for _, tf in known])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), (offs - offs[0]).astype(np.int64)


@dataclass
class Graph:
    """Edges between documents and the most frequent terms, which are numbered anew."""

    doc: np.ndarray
    term: np.ndarray
    docs: int
    known: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, offs: np.ndarray, most: int) -> Graph:
        docs = len(offs) - 1
        known, place, many = np.unique(values, return_inverse=True, return_counts=True)
        doc = np.repeat(np.arange(docs), np.diff(offs))
        common = np.argsort(-many, kind="stable")[:most]
        slot = np.full(len(known), -1)
        slot[common] = np.arange(len(common))
        term = slot[place]
        return cls(doc[term >= 0], term[term >= 0], docs, known[common])


def _cost(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    return d * np.log2(np.maximum(n, 1)[:, None] / (d + 1))


def _degrees(graph: Graph, key: np.ndarray, keys: int) -> tuple[np.ndarray, np.ndarray]:
    terms = len(graph.known)
    d = np.bincount(key[graph.doc] * terms + graph.term, minlength=keys * terms).reshape(keys, terms).astype(np.float64)
    return d, np.bincount(key, minlength=keys).astype(np.float64)


def _halves(node: np.ndarray, by: np.ndarray, nodes: int) -> np.ndarray:
    """The upper half of each node's documents, in the order given."""
    order = np.lexsort((by, node))
    sizes = np.bincount(node, minlength=nodes)
    rank = np.empty(len(node), np.int64)
    rank[order] = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (rank >= (sizes[node] + 1) // 2).astype(np.int64)


def bisect(graph: Graph, node: np.ndarray, nodes: int, rounds: int = ROUNDS) -> np.ndarray:
    """One level of the bisection in all nodes at once: the side, 0 or 1, of each document; sides of a node differ by one document at most."""
    rng = np.random.default_rng(7)
    spread = rng.normal(size=len(graph.known))
    side = _halves(node, np.bincount(graph.doc, spread[graph.term], graph.docs), nodes)
    for _ in range(rounds):
        key = 2 * node + side
        d, n = _degrees(graph, key, 2 * nodes)
        other = np.arange(2 * nodes) ^ 1
        now = _cost(d, n)
        # what the two sides cost less once one edge has moved from the row's side to the other
        gain = now - _cost(np.maximum(d - 1, 0), n) + now[other] - _cost(d[other] + 1, n[other])
        gain = np.bincount(graph.doc, gain[key[graph.doc], graph.term], graph.docs)
        order = np.lexsort((-gain, key))
        sizes = np.bincount(key, minlength=2 * nodes)
        rank = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        best = np.full((2 * nodes, int(sizes.max())), -np.inf)
        who = np.zeros(best.shape, np.int64)
        best[key[order], rank], who[key[order], rank] = gain[order], order
        swap = best[0::2] + best[1::2] > 1e-9
        if not swap.any():
            break
        side[who[0::2][swap]], side[who[1::2][swap]] = 1, 0
    return side


def shard_order(graph: Graph, block: int) -> np.ndarray:
    """Documents in the order of a bisection down to blocks."""
    node, nodes = np.zeros(graph.docs, np.int64), 1
    while graph.docs > block * nodes:
        node = 2 * node + bisect(graph, node, nodes)
        nodes *= 2
    return np.lexsort((np.arange(graph.docs), node))


@dataclass
class Router:
    """A fitted bisection: weight[node, slot] is what a term costs more on the left, cut[node] the sum that goes right; nodes as in a heap."""

    slot: np.ndarray
    weight: np.ndarray
    cut: np.ndarray
    levels: int

    def leaves(self, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
        docs = len(offs) - 1
        at = np.ones(docs, np.int64)
        slot = self.slot[values]
        doc = np.repeat(np.arange(docs), np.diff(offs))[slot >= 0]
        slot = slot[slot >= 0]
        for _ in range(self.levels):
            more = np.bincount(doc, self.weight[at[doc], slot], docs)
            at = 2 * at + (more > self.cut[at])
        return at - (1 << self.levels)


def fit_router(values: np.ndarray, offs: np.ndarray, vocabulary: int, levels: int) -> Router:
    graph = Graph.of(values, offs, MODEL_TERMS)
    slot = np.full(vocabulary, -1)
    slot[graph.known] = np.arange(len(graph.known))
    router = Router(slot, np.zeros((1 << levels, max(1, len(graph.known))), np.float32), np.zeros(1 << levels), levels)
    at = np.ones(graph.docs, np.int64)
    for level in range(levels):
        first = 1 << level
        side = bisect(graph, at - first, first)
        d, n = _degrees(graph, 2 * (at - first) + side, 2 * first)
        added = _cost(d + 1, n) - _cost(d, n)
        router.weight[first : 2 * first] = added[0::2] - added[1::2]
        more = np.bincount(graph.doc, router.weight[at[graph.doc], graph.term], graph.docs)
        # the middle of the node's documents, so that leaves are of like size
        order = np.lexsort((more, at))
        sizes = np.bincount(at - first, minlength=first)
        ends = np.cumsum(sizes)
        some = np.flatnonzero(sizes)
        router.cut[first + some] = more[order[ends[some] - sizes[some] + (sizes[some] - 1) // 2]]
        at = 2 * at + (more > router.cut[at])
    return router


def _route(shared):
    def run(batches):
        for batch in batches:
            values, offs = _lists(batch.column(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaves(values, offs).astype(np.int32))], names=[*batch.schema.names, "leaf"])

    return run


@dataclass
class Statistics:
    documents: int
    terms: int
    weight: np.ndarray

    def measure(self, n: np.ndarray) -> np.ndarray:
        top = 90 * self.documents
        if len(n) and int(n.max()) * top > (1 << 62):
            return np.array([10 + top * int(x) // self.terms for x in n], np.int64)
        return 10 + top * n // self.terms

    def addend(self, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


_BLOCKS = "shard long, block int, ids array<long>, measures array<long>, terms array<int>, ends array<int>, places array<short>, tfs array<int>, tops array<long>"


def _blocks(shared):
    """The documents of one shard as blocks: postings by term, and the greatest addend of each term."""

    def run(table):
        stats = shared.value
        values, offs = _lists(table["terms"])
        tfs, _ = _lists(table["tfs"])
        ids = table["doc_id"].to_numpy()
        m = stats.measure(table["n"].to_numpy())
        order = shard_order(Graph.of(values, offs, MODEL_TERMS), BLOCK)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(ids)), np.diff(offs))
        place = rank[doc]
        sort = np.lexsort((place, values, place // BLOCK))
        place, term, tf = place[sort], values[sort], tfs[sort]
        added = stats.addend(term, tf, m[doc[sort]])
        rows = []
        for b in range(-(-len(order) // BLOCK)):
            lo, hi = np.searchsorted(place // BLOCK, [b, b + 1])
            own = order[b * BLOCK : (b + 1) * BLOCK]
            known, starts = np.unique(term[lo:hi], return_index=True)
            ends = np.append(starts[1:], hi - lo)
            rows.append((ids[own], m[own], known, ends, place[lo:hi] - b * BLOCK, tf[lo:hi], np.maximum.reduceat(added[lo:hi], starts) if len(starts) else []))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int32(), pa.int64())
        cols = [pa.array([np.asarray(v, k.to_pandas_dtype()) for v in c], pa.list_(k)) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        shard = pa.array(np.full(len(rows), table["shard"][0].as_py()), pa.int64())
        return pa.table([shard, pa.array(np.arange(len(rows)), pa.int32()), *cols], names=[f.split()[0] for f in _BLOCKS.split(", ")])

    return run


class Shard:
    """One shard's blocks in memory."""

    def __init__(self, table: pa.Table, stats: Statistics):
        self.stats = stats
        self.ids, offs = _lists(table["ids"])
        self.first = offs[:-1]
        self.measures, _ = _lists(table["measures"])
        terms, cuts = _lists(table["terms"])
        ends, _ = _lists(table["ends"])
        self.places, ranges = _lists(table["places"])
        self.tfs, _ = _lists(table["tfs"])
        tops, _ = _lists(table["tops"])
        block = np.repeat(np.arange(table.num_rows), np.diff(cuts))
        ends = ends + ranges[:-1][block]
        starts = np.append(0, ends[:-1])
        order = np.lexsort((block, terms))
        self.terms, self.block, self.start, self.end, self.top = terms[order], block[order], starts[order], ends[order], tops[order]
        self.blocks = table.num_rows
        self.visited = 0

    def search(self, asked: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """doc_ids and scores of the shard's k best with a score of floor at least, which is above 0."""
        lo, hi = np.searchsorted(self.terms, asked, "left"), np.searchsorted(self.terms, asked, "right")
        entry = _ranges(lo, hi - lo)
        bound = np.zeros(self.blocks, np.int64)
        np.add.at(bound, self.block[entry], self.top[entry])
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, self.blocks, STRIDE):
            visit = order[at : at + STRIDE]
            visit = visit[bound[visit] >= floor]
            if not len(visit):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[visit] = True
            here = entry[chosen[self.block[entry]]]
            many = self.end[here] - self.start[here]
            posting = _ranges(self.start[here], many)
            doc = self.places[posting] + np.repeat(self.first[self.block[here]], many)
            added = self.stats.addend(np.repeat(self.terms[here], many), self.tfs[posting], self.measures[doc])
            sort = np.argsort(doc, kind="stable")
            hit, begin = np.unique(doc[sort], return_index=True)
            score = np.add.reduceat(added[sort], begin)
            good = score >= floor
            ids, scores = np.append(ids, self.ids[hit[good]]), np.append(scores, score[good])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                floor = max(floor, int(scores[-1]))
            self.visited += len(visit)
        return ids, scores


def _ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, many of each, one after the other."""
    return np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)


def _visit(shared, k: int):
    """A shard's blocks and the items sent to it (cogrouped)."""

    def run(left, right):
        asks, ids, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            shard = Shard(left.combine_chunks(), shared.value)
            terms, offs = _lists(right["terms"])
            for r, (ask, floor) in enumerate(zip(right["ask"].to_pylist(), right["floor"].to_pylist(), strict=True)):
                i, s = shard.search(terms[offs[r] : offs[r + 1]], floor, k)
                asks.append(np.full(len(i), ask))
                ids.append(i)
                scores.append(s)
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in (asks, ids, scores)], names=["ask", "doc_id", "score"])

    return run


@dataclass
class Index:
    """blocks, tops (the greatest addend of a term in a shard), statistics, and the number of each term (bytes)."""

    blocks: DataFrame
    tops: DataFrame
    stats: Statistics
    number: dict[bytes, int]


def build_index(docs: DataFrame, vocabulary: list[bytes], k: int = K) -> Index | None:
    """The index of all documents over the given terms; none where no document has a term."""
    spark = docs.sparkSession
    number = {t: x for x, t in enumerate(sorted(vocabulary))}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = spark.sparkContext.broadcast(number)
    counts = written(texts.mapInArrow(_count(words), "doc_id long, n long, terms array<int>, tfs array<int>"), "op12-counts")
    documents, total = counts.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    weight = np.zeros(max(1, len(number)), np.int64)
    df = np.zeros(max(1, len(number)), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # the vocabulary bounds it
        df[r.t] = r.df
        weight[r.t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
    stats = Statistics(documents, total, weight)

    # of documents with the same terms, the k of least doc_id
    same = Window.partitionBy(F.xxhash64("n", "terms", "tfs"), "n", "terms", "tfs").orderBy("doc_id")
    points = counts.filter("doc_id is not null and size(terms) > 0").withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k).drop("r")
    points = written(points, "op12-points")
    discard(counts)
    many = points.count()
    if not many:
        return None
    levels = min(LEVELS, max(0, math.ceil(math.log2(many / SHARD))))
    common = F.lit(np.sort(np.argsort(-df, kind="stable")[:MODEL_TERMS]).astype(np.int32).tolist())
    share = int(min(1.0, 1.2 * SAMPLE / many) * (1 << 20)) + 1
    sample = points.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share).select(F.array_intersect("terms", common).alias("terms")).limit(SAMPLE).toArrow()
    values, offs = _lists(sample["terms"]) if levels and sample.num_rows else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    router = spark.sparkContext.broadcast(fit_router(values, offs, len(weight), levels))
    routed = written(points.mapInArrow(_route(router), "doc_id long, n long, terms array<int>, tfs array<int>, leaf int"), "op12-routed")
    discard(points)
    # one row a leaf
    sizes = routed.groupBy("leaf").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD), F.ceil(F.sum(F.size("terms")) / EDGES)).cast("int").alias("salts"))
    salts = spark.createDataFrame([(r.leaf, r.salts) for r in sizes.collect()], "leaf int, salts int")
    salted = routed.join(F.broadcast(salts), "leaf")
    shard = F.shiftleft(F.col("leaf").cast("long"), 40) + F.pmod(F.xxhash64("doc_id", "n", F.lit(5)), F.col("salts"))
    shards = salted.select("doc_id", "n", "terms", "tfs", shard.alias("shard")).groupBy("shard")
    blocks = written(shards.applyInArrow(_blocks(spark.sparkContext.broadcast(stats)), _BLOCKS), "op12-blocks")
    discard(routed)
    tops = blocks.select("shard", F.explode(F.arrays_zip("terms", "tops")).alias("x")).groupBy("shard", F.col("x.terms").alias("term")).agg(F.max("x.tops").alias("top"))
    return Index(blocks, written(tops, "op12-tops"), stats, number)


def _bounds(index: Index, asks: DataFrame) -> DataFrame:
    """(ask, shard, bound), of the shards that have a term of the item."""
    wanted = asks.select("ask", F.explode("terms").alias("term"))
    if wanted.count() <= BROADCAST_ROWS:
        met = index.tops.join(F.broadcast(wanted), "term")
    else:
        dealt = index.tops.withColumn("_salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
        met = dealt.join(wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "_salt"])
    return met.groupBy("ask", "shard").agg(F.sum("top").alias("bound")).filter("bound > 0")


def search_index(index: Index, asks: DataFrame, k: int = K) -> tuple[DataFrame, list[int]]:
    """(ask, doc_id, score) of the k best for asks(ask, terms as sorted numbers), and how many (item, shard) pairs each wave visited."""
    shared = asks.sparkSession.sparkContext.broadcast(index.stats)
    place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("bound"), "shard"))
    pairs = written(_bounds(index, asks).withColumn("place", place), "op12-pairs")
    many = asks.count()
    best: DataFrame | None = None
    at, size, visited = 0, FIRST, []
    while True:
        wave = pairs.filter((F.col("place") > at) & (F.col("place") <= at + size))
        if best is None:
            wave = wave.withColumn("floor", F.lit(1).cast("long"))
        else:
            floors = best.groupBy("ask").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("ask", F.col("least").alias("floor"))
            wave = spread_join(wave, floors, ["ask"], "left", rows=many).withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).filter("bound >= floor")
        wave = written(wave.select("ask", "shard", "floor"), "op12-wave")
        sent = wave.count()
        if not sent:
            break  # bounds fall with the place, so no later shard can hold a result
        visited.append(sent)
        parts = written(wave.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts")), "op12-parts")
        shards = parts.count()
        left = spread_join(index.blocks, parts, ["shard"], rows=shards).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = spread_join(wave, parts, ["shard"], rows=shards).withColumn("part", F.pmod(F.xxhash64("ask"), F.col("parts")).cast("int")).drop("parts")
        right = spread_join(right, asks.select("ask", "terms"), ["ask"], rows=many)
        hits = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(_visit(shared, k), "ask long, doc_id long, score long")
        hits = hits if best is None else hits.unionByName(best)
        best_first = Window.partitionBy("ask").orderBy(F.desc("score"), "doc_id")
        best = written(hits.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= k).drop("r"), "op12-best")
        at, size = at + size, size * GROWTH
    return best if best is not None else asks.sparkSession.createDataFrame([], "ask long, doc_id long, score long"), visited


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, vocabulary: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    vocabulary = vocabulary or VOCABULARY
    kind = items.schema["item_id"].dataType.simpleString()
    named = items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {kind}, terms array<binary>")
    named = written(named.filter("size(terms) > 0").distinct().withColumn("ask", F.monotonically_increasing_id()), "op12-items")
    different, total = named.select(F.explode("terms").alias("t")).agg(F.count_distinct("t"), F.count("t")).first()
    slices = 1 if different <= vocabulary else -(-2 * total // vocabulary)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for s in range(slices):
        own = named if slices == 1 else named.filter(F.pmod(F.xxhash64("ask"), F.lit(slices)) == s)
        terms = [bytes(r.t) for r in own.select(F.explode("terms").alias("t")).distinct().collect()]
        index = build_index(docs, terms, k) if terms else None
        if index is None:
            continue
        numbers = spark.sparkContext.broadcast(index.number)
        asks = written(own.select("ask", "terms").mapInArrow(_numbered(numbers), "ask long, terms array<int>"), "op12-asks")
        best, _ = search_index(index, asks, k)
        discard(index.blocks, index.tops)
        rank = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "doc_id")).cast("int")
        ranked = spread_join(best.withColumn("rank", rank), own.select("ask", "item_id"), ["ask"])
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score")) if slices > 1 else ranked.select("item_id", "rank", "doc_id", "score")
    return out


def _numbered(shared):
    def run(batches):
        for batch in batches:
            terms = [sorted(shared.value[t] for t in row.as_py()) for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32()))], names=["ask", "terms"])

    return run

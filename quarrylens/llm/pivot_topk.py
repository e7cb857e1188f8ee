"""Exact top-k by inner product over a pivot-distance index.

Components become floor(64 * x).  Each vector v gets one more component sqrt(M - |v|^2), M the greatest
squared norm, so that all lie on a sphere; a query q gets 0 and is stretched onto it by s, so that a higher inner product
is a smaller distance: ``|s q - v|^2 = 2 M - 2 s q.v``.  Each vector is keyed by its nearest pivot and its distance to it.  The annuli of a pivot
are cut into rings of distance, and a ring of many vectors into salts, so a cell holds about CELL vectors, sorted
by distance.  There are more pivots the more vectors there are.

A query first searches one cell of its nearest pivot, which bounds its k-th score.  It then goes to
every ring that can hold a nearer vector by the triangle inequality, and to no other.  Inside a cell it
expands annuli around its own distance to the pivot and stops when the triangle inequality shows that nothing outside can
reach the k-th score.  Queries go to cells in blocks of QUERIES; a cell is copied for each block that it is asked by, so what
moves is in proportion to the vectors and to the (query, cell) pairs that the bounds leave.  Scores are exact
integers; the pivots (k-means on a bounded sample) only steer the search.

Equal vectors are one point of the index with their smallest vec_ids, as many as any result can need, and equal queries
are searched once; a vector that is a third of all rows costs what a single one costs.

Defined results: vectors that are null or hold a null or non-finite component take no part, neither does a
null vec_id; shorter vectors count as padded with zeros, very long ones are taken whole; components whose
floor is beyond 64 bits count as the greatest or least such integer, scores as 2**63 - 1 or its negative; fewer than k candidates: all of them;
ties go to the smaller vec_id; the query's own vec_id is no candidate, in whatever row; a vec_id with several
vectors asks with the least of them; repeated rows are candidates each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import BROADCAST_ROWS, discard, spread_join, written

K = 20
PIVOTS = (16, 2048)
SAMPLE = 4096
CELL = 8192
QUERIES = 4096
RING = 256
#: Rows with a vector and its results are broadcast up to so many.
WIDE_ROWS = 10_000
#: Queries that are routed at once, and numbers of their differences to pivots that are held at once.
ROUTED, HELD = 512, 1 << 21
EXACT = 2.0**52
SLACK = 1e-9
MOST = (1 << 63) - 1


def _matrix(column, width: int) -> np.ndarray:
    """Rows of 64-bit integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _scores(vectors: np.ndarray, floats: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; floats hold them exactly while they are small, else whole numbers do, up to MOST in size."""
    if exact:
        return floats @ q.astype(np.float64)
    return np.array([min(max(sum(map(int.__mul__, v, q.tolist())), -MOST), MOST) for v in vectors.tolist()], object)


def fit_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """k-means centres of a sample of (augmented) vectors; fewer if there are fewer distinct ones."""
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(5)
    centres = distinct[rng.permutation(len(distinct))[: min(count, len(distinct))]]
    for _ in range(8):
        near = ((vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1)).argmin(1)
        for c in range(len(centres)):
            own = vectors[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def _augment(q: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([q.astype(np.float64), np.sqrt(np.maximum(top - norm, 0))[:, None]])


def _stretched(q: np.ndarray, norm: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([q * _stretch(norm, top)[:, None], np.zeros((len(q), 1))])


def _distances(full: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((full**2).sum(1)[:, None] - 2 * full @ pivots.T + (pivots**2).sum(1), 0))


def _stretch(norm, top: float):
    """Factor that brings a query onto the sphere of the augmented vectors; 0 for a query of zeros."""
    return np.sqrt(np.divide(top, norm, out=np.zeros_like(norm), where=norm > 0))


def _reach(stretch, top: float, score):
    """Distance from the stretched query within which a vector of at least that score lies, with room for rounding."""
    return np.sqrt(np.maximum(2 * top - 2 * stretch * score, 0) + 2 * SLACK * top) + 1e-7 * np.sqrt(top) + 1e-6


def _assign(shared, augmented: bool):
    """The nearest pivot and the distance to it, at the end of rows that begin with (id, q, norm)."""

    def run(batches):
        pivots, top, width = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            norm = batch.column(2).to_numpy(zero_copy_only=False)
            full = _matrix(batch.column(1), width)
            full = _augment(full, norm, top) if augmented else _stretched(full, norm, top)
            pivot = _distances(full, pivots).argmin(1)
            # exact distance to the chosen one, as the matrix form cancels
            own = np.sqrt(((full - pivots[pivot]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(own)], names=[*batch.schema.names, "pivot", "dist"])

    return run


def _route(shared, spans):
    """For queries (asked, q, norm, bound): the pivots that can still hold something, the query's distance to each, and its reach."""

    def run(batches):
        pivots, top, width = shared.value
        alive, lo, hi = spans
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTED):
                yield from _routed(batch.slice(at, ROUTED), pivots, top, width, alive, lo, hi)

    return run


def _routed(batch: pa.RecordBatch, pivots: np.ndarray, top: float, width: int, alive: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """The rows of _route, one batch for each block of (query, pivot) pairs, so that what is held does not grow with the pivots."""
    norm = batch.column(2).to_numpy(zero_copy_only=False)
    bound = batch.column(3).to_numpy(zero_copy_only=False)
    full = _stretched(_matrix(batch.column(1), width), norm, top)
    dist = _distances(full, pivots[alive])
    bound = bound - SLACK * np.abs(bound) - 1  # of scores beyond the exact doubles
    reach = np.where(np.isnan(bound), np.inf, _reach(_stretch(norm, top), top, np.where(np.isnan(bound), 0, bound)))
    room = reach[:, None] + 1e-6 * np.sqrt(top)  # of the matrix form
    rows, cols = np.nonzero((lo <= dist + room) & (hi >= dist - room))
    step = max(1, HELD // (width + 1))
    for begin in range(0, len(rows), step):
        row, col = rows[begin : begin + step], cols[begin : begin + step]
        exact = np.sqrt(((full[row] - pivots[alive[col]]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(alive[col]), pa.array(exact), pa.array(reach[row])], names=["asked", "pivot", "dist", "reach"])


def _search(shared, k: int):
    """One cell's vectors and a block of the queries sent to it (cogrouped): the points of each query that reach its k-th score."""

    def run(left, right):
        _, top, width = shared.value
        left, right = left.combine_chunks(), right.combine_chunks()
        none = pa.table({"asked": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return none
        dist = left["dist"].to_numpy()
        order = np.lexsort((left["point"].to_numpy(), dist))
        dist, ids, many = dist[order], left["point"].to_numpy()[order], left["many"].to_numpy()[order]
        vectors = _matrix(left["q"], width)[order]
        floats = vectors.astype(np.float64)
        q = _matrix(right["q"], width)
        asked, qnorm, bound, qdist = (right[c].to_numpy(zero_copy_only=False) for c in ("asked", "norm", "bound", "dist"))
        out = []
        for r in range(len(asked)):
            stretch = _stretch(qnorm[r : r + 1], top)[0]
            exact = math.sqrt(qnorm[r]) * math.sqrt(top) < EXACT
            score = lambda a, b: _scores(vectors[a:b], floats[a:b], q[r], exact)  # noqa: B023, E731
            floor = -math.inf if np.isnan(bound[r]) else bound[r] if exact else bound[r] - 1e-9 * abs(bound[r]) - 1
            mid = int(np.searchsorted(dist, qdist[r]))
            lo, hi = max(0, mid - RING), min(len(dist), mid + RING)
            got, ring = score(lo, hi), RING
            while True:
                best = np.argsort(-got, kind="stable")
                enough = np.searchsorted(np.cumsum(many[lo:hi][best]), k)  # equal vectors count as often as they occur
                if enough < len(best):
                    floor = max(floor, got[best[enough]])
                if floor > -math.inf:
                    reach = _reach(stretch, top, float(floor))
                    to_lo, to_hi = int(np.searchsorted(dist, qdist[r] - reach)), int(np.searchsorted(dist, qdist[r] + reach, side="right"))
                else:
                    to_lo, to_hi = 0, len(dist)
                if to_lo >= lo and to_hi <= hi:
                    break
                ring *= 4
                new_lo = max(to_lo, lo - ring, 0) if to_lo < lo else lo
                new_hi = min(to_hi, hi + ring) if to_hi > hi else hi
                got = np.concatenate([score(new_lo, lo), got, score(hi, new_hi)])
                lo, hi = new_lo, new_hi
            good = np.flatnonzero(got >= floor)
            out.append((np.full(len(good), asked[r]), ids[lo:hi][good], got[good].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"asked": pa.array(cols[0], pa.int64()), "point": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    return run


def _norm(q: F.Column) -> F.Column:
    return F.aggregate(q, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def _quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q and squared norm of the vectors that take part."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null and e is not null")
    kept = kept.filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    q = kept.select("vec_id", F.transform("e", lambda x: F.floor(x * 64)).alias("q"))
    return q.withColumn("norm", _norm(F.col("q")))


def _points(quantised: DataFrame, k: int, most: int) -> DataFrame:
    """Equal vectors as one point: its number, q, norm, the least vec_ids that a result can need, and how many those are.

    A query passes over the rows of its own vec_id, ``most`` at most, and then takes k.  Both windows keep the first rows of a group
    before they shuffle, so a vector of a third of all rows never meets in one task.
    """
    rows = quantised.withColumn("point", F.xxhash64("q"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("point", "q", "vec_id").orderBy("norm"))).filter(F.col("r") <= k)
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("point", "q").orderBy("vec_id"))).filter(F.col("r") <= k + most)
    held = rows.groupBy("point", "q").agg(F.first("norm").alias("norm"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return _apart(written(held.select("point", "q", "norm", "ids", F.size("ids").alias("many")), "op3-points"), "point")


def _apart(rows: DataFrame, number: str) -> DataFrame:
    """Different vectors whose hashes are equal get numbers of their own."""
    shared = rows.groupBy(number).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(number)
    if not shared.limit(1).count():
        return rows
    place = F.row_number().over(Window.partitionBy(number).orderBy("q"))
    moved = rows.join(shared, number, "left_semi").withColumn("_place", place).withColumn(number, F.when(F.col("_place") == 1, F.col(number)).otherwise(F.xxhash64(number, "_place")))
    return written(rows.join(shared, number, "left_anti").unionByName(moved.drop("_place")), "op3-apart")


def pivot_topk(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by ``every``."""
    return _search_all(vectors, every, k)[0]


def _search_all(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The result, and the (query, cell) pairs that were searched."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    quantised = _quantised(vectors)
    own = quantised.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("rows"))
    own = written(own, "op3-queries")
    most = own.agg(F.max("rows")).first()[0]
    if not most:
        return nothing, None
    most = min(int(most), k)
    points = _points(quantised, k, most)
    shape = points.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max(F.size("q")).alias("width")).first()
    top, width, count = float(shape.top), int(shape.width), min(PIVOTS[1], max(PIVOTS[0], math.isqrt(shape.n) // 4))
    share = int(min(1.0, max(SAMPLE, 4 * count) / shape.n) * (1 << 20)) + 1
    sample = points.filter(F.pmod(F.xxhash64("point", F.lit(3)), F.lit(1 << 20)) < share).select("q", "norm").limit(2 * max(SAMPLE, 4 * count)).toArrow()
    if not sample.num_rows:
        sample = points.select("q", "norm").limit(SAMPLE).toArrow()
    pivots = fit_pivots(_augment(_matrix(sample["q"], width), sample["norm"].to_numpy(), top), count)
    shared = spark.sparkContext.broadcast((pivots, top, width))

    head = "long, q array<bigint>, norm double"
    assigned = written(points.select("point", "q", "norm", "many").mapInArrow(_assign(shared, True), f"point {head}, many int, pivot int, dist double"), "op3-assigned")
    # one row a pivot: PIVOTS bounds them
    by_pivot = written(assigned.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("rings"), F.min("dist").alias("lo"), F.max("dist").alias("hi")), "op3-pivots")
    spans = np.array(sorted((r.pivot, r.lo, r.hi) for r in by_pivot.collect()))
    spans = (spans[:, 0].astype(np.int32), spans[:, 1], spans[:, 2])
    wide = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    ring = F.least(F.floor((F.col("dist") - F.col("lo")) / wide * F.col("rings")), F.col("rings") - 1).cast("int")
    ringed = assigned.join(F.broadcast(by_pivot), "pivot").withColumn("ring", ring).drop("lo", "hi", "rings")
    rings = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("salts"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    rings = written(rings, "op3-rings")
    many_rings, many_cells = rings.agg(F.count(F.lit(1)), F.sum("salts")).first()
    salts = rings.select("pivot", "ring", "salts")
    cells = spread_join(ringed, salts, ["pivot", "ring"], rows=many_rings).withColumn("salt", F.pmod(F.xxhash64("point", F.lit(1)), F.col("salts")).cast("int")).drop("salts")
    cells = written(cells, "op3-cells")
    discard(assigned)

    # equal queries are asked once
    asked = own.groupBy(F.xxhash64("q").alias("asked"), "q").agg(F.count(F.lit(1)).alias("n"))
    asked = asked.select("asked", "q", _norm(F.col("q")).alias("norm")).mapInArrow(_assign(shared, False), f"asked {head}, pivot int, dist double")
    asked = _apart(written(asked, "op3-asked"), "asked")
    cell = ["pivot", "ring", "salt"]

    def searched(sent: DataFrame) -> DataFrame:
        """sent(asked, pivot, ring, salt, dist, bound): every query against its cells."""
        blocks = sent.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        index = spread_join(cells, blocks, cell, rows=many_cells).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        right = spread_join(sent, blocks, cell, rows=many_cells).withColumn("block", F.pmod(F.xxhash64("asked", F.lit(4)), F.col("blocks")).cast("int")).drop("blocks")
        right = right.join(asked.select("asked", "q", "norm"), "asked")
        return index.groupBy(*cell, "block").cogroup(right.groupBy(*cell, "block")).applyInArrow(_search(shared, k + most), "asked long, point long, score long")

    # the first cell: the ring of the nearest pivot that lies nearest
    gap = F.greatest(F.col("lo") - F.col("dist"), F.col("dist") - F.col("hi"), F.lit(0.0))
    by_rings = rings.groupBy("pivot").agg(F.collect_list(F.struct("ring", "salts", "lo", "hi")).alias("all"))
    first = spread_join(asked.select("asked", "pivot", "dist"), by_rings, ["pivot"], rows=many_rings)
    nearest = first.select("asked", "pivot", "dist", F.explode("all").alias("x")).select("asked", "pivot", "dist", "x.*")
    nearest = nearest.groupBy("asked", "pivot", "dist").agg(F.min_by(F.struct("ring", "salts"), F.struct(gap, "ring")).alias("x"))
    nearest = nearest.select("asked", "pivot", "dist", "x.ring", F.pmod(F.xxhash64("asked", F.lit(2)), F.col("x.salts")).cast("int").alias("salt"), F.lit(float("nan")).alias("bound"))
    nearest = written(nearest, "op3-first")
    found = written(searched(nearest), "op3-found-first")
    # the score that k + most rows reach in the first cell
    counted = found.join(points.select("point", "many"), "point")
    upto = F.sum("many").over(Window.partitionBy("asked").orderBy(F.desc("score"), "point"))
    bounds = counted.withColumn("upto", upto).filter(F.col("upto") >= k + most).groupBy("asked").agg(F.max("score").cast("double").alias("bound"))
    bounded = written(asked.select("asked", "q", "norm").join(bounds, "asked", "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan")))), "op3-bounds")

    routed = bounded.mapInArrow(_route(shared, spans), "asked long, pivot int, dist double, reach double")
    sent = routed.join(F.broadcast(rings) if many_rings <= BROADCAST_ROWS else rings, "pivot").filter((F.col("lo") <= F.col("dist") + F.col("reach")) & (F.col("hi") >= F.col("dist") - F.col("reach")))
    sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("asked", *cell, "dist")
    sent = sent.join(nearest.select("asked", *cell), ["asked", *cell], "left_anti").join(bounded.select("asked", "bound"), "asked")
    sent = written(sent, "op3-sent")
    hits = found.unionByName(searched(sent)).join(points.select("point", "ids"), "point")

    # the best rows of each query vector, enough for every query that has it, as one row
    ranked = hits.select("asked", "score", F.explode("ids").alias("vec_id"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + most)
    best = ranked.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("best"))
    best = asked.select("asked", "q").join(best, "asked").withColumn("hash", F.xxhash64("q"))
    out = spread_join(own.withColumn("hash", F.xxhash64("q")), best, ["hash", "q"], rows=asked.count(), most=WIDE_ROWS)
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"), sent

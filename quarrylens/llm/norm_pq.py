"""Product quantisation of vectors; the nearest codebook entry is found by annular norm pruning.

Components become floor(scale * x); a vector is cut into PARTS equal consecutive parts, and each part position has a codebook of up to
CODES entries of whole numbers.  They start as the parts of the rows of least vec_id; each round assigns every part of the table to its nearest entry
and moves each entry to the floor of the mean of its parts.  All sums are whole numbers and added up by Spark, so reruns and other partitionings give
the same codebooks.  What a task sends is a sum for each entry; what the driver holds is the codebooks, of a size fixed by parameters and the width.

Search: a codebook is sorted by norm.  By the triangle inequality an entry c can be as near as the best distance d so far only
if its norm lies in [|x| - d, |x| + d].  A part begins with the entries around its own norm; binary search then gives the interval that d
allows, which is evaluated outward, with d shrinking, until everything in it (bounds included, as equal distances go to the lower index) is evaluated exactly.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; shorter vectors, and widths that are no
multiple of PARTS, count as padded with zeros; vectors without components are all zeros; components beyond 64 bits count as the greatest or least such integer and are
computed with whole numbers of any size, errors beyond 64 bits as 2**63 - 1; a null vec_id is kept, and comes last when entries are chosen; of rows that share a
vec_id the lesser vector comes first; repeated rows count as rows each; fewer than CODES rows: as many entries; an empty table: an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import BROADCAST_ROWS, SALTS, written

SCALE = 1024
PARTS = 4
CODES = 256
ROUNDS = 4
#: Entries looked at on either side of a part's norm before the first bound.
FIRST = 8
#: Numbers held at once while pairs are evaluated.
BLOCK = 1 << 20
MOST = (1 << 63) - 1
#: Squared distances below it, times CODES, fit into 64 bits.
SMALL = 1 << 54


@dataclass
class Codebooks:
    """entries[part]: one row an entry, whole numbers."""

    entries: list[list[list[int]]]
    width: int

    @property
    def part(self) -> int:
        return -(-self.width // PARTS)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


class NormIndex:
    """A codebook sorted by norm."""

    def __init__(self, entries: list[list[int]], part: int):
        rows = np.array(entries, object).reshape(len(entries), part)
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        self.place = np.argsort(norms, kind="stable")
        self.norms = norms[self.place]
        self.whole = rows[self.place]
        self.most = int(np.abs(self.whole).max()) if rows.size else 0
        self.small = self.whole.astype(np.int64) if self.most <= MOST else None
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of x (64-bit integers), and the squared distance; ties go to the lower index."""
        size = max(self.most, int(x.max()), -int(x.min())) if x.size else 0
        fits = 4 * size * size * max(1, x.shape[1]) < SMALL
        rows, entries = (x, self.small) if fits else (x.astype(object), self.whole)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at = np.searchsorted(self.norms, norm)
        lo, hi = np.maximum(at - FIRST, 0), np.minimum(at + FIRST, len(entries))
        best = np.full(len(x), -1, np.int64 if fits else object)
        self._evaluate(rows, entries, np.arange(len(x)), lo, hi, best)
        step = 2 * FIRST
        while True:
            reach = np.sqrt((best // CODES).astype(np.float64))
            reach += 1e-9 * (reach + norm) + 1e-6  # room for rounding, so that the bounds themselves are within
            to_lo = np.minimum(np.searchsorted(self.norms, norm - reach, "left"), lo)
            to_hi = np.maximum(np.searchsorted(self.norms, norm + reach, "right"), hi)
            open_rows = np.flatnonzero((to_lo < lo) | (to_hi > hi))
            if not len(open_rows):
                return (best % CODES).astype(np.int64), best // CODES
            new_lo, new_hi = np.maximum(to_lo, lo - step)[open_rows], np.minimum(to_hi, hi + step)[open_rows]
            self._evaluate(rows, entries, open_rows, new_lo, lo[open_rows], best)
            self._evaluate(rows, entries, open_rows, hi[open_rows], new_hi, best)
            lo[open_rows], hi[open_rows] = new_lo, new_hi
            step *= 2

    def _evaluate(self, rows, entries, which, lo, hi, best) -> None:
        """Lower best[which], which is distance * CODES + index, by the entries lo to hi of each row."""
        some = hi > lo
        which, lo, many = which[some], lo[some], (hi - lo)[some]
        ends = np.cumsum(many)
        begin = 0
        while begin < len(which):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK // max(1, rows.shape[1]), "right")))
            n = many[begin:end]
            starts = np.cumsum(n) - n
            entry = np.arange(n.sum()) + np.repeat(lo[begin:end] - starts, n)
            apart = rows[np.repeat(which[begin:end], n)] - entries[entry]
            keys = (apart * apart).sum(1) * CODES + self.place[entry]
            least = np.minimum.reduceat(keys, starts)
            old = best[which[begin:end]]
            best[which[begin:end]] = np.where(old < 0, least, np.minimum(old, least))
            self.evaluated += len(entry)
            begin = end


def _matrix(column, width: int) -> np.ndarray:
    """Rows of 64-bit integers, padded with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _indexes(books: Codebooks) -> list[NormIndex]:
    return [NormIndex(entries, books.part) for entries in books.entries]


_SUMS = "part int, entry int, n long, high array<long>, low array<long>"


def _sums(shared):
    """For each part and entry of a task's rows: how many parts, and their sums, the upper and lower 32 bits apart."""

    def run(batches):
        books = shared.value
        part, codes = books.part, len(books.entries[0])
        indexes = _indexes(books)
        n = np.zeros((PARTS, codes), np.int64)
        high, low = np.zeros((PARTS, codes, part), np.int64), np.zeros((PARTS, codes, part), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), PARTS * part)
            for p, index in enumerate(indexes):
                own = x[:, p * part : (p + 1) * part]
                code, _ = index.nearest(own)
                order = np.argsort(code, kind="stable")
                used, starts = np.unique(code[order], return_index=True)
                n[p] += np.bincount(code, minlength=codes)
                high[p, used] += np.add.reduceat(own[order] >> 32, starts, axis=0)
                low[p, used] += np.add.reduceat(own[order] & 0xFFFFFFFF, starts, axis=0)
        at = np.argwhere(n)
        if len(at):
            p, e = at[:, 0], at[:, 1]
            lists = [pa.array(list(s[p, e]), pa.list_(pa.int64())) for s in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), *lists], names=["part", "entry", "n", "high", "low"])

    return run


def _codes(shared):
    """Rows that end with q: code and error in its place."""

    def run(batches):
        books = shared.value
        part, indexes = books.part, _indexes(books)
        for batch in batches:
            x = _matrix(batch.column(batch.num_columns - 1), PARTS * part)
            found = [index.nearest(x[:, p * part : (p + 1) * part]) for p, index in enumerate(indexes)]
            error = sum(d.astype(object) for _, d in found) if batch.num_rows else []
            text = ["".join(f"{c:02x}" for c in codes) for codes in zip(*(c.tolist() for c, _ in found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array([min(e, MOST) for e in error], pa.int64())], names=[*batch.schema.names[:-1], "code", "error"])

    return run


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and q, the whole-number components, of the rows that take part."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e")).filter("e is not null")
    kept = kept.filter(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return kept.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("q"))


def fit_codebooks(whole: DataFrame, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after the given rounds over all rows of a table with vec_id and q; none for an empty table."""
    spark = whole.sparkSession
    width = whole.agg(F.max(F.size("q"))).first()[0]
    if width is None:
        return None
    part = -(-width // PARTS)
    first = [list(r.q) + [0] * (PARTS * part - len(r.q)) for r in whole.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(CODES).collect()]
    books = Codebooks([[q[p * part : (p + 1) * part] for q in first] for p in range(PARTS)], width)
    for _ in range(rounds if part else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = whole.select("q").mapInArrow(_sums(shared), _SUMS).select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "s"))
        added = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c.removeprefix("s.")) for c in ("s.high", "s.low")]
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), *added)
        entries = [[list(e) for e in book] for book in books.entries]
        for r in sums.collect():  # one row a number of the codebooks
            entries[r.part][r.entry][r.place] = ((int(r.high) << 32) + int(r.low)) // r.n
        books = Codebooks(entries, width)
        shared.unpersist()
    return books


def encode_vectors(whole: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The kept columns, code (two hex digits a part) and error (squared distance to what the code stands for) of a table with q."""
    held = whole.select(*keep, "q")
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in held.schema.fields[:-1])
    return held.mapInArrow(_codes(whole.sparkSession.sparkContext.broadcast(books)), head + "code string, error long")


def decode_vectors(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id and embedding, the middle of the cells that the codes stand for."""
    size = len(books.entries[0])
    table = F.lit([[(x + 0.5) / scale for x in e] for book in books.entries for e in book])
    piece = lambda p: F.element_at(table, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * size + 1)
    return coded.select("vec_id", F.slice(F.concat(*(piece(p) for p in range(PARTS))), 1, books.width).alias("embedding"))


def vector_codes(vectors: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256.

    Errors are added up by label before they shuffle; up to ``most`` labels go back by broadcast, more by salts over which the rows of a hot label are dealt.
    """
    whole = written(whole_vectors(vectors), "op11-whole")
    books = fit_codebooks(whole)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(encode_vectors(whole, books, keep=("vec_id", "label")), "op11-coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = written(coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "op11-labels")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= most:
        out = coded.join(F.broadcast(sums), same)
    else:
        dealt = coded.withColumn("_deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = dealt.join(sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_deal") == F.col("_salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

"""Helpers shared by the pipeline operators: shared-folder tables, joins past hot keys, chunked text access."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1024
#: A table of keys is broadcast up to so many rows, which are counted first.
BROADCAST_ROWS = 2_000_000
SALTS = 16
PART_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local master, as in tests; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    path = tempfile.mkdtemp(prefix="quarry-")
    spark.sparkContext.setCheckpointDir(path)
    return path


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open: list[list[DataFrame]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quarry-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    for made in _open:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made.  Nothing that still reads them may run afterwards."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Scratch:
    """Remembers the tables written inside the block; discard() deletes them, once their results are written themselves."""

    def __enter__(self) -> Scratch:
        self.made: list[DataFrame] = []
        _open.append(self.made)
        return self

    def __exit__(self, *_) -> None:
        _open[:] = [made for made in _open if made is not self.made]

    def discard(self, *keep: DataFrame) -> None:
        discard(*(df for df in self.made if all(df is not k for k in keep)))


def parts(spark: SparkSession, size: int = 0) -> int:
    """Shuffle partitions: those of the session, more where ``size`` bytes would not fit into them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // PART_BYTES))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """left with right, a table of one row a key, so that no task holds all of a hot key's rows.

    Up to ``most`` counted rows of right are broadcast; beyond that each goes to SALTS salts, over which left is dealt.
    """
    if (right.count() if rows is None else rows) <= most:
        return left.join(F.broadcast(right), keys, how)
    rest = [F.col(f"`{c}`") for c in left.columns if c not in keys]
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*rest, F.lit(11)), F.lit(SALTS)).cast("int"))
    return dealt.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def named(column: str) -> F.Column:
    """A column of any name."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> F.Column:
    """All columns as one struct, whatever their names; ``select("<struct>.*")`` gives them back."""
    return F.struct(*map(named, docs.columns))


def row_key() -> F.Column:
    """Identity of a document row by content; repeated identical rows share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS):
    """Yield (first row, uint8 bytes, int64 offsets) over slices of at most about ``limit`` bytes and ``rows`` rows.

    Nulls count as empty.  A text longer than the limit makes a slice of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(n, row + rows, max(end, row + 1))
        yield row, buf[offs[row] : offs[end]], (offs[row : end + 1] - offs[row]).astype(np.int64)
        row = end


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * _C1
    x ^= x >> np.uint64(33)
    x *= _C2
    x ^= x >> np.uint64(33)
    return x


class PrefixHash:
    """Hashes of any substring of a byte array from one cumulative sum (mod 2**64)."""

    _pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, buf: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = (int(rng.integers(2**40, 2**62)) * 8 + 5) % (1 << 64)
        n = len(buf) + 1
        have = self._pow.get(seed)
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK_BYTES + 1024)
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
            if size <= 4 * CHUNK_BYTES:
                self._pow[seed] = have
        self.base, self.inv = base, have[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(table[buf] * have[0][: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inv[start])

    @classmethod
    def whole(cls, buf: np.ndarray, seed: int) -> np.ndarray:
        """Of all of a long buffer, piece by piece: the same as of(0, its length)."""
        total = 0
        for at in range(0, len(buf), CHUNK_BYTES):
            piece = cls(buf[at : at + CHUNK_BYTES], seed)
            total = (total + int(piece.sums[-1]) * pow(piece.base, at, 1 << 64)) % (1 << 64)
        return mix64(np.array([total], np.uint64))

    def fixed(self, k: int) -> np.ndarray:
        """Of the k bytes from each position on."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inv[:n]) if n > 0 else np.zeros(0, np.uint64)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offs: np.ndarray):
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+`` and how many words each document has."""
    inside = ~SPACE[buf]
    prev = np.zeros(len(buf), bool)
    prev[1:] = inside[:-1]
    edges = offs[:-1][offs[:-1] < len(buf)]
    prev[edges] = False
    starts = np.flatnonzero(inside & ~prev)
    nxt = np.zeros(len(buf), bool)
    nxt[:-1] = inside[1:]
    last = offs[1:][offs[1:] > 0] - 1
    nxt[last] = False
    ends = np.flatnonzero(inside & ~nxt) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def hashed_grams(codes: np.ndarray, offs: np.ndarray, k: int, dims: int) -> np.ndarray:
    """Counts of hashed k-grams of each document, as a documents x dims matrix; dims is a power of two."""
    docs = len(offs) - 1
    many = np.maximum(np.diff(offs) - k + 1, 0)
    if not many.sum():
        return np.zeros((docs, dims), np.float32)
    gram = np.zeros(len(codes) - k + 1, np.uint32)
    for j in range(k):
        gram = gram * np.uint32(257) + codes[j : len(codes) - k + 1 + j]
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - dims.bit_length() + 1)
    doc = np.repeat(np.arange(docs), many)
    at = np.arange(len(doc)) + np.repeat(offs[:-1] - (np.cumsum(many) - many), many)
    return np.bincount(doc * dims + gram[at], minlength=docs * dims).reshape(docs, dims).astype(np.float32)

"""Usage analytics: tokens returned against the tokens of reading the candidate files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.text import iso_utc, reduction, savings
from quarrylens.sources.facts import Facts


def _since(u: DataFrame, since_ns: int | None) -> DataFrame:
    return u if since_ns is None else u.filter(F.col("ts_unix_ns") >= since_ns)


def _sums() -> list[F.Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("candidate_bytes", "estimated_baseline_tokens", "returned_tokens")]


def _with_savings(df: DataFrame) -> DataFrame:
    b, r = F.col("estimated_baseline_tokens"), F.col("returned_tokens")
    return df.withColumn("saved", savings(b, r)).withColumn("reduction", reduction(b, r))


def totals(t: Facts, since_ns: int | None = None) -> DataFrame:
    """One row, zeros where nothing was recorded."""
    return _with_savings(_since(t.usage, since_ns).agg(F.count(F.lit(1)).alias("invocations"), *_sums()))


def per_command(t: Facts, since_ns: int | None = None) -> DataFrame:
    return _with_savings(_since(t.usage, since_ns).groupBy("command").agg(F.count(F.lit(1)).alias("invocations"), *_sums())).orderBy("command")


def top(t: Facts, by: str = "saved", since_ns: int | None = None, limit: int | None = None) -> DataFrame:
    """Commands by what they saved, or by their reduction."""
    rows = per_command(t, since_ns).orderBy(F.desc("saved" if by == "saved" else "reduction"), "command")
    return rows.limit(limit) if limit is not None else rows


def recent(t: Facts, limit: int = 20) -> DataFrame:
    """The last rows; rows of one instant in the order they were recorded, latest first where that is known."""
    order = [F.desc("ts_unix_ns"), *([F.desc("seq")] if "seq" in t.usage.columns else [])]
    return t.usage.orderBy(*order).limit(limit)


def history(t: Facts, limit: int = 20, since_ns: int | None = None) -> DataFrame:
    """The last rows, of these only those in the window."""
    return _with_savings(_since(recent(t, limit), since_ns)).withColumn("recorded_at", iso_utc("ts_unix_ns"))


def baseline(t: Facts, paths: DataFrame) -> DataFrame:
    """How many of the paths are indexed, and their bytes."""
    f = t.files.join(paths.select("path").distinct(), "path", "left_semi")
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))

"""Incremental maintenance: what changed on disk, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.functions.text import extension


def reconcile(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    """changed, new and deleted paths: disk(path, mtime_ns, size) against the index."""
    d = disk.select("path", F.struct("mtime_ns", "size").alias("now"))
    i = indexed.select("path", F.struct("mtime_ns", "size").alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("was"), "changed").otherwise("unchanged")
    return d.join(i, "path", "full_outer").select("path", state.alias("state"))


def status(disk: DataFrame, indexed: DataFrame) -> DataFrame:
    s = F.col("state")
    return reconcile(disk, indexed).agg(*[F.count_if(s == k).alias(k) for k in ("changed", "new", "deleted")])


def dirty(disk: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Paths to index again: all when forced, else the new and the changed."""
    if force:
        return disk.select("path")
    return reconcile(disk, indexed).filter(F.col("state").isin("new", "changed")).select("path")


def summary(disk: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """indexed, unchanged, removed of an index run."""
    s = F.col("state")
    done = s.isin("new", "changed") | (F.lit(force) & (s == "unchanged"))
    return reconcile(disk, indexed).agg(F.count_if(done).alias("indexed"), F.count_if(~done & (s != "deleted")).alias("unchanged"), F.count_if(s == "deleted").alias("removed"))


def prune(table: DataFrame, gone: DataFrame, column: str = "file_path") -> DataFrame:
    """The table without the rows of these paths."""
    return table.join(gone.select(F.col("path").alias(column)), column, "left_anti").select(*table.columns)


def replace_files(table: DataFrame, paths: DataFrame, fresh: DataFrame, column: str = "file_path") -> DataFrame:
    """The table with the rows of these paths replaced by the fresh ones."""
    return prune(table, paths, column).unionByName(fresh)


def with_language(paths: DataFrame) -> DataFrame:
    """Rows whose last extension (case-sensitive) is known, with the language."""
    known = F.create_map(*[F.lit(x) for pair in sorted(schema.EXTENSIONS.items()) for x in pair])
    return paths.withColumn("language", F.element_at(known, extension("path"))).filter("language is not null")


def under_size_cap(files: DataFrame, most: int = schema.MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.col("size") <= most)


def is_minified(text: F.Column) -> F.Column:
    """Some line is longer than 5000 bytes."""
    return F.exists(F.split(text, "\n"), lambda s: F.octet_length(s) > schema.MAX_LINE_BYTES)


def dedupe_overlaps(symbols: DataFrame, seq: str = "seq") -> DataFrame:
    """Of symbols with one and the same range in a file, the kind of highest priority; the first of equals."""
    rank = F.create_map(*[F.lit(x) for pair in sorted(schema.KIND_PRIORITY.items()) for x in pair])
    best = F.coalesce(F.element_at(rank, F.col("kind")), F.lit(0))
    w = Window.partitionBy("file_path", "start_line", "start_column", "end_line", "end_column").orderBy(best.desc(), seq)
    return symbols.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

"""Architecture overview: modules, public surface, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.functions.text import ascii_lower, basename, parent_dir
from quarrylens.operators.lookup import symbol_counts_by_file
from quarrylens.sources.facts import Facts


def module_stats(t: Facts, limit: int = 30) -> DataFrame:
    """Files, bytes and symbols by directory; the most code first."""
    n = symbol_counts_by_file(t).withColumnRenamed("file_path", "path")
    f = t.files.join(n, "path", "left").select(parent_dir("path").alias("dir"), "size", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("code", F.lit(0)).alias("code"))
    rows = f.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("code").alias("code_symbols"), F.sum("total").alias("symbols"), F.sum("size").alias("bytes"))
    return rows.orderBy(F.desc("code_symbols"), F.desc("symbols"), "dir").limit(limit)


def public_api(t: Facts) -> DataFrame:
    """Public symbols other than data, fields and variables."""
    s = t.symbols.filter((F.col("visibility") == "public") & ~F.col("kind").isin(*schema.PRIVATE_SURFACE_KINDS))
    return s.select("file_path", "name", "kind", "start_line")


def public_api_by_dir(t: Facts, shown: int = 12, limit: int = 20) -> DataFrame:
    """How many public symbols each directory has, and the first of them."""
    s = public_api(t).select(parent_dir("file_path").alias("dir"), F.concat_ws(":", "name", "kind").alias("entry"))
    top = s.groupBy("dir").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "dir").limit(limit)
    first = F.row_number().over(Window.partitionBy("dir").orderBy("entry"))
    kept = s.join(F.broadcast(top), "dir").withColumn("_n", first).filter(F.col("_n") <= shown)  # top has limit rows
    return kept.groupBy("dir", "count").agg(F.sort_array(F.collect_list("entry")).alias("symbols")).orderBy(F.desc("count"), "dir")


def entry_points(t: Facts) -> DataFrame:
    """Functions and methods called main, and bootstrap modules as entries at line 1."""
    main = t.symbols.filter((F.col("name") == "main") & F.col("kind").isin("function", "method")).select("name", "kind", F.col("file_path").alias("path"), F.col("start_line").alias("line"))
    boot = F.lit(False)
    for b in schema.BOOTSTRAP_FILES:  # in a folder any ASCII case counts, at the root the exact name
        boot = boot | F.endswith(ascii_lower("path"), F.lit(f"/{b}")) | (F.col("path") == b)
    files = t.files.filter(boot).select(basename("path").alias("name"), F.lit("entry").alias("kind"), "path", F.lit(1).alias("line")).distinct()
    return main.unionByName(files)

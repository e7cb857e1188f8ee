"""Symbol lookups: substring search, definitions, outlines, source context, counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.functions.text import ascii_lower, contains_ci, fold
from quarrylens.sources.facts import Facts

#: Symbols that are compared pair by pair.
BLOCK = 1024

COLUMNS = ["name", "kind", "file_path", "start_line", "start_column", "end_line", "end_column"]


def symbols(t: Facts, query: str, kind: str | None = None, lang: str | None = None, limit: int = 50) -> DataFrame:
    """Symbols whose name contains the query, ASCII case-insensitive, by folded name, path, line.  limit 0: all."""
    s = t.symbols.filter(contains_ci("name", query))
    if kind is not None:
        s = s.filter(F.col("kind") == kind)
    if lang is not None:
        s = s.join(t.files.filter(F.col("language") == lang).select(F.col("path").alias("file_path")), "file_path", "left_semi")
    s = s.select(*COLUMNS).orderBy(ascii_lower("name"), "file_path", "start_line", "start_column", "name", "kind")
    return s.limit(limit) if limit else s


def definition(t: Facts, name: str, lang: str | None = None, limit: int = 50) -> DataFrame:
    """Definitions of exactly this name.  limit 0: none."""
    s = symbols(t, name, lang=lang, limit=0).filter((F.col("name") == name) & F.col("kind").isin(*schema.DEFINITION_KINDS))
    return s.orderBy("file_path", "start_line", "start_column", "kind").limit(limit)


def near_misses(t: Facts, name: str, most: int = 3) -> DataFrame:
    """Names of definitions that differ from this one in ASCII case only."""
    s = t.symbols.filter((ascii_lower("name") == fold(name)) & (F.col("name") != name) & F.col("kind").isin(*schema.DEFINITION_KINDS))
    return s.select("name").distinct().orderBy("name").limit(most)


def _depths(table: pa.Table) -> pa.Table:
    """Symbols of a file with how many others strictly contain each.

    In order of begin, then of end from the last on, whatever contains a symbol stands before it and ends with it or later.  The ends before a block
    of symbols are kept sorted, so each is counted by binary search; inside a block all pairs are compared.
    """
    at = [table[c].to_numpy().astype(np.int64) for c in ("start_line", "start_column", "end_line", "end_column")]
    begin, end = at[0] << 32 | at[1], at[2] << 32 | at[3]
    order = np.lexsort((-end, begin))
    b, e = begin[order], end[order]
    depth, seen = np.zeros(len(e), np.int32), np.zeros(0, np.int64)
    for k in range(0, len(e), BLOCK):
        own = e[k : k + BLOCK]
        inside = np.tril(own[None, :] >= own[:, None], -1).sum(1)
        depth[k : k + BLOCK] = len(seen) - np.searchsorted(seen, own, "left") + inside
        seen = np.sort(np.concatenate([seen, own]), kind="stable")
    # of equal ranges none contains another
    fresh = np.append(True, (b[1:] != b[:-1]) | (e[1:] != e[:-1]))
    depth -= (np.arange(len(e)) - np.maximum.accumulate(np.where(fresh, np.arange(len(e)), 0))).astype(np.int32)
    back = np.empty(len(e), np.int32)
    back[order] = depth
    return table.append_column("depth", pa.array(back))


def outline(t: Facts, path: str) -> DataFrame:
    """Symbols of a file in order, with their nesting depth: how many of its symbols strictly contain each."""
    s = t.symbols.filter(F.col("file_path") == path).select(*COLUMNS, "visibility")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema.fields)
    return s.groupBy("file_path").applyInArrow(_depths, f"{head}, depth int").orderBy("start_line", "start_column")


def context(t: Facts, name: str, around: int = 5, limit: int = 3) -> DataFrame:
    """Source of each definition with the lines around it.  limit 0: none.

    Shortest path (in bytes) first.  Lines beyond the file's ends are left out.  Only the files of these definitions are read.
    """
    s = t.symbols.filter(F.col("name") == name).orderBy(F.octet_length("file_path"), "file_path", "start_line", "start_column", "kind").limit(limit)
    lines = t.windows(s.select(F.col("file_path").alias("path"), (F.col("start_line") - around).alias("first"), (F.col("end_line") + around).alias("last")))
    near = s.join(lines, (F.col("path") == F.col("file_path")) & F.col("line_no").between(F.col("start_line") - around, F.col("end_line") + around), "left")
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", "text")))), lambda r: r["text"]), "\n")
    return near.groupBy(*COLUMNS).agg(
        part(F.col("line_no") < F.col("start_line")).alias("before"), part(F.col("line_no").between(F.col("start_line"), F.col("end_line"))).alias("body"), part(F.col("line_no") > F.col("end_line")).alias("after")
    )


def counts(t: Facts) -> DataFrame:
    return t.files.agg(F.count(F.lit(1)).alias("files")).crossJoin(t.symbols.agg(F.count(F.lit(1)).alias("symbols")))  # one row each


def files_per_language(t: Facts) -> DataFrame:
    return t.files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def symbol_counts_by_file(t: Facts) -> DataFrame:
    code = F.sum(F.when(F.col("kind").isin(*schema.DATA_KINDS), 0).otherwise(1))
    return t.symbols.groupBy("file_path").agg(F.count(F.lit(1)).alias("total"), code.alias("code"))


def file_stat(t: Facts, path: str) -> DataFrame:
    """The file's row, or none."""
    return t.files.filter(F.col("path") == path).limit(1)

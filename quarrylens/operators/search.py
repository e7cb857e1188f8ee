"""Text search with provenance: structural hits, references, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.tables import cut
from quarrylens.functions.text import shortened
from quarrylens.operators.edges import counted_edges, distinct_edges, with_caller
from quarrylens.operators.lookup import symbols
from quarrylens.sources.facts import Facts

PER_FILE, FILES, SHOWN = 8, 40, 50


def files_shown(limit: int) -> int:
    return min(limit, FILES) if limit else FILES


def matching(t: Facts, pattern: str, files: int, lang: str | None = None) -> DataFrame:
    """path and hits (line, text) of the first files by path that have a line which matches a regular expression, case-sensitive; hits are the first PER_FILE of a file.

    One pass over the texts: a file is left alone once it has its hits, a task keeps the first files by path, and those are merged once.
    """
    none = F.array().cast("array<struct<line:int,text:string>>")
    line = lambda a, x: F.array(F.struct(a["n"].alias("line"), shortened(F.trim(x)).alias("text")))
    more = lambda a, x: F.when((F.size(a["hits"]) < PER_FILE) & x.rlike(pattern), F.concat(a["hits"], line(a, x))).otherwise(a["hits"])
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), more(a, x).alias("hits"))
    hits = F.aggregate(F.split("text", "\n"), F.struct(F.lit(0).alias("n"), none.alias("hits")), step, lambda a: a["hits"])
    # as the row of a generator, so that the filter does not compute it again
    found = t.texts(lang).select("path", F.explode(F.array(hits)).alias("hits")).filter(F.size("hits") > 0)
    return found.orderBy("path").limit(files)


def listed(found: DataFrame) -> DataFrame:
    """path, line, text of what `matching` found."""
    return found.select("path", F.inline("hits"))


def text_hits(t: Facts, pattern: str, lang: str | None = None, limit: int = 50) -> DataFrame:
    """Lines that match a regular expression, case-sensitive: 8 a file at most, in the first 40 files (fewer for a lower limit) by path."""
    return listed(matching(t, pattern, files_shown(limit), lang))


def truncated(t: Facts, pattern: str, limit: int = 50, lang: str | None = None) -> DataFrame:
    """Whether more files match than are shown."""
    return matching(t, pattern, files_shown(limit) + 1, lang).agg((F.count(F.lit(1)) > files_shown(limit)).alias("truncated"))


def search(t: Facts, pattern: str, lang: str | None = None, limit: int = 50, hits: DataFrame | None = None) -> DataFrame:
    """source (structural, reference, textual), path, line, name, kind, text, in that order of sources.

    Structural hits are symbols whose name contains the pattern literally; a text line where a symbol starts is left out, one that
    calls exactly the pattern is a reference.  hits: the text hits, where they are known.
    """
    s = symbols(t, pattern, lang=lang, limit=limit)
    hits = text_hits(t, pattern, lang, limit) if hits is None else hits
    starts = s.select(F.col("file_path").alias("path"), F.col("start_line").alias("line")).distinct()
    sites = with_caller(t, t.calls.filter(F.col("callee_name") == pattern)).select(F.col("caller_file").alias("path"), F.col("site_line").alias("line")).distinct()
    rest = hits.join(starts, ["path", "line"], "left_anti").join(sites.withColumn("_ref", F.lit(True)), ["path", "line"], "left")
    text = rest.select(F.when(F.col("_ref"), "reference").otherwise("textual").alias("source"), "path", "line", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), "text")
    found = s.select(F.lit("structural").alias("source"), F.col("file_path").alias("path"), F.col("start_line").alias("line"), "name", "kind", F.lit(None).cast("string").alias("text"))
    return found.unionByName(text)


def _calls_of(t: Facts, names: DataFrame, near: str) -> DataFrame:
    return t.calls.join(names.select(F.col("name").alias(near)), near, "left_semi")


def callers_groups(t: Facts, names: DataFrame) -> DataFrame:
    """name and its distinct callers, SHOWN at most, in edge order."""
    e = with_caller(t, _calls_of(t, names, "callee_name"))
    ref = F.struct(F.col("caller_file").alias("path"), F.col("caller_line").alias("line"), F.col("caller_name").alias("name"), F.col("caller_kind").alias("kind"))
    order = F.min(F.struct("caller_file", "caller_line", "site_line", "site_column"))
    one = e.groupBy(F.col("callee_name").alias("name"), ref.alias("ref")).agg(order.alias("at"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("at", "ref"))
    kept = one.withColumn("n", n).filter(F.col("n") <= SHOWN)
    return kept.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda s: s["ref"]).alias("internal"))


def _callees(t: Facts, names: DataFrame) -> DataFrame:
    """name, callee, ref (null: external), ambiguous and first place: one row for each distinct callee of a name."""
    e = distinct_edges(t, _calls_of(t, names, "caller_name"))
    ref = F.struct(F.col("callee_file").alias("path"), F.col("callee_line").alias("line"), F.col("callee_name").alias("name"), F.col("callee_kind").alias("kind"))
    at = F.min(F.struct("at.*", "callee_file", "callee_line"))
    known = F.when(F.col("callee_file").isNotNull(), ref)
    return e.groupBy(F.col("caller_name").alias("name"), F.col("callee_name").alias("callee"), known.alias("ref"), "ambiguous").agg(at.alias("at"))


def callees_groups(t: Facts, names: DataFrame) -> DataFrame:
    """name, number of distinct internal callees, of ambiguous names, of their candidates, and of external names."""
    known, sure = F.col("n").isNotNull(), ~F.col("several")
    sums = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    return counted_edges(t, _calls_of(t, names, "caller_name")).groupBy("name").agg(
        sums(known & sure).alias("internal"), F.count_if(known & ~sure).alias("ambiguous_names"), sums(known & ~sure).alias("candidates"), F.count_if("outside").alias("external")
    )


def callees_listed(t: Facts, names: DataFrame, expand: bool = False) -> DataFrame:
    """name; internal: its callees of one definition, SHOWN at most, in edge order; ambiguous: names of several with how many;
    external_count.  expand adds the candidates of ambiguous names and the external names, sorted; else they are empty.

    Candidates of ambiguous names are counted by name; calls meet them only where they are shown.
    """
    calls = _calls_of(t, names, "caller_name")
    g = cut(counted_edges(t, calls), "counted")
    known, sure = F.col("n").isNotNull(), ~F.col("several")
    # a kind other than method is reached by free calls only
    one = g.filter(known & sure).withColumn("kind", F.explode("kinds"))
    first = F.when(F.col("kind") == "method", F.least("at_free", "at_method")).otherwise(F.col("at_free"))
    ref = F.struct(F.col("file").alias("path"), "line", F.col("callee").alias("name"), "kind")
    place = F.row_number().over(Window.partitionBy("name").orderBy("first", "ref"))
    internal = one.select("name", first.alias("first"), ref.alias("ref")).withColumn("n", place).filter(F.col("n") <= SHOWN)
    internal = internal.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ref"))), lambda s: s["ref"]).alias("internal"))
    several = g.filter(known & ~sure).select("name", "callee", "n")
    if expand:
        whole = _callees(t, names).filter(F.col("ref").isNotNull() & F.col("ambiguous")).groupBy("name", "callee")
        several = several.join(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda s: s["ref"]).alias("candidates")), ["name", "callee"])
    else:
        several = several.withColumn("candidates", F.array().cast(f"array<{internal.schema['internal'].dataType.elementType.simpleString()}>"))
    each = several.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("callee").alias("name"), F.col("n").alias("count"), "candidates"))).alias("ambiguous"))
    listed = F.array_sort(F.collect_list("callee")) if expand else F.array().cast("array<string>")
    outside = g.filter("outside").groupBy("name").agg(F.count(F.lit(1)).alias("external_count"), listed.alias("external"))
    out = g.select("name").distinct().join(internal, "name", "left").join(each, "name", "left").join(outside, "name", "left")
    none = lambda column, df: F.coalesce(column, F.array().cast(df.schema[column].dataType)).alias(column)
    return out.select("name", none("internal", internal), none("ambiguous", each), F.coalesce("external_count", F.lit(0)).alias("external_count"), none("external", outside))


def candidate_paths(hits: DataFrame) -> DataFrame:
    return hits.select("path").distinct().orderBy("path")

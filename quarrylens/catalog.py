"""Registered queries of the code-intelligence engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.extract.stage import extract
from quarrylens.functions import text
from quarrylens.functions.tables import cut
from quarrylens.operators import clusters, delta, edges, graph, imports, lookup, overview, search, usage
from quarrylens.plans.oracle import oracle_sql
from quarrylens.sources import nested_code, sample_code, tree
from quarrylens.sources.facts import Derived

SINCE = 1705276800000000000  # 2024-01-15


def _path(t: Derived, doc: int) -> str:
    return t._files.filter(F.col("doc_id") == doc).first().path


def _hunks(t: Derived) -> DataFrame:
    return t._files.filter(F.col("doc_id").isin(1, 2, 3, 5)).select("path", F.lit(1).alias("start"), F.lit(6).alias("end"))


def _disk(t: Derived) -> DataFrame:
    """The tree as it is now: some files changed, some gone."""
    size = F.when(F.col("doc_id") % 5 == 0, F.col("size") + 1).otherwise(F.col("size"))
    return t._files.filter(F.col("doc_id") % 7 != 3).select("path", "mtime_ns", size.alias("size"))


def _indexed(t: Derived) -> DataFrame:
    return t._files.filter(F.col("doc_id") % 11 != 4).select("path", "mtime_ns", "size")


def _first_unique(t: Derived) -> str:
    """The least name that calls of either kind find one definition of."""
    called = t.calls.select("callee_name", "is_method").distinct()
    each = edges.definitions(t).join(called, ["callee_name", "is_method"], "left_semi").groupBy("callee_name").agg(F.max("defs").alias("defs"))
    return each.filter("defs = 1").agg(F.min("callee_name")).first()[0] or ""


def _joined(df: DataFrame, column: str, item=lambda s: s) -> DataFrame:
    """Arrays as comma-joined text."""
    return df.withColumn(column, F.array_join(F.transform(column, item), ","))


def _upsert(t: Derived) -> DataFrame:
    paths = delta.dirty(_disk(t), _indexed(t))
    s = t.symbols.select(*lookup.COLUMNS, "visibility")
    fresh = s.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").withColumn("visibility", F.lit("fresh")).select(*s.columns)
    return delta.replace_files(s, paths, fresh)


def _overlapping(t: Derived) -> DataFrame:
    s = t._symbols.withColumn("start_line", F.lit(0)).withColumn("end_line", (F.col("partkey") % 3).cast("int")).withColumn("end_column", F.lit(0))
    return delta.dedupe_overlaps(s.withColumnRenamed("partkey", "seq")).select("file_path", "name", "kind", "start_line", "end_line", "seq")


_QUERIES: dict[str, Callable[[Derived], DataFrame]] = {
    "hotspots": edges.hotspots,
    "counts": lookup.counts,
    "files_per_language": lookup.files_per_language,
    "symbol_counts_by_file": lookup.symbol_counts_by_file,
    "symbols_substring": lambda t: lookup.symbols(t, "WIDGET"),
    "symbols_substring_kind_lang": lambda t: lookup.symbols(t, "WIDGET", "function", "rust"),
    "definition_exact": lambda t: lookup.definition(t, "red_widget"),
    "definition_near_miss": lambda t: lookup.near_misses(t, "RED_WIDGET"),
    "outline_file": lambda t: lookup.outline(t, _path(t, 0)),
    "context_window": lambda t: lookup.context(t, "red_widget"),
    "callers_of": lambda t: edges.callers(t, "red_widget"),
    "callees_of": lambda t: edges.callees(t, "red_widget"),
    "callers_resolved_only": lambda t: edges.callers(t := t.held(), _first_unique(t), 0, True),
    "callees_resolved_only": lambda t: edges.callees(t, "red_widget", resolved_only=True),
    "resolved_pairs": edges.resolved_pairs,
    "located_edges": edges.located_edges,
    "deadcode": edges.dead_code,
    "deadcode_lang": lambda t: edges.dead_code(t, "rust", 0),
    "public_api": overview.public_api,
    "public_api_by_dir": lambda t: _joined(overview.public_api_by_dir(t), "symbols"),
    "entry_points": overview.entry_points,
    "module_stats": overview.module_stats,
    "deps_of": lambda t: imports.deps(t, _path(t, 1)),
    "rdeps_of": lambda t: imports.rdeps(t, "pkg_"),
    "imports_under": lambda t: imports.imports_under(t, "src1/"),
    "boundary_raw": lambda t: imports.imports_under(t, "src1").join(imports.rdeps(t, "src2"), imports.COLUMNS, "left_semi"),
    "boundary_union": lambda t: imports.boundary(t, "src1", "src2"),
    "boundary_unresolved_count": lambda t: imports.boundary_unresolved(t, "src1"),
    "resolve_imports": imports.resolve,
    "external_import_count": imports.external_count,
    "page_link_deps": lambda t: t.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("module")),
    "import_scc": lambda t: graph.components(imports.file_graph(t)),
    "cycle_nodes": graph.cycle_nodes,
    "call_cycles": lambda t: _joined(graph.call_cycles(t, cap=None), "cycle"),
    "module_levels": lambda t: graph.module_levels(imports.file_graph(t).filter("source < target")),
    "module_is_cyclic": graph.modules,
    "callgraph_down": lambda t: graph.walk(t.held(), "red_widget", cap=None),
    "callgraph_up": lambda t: graph.walk(t.held(), "red_widget", direction="up", cap=None),
    "callgraph_both": lambda t: graph.walk(t.held(), "red_widget", direction="both", cap=None),
    "impact": lambda t: graph.walk(t.held(), "blue_bolt", direction="up", cap=None),
    "changed_symbols": lambda t: graph.changed_symbols(t, _hunks(t)),
    "changed_impact": lambda t: graph.changed_impact(t, _hunks(t), None),
    "edge_weights": clusters.edge_weights,
    "degree_rank": clusters.god_nodes,
    "node_degrees": clusters.degrees,
    "communities": lambda t: _joined(clusters.communities(t), "members"),
    "bridges": clusters.bridges,
    "export_nodes": clusters.export_nodes,
    "export_edges": clusters.export_edges,
    "export_graph": clusters.export_graph,
    "gain_totals": lambda t: usage.totals(t, SINCE),
    "gain_per_command": usage.per_command,
    "gain_top_saved": lambda t: usage.top(t, "saved", SINCE, 3),
    "gain_top_ratio": lambda t: usage.top(t, "ratio", None, 3),
    "gain_recent": lambda t: usage.recent(t).select("ts_unix_ns", "command", "candidate_bytes", "returned_tokens"),
    "gain_history": lambda t: usage.history(t, 50, SINCE).select("ts_unix_ns", "command", "estimated_baseline_tokens", "returned_tokens", "saved", "reduction", "recorded_at"),
    "gain_baseline": lambda t: usage.baseline(t, t.imports.select(F.col("file_path").alias("path"))),
    "text_search": lambda t: search.text_hits(t, "with"),
    "search_provenance": lambda t: search.search(t, "ing"),
    "edge_groups": lambda t: search.callees_groups(t, t.symbols.select("name").distinct()),
    "caller_groups": lambda t: _joined(search.callers_groups(t, t.calls.select(F.col("callee_name").alias("name")).distinct()), "internal", lambda s: F.concat(s["name"], F.lit("@"), s["path"], F.lit(":"), s["line"].cast("string"))),
    "status_delta": lambda t: delta.status(_disk(t), _indexed(t)),
    "index_delta": lambda t: delta.dirty(_disk(t), _indexed(t)),
    "index_summary": lambda t: delta.summary(_disk(t), _indexed(t)),
    "prune": lambda t: delta.prune(t.symbols.select(*lookup.COLUMNS, "visibility"), delta.reconcile(_disk(t), _indexed(t)).filter("state = 'deleted'")),
    "upsert_merge": _upsert,
    "minified_guard": lambda t: t.table("documents").join(t._files.select("doc_id", "path"), "doc_id").select("path", delta.is_minified(F.col("text")).alias("minified")),
    "size_cap": lambda t: delta.under_size_cap(t.files, 2000).select("path"),
    "language_detect": lambda t: delta.with_language(t.files.select("path")),
    "dedupe_overlaps": _overlapping,
}


def _extracted(t: Derived, table: str, texts=sample_code.source_texts) -> DataFrame:
    return extract(texts(t.spark, t.sf_dir), held=False)[table].drop("resolution")


def _deep_keys(t: Derived, texts=sample_code.json_texts) -> DataFrame:
    texts = texts(t.spark, t.sf_dir)
    each = [extract(texts, deep, held=False)["symbols"].select("file_path", "name", "start_line", "start_column", "end_line", "end_column", F.lit(deep).alias("deep")) for deep in (False, True)]
    return each[0].unionByName(each[1])


def _readable(t: Derived) -> DataFrame:
    """One in seven suppliers' files is not UTF-8, another holds a zero byte."""
    key = F.col("s_suppkey")
    tail = F.when(key % 7 == 3, F.unhex(F.lit("FF"))).when(key % 7 == 5, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("C3A9")))
    files = t.table("supplier").select(F.concat(F.lit("s"), key.cast("string")).alias("path"), F.concat(F.encode(F.col("s_name"), "UTF-8"), tail).alias("content"))
    return tree.readable(files).select("path", "text")


def _formats(t: Derived) -> DataFrame:
    e = t.table("events")
    span = F.concat((F.col("user_id") % 90 + 1).cast("string"), F.element_at(F.array(*map(F.lit, "dhms")), (F.col("event_id") % 4 + 1).cast("int")))
    id_ = F.col("event_id").cast("decimal(19,0)")  # the product leaves 64 bits
    n, flag = id_ * id_ * (F.col("user_id") - 3), F.element_at(F.array(F.lit(" True"), F.lit("false "), F.lit("yes")), (F.col("event_id") % 3 + 1).cast("int"))
    word = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "/a.b").otherwise("'s x"))
    out = e.select("event_id", span.alias("span"), n.alias("n"), flag.alias("flag"), word.alias("word"), (F.col("event_id") % 101).cast("double").alias("pct"))
    return out.select(
        "event_id", text.duration_seconds("span").alias("seconds"), text.window_label(text.duration_seconds("span")).alias("label"), text.thousands("n").alias("thousands"), text.abbreviated("n").alias("short"),
        text.meter("pct").alias("meter"), text.shell_quote("word").alias("quoted"), text.setting_flag("flag").alias("flag"),
    )


def _rotated(t: Derived) -> DataFrame:
    o = t.table("orders")
    cycle = F.transform(F.array("o_orderkey", "o_custkey", F.col("o_orderkey") * 7 % 1000), lambda x: F.concat(F.lit("n"), x.cast("string")))
    return o.select("o_orderkey", F.array_join(text.rotate_to_min(F.array_distinct(cycle)), ",").alias("cycle"))


def _replaced(t: Derived, table: str) -> DataFrame:
    """calls or imports after an index run: of new and changed files, rows marked as fresh."""
    paths = cut(delta.dirty(_disk(t), _indexed(t)), "dirty")
    old = getattr(t.held() if table == "calls" else t, table)
    fresh = old.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").withColumn("resolution", F.lit("fresh")).select(*old.columns)
    return delta.replace_files(old, paths, fresh)


def _appended(t: Derived) -> DataFrame:
    new = t.files.select(
        F.col("mtime_ns").alias("ts_unix_ns"), F.lit("outline").alias("command"), F.lit(1).alias("candidate_files"), F.col("size").alias("candidate_bytes"), text.token_estimate("size").alias("estimated_baseline_tokens"),
        F.lit(10).cast("long").alias("returned_tokens"), F.lit("json").alias("output_format"), F.lit(None).cast("string").alias("query"), F.lit(0).cast("long").alias("seq"),
    )
    return t.usage.unionByName(new).groupBy("command").agg(F.count(F.lit(1)).alias("invocations"), F.sum("candidate_bytes").alias("bytes"), F.sum("estimated_baseline_tokens").alias("baseline"))


def _stale(t: Derived) -> DataFrame:
    state = delta.reconcile(_disk(t), t.files.select("path", "mtime_ns", "size")).filter(F.col("state").isin("changed", "deleted"))
    flagged = t.symbols.join(state.select(F.col("path").alias("file_path"), F.lit(True).alias("stale")), "file_path", "left")
    return flagged.select("file_path", "name", "start_line", F.coalesce("stale", F.lit(False)).alias("stale"))


_QUERIES |= {
    "extract_symbols": lambda t: _extracted(t, "symbols"),
    "extract_calls": lambda t: _extracted(t, "calls"),
    "extract_imports": lambda t: _extracted(t, "imports"),
    "extract_deep_keys": _deep_keys,
    "extract_nested_symbols": lambda t: _extracted(t, "symbols", nested_code.nested_texts),
    "extract_nested_calls": lambda t: _extracted(t, "calls", nested_code.nested_texts),
    "extract_data_keys": lambda t: _deep_keys(t, nested_code.data_texts),
    "utf8_filter": _readable,
    "diff_hunks": lambda t: tree.hunks_of(sample_code.diff_texts(t.spark, t.sf_dir)),
    "path_aliases": lambda t: tree.alias_table(sample_code.config_texts(t.spark, t.sf_dir)),
    "usage_formats": _formats,
    "rotate_cycle": _rotated,
    "replace_calls": lambda t: _replaced(t, "calls"),
    "replace_imports": lambda t: _replaced(t, "imports"),
    "append_usage": _appended,
    "stale_symbols": _stale,
    "search_paths": lambda t: search.candidate_paths(search.search(t, "ing")),
    "import_cycles": lambda t: _joined(graph.import_cycles(t), "members"),
    "callees_listed": lambda t: search.callees_listed(t, t.symbols.select("name").distinct()).select(
        "name", F.array_join(F.transform("internal", lambda r: F.concat(r["name"], F.lit("@"), r["path"], F.lit(":"), r["line"].cast("string"))), ",").alias("internal"),
        F.array_join(F.transform("ambiguous", lambda a: F.concat(a["name"], F.lit("="), a["count"].cast("string"))), ",").alias("ambiguous"), "external_count",
    ),
    "entry_points_first": lambda t: overview.entry_points(t).orderBy(F.when(F.col("kind") == "entry", 1).otherwise(0), "path", "line", "name").limit(15),
    "prime_languages": lambda t: lookup.files_per_language(t).orderBy(F.desc("files"), "language").limit(6),
    "louvain_placement": clusters.placement_check,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Derived(spark, sf_dir))) for name, f in _QUERIES.items()}


__all__ = ["oracle_sql", "queries"]

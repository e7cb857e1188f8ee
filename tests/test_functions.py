"""Scalar functions and small operators on literal tables."""

import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.functions import text
from quarrylens.operators import delta, edges, imports, lookup, search, usage
from quarrylens.sources.facts import Snapshot
from quarrylens import schema


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_paths(spark):
    rows = ["a/b/c.rs", "x.py", "a/../b/./c", "../up", "/abs//x", ".json", "a.b/c"]
    got = values(spark, rows, text.basename("v"), text.parent_dir("v"), text.extension("v"), text.normalize_path("v"))
    assert got == [
        ("c.rs", "a/b", "rs", "a/b/c.rs"), ("x.py", ".", "py", "x.py"), ("c", "a/../b/.", "", "b/c"), ("up", "..", "", "up"), ("x", "/abs/", "", "abs/x"), (".json", ".", "", ".json"), ("c", "a.b", "", "a.b/c"),
    ]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab./", max_size=12), min_size=1, max_size=30))
def test_normalize_path_any(spark, paths):
    want = [posixpath.normpath("/" + p.lstrip("/"))[1:].lstrip("/") for p in paths]
    assert [r[0] for r in values(spark, paths, text.normalize_path("v"))] == want


def test_folding_is_ascii_only(spark):
    got = values(spark, ["ÉcOLE", "x%_y", "Snake_Case"], text.ascii_lower("v"), text.contains_ci("v", "%_"), text.contains_ci("v", "É"))
    assert got == [("École", False, True), ("x%_y", True, False), ("snake_case", False, False)]


def test_savings(spark):
    df = spark.createDataFrame([(1000, 100), (100, 166), (0, 92), (1000, 345)], "b long, r long")
    got = [tuple(r) for r in df.select(text.savings("b", "r"), text.reduction("b", "r")).collect()]
    assert got == [(900, 90.0), (0, 0.0), (0, 0.0), (655, 65.5)]


def test_rotation_and_time(spark):
    df = spark.createDataFrame([(["c", "a", "b"],)], "c array<string>")
    assert df.select(text.rotate_to_min("c")).first()[0] == ["a", "b", "c"]
    assert spark.range(1).select(text.iso_utc(F.lit(1_700_000_000_123_456_789))).first()[0] == "2023-11-14T22:13:20Z"


def facts(spark, symbols=(), calls=(), imports_=(), files=(), lines=()):
    sym = [(f, n, k, s, 0, e, 0, v) for f, n, k, s, e, v in symbols]
    call = [(f, a, s, b, line, 0, "syntactic", m) for f, a, s, b, line, m in calls]
    return Snapshot(
        {
            "files": spark.createDataFrame([(p, 0, n, lang) for p, n, lang in files], schema.FILES), "symbols": spark.createDataFrame(sym, schema.SYMBOLS), "calls": spark.createDataFrame(call, schema.CALLS),
            "imports": spark.createDataFrame([(f, m, line, 0, "syntactic") for f, m, line in imports_], schema.IMPORTS), "lines": spark.createDataFrame(lines, "path string, line_no int, text string"),
            "usage": spark.createDataFrame([], schema.USAGE),
        },
        [("@/", "src/", True), ("@core", "core/main", False)],
    )


def test_ambiguous_and_external_edges(spark):
    t = facts(spark, [("a.rs", "main", "function", 1, 2, "unknown"), ("a.rs", "helper", "function", 5, 6, "unknown"), ("b.rs", "helper", "function", 1, 2, "unknown")], [("a.rs", "main", 1, "helper", 2, False), ("a.rs", "main", 1, "external_fn", 3, False)])
    assert [r.caller_name for r in edges.callers(t, "helper").collect()] == ["main", "main"]
    got = edges.callees(t, "main").collect()
    assert len(got) == 3 and sum(r.callee_file is None for r in got) == 1 and sum(r.ambiguous for r in got) == 2
    assert edges.callees(t, "main", resolved_only=True).collect() == []


def test_receivers_macros_and_data_names(spark):
    t = facts(
        spark,
        [("a.ts", "m", "function", 0, 9, "unknown"), ("a.ts", "set", "method", 10, 11, "unknown"), ("a.ts", "real", "method", 12, 13, "unknown"), ("a.ts", "mac", "macro", 5, 6, "unknown"), ("c.yaml", "toolchain", "key", 0, 0, "unknown"), ("b.ts", "free", "function", 0, 1, "unknown")],
        [("a.ts", "m", 0, "set", 1, True), ("a.ts", "m", 0, "real", 2, True), ("a.ts", "m", 0, "mac", 3, False), ("a.ts", "m", 0, "toolchain", 4, False), ("a.ts", "m", 0, "free", 5, True)],
    )
    assert {(r.caller_name, r.callee_name) for r in edges.resolved_pairs(t).collect()} == {("m", "real"), ("m", "mac")}
    assert [(r.name, r.line) for r in edges.hotspots(t).collect()] == [("mac", 5), ("real", 12)]


def test_dead_code_exclusions(spark):
    files = [("foo.test.ts", 1, "typescript"), ("types.d.ts", 1, "typescript"), ("tests/x.ts", 1, "typescript"), ("src/real.ts", 1, "typescript"), ("s.sh", 1, "bash"), ("g.go", 1, "go")]
    symbols = [(p, f"dead{k}", "function", k, k, "unknown") for k, (p, _, _) in enumerate(files)] + [("src/real.ts", "constructor", "method", 9, 9, "unknown"), ("g.go", "Pub", "function", 9, 9, "public"), ("g.go", "main", "function", 8, 8, "private")]
    t = facts(spark, symbols, files=files)
    assert {r.name for r in edges.dead_code(t).collect()} == {"dead3", "dead5"}
    assert {r.name for r in edges.dead_code(t, drop_main=False).collect()} == {"dead3", "dead5", "main"}


def test_outline_depth_and_context(spark):
    spans = [("Outer", 0, 30), ("m1", 2, 6), ("m2", 8, 14), ("inner", 10, 12), ("free", 32, 40)]
    t = facts(spark, [("f.rs", n, "class", s, e, "unknown") for n, s, e in spans], lines=[("f.rs", k, f"l{k}") for k in range(35)])
    assert [(r.name, r.depth) for r in lookup.outline(t, "f.rs").collect()] == [("Outer", 0), ("m1", 1), ("m2", 1), ("inner", 2), ("free", 0)]
    row = lookup.context(t, "free", 3).first()
    assert (row.before, row.body, row.after) == ("l29\nl30\nl31", "l32\nl33\nl34", "")
    assert lookup.context(t, "free", 3, 0).collect() == [] and lookup.definition(t, "free", limit=0).collect() == []


def test_resolver_rules(spark):
    paths = ["src/a.ts", "src/b/index.tsx", "core/main.go", "k/src/lib.rs", "k/src/x/y.rs", "k/src/x/mod.rs", "k/src/z.rs", "src/main.rs"]
    asked = [
        ("src/a.ts", "./b"), ("src/a.ts", "./a"), ("src/a.ts", "@/b"), ("src/a.ts", "@core"), ("src/a.ts", "react"), ("src/a.ts", "../core/main"), ("k/src/lib.rs", "crate::x::y::Item"), ("k/src/x/y.rs", "super::super::z"), ("k/src/x/y.rs", "self::q"),
        ("k/src/z.rs", "crate::x::{A, B}"), ("k/src/z.rs", "std::fmt"), ("k/src/x/mod.rs", "super::z::f"),
    ]
    t = facts(spark, files=[(p, 1, "rust") for p in paths], imports_=[(f, m, k) for k, (f, m) in enumerate(asked)])
    got = {(r.file_path, r.module): r.target for r in imports.resolve(t).collect()}
    assert [got[a] for a in asked] == ["src/b/index.tsx", None, "src/b/index.tsx", "core/main.go", None, "core/main.go", "k/src/x/y.rs", "k/src/z.rs", None, "k/src/x/mod.rs", None, "k/src/z.rs"]


def test_overlaps_and_delta(spark):
    rows = [("f", "a", "function", 0, 0, 1, 1, 0), ("f", "a", "method", 0, 0, 1, 1, 1), ("f", "a", "macro", 0, 0, 1, 1, 2), ("f", "b", "key", 2, 0, 2, 1, 3)]
    df = spark.createDataFrame(rows, "file_path string, name string, kind string, start_line int, start_column int, end_line int, end_column int, seq int")
    assert {(r.name, r.kind) for r in delta.dedupe_overlaps(df).collect()} == {("a", "method"), ("b", "key")}
    disk = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), ("c", 3, 3)], "path string, mtime_ns long, size long")
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 4, 4)], "path string, mtime_ns long, size long")
    assert delta.status(disk, old).first().asDict() == {"changed": 1, "new": 1, "deleted": 1}
    assert delta.summary(disk, old, True).first().asDict() == {"indexed": 3, "unchanged": 0, "removed": 1}


def test_search_sources(spark):
    lines = [("a.rs", 0, "fn target() {}"), ("a.rs", 1, "// target here"), ("b.rs", 2, "  target();"), *[("c.rs", k, "target") for k in range(12)]]
    t = facts(spark, [("a.rs", "target", "function", 0, 0, "unknown"), ("b.rs", "use_it", "function", 1, 3, "unknown")], [("b.rs", "use_it", 1, "target", 2, False)], lines=lines)
    got = search.search(t, "target").collect()
    assert [(r.source, r.path, r.line) for r in got if r.path != "c.rs"] == [("structural", "a.rs", 0), ("textual", "a.rs", 1), ("reference", "b.rs", 2)]
    assert sum(r.path == "c.rs" for r in got) == 8
    assert search.truncated(t, "target", 2).first().truncated and not search.truncated(t, "target").first().truncated


def test_usage_of_nothing(spark):
    t = facts(spark)
    assert usage.totals(t).first().asDict() == {"invocations": 0, "candidate_bytes": 0, "estimated_baseline_tokens": 0, "returned_tokens": 0, "saved": 0, "reduction": 0.0}
    assert usage.per_command(t).collect() == []


def test_abbreviated_near_the_end_of_64_bits(spark):
    df = spark.createDataFrame([(9_223_372_036_854_775_807,), (-3_240_000_050_000_000_000,), (1_125_612_931_650_000_016,), (12_350,), (1_250,), (999,)], "n long")
    want = ["9223372036.9G", "-3240000050.0G", "1125612931.6G", "12.4K", "1.2K", "999"]
    assert [r[0] for r in df.select(text.abbreviated("n")).collect()] == want
    wide = df.withColumn("n", F.col("n").cast("decimal(38,0)") * 1000)
    assert wide.select(text.abbreviated("n"), text.thousands("n")).first()[:] == ("9223372036854.8G", "9,223,372,036,854,775,807,000")

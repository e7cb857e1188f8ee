"""The store's buckets: bounded rewrites, writers at once, removal of what no reader needs; and reads that open only what they show."""

import glob
import os
import random
import threading

import pytest

from quarrylens import store as store_module
from quarrylens.operators import lookup, search
from quarrylens.sources.facts import Derived
from quarrylens.store import Store, buckets_for


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET_FILES", 8)
    root = tmp_path / "repo"
    for k in range(96):
        at = root / f"d{k % 7}" / f"f{k}.rs"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"use crate::m{k};\npub fn f{k}() {{\n    g{k}();\n}}\nfn g{k}() {{}}\n")
    return root


def files(store, version="*"):
    return glob.glob(f"{store.path}/{version}/fact=*/bucket=*/*.parquet")


def names(store):
    return {r.name for r in store.tables()["symbols"].collect()}


def test_a_changed_file_rewrites_its_bucket_only(spark, tree, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.index(str(tree))
    first = store.current()
    assert first["buckets"] == 12 and len(files(store)) == 4 * len(first["at"])
    for k in range(4):
        (tree / "d3" / "f3.rs").write_text(f"fn fresh{k}() {{ g3(); }}\n")
        done = store.index(str(tree))
        assert (done["indexed"], done["unchanged"], done["removed"]) == (1, 95, 0)
        head = store.current()
        assert sum(v[0] == head["version"] for v in head["at"].values()) == 1
        assert len(files(store, head["version"])) <= 4
        # the first version and those of the last two pointers, whatever the number of runs
        assert len(glob.glob(f"{store.path}/v-*")) <= 3 and len(files(store)) <= 4 * len(first["at"]) + 4
        assert f"fresh{k}" in names(store) and f"fresh{k - 1}" not in names(store) and "f95" in names(store)
    t = store.tables()
    assert t["files"].count() == 96 and t["symbols"].count() == 95 * 2 + 1 and t["calls"].count() == 96 and t["imports"].count() == 95
    before = store.current()
    assert store.index(str(tree))["indexed"] == 0 and store.current() == before


def test_files_that_cannot_be_read_make_no_version(spark, tree, tmp_path):
    (tree / "bad.py").write_bytes(b"\xff\xfe")
    store = Store(spark, f"{tmp_path}/store")
    store.index(str(tree))
    before = store.current()
    assert store.index(str(tree))["indexed"] == 1
    assert store.current() == before and len(glob.glob(f"{store.path}/v-*")) == 1


def test_force_deletion_and_growth(spark, tree, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.index(str(tree))
    assert store.index(str(tree), force=True)["indexed"] == 96
    os.remove(tree / "d1" / "f1.rs")
    assert store.index(str(tree))["removed"] == 1 and "f1" not in names(store)
    for k in range(400):
        (tree / f"n{k}.rs").write_text(f"fn n{k}() {{}}\n")
    store.index(str(tree))
    assert store.current()["buckets"] == buckets_for(495) and {"n0", "n399", "f2"} <= names(store)
    assert store.tables()["files"].count() == 495


def test_two_writers_at_once_lose_nothing(spark, tree, tmp_path):
    Store(spark, f"{tmp_path}/store").index(str(tree))
    failed = []

    def work(k):
        try:
            mine = Store(spark, f"{tmp_path}/store")
            for r in range(2):
                (tree / f"d{k}" / f"t{k}_{r}.rs").write_text(f"fn t{k}_{r}() {{}}\n")
                mine.index(str(tree))
                mine.set(f"key{k}", str(r))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    store = Store(spark, f"{tmp_path}/store")
    assert {f"t{k}_{r}" for k in range(3) for r in range(2)} <= names(store) and store.tables()["files"].count() == 102
    assert store.settings() == {f"key{k}": "1" for k in range(3)}
    assert store.index(str(tree))["indexed"] == 0


def test_a_pointer_moves_from_the_one_that_was_read(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert store._write("x.json", {"n": 1}, 0) and not store._write("x.json", {"n": 2}, 0)
    assert store._write("x.json", {"n": 3}, 1) and store._head("x.json") == ({"n": 3}, 2)


def test_vacuum_removes_what_lost_writers_left(spark, tree, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.index(str(tree))
    os.makedirs(f"{store.path}/v-0-lost/fact=file")
    os.utime(f"{store.path}/v-0-lost", (1, 1))
    assert store.vacuum() == 1 and not os.path.exists(f"{store.path}/v-0-lost") and "f1" in names(store)


def test_context_opens_the_files_that_it_shows(spark, tree, tmp_path):
    probe = tmp_path / "probe"
    probe.write_text("x")
    os.utime(probe, (1, 10))
    probe.read_text()
    if os.stat(probe).st_atime == 1:
        pytest.skip("this file system does not keep the time of the last read")
    (tree / "d0" / "f0.rs").write_text("// é\nfn shared() {}\n// after\n" + "// more\n" * 50_000)
    (tree / "d1" / "f1.rs").write_text("fn shared() {\n}")
    store = Store(spark, f"{tmp_path}/store")
    store.index(str(tree))
    every = glob.glob(f"{tree}/*/*.rs")
    for f in every:
        os.utime(f, (1, 10))
    t = store.facts(str(tree))
    rows = {r.file_path: r for r in lookup.context(t, "shared", 1).collect()}
    assert {f for f in every if os.stat(f).st_atime != 1} == {f"{tree}/d0/f0.rs", f"{tree}/d1/f1.rs"}
    assert (rows["d0/f0.rs"].before, rows["d0/f0.rs"].body, rows["d0/f0.rs"].after) == ("// é", "fn shared() {}", "// after")
    assert (rows["d1/f1.rs"].before, rows["d1/f1.rs"].body, rows["d1/f1.rs"].after) == ("", "fn shared() {\n}", "")


def test_windows_equal_lines_of_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    texts = {f"f{k}": "".join(rng.choice(["a", "é", "\n", "\r\n", "", "x" * 300, "\n\n"]) for _ in range(rng.randint(0, 60))) for k in range(30)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spans = [(f"f{rng.randrange(31)}", a := rng.randint(-3, 30), a + rng.randint(0, 20)) for _ in range(60)]
    want = {(p, k, line) for p, a, b in spans if p in texts for k, line in enumerate(texts[p].split("\n")) if a <= k <= b}
    table = spark.createDataFrame(spans, "path string, first int, last int")
    from quarrylens.sources.tree import read_windows

    assert {tuple(r) for r in read_windows(spark, str(tmp_path), table).collect()} == want

    class Held(Derived):
        def texts(self, lang=None):
            return spark.createDataFrame(list(texts.items()), "path string, text string")

    assert {tuple(r) for r in Held(spark, "").windows(table).collect()} == want


def test_text_search_is_one_pass(spark, monkeypatch):
    class Held(Derived):
        def texts(self, lang=None):
            return spark.createDataFrame([(f"p{k:03}", "\n".join(f"  line {j} {'hit' if (k + j) % 3 else ''} " for j in range(20))) for k in range(90)], "path string, text string").repartition(7)

    t = Held(spark, "")
    got = [(r.path, r.line, r.text) for r in search.text_hits(t, r"hit", limit=0).collect()]
    want = [(f"p{k:03}", j, f"line {j} hit") for k in range(40) for j in [j for j in range(20) if (k + j) % 3][:8]]
    assert sorted(got) == want
    plan = search.text_hits(t, "hit")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 1 and "Join" not in plan and "Window" not in plan
    assert search.truncated(t, "hit").first().truncated and not search.truncated(t, "no such line").first().truncated
    assert [r.path for r in search.matching(t, "hit", 3).collect()] == ["p000", "p001", "p002"]


def test_outline_depth_of_a_large_file(spark):
    rng = random.Random(6)
    spans = [(0, 0, 9, 9), (0, 0, 9, 9), (0, 0, 5, 0), (1, 0, 6, 0), (1, 0, 2, 0), (2, 0, 2, 5), (3, 3, 3, 3), (9, 9, 9, 9)] + [(a := rng.randint(0, 40), rng.randint(0, 3), a + rng.randint(0, 20), rng.randint(0, 3)) for _ in range(1500)]
    rows = [("f", f"n{k}", "function", *s, "unknown") for k, s in enumerate(spans)]

    class Held(Derived):
        symbols = spark.createDataFrame(rows, "file_path string, name string, kind string, start_line int, start_column int, end_line int, end_column int, visibility string")

    inside = lambda o, s: o != s and o[:2] <= s[:2] and o[2:] >= s[2:]
    got = {r.name: r.depth for r in lookup.outline(Held(spark, ""), "f").collect()}
    assert got == {f"n{k}": sum(inside(o, s) for o in spans) for k, s in enumerate(spans)}

    import time

    import pyarrow as pa

    n = 100_000  # nested 100 deep
    starts = [k for k in range(n)]
    ends = [k - k % 100 + 200 - k % 100 for k in range(n)]
    table = pa.table({"start_line": pa.array(starts, pa.int32()), "start_column": pa.array([0] * n, pa.int32()), "end_line": pa.array(ends, pa.int32()), "end_column": pa.array([0] * n, pa.int32())})
    began = time.process_time()
    depth = lookup._depths(table)["depth"].to_pylist()
    assert time.process_time() - began < 20 and max(depth) >= 99


def test_usage_files_are_merged(spark, tmp_path, monkeypatch):
    from quarrylens.operators import usage

    monkeypatch.setattr(store_module, "LOOSE", 4)
    monkeypatch.setattr(store_module, "MERGED", 2)
    store = Store(spark, f"{tmp_path}/store")
    for k in range(14):
        store.record("symbols" if k % 2 else "outline", 1, 400 * k, 10, "json", f"q{k}")
        assert store.usage().count() == k + 1
    assert len(glob.glob(f"{store.path}/usage/*.parquet")) <= 8 and len(glob.glob(f"{store.path}/usage-*")) <= 4
    totals = usage.totals(store.facts()).first()
    assert (totals.invocations, totals.candidate_bytes, totals.returned_tokens) == (14, 400 * sum(range(14)), 140)
    assert sorted(r.query for r in store.usage().collect()) == sorted(f"q{k}" for k in range(14))
    number = store._head("usage.json")[1]
    assert store.compact_usage() and store._head("usage.json")[1] == number + 1 and store.usage().count() == 14


def test_spread_walk_equals_the_walk(spark, tmp_path):
    from quarrylens.sources import tree as trees

    rng = random.Random(8)
    rules = ["*.log", "!keep.log", "build/", "/top.rs", "a*/x?.rs", "**/deep/*.md", "#c", "", "!*.md", "src"]
    for _ in range(60):
        at = tmp_path / "/".join(rng.choice(["a", "b", "src", "build", "deep", ".h"]) for _ in range(rng.randint(0, 5)))
        at.mkdir(parents=True, exist_ok=True)
        for name in rng.sample(["x1.rs", "top.rs", "k.log", "keep.log", "n.md", "é.py"], 3):
            (at / name).write_text("x")
        if rng.random() < 0.4:
            (at / rng.choice([".gitignore", ".ignore"])).write_text("\n".join(rng.sample(rules, 3)))
    want = trees.walk(str(tmp_path))
    for most in (0, 1, 5, None):
        assert sorted(tuple(r) for r in trees.tree_files(spark, str(tmp_path), most).collect()) == want


def test_the_program_and_its_exit_codes(spark, tmp_path, capsys):
    import io
    import json

    from quarrylens.__main__ import main

    root = tmp_path / "r"
    (root / "ui").mkdir(parents=True)
    (root / "core").mkdir()
    (root / "ui" / "a.ts").write_text("import { c } from '../core/c';\nexport function a() { c(); }\n")
    (root / "core" / "c.ts").write_text("export function c() {}\n")

    def call(*argv):
        out = io.StringIO()
        code = main(["--repo", str(root), "--store", f"{tmp_path}/s", "--no-record", *argv], spark, out)
        return code, out.getvalue()

    code, text = call("--json", "symbols", "C", "--limit", "0")
    assert code == 0 and [i["name"] for i in json.loads(text)["items"]] == ["c"]
    assert call("--toon", "callers", "c")[1].startswith("count: 1")
    assert call("boundary", "--source", "ui/", "--target", "core/", "--forbid")[0] == 1
    assert call("boundary", "--source", "core/", "--target", "ui/", "--forbid")[0] == 0
    assert call("outline", "../x")[0] == 2 and call("outline", "no.ts")[0] == 2 and call("nonsense")[0] == 2 and call("config", "--key", "nope", "--value", "1")[0] == 2
    assert "error" in capsys.readouterr().err
    assert main(["--repo", str(root), "--store", f"{tmp_path}/s", "--no-record", "--output", f"{tmp_path}/page.html", "export"], spark) == 0
    assert "<canvas" in (tmp_path / "page.html").read_text()

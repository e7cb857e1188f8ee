import os
import subprocess

import pytest

from quarrylens import schema
from quarrylens.operators import edges, imports, lookup, usage
from quarrylens.plans import render
from quarrylens.sources import tree
from quarrylens.store import NewerStore, Store


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "src/main.rs": "use crate::util::helper;\nfn main() {\n  helper();\n  external_thing();\n}\n", "src/util.rs": "pub fn helper() {\n  leaf();\n}\nfn leaf() {}\n", "web/a.ts": "import { b } from './b';\nimport c from '@lib/c';\nexport function a() { b(); }\n",
        "web/b.ts": "export function b() {}\n", "lib/c.ts": "export default function c() {}\n", "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"],}} }', "ignored/x.py": "def x(): pass\n", ".gitignore": "ignored/\n*.log\n",
        ".hidden.py": "def hid(): pass\n", "notes.txt": "no", "min.js": "function f(){}" + "x" * 6000, "big.py": "#" * (2 * 1024 * 1024 + 1),
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe def x")
    return root


def test_lifecycle(spark, repo, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    done = store.index(str(repo))
    assert done["removed"] == 0 and done["unchanged"] == 0
    t = store.facts(str(repo))
    paths = {r.path for r in t.files.collect()}
    assert paths == {"src/main.rs", "src/util.rs", "web/a.ts", "web/b.ts", "lib/c.ts", "tsconfig.json", ".hidden.py", "min.js"}
    assert not t.symbols.filter("file_path = 'min.js'").count()
    assert {(r.caller_name, r.callee_file) for r in edges.callers(t, "helper").collect()} == {("main", "src/util.rs")}
    means = {(r.file_path, r.module): r.target for r in imports.resolve(t).collect()}
    assert means == {("src/main.rs", "crate::util::helper"): "src/util.rs", ("web/a.ts", "./b"): "web/b.ts", ("web/a.ts", "@lib/c"): "lib/c.ts"}
    row = lookup.context(t, "leaf", 1).first()
    assert row.body == "fn leaf() {}" and row.before == "}"

    again = store.index(str(repo))
    assert again["indexed"] == 1 and again["unchanged"] == 8  # the one that is not UTF-8 is tried again
    (repo / "src/util.rs").write_text("pub fn helper() {}\n")
    (repo / "web/new.ts").write_text("function fresh() {}\n")
    os.remove(repo / "lib/c.ts")
    last = store.index(str(repo))
    assert last["indexed"] == 3 and last["removed"] == 1
    names = {r.name for r in store.facts().symbols.collect()}
    assert "fresh" in names and "leaf" not in names and "c" not in names and "main" in names


def test_usage_settings_and_version(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    store.record("symbols", 2, 4000, 300, "json")
    store.record("outline", 1, 100, 30, "json", "q")
    row = usage.totals(store.facts()).first()
    assert (row.invocations, row.candidate_bytes, row.estimated_baseline_tokens, row.returned_tokens) == (2, 4100, 1025, 330)
    store.set("index.nested_keys", "true")
    store.set("x", "1")
    store.set("x", None)
    assert store.settings() == {"index.nested_keys": "true"}
    store.publish(store.tables())
    store._write("current.json", {"version": "v", "schema_version": schema.SCHEMA_VERSION + 1})
    with pytest.raises(NewerStore):
        store.tables()


def test_diff_and_hunks(spark, tmp_path):
    text = "diff --git a/x b/x\n+++ b/x\n@@ -1,2 +3,4 @@\n@@ -9 +12 @@\n@@ -20,2 +22,0 @@\n+++ /dev/null\n@@ -1 +1 @@\n"
    assert tree.parse_diff(text) == [("x", 3, 6), ("x", 12, 12)]
    run = lambda *a: subprocess.run(["git", "-C", tmp_path, *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f.py").write_text("a\nb\nc\n")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "x")
    (tmp_path / "f.py").write_text("a\nB\nc\nd\n")
    assert [tuple(r) for r in tree.git_hunks(spark, str(tmp_path)).collect()] == [("f.py", 2, 2), ("f.py", 4, 4)]


def test_render():
    value = {"count": 2, "items": [{"a": 1, "b": "x y"}, {"a": 2, "b": "p,q"}], "note": "k: v"}
    assert render.to_toon(value) == 'count: 2\nitems[2]{a,b}:\n  1,x y\n  2,"p,q"\nnote: "k: v"'
    assert render.to_json({"a": [1, None]}) == '{"a":[1,null]}\n'
    assert render.to_toon({"a": [], "o": {"n": [{"x": [1]}]}}) == "a[0]:\no:\n  n[1]:\n    - x[1]: 1"
    assert render.duration_seconds("7d") == 604800 and render.window_label(7200) == "last 2 hours" and render.abbreviated(1500) == "1.5K"
    assert render.shell_quote("it's") == "'it'\\''s'"


def test_pointers_move_in_one_step(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert store.current() is None
    store._write("current.json", {"version": "a", "schema_version": 1})
    listed = store._pointers("current.json")
    for v in "bcd":
        store._write("current.json", {"version": v, "schema_version": 1})
        assert store.current()["version"] == v
        assert 1 <= len(store._pointers("current.json")) <= 2
    assert not set(listed) & set(store._pointers("current.json"))
    assert not [f for f in os.listdir(f"{tmp_path}/store") if f.startswith(".current") and not f.endswith(".crc")]


def test_ignore_files(tmp_path, monkeypatch):
    home = tmp_path / "home"
    (home / ".config" / "git").mkdir(parents=True)
    (home / ".config" / "git" / "ignore").write_text("*.swp\n")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(home / "none"))
    root = tmp_path / "tree"
    files = ["a.swp", "keep.rs", "logs/x.log", "logs/keep.log", "gen/a1.rs", "gen/b2.rs", "gen/deep/c3.rs", "no/y.rs", "yes/y.rs", "odd#.rs"]
    for f in files:
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("x")
    (root / ".gitignore").write_text("*.log\n!keep.log\ngen/[ab][0-9].rs\nyes/\n\\#none\n")
    (root / ".ignore").write_text("no/\n!yes/\n")
    found = [p for p, _, _ in tree.walk(str(root)) if not p.startswith(".")]
    assert found == ["gen/deep/c3.rs", "keep.rs", "logs/keep.log", "odd#.rs", "yes/y.rs"]


def test_usage_report():
    totals = {"invocations": 1234, "estimated_baseline_tokens": 2_000_000, "returned_tokens": 500_000, "saved": 1_500_000, "reduction": 75.0}
    commands = [{"command": "symbols", "invocations": 1200, "saved": 1_400_000, "reduction": 80.0}, {"command": "x" * 40, "invocations": 34, "saved": 100_000, "reduction": 33.3}]
    text = render.gain_report("last 30 days", totals, commands).split("\n")
    assert "1,234" in text[1] and "1,500,000" in text[4] and "75.0%" in text[4] and text[4].count("█") == 15
    assert text[8].split() == ["1", "symbols", "1,200", "1.4M", "80.0%", "█" * 10] and "…" in text[9] and text[9].endswith("█" + "░" * 9)


def test_large_results_are_not_rendered(spark, monkeypatch):
    monkeypatch.setattr(render, "MOST", 5)
    assert len(render.rows(spark.range(5))) == 5
    with pytest.raises(ValueError):
        render.rows(spark.range(6))

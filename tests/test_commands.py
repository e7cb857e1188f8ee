import subprocess

import pytest

from quarrylens import schema
from quarrylens.plans.commands import OutsideRepository, Session
from quarrylens.streaming.usage_stream import append_rollup, read_usage


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    files = {
        "src/main.rs": "use crate::util::helper;\nfn main() {\n  helper();\n  external_thing();\n}\n", "src/util.rs": "pub fn helper() {\n  leaf();\n}\nfn leaf() {}\nfn orphan() {}\nfn ping() { pong(); }\nfn pong() { ping(); }\n",
        "ui/a.ts": "import { b } from './b';\nimport x from 'react';\nexport function a() { b(); }\n", "ui/b.ts": "import { c } from '../core/c';\nexport function b() { c(); }\n", "core/c.ts": "export function c() {}\n", "doc.md": "# Helper notes\n", "conf.yaml": "name: x\n",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    return Session(spark, str(root), f"{tmp_path_factory.mktemp('store')}/s")


def items(result):
    return result.value()["items"]


def test_lookups(session):
    assert [i["name"] for i in items(session.symbols("HELP"))] == ["helper", "Helper notes"]
    found = session.definition("Leaf").value()
    assert found["count"] == 0 and "leaf" in found["advisory"]
    assert [i["name"] for i in items(session.outline("src/util.rs"))] == ["helper", "leaf", "orphan", "ping", "pong"]
    assert "in part" in session.outline("conf.yaml").value()["advisory"]
    with pytest.raises(OutsideRepository):
        session.outline("../x")
    with pytest.raises(FileNotFoundError):
        session.outline("nope.rs")
    assert items(session.context("leaf", 0))[0]["body"] == "fn leaf() {}"


def test_graph(session):
    assert [i["caller_name"] for i in items(session.callers("helper"))] == ["main"]
    assert {(i["callee_name"], i["depth"]) for i in items(session.callgraph("main"))} == {("helper", 1), ("external_thing", 1), ("leaf", 2)}
    assert {i["caller_name"] for i in items(session.impact("leaf"))} == {"helper", "main"}
    assert {i["name"] for i in items(session.deadcode())} == {"orphan"}
    assert items(session.cycles())[0]["cycle"] == ["ping", "pong"]
    assert items(session.import_cycles()) == []
    m = session.modules().value()
    assert m["order"].index("core/c.ts") < m["order"].index("ui/b.ts") < m["order"].index("ui/a.ts") and not m["cyclic"]
    assert session.boundary("ui/", "core/", forbid=True).failed and not session.boundary("core/", "ui/", forbid=True).failed


def test_search_overview_and_artifacts(session):
    found = session.search("helper").value()
    assert {(r["source"], r["path"], r["line"]) for r in found["results"]} == {("structural", "src/util.rs", 0), ("structural", "doc.md", 0), ("reference", "src/main.rs", 2), ("textual", "src/main.rs", 0)}
    assert session.overview().value()["files"] == 7
    assert "helper" in session.report() and "# Digest" in session.prime() and "<canvas" in session.export()
    assert len(session.languages().value()["languages"]) == 20


def test_changed_and_gain(session):
    with open(f"{session.root}/src/util.rs", "r+") as f:
        text = f.read().replace("  leaf();", "  leaf(); // now")
        f.seek(0)
        f.write(text)
    out = session.changed().value()
    assert [c["name"] for c in out["changed"]] == ["helper"] and [(i["name"], i["depth"]) for i in out["impacted"]] == [("main", 1)]
    gained = session.gain().value()
    assert gained["window"] == "last 30 days" and {c["command"] for c in gained["commands"]} >= {"symbols", "changed"}
    assert session.gain_top().text("json").startswith('{"count":')
    session.config_set("analysis.subsystem_min_size", "3")
    assert session.setting("analysis.subsystem_min_size") == ("3", "stored")
    with pytest.raises(ValueError):
        session.config_set("index.nested_keys", "maybe")


def test_usage_stream(spark, tmp_path):
    hour = 3_600_000_000_000
    rows = [(k * hour // 4, "symbols" if k % 2 else "outline", 1, 400, 100, 10, "json", None) for k in range(400)]
    spark.createDataFrame(rows, schema.USAGE).write.parquet(f"{tmp_path}/usage")
    append_rollup(read_usage(spark, f"{tmp_path}/usage"), f"{tmp_path}/out", f"{tmp_path}/check", late="1 hour").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() >= 190 and {r.invocations for r in got.collect()} == {2}


def test_search_reads_every_file_and_lists_callees(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.rs").write_text("fn top() {\n  low();\n  twin();\n  println();\n}\nfn low() {}\nfn twin() {}\n")
    (root / "b.rs").write_text("fn twin() {}\n")
    (root / "notes.txt").write_text("the top of it\n")
    (root / "data.bin").write_bytes(b"top\x00top")
    s = Session(spark, str(root), f"{tmp_path}/s", record=False)
    found = s.search("top").value()
    assert {(r["source"], r["path"]) for r in found["results"]} == {("structural", "a.rs"), ("textual", "notes.txt")}
    got = found["callees"][0]
    assert [r["name"] for r in got["internal"]] == ["low"] and got["external_count"] == 1 and got["external"] == []
    assert [(a["name"], a["count"], a["candidates"]) for a in got["ambiguous"]] == [("twin", 2, [])]
    more = s.search("top", all_callees=True).value()["callees"][0]
    assert more["external"] == ["println"] and {c["path"] for c in more["ambiguous"][0]["candidates"]} == {"a.rs", "b.rs"}
    assert items(s.callgraph("top", depth=0)) == []
    status = s.status().value()
    assert status["store_bytes"] > 0 and status["staleness"] == {"changed": 0, "new": 0, "deleted": 0}

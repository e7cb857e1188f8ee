"""The command surface: one method a command, each giving a result with its advisory, and its usage row.

A command that reads facts first brings the index up to the tree.  Results are DataFrames until they are rendered; those
that are rendered are small by their own limits.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field
from functools import cached_property
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.operators import clusters, delta, edges, graph, imports, lookup, overview, search, usage
from quarrylens.plans import artifacts, render
from quarrylens.sources.tree import disk_files, git_hunks
from quarrylens.store import Store


@dataclass
class Result:
    """Items with an advisory, or a document of named parts; run once, however often it is asked."""

    items: DataFrame | None = None
    parts: dict = field(default_factory=dict)
    advisory: str | None = None
    failed: bool = False

    @cached_property
    def _value(self) -> dict:
        if self.items is not None:
            return render.envelope(self.items, self.advisory)
        out = {k: render.rows(v) if isinstance(v, DataFrame) else v for k, v in self.parts.items()}
        return out | ({"advisory": self.advisory} if self.advisory else {})

    def value(self) -> dict:
        return self._value

    def text(self, fmt: str = "toon") -> str:
        return render.render(self.value(), fmt)

    def write(self, out: IO[str]) -> None:
        """The JSON of text("json") to a file, of any number of items: the driver holds one partition of them at a time."""
        if self.items is None:
            out.write(self.text("json"))
            return
        out.write(f'{{"count":{self.items.count()},"items":[')
        for k, row in enumerate(self.items.toLocalIterator()):
            out.write(("," if k else "") + render.to_json(render.plain(row)).rstrip("\n"))
        out.write("]" + (f',"advisory":{json.dumps(self.advisory, ensure_ascii=False)}' if self.advisory else "") + "}\n")


class OutsideRepository(ValueError):
    """A path beyond the repository's root."""


class Session:
    """Commands over one repository."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, record: bool = True, record_query: bool = False):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = Store(spark, store or f"file://{self.root}/.quarrylens")
        self.recording, self.record_query = record, record_query

    # settings: explicit, then environment, then stored, then default
    DEFAULTS = {"analysis.subsystem_min_size": "5", "index.nested_keys": "false", "gain.record": "true", "gain.record_query": "false", "output.format": "toon"}

    def setting(self, key: str) -> tuple[str, str]:
        """Value and where it comes from."""
        if key not in self.DEFAULTS:
            raise KeyError(key)
        env = os.environ.get("QUARRYLENS_" + key.upper().replace(".", "_"))
        if env is not None:
            return env, "environment"
        stored = self.store.settings().get(key)
        return (stored, "stored") if stored is not None else (self.DEFAULTS[key], "default")

    def config(self) -> Result:
        return Result(parts={"settings": [{"key": k, "value": v, "source": s, "default": d} for k, d in self.DEFAULTS.items() for v, s in [self.setting(k)]]})

    def config_set(self, key: str, value: str | None) -> None:
        if key not in self.DEFAULTS:
            raise KeyError(key)
        if value is not None and self.DEFAULTS[key] in ("true", "false") and value.lower() not in ("true", "false"):
            raise ValueError(f"{key} is true or false")
        if value is not None and self.DEFAULTS[key].isdigit() and not value.isdigit():
            raise ValueError(f"{key} is a number")
        self.store.set(key, value)

    # facts
    def index(self, force: bool = False) -> Result:
        return Result(parts=self.store.index(self.root, force))

    def facts(self):
        self.store.index(self.root)
        return self.store.facts(self.root)

    def status(self, fast: bool = False) -> Result:
        t = self.store.facts()
        head = self.store.current()
        parts = lookup.counts(t).first().asDict() | {"schema_version": head["schema_version"] if head else schema.SCHEMA_VERSION, "languages": lookup.files_per_language(t).orderBy("language"), "store_bytes": self.store.size()}
        if not fast:
            parts["staleness"] = delta.status(disk_files(self.spark, self.root), t.files).first().asDict()
        return Result(parts=parts)

    def path(self, given: str) -> str:
        """A path as the facts name it."""
        full = os.path.normpath(os.path.join(self.root, given))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise OutsideRepository(given)
        return os.path.relpath(full, self.root).replace(os.sep, "/")

    def _done(self, result: Result, command: str, t, paths: DataFrame, query: str | None = None) -> Result:
        if self.recording and self.setting("gain.record")[0].lower() == "true":
            base = usage.baseline(t, paths).first()
            keep = self.record_query or self.setting("gain.record_query")[0].lower() == "true"
            out = _Length()
            result.write(out)
            self.store.record(command, base.files, base.bytes, out.bytes // 4, self.setting("output.format")[0], query if keep else None)
        return result

    def _partial(self, t, lang: str | None, empty: bool) -> str | None:
        if lang in schema.PARTIAL_LANGUAGES:
            return f"{lang} is covered in part only: top-level names"
        if empty and t.files.filter(F.col("language").isin(*schema.PARTIAL_LANGUAGES)).limit(1).count():
            return "no match; some files are in languages that are covered in part only"
        return None

    def symbols(self, query: str, kind: str | None = None, lang: str | None = None, limit: int = 50) -> Result:
        t = self.facts()
        rows = render.held(lookup.symbols(t, query, kind, lang, limit))
        return self._done(Result(rows, advisory=self._partial(t, lang, not rows.limit(1).count())), "symbols", t, rows.select(F.col("file_path").alias("path")), query)

    def definition(self, name: str, lang: str | None = None, limit: int = 50) -> Result:
        t = self.facts()
        rows = render.held(lookup.definition(t, name, lang, limit))
        note = None
        if not rows.limit(1).count():
            near = [r.name for r in lookup.near_misses(t, name).collect()]
            note = f"no definition of this case; there is {', '.join(near)}" if near else self._partial(t, lang, True)
        return self._done(Result(rows, advisory=note or self._partial(t, lang, False)), "definition", t, rows.select(F.col("file_path").alias("path")), name)

    def outline(self, file: str) -> Result:
        t, path = self.facts(), self.path(file)
        if not lookup.file_stat(t, path).count():
            raise FileNotFoundError(path)
        rows = render.held(lookup.outline(t, path))
        lang = lookup.file_stat(t, path).first().language
        return self._done(Result(rows, advisory=self._partial(t, lang, False)), "outline", t, self.spark.createDataFrame([(path,)], "path string"), path)

    def context(self, symbol: str, around: int = 5, limit: int = 3) -> Result:
        t = self.facts()
        rows = lookup.context(t, symbol, around, limit)
        stale = delta.reconcile(disk_files(self.spark, self.root), t.files).filter("state = 'changed' or state = 'deleted'").select(F.col("path").alias("file_path"), F.lit(True).alias("stale"))
        rows = render.held(rows.join(stale, "file_path", "left").withColumn("stale", F.coalesce("stale", F.lit(False))))
        return self._done(Result(rows), "context", t, rows.select(F.col("file_path").alias("path")), symbol)

    def _edges(self, command: str, t, rows: DataFrame, name: str) -> Result:
        rows = render.held(rows)
        state = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("ambiguous").alias("many")).first()
        note = "no edges; calls through values or other languages are not seen" if not state.n else (f"{state.many} edges are ambiguous" if state.many else None)
        paths = rows.select(F.col("caller_file").alias("path")).unionByName(rows.filter("callee_file is not null").select(F.col("callee_file").alias("path")))
        return self._done(Result(rows, advisory=note), command, t, paths, name)

    def callers(self, name: str, limit: int = 50, resolved_only: bool = False) -> Result:
        t = self.facts()
        return self._edges("callers", t, edges.callers(t, name, limit, resolved_only), name)

    def callees(self, name: str, limit: int = 50, resolved_only: bool = False) -> Result:
        t = self.facts()
        return self._edges("callees", t, edges.callees(t, name, limit, resolved_only), name)

    def callgraph(self, name: str, depth: int = 3, direction: str = "down", resolved_only: bool = False) -> Result:
        t = self.facts()
        return self._edges("callgraph", t, graph.walk(t, name, depth, direction, resolved_only), name)

    def impact(self, name: str, depth: int = 3, resolved_only: bool = False) -> Result:
        t = self.facts()
        return self._edges("impact", t, graph.impact(t, name, depth, resolved_only), name)

    def deps(self, file: str) -> Result:
        t, path = self.facts(), self.path(file)
        return self._done(Result(render.held(imports.deps(t, path))), "deps", t, self.spark.createDataFrame([(path,)], "path string"), path)

    def rdeps(self, module: str) -> Result:
        t = self.facts()
        rows = render.held(imports.rdeps(t, module))
        return self._done(Result(rows), "rdeps", t, rows.select(F.col("file_path").alias("path")), module)

    def boundary(self, source: str, target: str, forbid: bool = False) -> Result:
        """failed: crossings were found and are forbidden."""
        t = self.facts()
        rows = render.held(imports.boundary(t, source, target))
        any_row = bool(rows.limit(1).count())
        lost = imports.boundary_unresolved(t, source).first().unresolved
        note = f"{lost} imports mean no file here and were not followed" if not any_row and lost else None
        return self._done(Result(rows, advisory=note, failed=forbid and any_row), "boundary", t, rows.select(F.col("file_path").alias("path")), f"{source} {target}")

    def deadcode(self, lang: str | None = None, limit: int = 50) -> Result:
        t = self.facts()
        rows = render.held(edges.dead_code(t, lang, limit))
        return self._done(Result(rows, advisory="candidates by name: dynamic and outside calls are not seen"), "deadcode", t, rows.select(F.col("file_path").alias("path")))

    def cycles(self, limit: int = 0) -> Result:
        t = self.facts()
        rows = render.held(graph.call_cycles(t, limit))
        note = f"output capped at {graph.MAX_CYCLES} cycles" if rows.count() >= graph.MAX_CYCLES else None
        return self._done(Result(rows, advisory=note), "cycles", t, t.files.select("path").limit(0))

    def import_cycles(self, limit: int = 0) -> Result:
        t = self.facts()
        return self._done(Result(graph.import_cycles(t, limit)), "import-cycles", t, t.files.select("path").limit(0))

    def modules(self) -> Result:
        t = self.facts()
        g = imports.file_graph(t)
        parts = graph.modules(t).first().asDict()
        parts["order"] = [] if parts["cyclic"] else [r.node for r in graph.module_levels(g).orderBy("level", "node").collect()]
        parts["links"] = g.orderBy("source", "target").limit(500)
        return self._done(Result(parts=parts), "modules", t, t.files.select("path"))

    def overview(self) -> Result:
        t = self.facts()
        parts = lookup.counts(t).first().asDict() | {
            "languages": lookup.files_per_language(t).orderBy("language"), "modules": overview.module_stats(t), "entry_points": overview.entry_points(t).orderBy("path").limit(20),
            "hotspots": edges.hotspots(t), "public_api": overview.public_api_by_dir(t),
        }
        return self._done(Result(parts=parts), "overview", t, t.files.select("path"))

    def _min_size(self) -> int:
        return int(self.setting("analysis.subsystem_min_size")[0])

    def communities(self) -> Result:
        t = self.facts()
        at = clusters.located(t)
        return self._done(Result(parts={"communities": clusters.communities(t, self._min_size(), at=at), "god_nodes": clusters.god_nodes(t, at=at)}), "communities", t, t.files.select("path"))

    def report(self) -> str:
        return artifacts.report(self.facts(), self._min_size())

    def export(self, out: IO[str] | None = None) -> str:
        """The page of the call graph, or nothing but the page in a file that is open for writing."""
        if out is None:
            return artifacts.export_html(self.facts(), self._min_size())
        artifacts.export_to(self.facts(), out, self._min_size())
        return ""

    def prime(self) -> str:
        """A digest of the facts as they are; nothing is indexed."""
        return artifacts.prime(self.store.facts(), self._min_size())

    def changed(self, since: str = "HEAD") -> Result:
        t = self.facts()
        hunks = git_hunks(self.spark, self.root, since)
        parts = {"since": since, "files_changed": hunks.select("path").distinct().count(), "changed": graph.changed_symbols(t, hunks).orderBy("path", "line"), "impacted": graph.changed_impact(t, hunks)}
        return self._done(Result(parts=parts), "changed", t, hunks.select("path"))

    def languages(self) -> Result:
        return Result(parts={"languages": [{"language": s, "extensions": " ".join(e), "coverage": c, "calls": k, "imports": k} for s, e, c, k in schema.LANGUAGES]})

    def search(self, pattern: str, lang: str | None = None, limit: int = 50, all_callees: bool = False) -> Result:
        t = self.facts()
        shown = search.files_shown(limit)
        found = render.held(search.matching(t, pattern, shown + 1, lang))  # the only pass over the texts; a bounded number of files
        cut = found.count() > shown
        hits = render.held(search.search(t, pattern, lang, limit, search.listed(found.orderBy("path").limit(shown))))
        names = hits.filter("source = 'structural'").select("name").distinct()
        parts = {"pattern": pattern, "results": hits, "callers": search.callers_groups(t, names), "callees": search.callees_listed(t, names, all_callees), "truncated": cut}
        return self._done(Result(parts=parts, advisory="more files match than are shown" if cut else None), "search", t, hits.select("path"), pattern)

    def gain(self, since: str | None = "30d", history: int | None = None) -> Result:
        t = self.store.facts()
        bound = None if since is None else _ago(since)
        if history is not None:
            return Result(usage.history(t, history, bound))
        label = "all time" if since is None else render.window_label(render.duration_seconds(since))
        return Result(parts={"window": label, "totals": usage.totals(t, bound), "commands": usage.per_command(t, bound)})

    def gain_text(self, since: str | None = "30d") -> str:
        """The usage report: totals, a meter of the reduction, and a table of the commands by what they saved."""
        value = self.gain(since).value()
        return render.gain_report(value["window"], value["totals"][0], sorted(value["commands"], key=lambda r: (-r["saved"], r["command"])))

    def gain_top(self, by: str = "saved", since: str | None = "30d") -> Result:
        return Result(usage.top(self.store.facts(), by, None if since is None else _ago(since)))


class _Length:
    """A file that only counts its bytes."""

    bytes = 0

    def write(self, text: str) -> None:
        self.bytes += len(text.encode())


def _ago(text: str) -> int:
    return time.time_ns() - render.duration_seconds(text) * 1_000_000_000

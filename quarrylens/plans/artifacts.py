"""Text artifacts over small results: a Markdown report, an HTML graph, a digest."""

from __future__ import annotations

import html
import io
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.functions.tables import cut, numbered
from quarrylens.operators import clusters, edges, lookup, overview
from quarrylens.sources.facts import Facts

REPORT = {"communities": 12, "members": 12, "god_nodes": 10, "bridges": 12, "entry_points": 15}
PRIME = {"communities": 8, "members": 3, "god_nodes": 8, "entry_points": 8, "languages": 6}


def _section(title: str, lines: list[str]) -> str:
    return f"## {title}\n\n" + ("\n".join(lines) if lines else "none detected") + "\n"


def questions(god: list, found: list, crossing: list) -> list[str]:
    """At most eight questions that the graph suggests."""
    out = [f"What depends on {g.label}, and can it be smaller?" for g in god[:3]]
    out += [f"Why does {b.from_label} reach into the part around {b.to_cluster}?" for b in crossing[:3]]
    out += [f"Is the part around {c.label} one unit?" for c in found[:2]]
    return out[:8]


def report(t: Facts, min_size: int = clusters.MIN_SIZE) -> str:
    n = lookup.counts(t).first()
    at = clusters.located(t)
    god = clusters.god_nodes(t, REPORT["god_nodes"], at).collect()
    found = clusters.communities(t, min_size, REPORT["communities"], REPORT["members"], at).collect()
    crossing = clusters.bridges(t, REPORT["bridges"], at).collect()
    entry = overview.entry_points(t).orderBy(F.when(F.col("kind") == "entry", 1).otherwise(0), "path", "line", "name").limit(REPORT["entry_points"]).collect()
    return "\n".join(
        [
            f"# Architecture\n\n{n.files} files, {n.symbols} symbols\n",
            _section("Entry points", [f"- {e.name} ({e.path}:{e.line})" for e in entry]),
            _section("Most connected", [f"- {g.label}: {g.degree}" for g in god]),
            _section("Subsystems", [f"- {c.label} ({c.size}): {', '.join(c.members)}" for c in found]),
            _section("Bridges", [f"- {b.from_label} ({b.from_cluster}) to {b.to_label} ({b.to_cluster})" for b in crossing]),
            _section("Questions", [f"- {q}" for q in questions(god, found, crossing)]),
        ]
    )


def prime(t: Facts, min_size: int = clusters.MIN_SIZE) -> str:
    n = lookup.counts(t).first()
    if not n.files:
        return "Nothing is indexed yet.\n"
    langs = lookup.files_per_language(t).orderBy(F.desc("files"), "language").limit(PRIME["languages"]).collect()
    at = clusters.located(t)
    god = clusters.god_nodes(t, PRIME["god_nodes"], at).collect()
    found = clusters.communities(t, min_size, PRIME["communities"], PRIME["members"], at).collect()
    entry = overview.entry_points(t).orderBy(F.when(F.col("kind") == "entry", 1).otherwise(0), "path", "line", "name").limit(PRIME["entry_points"]).collect()
    hot = edges.hotspots(t, PRIME["god_nodes"]).collect()
    return "\n".join(
        [
            f"# Digest\n\n{n.files} files, {n.symbols} symbols; {', '.join(f'{x.language} {x.files}' for x in langs)}\n",
            _section("Entry points", [f"- {e.name} ({e.path})" for e in entry]),
            _section("Most called", [f"- {h.name}: {h.callers} ({h.path})" for h in hot]),
            _section("Most connected", [f"- {g.label}: {g.degree}" for g in god]),
            _section("Subsystems", [f"- {c.label} ({c.size}): {', '.join(c.members)}" for c in found]),
        ]
    )


_PAGE = """<!doctype html>
<html><head><meta charset="utf-8"><title>Call graph</title>
<style>body{{margin:0;font:13px sans-serif}}canvas{{display:block}}p{{position:fixed;margin:8px}}</style></head>
<body><p>{title}</p><canvas id="c"></canvas>
<script id="data" type="application/json">{data}</script>
<script>
const g = JSON.parse(document.getElementById("data").textContent);
const c = document.getElementById("c"), x = c.getContext("2d");
c.width = innerWidth; c.height = innerHeight;
const groups = [...new Set(g.nodes.map(n => n.community))];
const place = g.nodes.map((n, i) => {{
  const turn = 2 * Math.PI * groups.indexOf(n.community) / groups.length, own = 2.4 * i, r = 12 + 3 * Math.sqrt(i);
  return [c.width / 2 + c.width / 3 * Math.cos(turn) + r * Math.cos(own), c.height / 2 + c.height / 3 * Math.sin(turn) + r * Math.sin(own)];
}});
for (const e of g.edges) {{
  x.setLineDash(e.ambiguous ? [3, 3] : []); x.strokeStyle = "#bbb"; x.beginPath(); x.moveTo(...place[e.source]); x.lineTo(...place[e.target]); x.stroke();
}}
g.nodes.forEach((n, i) => {{
  x.fillStyle = n.community < 0 ? "#999" : `hsl(${{(n.community * 47) % 360}} 60% 45%)`; x.beginPath(); x.arc(...place[i], 2 + Math.sqrt(n.degree), 0, 7); x.fill();
}});
</script></body></html>
"""


def export_to(t: Facts, out: IO[str], min_size: int = clusters.MIN_SIZE) -> None:
    """One page with the located call graph, written part by part: nodes are numbered by range, and the driver holds one partition of rows at a time."""
    at = clusters.located(t)
    nodes = cut(numbered(clusters.export_graph(t, min_size, at), ["key"], "place", "export-nodes"), "export")
    place = nodes.select("key", "place")
    ends = clusters.export_edges(t, at).join(place.select(F.col("key").alias("source"), F.col("place").alias("_s")), "source").join(place.select(F.col("key").alias("target"), F.col("place").alias("_t")), "target")
    links = cut(ends.select(F.col("_s").alias("source"), F.col("_t").alias("target"), "ambiguous"), "export-edges")
    lines = lambda df, *columns: df.select(F.replace(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/")).alias("line"))
    many = nodes.filter("major").agg(F.count_distinct("community")).first()[0]
    title = html.escape(f"{nodes.count()} nodes, {links.count()} edges, {many} subsystems")
    head, tail = _PAGE.format(title=title, data="\0").split("\0")
    out.write(head + '{"nodes": [')
    _write(out, lines(nodes.orderBy("place"), "name", "file", "line", "degree", "community", "major"))
    out.write('], "edges": [')
    _write(out, lines(links, "source", "target", "ambiguous"))
    out.write("]}" + tail)


def _write(out: IO[str], lines: DataFrame) -> None:
    for k, row in enumerate(lines.toLocalIterator()):
        out.write((", " if k else "") + row.line)


def export_html(t: Facts, min_size: int = clusters.MIN_SIZE) -> str:
    """The page of export_to as text, for graphs that a page can show."""
    out = io.StringIO()
    export_to(t, out, min_size)
    return out.getvalue()

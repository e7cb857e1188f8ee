"""DuckDB SQL of the registered queries over the driver's tables."""

from __future__ import annotations

from quarrylens import schema
from quarrylens.functions.text import LOWER, UPPER
from quarrylens.plans.oracle_nested import nested_sql

BUILTIN = ", ".join(f"'{m}'" for m in schema.BUILTIN_METHODS)
SUFFIXES = ", ".join(f"'{e}'" for e in (*schema.IMPORT_SUFFIXES, *(f"/index{e}" for e in schema.IMPORT_SUFFIXES)))
CALL_LANGS = ", ".join(f"'{x}'" for x in schema.CALL_LANGUAGES)


def low(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{LOWER}')"


MATCH = f"(CASE WHEN c.is_method THEN s.kind = 'method' AND c.callee_name NOT IN ({BUILTIN}) ELSE s.kind IN ('function', 'method', 'macro') END)"

#: Every derived table; a query reads those it names.
BASE = f"""
WITH RECURSIVE docs AS (
  SELECT *, CASE lang WHEN 'en' THEN '.rs' WHEN 'fr' THEN '.py' WHEN 'de' THEN '.go' ELSE '.sh' END AS ext FROM documents
), files_ AS (
  SELECT doc_id, CASE doc_id % 50 WHEN 7 THEN source || '/app_' || doc_id || '/Main.tsx' WHEN 11 THEN source || '/tests/doc_' || doc_id || ext
    WHEN 13 THEN source || '/src/doc_' || doc_id || '.test' || ext ELSE source || '/src/doc_' || doc_id || ext END AS path,
    doc_id * 1000000000 AS mtime_ns, CAST(strlen(text) AS BIGINT) AS size,
    CASE lang WHEN 'en' THEN 'rust' WHEN 'fr' THEN 'python' WHEN 'de' THEN 'go' ELSE 'bash' END AS language FROM docs
), files AS (SELECT path, mtime_ns, size, language FROM files_),
spread AS (SELECT greatest(200, count(*) // 5) AS m FROM documents),
symbols_ AS (
  SELECT p_partkey AS partkey, path AS file_path,
    CASE WHEN p_partkey % 500 = 1 THEN 'main' WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name,
    CASE p_size % 8 WHEN 0 THEN 'method' WHEN 1 THEN 'class' WHEN 2 THEN 'macro' WHEN 3 THEN 'key' WHEN 4 THEN 'section' ELSE 'function' END AS kind,
    CAST(p_partkey // m * 10 AS INTEGER) AS start_line, 0 AS start_column, CAST(p_partkey // m * 10 + p_size % 10 AS INTEGER) AS end_line,
    CAST(p_size AS INTEGER) AS end_column, CASE p_type WHEN 'ECONOMY' THEN 'public' WHEN 'SMALL' THEN 'unknown' ELSE 'private' END AS visibility
  FROM part CROSS JOIN spread JOIN files_ ON doc_id = p_partkey % m
), symbols AS (SELECT * EXCLUDE partkey FROM symbols_),
calls AS (
  SELECT a.file_path, a.name AS caller_name, a.start_line AS caller_start_line, CASE WHEN l_linenumber = 7 OR l_quantity > 6 THEN 'ext_' || l_suppkey ELSE b.name END AS callee_name,
    CAST(a.start_line + l_linenumber AS INTEGER) AS site_line, CAST(l_suppkey % 80 AS INTEGER) AS site_column, 'syntactic' AS resolution, l_returnflag = 'R' AS is_method
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN symbols_ a ON a.partkey = l_partkey AND a.kind IN ('function', 'method') JOIN symbols_ b ON b.partkey = o_custkey
), imports_ AS (SELECT e.*, CAST(floor(value * 100) AS BIGINT) % m AS t, path AS file_path FROM events e CROSS JOIN spread JOIN files_ ON doc_id = user_id % m),
imports AS (
  SELECT file_path, CASE CASE WHEN event_id % 4 = 0 THEN event_type END WHEN 'view' THEN './doc_' || t WHEN 'click' THEN '../../src' || t % 20 || '/src/doc_' || t WHEN 'purchase' THEN '@docs/src' || t % 20 || '/src/doc_' || t
    WHEN 'signup' THEN 'crate::doc_' || t || '::item' ELSE 'pkg_' || user_id % 10 END AS module, CAST(event_id AS INTEGER) AS site_line, 0 AS site_column FROM imports_
), usage AS (
  SELECT epoch_ns(ts) AS ts_unix_ns, event_type AS command, CAST(user_id % 50 AS INTEGER) AS candidate_files, CAST(floor(value * 100) AS BIGINT) AS candidate_bytes,
    CAST(floor(value * 100) AS BIGINT) // 4 AS estimated_baseline_tokens, CAST(user_id AS BIGINT) AS returned_tokens, event_id AS seq FROM events
), lines AS (
  SELECT path, CAST(i - 1 AS INTEGER) AS line_no, ls[i] AS text FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS ls FROM documents JOIN files_ USING (doc_id)))
), defs AS (
  SELECT c.callee_name, c.is_method, count(*) AS defs, min(struct_pack(f := s.file_path, l := s.start_line)) AS spot
  FROM (SELECT DISTINCT callee_name, is_method FROM calls) c JOIN symbols s ON s.name = c.callee_name AND {MATCH} GROUP BY 1, 2
), edges AS (
  SELECT c.caller_name, a.kind AS caller_kind, a.file_path AS caller_file, a.start_line AS caller_line, a.end_line AS caller_end_line, c.callee_name, s.kind AS callee_kind, s.file_path AS callee_file,
    s.start_line AS callee_line, c.site_line, c.site_column, c.resolution, c.is_method
  FROM calls c JOIN symbols a ON a.file_path = c.file_path AND a.name = c.caller_name AND a.start_line = c.caller_start_line LEFT JOIN symbols s ON s.name = c.callee_name AND {MATCH}
), places AS (SELECT callee_name, count(DISTINCT CASE WHEN callee_file IS NOT NULL THEN callee_file || ':' || callee_line END) > 1 AS ambiguous FROM edges GROUP BY 1),
down_places AS (SELECT caller_name, callee_name, count(DISTINCT CASE WHEN callee_file IS NOT NULL THEN callee_file || ':' || callee_line END) > 1 AS ambiguous FROM edges GROUP BY 1, 2),
up_edges AS (SELECT e.*, ambiguous FROM edges e JOIN places USING (callee_name)),
down_edges AS (SELECT e.*, ambiguous FROM edges e JOIN down_places USING (caller_name, callee_name)),
pairs AS (SELECT DISTINCT caller_name, callee_name FROM calls JOIN defs USING (callee_name, is_method) WHERE caller_name <> callee_name AND defs = 1),
located AS (
  SELECT DISTINCT caller_name, file_path AS caller_file, caller_start_line AS caller_line, callee_name, is_method, defs AS callee_defs, CASE WHEN defs = 1 THEN spot.f END AS callee_file,
    CASE WHEN defs = 1 THEN spot.l END AS callee_line FROM calls JOIN defs USING (callee_name, is_method) WHERE caller_name <> callee_name
), stems AS (
  SELECT DISTINCT file_path, module, CASE WHEN module LIKE './%' THEN regexp_replace(file_path, '/[^/]*$', '') || '/' || substr(module, 3) WHEN module LIKE '../../%' THEN substr(module, 7)
    WHEN file_path LIKE '%.rs' AND module LIKE 'crate::%' AND file_path LIKE '%/src/%' THEN split_part(file_path, '/', 1) || '/src/' || split_part(module, '::', 2)
    WHEN file_path NOT LIKE '%.rs' AND module LIKE '@docs/%' THEN substr(module, 7) END AS stem FROM imports
), tried AS (
  SELECT file_path, module, i, CASE WHEN module LIKE 'crate::%' THEN CASE i WHEN 1 THEN stem || '.rs' WHEN 2 THEN stem || '/mod.rs' END ELSE stem || ([{SUFFIXES}])[i] END AS path
  FROM stems, (SELECT unnest(range(1, {2 * len(schema.IMPORT_SUFFIXES) + 1})) AS i)
), resolved AS (
  SELECT s.file_path, s.module, t.target FROM stems s LEFT JOIN (
    SELECT file_path, module, arg_min(path, i) AS target FROM tried JOIN files USING (path) GROUP BY 1, 2
  ) t ON t.file_path = s.file_path AND t.module = s.module AND t.target <> s.file_path
), graph AS (SELECT DISTINCT file_path AS source, target FROM resolved WHERE target IS NOT NULL),
nodes_ AS (
  SELECT DISTINCT * FROM (SELECT caller_name AS name, caller_file AS file, caller_line AS line FROM located WHERE callee_defs = 1
    UNION ALL SELECT callee_name, callee_file, callee_line FROM located WHERE callee_defs = 1)
), keyed AS (
  SELECT caller_name || chr(1) || caller_file || chr(1) || caller_line AS x, callee_name || chr(1) || callee_file || chr(1) || callee_line AS y FROM located WHERE callee_defs = 1
), weights AS (SELECT least(x, y) AS a, greatest(x, y) AS b, CAST(count(*) AS BIGINT) AS weight FROM keyed WHERE x <> y GROUP BY 1, 2),
degree_ AS (SELECT key, CAST(count(*) AS BIGINT) AS degree, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT a AS key, weight FROM weights UNION ALL SELECT b, weight FROM weights) GROUP BY 1),
degrees AS (
  SELECT name || chr(1) || file || chr(1) || line AS key, name, file, line,
    CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '@' || regexp_extract(file, '[^/]*$') || ':' || (line + 1) ELSE name END AS label,
    coalesce(d.degree, 0) AS degree, coalesce(d.weight, 0) AS weight FROM nodes_ n LEFT JOIN degree_ d ON d.key = n.name || chr(1) || n.file || chr(1) || n.line
)
"""

SYMBOL = "name, kind, file_path, start_line, start_column, end_line, end_column"
EDGE = "caller_name, caller_kind, caller_file, caller_line, caller_end_line, callee_name, callee_kind, callee_file, callee_line, site_line, site_column, resolution, is_method, ambiguous"
EDGE_ORDER = "CASE WHEN NOT ambiguous AND callee_file IS NOT NULL THEN 0 ELSE 1 END, caller_file, caller_line, site_line, site_column, callee_file NULLS FIRST, callee_line NULLS FIRST, callee_name, is_method"
DEF_KINDS = ", ".join(f"'{k}'" for k in schema.DEFINITION_KINDS)
SAVED = "CAST(greatest(b - r, 0) AS BIGINT) AS saved, CASE WHEN b <= 0 THEN 0.0 ELSE floor(CAST(greatest(b - r, 0) AS DOUBLE) * 100.0 / b * 10.0 + 0.5) / 10.0 END AS reduction"


def _sums(group: str, where: str = "TRUE") -> str:
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {head}invocations, candidate_bytes, b AS estimated_baseline_tokens, r AS returned_tokens, {SAVED} FROM (
      SELECT {head}count(*) AS invocations, CAST(coalesce(sum(candidate_bytes), 0) AS BIGINT) AS candidate_bytes, CAST(coalesce(sum(estimated_baseline_tokens), 0) AS BIGINT) AS b,
        CAST(coalesce(sum(returned_tokens), 0) AS BIGINT) AS r FROM usage WHERE {where} {tail}))"""


def _dead(lang: str = "TRUE", limit: str = "") -> str:
    p = low("path")
    tests = " OR ".join(
        [f"{p} LIKE '%{x}'" for x in schema.TEST_PATH_SUFFIXES] + [f"contains({p}, '{x}')" for x in schema.TEST_PATH_PARTS] + [f"starts_with({p}, '{x}')" for x in schema.TEST_PATH_PREFIXES]
    )
    return f"""SELECT file_path, name, kind, start_line, end_line, visibility, language FROM symbols JOIN files ON path = file_path
      WHERE kind IN ('function', 'method') AND language IN ({CALL_LANGS}) AND {lang} AND visibility <> 'public' AND name NOT IN ('constructor', 'main') AND NOT ({tests})
      AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee_name = name) ORDER BY file_path, start_line, name {limit}"""


def _walk(name: str, depth: int, ways: tuple[str, ...]) -> str:
    steps = []
    if "down" in ways:
        steps.append("SELECT callee_name AS n, caller_name AS o FROM edges")
    if "up" in ways:
        steps.append("SELECT caller_name AS n, callee_name AS o FROM edges")
    rows = []
    if "down" in ways:
        rows.append(f"SELECT {EDGE}, 'down' AS direction, CAST(dist.d + 1 AS INTEGER) AS depth FROM down_edges JOIN dist ON dist.n = caller_name WHERE dist.d < {depth}")
    if "up" in ways:
        rows.append(f"SELECT {EDGE}, 'up' AS direction, CAST(dist.d + 1 AS INTEGER) AS depth FROM up_edges JOIN dist ON dist.n = callee_name WHERE dist.d < {depth}")
    return f""", hops AS (SELECT DISTINCT n, o FROM ({' UNION ALL '.join(steps)})),
    steps AS (SELECT '{name}' AS n, 0 AS d UNION SELECT h.n, d + 1 FROM steps JOIN hops h ON h.o = steps.n WHERE d < {depth}),
    dist AS (SELECT n, min(d) AS d FROM steps GROUP BY n)
    {' UNION ALL '.join(rows)}"""


HUNKS = "(SELECT path, 1 AS h_start, 6 AS h_end FROM files_ WHERE doc_id IN (1, 2, 3, 5))"
CHANGED = f"changed AS (SELECT name, s.file_path AS path, start_line AS line, min(kind) AS kind FROM symbols s JOIN {HUNKS} h ON h.path = s.file_path AND h_start <= end_line + 1 AND h_end > start_line GROUP BY 1, 2, 3)"
DISK = "(SELECT path, mtime_ns, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size FROM files_ WHERE doc_id % 7 <> 3)"
KNOWN = "(SELECT path, mtime_ns, size FROM files_ WHERE doc_id % 11 <> 4)"
STATE = f"state AS (SELECT path, CASE WHEN k.size IS NULL THEN 'new' WHEN d.size IS NULL THEN 'deleted' WHEN d.size <> k.size OR d.mtime_ns <> k.mtime_ns THEN 'changed' ELSE 'unchanged' END AS state FROM {DISK} d FULL JOIN {KNOWN} k USING (path))"
SINCE = "ts_unix_ns >= 1705276800000000000"


def bodies() -> dict[str, str]:
    needle = low("'WIDGET'")
    raw = f"contains({low('file_path')}, 'src1') AND contains({low('module')}, 'src2')"
    reach = ", reach AS (SELECT DISTINCT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)"
    scc = "SELECT r.a AS node, min(q.b) AS component FROM reach r JOIN reach q ON q.a = r.a AND EXISTS (SELECT 1 FROM reach z WHERE z.a = q.b AND z.b = q.a) WHERE r.a = r.b GROUP BY 1 HAVING count(DISTINCT q.b) > 1"
    return {
        "hotspots": """SELECT name, CAST(sum(n) AS BIGINT) AS callers, min(spot).f AS path, min(spot).l AS line FROM (SELECT callee_name AS name, count(*) AS n, any_value(spot) AS spot
          FROM calls JOIN defs USING (callee_name, is_method) WHERE defs = 1 GROUP BY callee_name, is_method) GROUP BY name ORDER BY callers DESC, name LIMIT 15""",
        "counts": "SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols",
        "files_per_language": "SELECT language, count(*) AS files FROM files GROUP BY 1",
        "symbol_counts_by_file": "SELECT file_path, count(*) AS total, CAST(sum(CASE WHEN kind IN ('key', 'section') THEN 0 ELSE 1 END) AS BIGINT) AS code FROM symbols GROUP BY 1",
        "symbols_substring": f"SELECT {SYMBOL} FROM symbols WHERE contains({low('name')}, {needle}) ORDER BY {low('name')}, file_path, start_line, start_column, name, kind LIMIT 50",
        "symbols_substring_kind_lang": f"""SELECT {SYMBOL} FROM symbols JOIN files ON path = file_path WHERE contains({low('name')}, {needle}) AND kind = 'function' AND language = 'rust'
          ORDER BY {low('name')}, file_path, start_line, start_column, name, kind LIMIT 50""",
        "definition_exact": f"SELECT {SYMBOL} FROM symbols WHERE name = 'red_widget' AND kind IN ({DEF_KINDS}) ORDER BY file_path, start_line, start_column, kind LIMIT 50",
        "definition_near_miss": f"SELECT DISTINCT name FROM symbols WHERE {low('name')} = 'red_widget' AND name <> 'RED_WIDGET' AND kind IN ({DEF_KINDS}) ORDER BY name LIMIT 3",
        "outline_file": f"""SELECT {', '.join('s.' + c.strip() for c in SYMBOL.split(','))}, s.visibility, CAST((SELECT count(*) FROM symbols o WHERE o.file_path = s.file_path
          AND (o.start_line, o.start_column) <= (s.start_line, s.start_column) AND (o.end_line, o.end_column) >= (s.end_line, s.end_column)
          AND (o.start_line, o.start_column, o.end_line, o.end_column) <> (s.start_line, s.start_column, s.end_line, s.end_column)) AS INTEGER) AS depth
          FROM symbols s WHERE file_path = (SELECT path FROM files_ WHERE doc_id = 0)""",
        "context_window": f"""SELECT {', '.join('s.' + c.strip() for c in SYMBOL.split(','))}, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (line_no < start_line), '') AS before,
          coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (line_no BETWEEN start_line AND end_line), '') AS body,
          coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (line_no > end_line), '') AS after
          FROM (SELECT * FROM symbols WHERE name = 'red_widget' ORDER BY strlen(file_path), file_path, start_line, start_column, kind LIMIT 3) s
          LEFT JOIN lines ON path = file_path AND line_no BETWEEN start_line - 5 AND end_line + 5 GROUP BY ALL""",
        "callers_of": f"SELECT {EDGE} FROM up_edges WHERE callee_name = 'red_widget' ORDER BY {EDGE_ORDER} LIMIT 50",
        "callees_of": f"SELECT {EDGE} FROM down_edges WHERE caller_name = 'red_widget' ORDER BY {EDGE_ORDER} LIMIT 50",
        "callers_resolved_only": f"SELECT {EDGE} FROM up_edges WHERE callee_name = (SELECT min(callee_name) FROM (SELECT callee_name FROM defs GROUP BY callee_name HAVING max(defs) = 1)) AND NOT ambiguous AND callee_file IS NOT NULL",
        "callees_resolved_only": f"SELECT {EDGE} FROM down_edges WHERE caller_name = 'red_widget' AND NOT ambiguous AND callee_file IS NOT NULL ORDER BY {EDGE_ORDER} LIMIT 50",
        "resolved_pairs": "SELECT caller_name, callee_name FROM pairs",
        "located_edges": "SELECT * FROM located",
        "deadcode": _dead(limit="LIMIT 50"),
        "deadcode_lang": _dead("language = 'rust'"),
        "public_api": "SELECT file_path, name, kind, start_line FROM symbols WHERE visibility = 'public' AND kind NOT IN ('key', 'section', 'field', 'variable')",
        "public_api_by_dir": """SELECT dir, count(*) AS count, array_to_string(list_sort(list(entry))[1:12], ',') AS symbols FROM (
          SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, name || ':' || kind AS entry FROM symbols WHERE visibility = 'public' AND kind NOT IN ('key', 'section', 'field', 'variable'))
          GROUP BY dir ORDER BY count DESC, dir LIMIT 20""",
        "entry_points": f"""SELECT name, kind, file_path AS path, start_line AS line FROM symbols WHERE name = 'main' AND kind IN ('function', 'method')
          UNION ALL SELECT DISTINCT regexp_extract(path, '[^/]*$'), 'entry', path, 1 FROM files WHERE {' OR '.join(f"{low('path')} LIKE '%/{b}' OR path = '{b}'" for b in schema.BOOTSTRAP_FILES)}""",
        "module_stats": """SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files, CAST(sum(coalesce(code, 0)) AS BIGINT) AS code_symbols, CAST(sum(coalesce(total, 0)) AS BIGINT) AS symbols, CAST(sum(size) AS BIGINT) AS bytes
          FROM files LEFT JOIN (SELECT file_path, count(*) AS total, sum(CASE WHEN kind IN ('key', 'section') THEN 0 ELSE 1 END) AS code FROM symbols GROUP BY 1) ON file_path = path
          GROUP BY 1 ORDER BY code_symbols DESC, symbols DESC, dir LIMIT 30""",
        "deps_of": "SELECT file_path, module, site_line, site_column FROM imports WHERE file_path = (SELECT path FROM files_ WHERE doc_id = 1)",
        "rdeps_of": f"SELECT file_path, module, site_line, site_column FROM imports WHERE contains({low('module')}, 'pkg_')",
        "imports_under": f"SELECT file_path, module, site_line, site_column FROM imports WHERE contains({low('file_path')}, 'src1/')",
        "boundary_raw": f"SELECT file_path, module, site_line, site_column FROM imports WHERE {raw}",
        "boundary_union": f"""SELECT file_path, module, site_line, site_column FROM imports WHERE {raw} UNION ALL
          SELECT i.file_path, i.module, i.site_line, min(i.site_column) FROM imports i JOIN resolved r ON r.file_path = i.file_path AND r.module = i.module
          WHERE contains({low('i.file_path')}, 'src1') AND contains(r.target, 'src2') AND NOT contains({low('i.module')}, 'src2') GROUP BY 1, 2, 3""",
        "boundary_unresolved_count": f"""SELECT count(*) AS unresolved FROM imports i JOIN resolved r ON r.file_path = i.file_path AND r.module = i.module
          WHERE contains({low('i.file_path')}, 'src1') AND NOT starts_with(i.module, '.') AND target IS NULL""",
        "resolve_imports": "SELECT file_path, module, target FROM resolved",
        "external_import_count": "SELECT count(*) AS external FROM imports i JOIN resolved r ON r.file_path = i.file_path AND r.module = i.module WHERE target IS NULL",
        "page_link_deps": "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS module FROM pages",
        "import_scc": f", e AS (SELECT source AS a, target AS b FROM graph){reach} {scc}",
        "cycle_nodes": f", e AS (SELECT caller_name AS a, callee_name AS b FROM pairs){reach} {scc}",
        "module_levels": """, e AS (SELECT source AS a, target AS b FROM graph WHERE source < target),
          up AS (SELECT DISTINCT b AS n, 0 AS k FROM e UNION SELECT e.a, k + 1 FROM up JOIN e ON e.b = up.n)
          SELECT n AS node, CAST(max(k) AS INTEGER) AS level FROM up GROUP BY n""",
        "module_is_cyclic": f""", e AS (SELECT source AS a, target AS b FROM graph){reach} SELECT (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) AS files, (SELECT count(*) FROM e) AS edges,
          EXISTS (SELECT 1 FROM reach WHERE a = b) AS cyclic,
          (SELECT count(*) FROM imports i JOIN resolved r ON r.file_path = i.file_path AND r.module = i.module WHERE target IS NULL) AS external""",
        "callgraph_down": _walk("red_widget", 3, ("down",)),
        "callgraph_up": _walk("red_widget", 3, ("up",)),
        "callgraph_both": _walk("red_widget", 3, ("down", "up")),
        "impact": _walk("blue_bolt", 3, ("up",)),
        "changed_symbols": f", {CHANGED} SELECT name, path, line, kind FROM changed",
        "changed_impact": f""", {CHANGED}, steps AS (SELECT DISTINCT name AS n, 0 AS d FROM changed UNION SELECT h.n, d + 1 FROM steps JOIN (SELECT DISTINCT caller_name AS n, callee_name AS o FROM edges) h ON h.o = steps.n WHERE d < 12),
          dist AS (SELECT n, min(d) AS d FROM steps GROUP BY n)
          SELECT caller_name AS name, caller_file AS path, caller_line AS line, min(caller_kind) AS kind, CAST(min(d) + 1 AS INTEGER) AS depth FROM edges JOIN dist ON n = callee_name GROUP BY 1, 2, 3""",
        "edge_weights": "SELECT a, b, weight FROM weights",
        "degree_rank": "SELECT label, file, line, degree FROM degrees ORDER BY degree DESC, label, file LIMIT 15",
        "node_degrees": "SELECT * FROM degrees",
        "export_edges": """SELECT caller_name || chr(1) || caller_file || chr(1) || caller_line AS source,
          CASE WHEN callee_defs = 1 THEN callee_name || chr(1) || callee_file || chr(1) || callee_line ELSE callee_name || chr(1) || '?' END AS target, callee_defs <> 1 AS ambiguous FROM located""",
        "export_nodes": """SELECT key, name, file, line, count(*) AS degree FROM (
          SELECT caller_name || chr(1) || caller_file || chr(1) || caller_line AS key, caller_name AS name, caller_file AS file, caller_line AS line FROM located UNION ALL
          SELECT CASE WHEN callee_defs = 1 THEN callee_name || chr(1) || callee_file || chr(1) || callee_line ELSE callee_name || chr(1) || '?' END, callee_name, callee_file, callee_line FROM located) GROUP BY 1, 2, 3, 4""",
        "gain_totals": f"SELECT * FROM {_sums('', SINCE)}",
        "gain_per_command": f"SELECT * FROM {_sums('command')}",
        "gain_top_saved": f"SELECT * FROM {_sums('command', SINCE)} ORDER BY saved DESC, command LIMIT 3",
        "gain_top_ratio": f"SELECT * FROM {_sums('command')} ORDER BY reduction DESC, command LIMIT 3",
        "gain_recent": "SELECT ts_unix_ns, command, candidate_bytes, returned_tokens FROM usage ORDER BY ts_unix_ns DESC, seq DESC LIMIT 20",
        "gain_history": f"""SELECT ts_unix_ns, command, estimated_baseline_tokens, returned_tokens, saved, reduction, strftime(make_timestamp(ts_unix_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS recorded_at
          FROM (SELECT ts_unix_ns, command, b AS estimated_baseline_tokens, r AS returned_tokens, {SAVED} FROM (SELECT *, estimated_baseline_tokens AS b, returned_tokens AS r FROM usage ORDER BY ts_unix_ns DESC, seq DESC LIMIT 50))
          WHERE {SINCE}""",
        "gain_baseline": "SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files WHERE path IN (SELECT file_path FROM imports)",
        "text_search": """SELECT path, line_no AS line, CASE WHEN length(trim(text, ' ')) > 200 THEN left(trim(text, ' '), 200) || '…' ELSE trim(text, ' ') END AS text FROM (
          SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE contains(text, 'with') AND path IN (SELECT DISTINCT path FROM lines WHERE contains(text, 'with') ORDER BY path LIMIT 40)) WHERE n <= 8""",
        "search_provenance": f""", hit AS (SELECT path, line_no AS line, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS n FROM lines WHERE contains(text, 'ing')
            AND path IN (SELECT DISTINCT path FROM lines WHERE contains(text, 'ing') ORDER BY path LIMIT 40)) WHERE n <= 8),
          st AS (SELECT {SYMBOL} FROM symbols WHERE contains({low('name')}, 'ing') ORDER BY {low('name')}, file_path, start_line, start_column, name, kind LIMIT 50)
          SELECT 'structural' AS source, file_path AS path, start_line AS line, name, kind, NULL AS text FROM st UNION ALL
          SELECT CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.callee_name = 'ing' AND e.caller_file = hit.path AND e.site_line = hit.line) THEN 'reference' ELSE 'textual' END, path, line, NULL, NULL,
            CASE WHEN length(trim(text, ' ')) > 200 THEN left(trim(text, ' '), 200) || '…' ELSE trim(text, ' ') END
          FROM hit WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.file_path = hit.path AND st.start_line = hit.line)""",
        "edge_groups": """SELECT caller_name AS name, count(DISTINCT CASE WHEN callee_file IS NOT NULL AND NOT ambiguous THEN (callee_name, callee_file, callee_line, callee_kind) END) AS internal,
          count(DISTINCT CASE WHEN callee_file IS NOT NULL AND ambiguous THEN callee_name END) AS ambiguous_names,
          count(DISTINCT CASE WHEN callee_file IS NOT NULL AND ambiguous THEN (callee_name, callee_file, callee_line, callee_kind) END) AS candidates,
          count(DISTINCT CASE WHEN callee_file IS NULL THEN callee_name END) AS external FROM down_edges GROUP BY 1""",
        "caller_groups": """SELECT name, string_agg(caller_name || '@' || caller_file || ':' || caller_line, ',' ORDER BY n) AS internal FROM (
          SELECT *, row_number() OVER (PARTITION BY name ORDER BY spot, caller_file, caller_line, caller_name, caller_kind) AS n FROM (
            SELECT callee_name AS name, caller_file, caller_line, caller_name, caller_kind, min(struct_pack(a := caller_file, b := caller_line, c := site_line, d := site_column)) AS spot FROM edges GROUP BY 1, 2, 3, 4, 5)) WHERE n <= 50 GROUP BY name""",
        "status_delta": f", {STATE} SELECT count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'deleted') AS deleted FROM state",
        "index_delta": f", {STATE} SELECT path FROM state WHERE state IN ('new', 'changed')",
        "index_summary": f", {STATE} SELECT count(*) FILTER (state IN ('new', 'changed')) AS indexed, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'deleted') AS removed FROM state",
        "prune": f", {STATE} SELECT {SYMBOL}, visibility FROM symbols WHERE file_path NOT IN (SELECT path FROM state WHERE state = 'deleted')",
        "upsert_merge": f", {STATE} SELECT {SYMBOL}, CASE WHEN file_path IN (SELECT path FROM state WHERE state IN ('new', 'changed')) THEN 'fresh' ELSE visibility END AS visibility FROM symbols",
        "minified_guard": "SELECT path, max(strlen(text)) > 5000 AS minified FROM lines GROUP BY path",
        "size_cap": "SELECT path FROM files WHERE size <= 2000",
        "language_detect": "SELECT path, CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'tsx' THEN 'tsx' WHEN 'sh' THEN 'bash' END AS language FROM files",
        "dedupe_overlaps": """SELECT file_path, name, kind, start_line, end_line, partkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY file_path, e ORDER BY CASE kind WHEN 'method' THEN 10 WHEN 'macro' THEN 9 WHEN 'class' THEN 7
          WHEN 'function' THEN 2 ELSE 1 END DESC, partkey) AS n FROM (SELECT * REPLACE (0 AS start_line, e AS end_line, 0 AS end_column) FROM (SELECT *, CAST(partkey % 3 AS INTEGER) AS e FROM symbols_))) WHERE n = 1""",
    }


#: Facts of the sample sources, counted by hand: language, values, lines from the end of the empty lines on.
SAMPLE_SYMBOLS = """('rust', 'S{k}', 'class', 1, 0, 1, 'pub struct S{k};', 'public'), ('rust', '{n}', 'method', 3, 4, 6, '    }', 'private'), ('go', 'T{k}', 'type', 2, 5, 3, '}', 'public'),
  ('go', 'F{k}', 'function', 4, 0, 7, '}', 'public'), ('python', 'C{k}', 'class', 1, 0, 4, '        self.{n}_x()', 'unknown'), ('python', '{n}', 'function', 2, 4, 4, '        self.{n}_x()', 'unknown'),
  ('typescript', 'C{k}', 'class', 1, 7, 6, '}', 'public'), ('typescript', '{n}', 'method', 2, 2, 5, '  }', 'private'), ('java', 'C{k}', 'class', 1, 0, 7, '}', 'unknown'), ('java', '{n}', 'method', 3, 2, 6, '  }', 'unknown')"""
SAMPLE_CALLS = """('rust', '{n}', 3, 'helper_{k}', 4, 8, FALSE), ('rust', '{n}', 3, '{n}_x', 5, 13, TRUE), ('go', 'F{k}', 4, 'helper_{k}', 5, 1, FALSE), ('go', 'F{k}', 4, '{n}', 6, 3, TRUE),
  ('python', '{n}', 2, 'helper_{k}', 3, 13, FALSE), ('python', '{n}', 2, '{n}_x', 4, 13, TRUE), ('typescript', '{n}', 2, 'helper_{k}', 3, 4, FALSE), ('typescript', '{n}', 2, '{n}_x', 4, 9, TRUE),
  ('java', '{n}', 3, 'helper_{k}', 4, 4, FALSE), ('java', '{n}', 3, '{n}_x', 5, 9, TRUE)"""
SAMPLE_IMPORTS = """('rust', 'crate::dep_{k}', 0, 4), ('go', 'dep/{n}', 1, 7), ('python', 'dep_{k}', 0, 7), ('typescript', './dep_{k}', 0, 19), ('java', 'dep.D{k}', 0, 7)"""
SAMPLE = """, code AS (
  SELECT 'part/f' || p_partkey || '.' || (['rs', 'go', 'py', 'ts', 'java'])[p_partkey % 5 + 1] AS file_path, (['rust', 'go', 'python', 'typescript', 'java'])[p_partkey % 5 + 1] AS lang, CAST(p_size % 7 AS INTEGER) AS lead,
    CAST(p_partkey AS VARCHAR) AS k, replace(p_name, ' ', '_') || '_' || p_partkey AS n FROM part
)"""


def _named(text: str) -> str:
    return f"replace(replace({text}, '{{k}}', k), '{{n}}', n)"


def more_bodies() -> dict[str, str]:
    unit = "(['d', 'h', 'm', 's'])[event_id % 4 + 1]"
    state = STATE.replace(KNOWN, "(SELECT path, mtime_ns, size FROM files_)")
    hit = f""", shown AS (SELECT DISTINCT path FROM lines WHERE contains(text, 'ing') ORDER BY path LIMIT 40),
      st AS (SELECT file_path FROM symbols WHERE contains({low('name')}, 'ing') ORDER BY {low('name')}, file_path, start_line, start_column, name, kind LIMIT 50)"""
    scc = bodies()["import_scc"]
    cut = scc.index("SELECT r.a AS node")
    filled = "CAST(floor(p / 5.0 + 0.5) AS INTEGER)"
    tenths = lambda unit: f"printf('%.1f', round_even(abs(n) * 10.0 / {unit}, 0) / 10)"
    return {
        "extract_symbols": f"""{SAMPLE} SELECT file_path, {_named('f.name')} AS name, kind, CAST(lead + sl AS INTEGER) AS start_line, sc AS start_column, CAST(lead + el AS INTEGER) AS end_line,
          CAST(strlen({_named('last')}) AS INTEGER) AS end_column, visibility FROM code JOIN (VALUES {SAMPLE_SYMBOLS}) f(lang, name, kind, sl, sc, el, last, visibility) USING (lang)""",
        "extract_calls": f"""{SAMPLE} SELECT file_path, {_named('caller')} AS caller_name, CAST(lead + cl AS INTEGER) AS caller_start_line, {_named('callee')} AS callee_name, CAST(lead + sl AS INTEGER) AS site_line, sc AS site_column, is_method
          FROM code JOIN (VALUES {SAMPLE_CALLS}) f(lang, caller, cl, callee, sl, sc, is_method) USING (lang)""",
        "extract_imports": f"{SAMPLE} SELECT file_path, {_named('m')} AS module, CAST(lead + sl AS INTEGER) AS site_line, sc AS site_column FROM code JOIN (VALUES {SAMPLE_IMPORTS}) f(lang, m, sl, sc) USING (lang)",
        "extract_deep_keys": """SELECT 's' || s_suppkey || '.json' AS file_path, name, line AS start_line, CAST(c AS INTEGER) AS start_column, line AS end_line, CAST(e AS INTEGER) AS end_column, deep FROM (
          SELECT s_suppkey, 's' || s_suppkey AS name, 1 AS line, 2 AS c, 20 + 3 * strlen(CAST(s_suppkey AS VARCHAR)) AS e, unnest([FALSE, TRUE]) AS deep FROM supplier
          UNION ALL SELECT s_suppkey, 'inner' || s_suppkey, 1, 8 + strlen(CAST(s_suppkey AS VARCHAR)), 19 + 3 * strlen(CAST(s_suppkey AS VARCHAR)), TRUE FROM supplier
          UNION ALL SELECT s_suppkey, 'plain', 2, 2, 16, unnest([FALSE, TRUE]) FROM supplier)""",
        "utf8_filter": "SELECT 's' || s_suppkey AS path, s_name || 'é' AS text FROM supplier WHERE s_suppkey % 7 NOT IN (3, 5)",
        "diff_hunks": "SELECT 'c' || c_custkey || '.rs' AS path, CAST(c_custkey % 90 + 1 AS INTEGER) AS start, CAST(c_custkey % 90 + c_custkey % 4 AS INTEGER) AS \"end\" FROM customer WHERE c_custkey % 4 > 0",
        "path_aliases": """SELECT 'tsconfig.' || s_suppkey || '.json' AS path, '@s' || s_suppkey || '/' AS key, 'b' || s_suppkey || '/src' || s_suppkey || '/' AS replacement, TRUE AS wildcard FROM supplier
          UNION ALL SELECT 'tsconfig.' || s_suppkey || '.json', 'one', 'b' || s_suppkey || '/// no comment', FALSE FROM supplier""",
        "usage_formats": f"""SELECT event_id, seconds, 'last ' || q || ' ' || u || CASE WHEN q = 1 THEN '' ELSE 's' END AS label, format('{{:,}}', n) AS thousands,
            CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN abs(n) >= 1000000000 THEN {tenths(1000000000)} || 'G' WHEN abs(n) >= 1000000 THEN {tenths(1000000)} || 'M' WHEN abs(n) >= 1000 THEN {tenths(1000)} || 'K' ELSE CAST(abs(n) AS VARCHAR) END AS short,
            repeat('█', {filled}) || repeat('░', 20 - {filled}) AS meter, CASE WHEN event_id % 2 = 0 THEN event_type || '/a.b' ELSE '''' || event_type || '''\\''''s x''' END AS quoted,
            CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag
          FROM (SELECT *, CASE WHEN seconds % 86400 = 0 THEN seconds // 86400 WHEN seconds % 3600 = 0 THEN seconds // 3600 WHEN seconds % 60 = 0 THEN seconds // 60 ELSE seconds END AS q,
            CASE WHEN seconds % 86400 = 0 THEN 'day' WHEN seconds % 3600 = 0 THEN 'hour' WHEN seconds % 60 = 0 THEN 'minute' ELSE 'second' END AS u FROM (
            SELECT *, (user_id % 90 + 1) * CASE {unit} WHEN 'd' THEN 86400 WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END AS seconds, event_id * event_id * (user_id - 3) AS n, event_id % 101 AS p FROM events))""",
        "rotate_cycle": """SELECT o_orderkey, CASE least(a, b, c) WHEN a THEN array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END], lambda x: x IS NOT NULL), ',')
            WHEN b THEN array_to_string(list_filter([b, CASE WHEN c <> a AND c <> b THEN c END, a], lambda x: x IS NOT NULL), ',') ELSE array_to_string(list_filter([c, a, CASE WHEN b <> a THEN b END], lambda x: x IS NOT NULL), ',') END AS cycle
          FROM (SELECT o_orderkey, 'n' || o_orderkey AS a, 'n' || o_custkey AS b, 'n' || (o_orderkey * 7 % 1000) AS c FROM orders)""",
        "replace_calls": f", {STATE} SELECT * REPLACE (CASE WHEN file_path IN (SELECT path FROM state WHERE state IN ('new', 'changed')) THEN 'fresh' ELSE resolution END AS resolution) FROM calls",
        "replace_imports": f", {STATE} SELECT *, CASE WHEN file_path IN (SELECT path FROM state WHERE state IN ('new', 'changed')) THEN 'fresh' ELSE 'syntactic' END AS resolution FROM imports",
        "append_usage": """SELECT command, count(*) AS invocations, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(e) AS BIGINT) AS baseline FROM (
          SELECT command, candidate_bytes AS b, estimated_baseline_tokens AS e FROM usage UNION ALL SELECT 'outline', size, size // 4 FROM files) GROUP BY command""",
        "stale_symbols": f", {state} SELECT file_path, name, start_line, file_path IN (SELECT path FROM state WHERE state IN ('changed', 'deleted')) AS stale FROM symbols",
        "search_paths": f"{hit} SELECT path FROM shown UNION SELECT file_path FROM st",
        "import_cycles": f"{scc[:cut]}, cyc AS ({scc[cut:]}) SELECT string_agg(node, ',' ORDER BY node) AS members FROM cyc GROUP BY component",
        "callees_listed": """, c AS (SELECT caller_name AS name, callee_name AS callee, callee_file AS f, callee_line AS l, callee_kind AS kd, ambiguous, min(struct_pack(a := caller_file, b := caller_line, c := site_line, d := site_column, e := callee_file, f := callee_line)) AS spot
            FROM down_edges GROUP BY 1, 2, 3, 4, 5, 6),
          inside AS (SELECT name, string_agg(callee || '@' || f || ':' || l, ',' ORDER BY n) AS internal FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY spot, f, l, callee, kd) AS n FROM c WHERE f IS NOT NULL AND NOT ambiguous) WHERE n <= 50 GROUP BY name),
          several AS (SELECT name, string_agg(callee || '=' || m, ',' ORDER BY callee) AS ambiguous FROM (SELECT name, callee, count(*) AS m FROM c WHERE f IS NOT NULL AND ambiguous GROUP BY 1, 2) GROUP BY name),
          outside AS (SELECT name, count(DISTINCT callee) AS x FROM c WHERE f IS NULL GROUP BY name)
          SELECT name, coalesce(internal, '') AS internal, coalesce(ambiguous, '') AS ambiguous, coalesce(x, 0) AS external_count FROM (SELECT DISTINCT name FROM c) LEFT JOIN inside USING (name) LEFT JOIN several USING (name) LEFT JOIN outside USING (name)""",
        "entry_points_first": f"SELECT * FROM ({bodies()['entry_points']}) ORDER BY CASE kind WHEN 'entry' THEN 1 ELSE 0 END, path, line, name LIMIT 15",
        "prime_languages": "SELECT language, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, language LIMIT 6",
        "louvain_placement": "SELECT (SELECT count(*) FROM nodes_) AS nodes, (SELECT count(*) FROM nodes_) AS in_communities, CAST(0 AS BIGINT) AS would_move",
    }


def oracle_sql() -> dict[str, str]:
    return {name: BASE + body for name, body in (bodies() | more_bodies()).items()} | nested_sql()

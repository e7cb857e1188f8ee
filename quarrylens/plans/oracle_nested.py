"""DuckDB SQL of extraction over nested sources: names, spans and call sites by counting lines and columns."""

from __future__ import annotations

from quarrylens.sources.nested_code import NESTS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: One row a level: i, its name ki, the lines before it, and where its declaration begins, ends and stands.
_LEVELS = f"""WITH nests AS (SELECT * FROM (VALUES {", ".join(f"({k}, {', '.join(map(_text, n))})" for k, n in enumerate(NESTS))}) v(l, language, ending, outer_, inner_, calls, close)),
parts AS (SELECT p_partkey AS k, p_size % 4 + 1 AS d, 'nest/f' || p_partkey || '.' || ending AS file_path, nests.* FROM part JOIN nests ON l = p_partkey % {len(NESTS)}),
levels AS (
  SELECT *, k || '_' || i AS ki, replace(calls, '{{i}}', k || '_' || i) AS line, language IN ('cpp', 'java') AS typed, i = 0 OR language NOT IN ('go', 'c') AS declares
  FROM (SELECT *, unnest(range(d)) AS i FROM parts)
)"""

_SYMBOLS = f"""{_LEVELS}
SELECT file_path, CASE WHEN typed THEN 'S' WHEN language = 'go' THEN 'F' ELSE 'f' END || ki AS name, CASE WHEN typed THEN 'class' ELSE 'function' END AS kind, CAST(2 * i AS INTEGER) AS start_line,
  CAST(2 * i + CASE language WHEN 'tsx' THEN 6 ELSE 0 END AS INTEGER) AS start_column, CAST(CASE language WHEN 'python' THEN 2 * d - 1 ELSE 3 * d - 1 - i END AS INTEGER) AS end_line,
  CAST(CASE language WHEN 'python' THEN 2 * d + strlen(replace(calls, '{{i}}', k || '_' || (d - 1))) ELSE 2 * i + 1 END AS INTEGER) AS end_column,
  CASE WHEN language IN ('rust', 'go') THEN 'public' WHEN language IN ('typescript', 'tsx', 'javascript') THEN 'private' ELSE 'unknown' END AS visibility
FROM levels WHERE declares
UNION ALL
SELECT file_path, CASE language WHEN 'cpp' THEN 'operator+' ELSE 'f' || ki END, 'method', CAST(2 * i + 1 AS INTEGER), CAST(2 * i + 2 AS INTEGER), CAST(2 * i + 1 AS INTEGER), CAST(2 * i + 2 + strlen(line) AS INTEGER), 'unknown'
FROM levels WHERE typed
"""

_CALLS = f"""{_LEVELS}
SELECT file_path, CASE WHEN language = 'cpp' THEN 'operator+' WHEN language = 'go' THEN 'F' || k || '_0' WHEN language = 'c' THEN 'f' || k || '_0' ELSE 'f' || ki END AS caller_name,
  CAST(CASE WHEN typed THEN 2 * i + 1 WHEN language IN ('go', 'c') THEN 0 ELSE 2 * i END AS INTEGER) AS caller_start_line, mark || ki AS callee_name, CAST(2 * i + 1 AS INTEGER) AS site_line,
  CAST(2 * i + 2 + strlen(left(line, strpos(line, mark || ki) - 1)) AS INTEGER) AS site_column, mark = 'm' OR language = 'java' AS is_method
FROM levels, (SELECT unnest(['c', 'm']) AS mark)
"""

#: Keys by the lines of their level (YAML: eight lines, the pairs above all reach to the last one) and of their table (TOML: seven lines).
_DATA_KEYS = """WITH levels AS (SELECT *, k || '_' || i AS ki, strlen(k || '_' || i) AS w, 4 * i AS c, CASE k % 2 WHEN 0 THEN 8 ELSE 7 END * i AS r FROM (SELECT p_partkey AS k, p_size % 4 + 1 AS d, unnest(range(p_size % 4 + 1)) AS i FROM part)),
yaml_ AS (
  SELECT k, 'k' || ki AS name, r AS sl, c AS sc, 8 * d - 1 AS el, 4 * (d - 1) + 4 AS ec, i = 0 AS top FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 't', r + 1, c + 2, r + 2, c + 9 + w, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'q:' || ki, r + 4, c + 2, r + 4, c + w + 32, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'e', r + 4, c + w + 9, r + 4, c + w + 13, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'f', r + 4, c + w + 15, r + 4, c + w + 31, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'g', r + 4, c + w + 25, r + 4, c + w + 29, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'u', r + 5, c + 2, r + 6, c + 12, FALSE FROM levels WHERE k % 2 = 0
  UNION ALL SELECT k, 'n', r + 7, c + 2, 8 * d - 1, 4 * (d - 1) + 4, FALSE FROM levels WHERE k % 2 = 0
),
toml_ AS (
  SELECT k, 't' || ki || '."x y"' AS name, r AS sl, 0 AS sc, r + 7 AS el, 0 AS ec, TRUE AS top FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 'k', r + 1, 0, r + 1, 33, FALSE FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 'e', r + 1, 5, r + 1, 10, FALSE FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 'f', r + 1, 12, r + 1, 32, FALSE FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 'g', r + 1, 20, r + 1, 25, FALSE FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 's', r + 2, 0, r + 5, 3, FALSE FROM levels WHERE k % 2 = 1
  UNION ALL SELECT k, 'q r', r + 6, 0, r + 6, 11, FALSE FROM levels WHERE k % 2 = 1
),
keys AS (SELECT 'data/f' || k || '.yaml' AS file_path, * FROM yaml_ UNION ALL SELECT 'data/f' || k || '.toml', * FROM toml_)
SELECT file_path, name, CAST(sl AS INTEGER) AS start_line, CAST(sc AS INTEGER) AS start_column, CAST(el AS INTEGER) AS end_line, CAST(ec AS INTEGER) AS end_column, deep FROM keys, (SELECT unnest([FALSE, TRUE]) AS deep) WHERE deep OR top
"""


def nested_sql() -> dict[str, str]:
    return {"extract_nested_symbols": _SYMBOLS, "extract_nested_calls": _CALLS, "extract_data_keys": _DATA_KEYS}

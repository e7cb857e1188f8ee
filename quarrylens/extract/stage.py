"""The extraction stage: a table of texts to the fact tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.extract import facts as one
from quarrylens.functions.tables import cut
from quarrylens.operators.delta import is_minified

#: One row a fact, told apart by ``fact``; a call's caller stands in end_line, as the line it begins at.
ROW = (
    "fact string, file_path string, name string, kind string, start_line int, start_column int, end_line int, end_column int, visibility string, caller_name string, is_method boolean, "
    "mtime_ns long, size long, language string"
)
_NAMES = [c.strip().split(" ")[0] for c in ROW.split(",")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
_KINDS = [_TYPES[c.strip().split(" ")[1]] for c in ROW.split(",")]
ROWS = 5000
FIXED = "syntactic"


def _extract(deep: bool):
    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for path, language, text, minified, mtime_ns, size in zip(*(batch.column(k).to_pylist() for k in range(6))):
                rows.append(("file", path, *[None] * 9, mtime_ns, size, language))
                if minified:
                    continue
                found, calls, imports = one.facts_of(text, language, deep)
                rows += [("symbol", path, s.name, s.kind, *s.span, s.visibility, *[None] * 5) for s in found]
                rows += [("call", path, c[2], None, c[3], c[4], c[1], None, None, c[0], c[5], None, None, None) for c in calls]
                rows += [("import", path, m, None, line, column, *[None] * 8) for m, line, column in imports]
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], names=_NAMES)


def extracted(texts: DataFrame, deep: bool = False) -> DataFrame:
    """One row each file, symbol, call and import of texts(path, language, text, and mtime_ns and size if known); a minified file has only its own."""
    plain = texts.filter(F.col("text").isNotNull())
    stat = [F.col(c) if c in texts.columns else F.lit(None).cast("long").alias(c) for c in ("mtime_ns", "size")]
    return plain.select("path", "language", "text", is_minified(F.col("text")), *stat).mapInArrow(_extract(deep), ROW)


#: What a row of each table is called, and its columns in those of ROW.
TABLES = {
    "files": ("file", {"path": "file_path", "mtime_ns": "mtime_ns", "size": "size", "language": "language"}),
    "symbols": ("symbol", {c: c for c in ("file_path", "name", "kind", "start_line", "start_column", "end_line", "end_column", "visibility")}),
    "calls": (
        "call",
        {"file_path": "file_path", "caller_name": "caller_name", "caller_start_line": "end_line", "callee_name": "name", "site_line": "start_line", "site_column": "start_column", "resolution": None, "is_method": "is_method"},
    ),
    "imports": ("import", {"file_path": "file_path", "module": "name", "site_line": "start_line", "site_column": "start_column", "resolution": None}),
}


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """The table in rows that are all of its fact."""
    return rows.select(*[F.col(source).alias(c) if source else F.lit(FIXED).alias(c) for c, source in TABLES[name][1].items()])


def rows_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Whole tables as rows."""
    out = None
    for name, df in tables.items():
        fact, columns = TABLES[name]
        back = {source: c for c, source in columns.items() if source}
        kinds = dict(c.strip().split(" ") for c in ROW.split(","))
        rows = df.select(*[(F.lit(fact) if c == "fact" else F.col(back[c]) if c in back else F.lit(None)).cast(kinds[c]).alias(c) for c in _NAMES])
        out = rows if out is None else out.unionByName(rows)
    return out


def extract(texts: DataFrame, deep: bool = False, held: bool = True) -> dict[str, DataFrame]:
    """files (path), symbols, calls and imports of texts(path, language, text); a minified file has none.

    held: what the files give is written once and all tables read that.
    """
    rows = extracted(texts, deep)
    if held:
        rows = cut(rows, "extracted")
    found = {name: table_of(rows.filter(F.col("fact") == fact), name) for name, (fact, _) in TABLES.items()}
    return found | {"files": found["files"].select("path")}

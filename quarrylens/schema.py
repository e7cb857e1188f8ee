"""Fact-table schemas and the fixed vocabularies of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 9


def _struct(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, n == "query") for n, t in cols.items()])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
FILES = _struct(path=_S, mtime_ns=_L, size=_L, language=_S)
SYMBOLS = _struct(file_path=_S, name=_S, kind=_S, start_line=_I, start_column=_I, end_line=_I, end_column=_I, visibility=_S)
CALLS = _struct(file_path=_S, caller_name=_S, caller_start_line=_I, callee_name=_S, site_line=_I, site_column=_I, resolution=_S, is_method=_B)
IMPORTS = _struct(file_path=_S, module=_S, site_line=_I, site_column=_I, resolution=_S)
USAGE = _struct(ts_unix_ns=_L, command=_S, candidate_files=_I, candidate_bytes=_L, estimated_baseline_tokens=_L, returned_tokens=_L, output_format=_S, query=_S)
TABLES = {"files": FILES, "symbols": SYMBOLS, "calls": CALLS, "imports": IMPORTS, "usage": USAGE}

# Kinds, and which of them count where.
KINDS = ("function", "method", "class", "interface", "trait", "struct", "enum", "type", "module", "macro", "constant", "variable", "field", "section", "key", "other")
DEFINITION_KINDS = ("function", "method", "class", "interface", "type", "module", "macro", "constant")
FREE_CALLEE_KINDS = ("function", "method", "macro")
DATA_KINDS = ("key", "section")
PRIVATE_SURFACE_KINDS = ("key", "section", "field", "variable")
KIND_PRIORITY = {
    "method": 10, "macro": 9, "constant": 8, "class": 7, "interface": 7, "trait": 7, "struct": 7, "enum": 7, "module": 6, "type": 5, "field": 4,
    "variable": 3, "function": 2, "section": 1, "key": 1, "other": 0,
}

# Method names of host languages that never bind to a repository method.
BUILTIN_METHODS = (
    "get", "set", "has", "delete", "push", "pop", "shift", "unshift", "map", "filter", "forEach", "reduce", "find", "findIndex", "some", "every", "join",
    "split", "slice", "splice", "concat", "flat", "keys", "values", "entries", "on", "off", "once", "emit", "then", "catch", "finally", "add", "remove",
    "clear", "toString", "valueOf", "call", "apply", "bind", "test", "exec", "match", "replace", "includes", "indexOf", "startsWith", "endsWith", "next",
    "log", "warn", "error", "info", "debug",
)

# Language, extensions, coverage, whether calls and imports are extracted.
LANGUAGES: tuple[tuple[str, tuple[str, ...], str, bool], ...] = (
    ("rust", ("rs",), "full", True),
    ("go", ("go",), "full", True),
    ("python", ("py",), "full", True),
    ("typescript", ("ts",), "full", True),
    ("tsx", ("tsx",), "full", True),
    ("javascript", ("js", "jsx", "mjs", "cjs"), "full", True),
    ("c", ("c", "h"), "full", True),
    ("cpp", ("cc", "cpp", "cxx", "hpp", "hh", "hxx"), "full", True),
    ("java", ("java",), "full", True),
    ("ruby", ("rb",), "full", False),
    ("csharp", ("cs",), "full", False),
    ("php", ("php", "phtml"), "full", False),
    ("lua", ("lua",), "full", False),
    ("kotlin", ("kt", "kts"), "full", False),
    ("swift", ("swift",), "full", False),
    ("markdown", ("md", "markdown"), "full", False),
    ("json", ("json",), "partial", False),
    ("yaml", ("yaml", "yml"), "partial", False),
    ("toml", ("toml",), "partial", False),
    ("bash", ("sh", "bash"), "partial", False),
)
EXTENSIONS = {ext: slug for slug, exts, _, _ in LANGUAGES for ext in exts}
CALL_LANGUAGES = tuple(slug for slug, _, _, calls in LANGUAGES if calls)
PARTIAL_LANGUAGES = tuple(slug for slug, _, cover, _ in LANGUAGES if cover == "partial")

# Suffixes tried for a specifier, in order; then the same after /index.
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts", ".rs", ".py", ".go")

# What a path may not look like for a dead-code candidate (ASCII case-insensitive), and bootstrap modules.
TEST_PATH_SUFFIXES = (".d.ts",)
TEST_PATH_PARTS = (".test.", ".spec.", "_test.", "/tests/", "/test/")
TEST_PATH_PREFIXES = ("tests/", "test/")
BOOTSTRAP_FILES = ("main.tsx", "main.jsx", "main.ts", "main.js", "index.tsx", "index.jsx")

MAX_FILE_BYTES = 2 * 1024 * 1024
MAX_LINE_BYTES = 5000

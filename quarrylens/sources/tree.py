"""Sources outside tables: a file tree, Git diffs, TypeScript path aliases."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections import deque
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import schema
from quarrylens.functions.tables import cut
from quarrylens.operators.delta import with_language

PRUNED = (".git", ".quarrylens")
READ_BYTES = 8 << 20
#: Folders that the driver lists before tasks take over.
DRIVER_FOLDERS = 2000


def _rules(path: str) -> list[tuple[str, bool, bool]]:
    """(pattern, negated, folders only) of an ignore file."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().split("\n")
    except (OSError, UnicodeDecodeError):
        return []
    out = []
    for line in lines:
        line = line.rstrip()
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            line = line[negated:].removeprefix("\\")
            out.append((line.rstrip("/"), negated, line.endswith("/")))
    return out


def _global_excludes() -> str:
    """The file that Git reads ignore rules of all repositories from."""
    try:
        done = subprocess.run(["git", "config", "--global", "--path", "core.excludesFile"], capture_output=True, text=True, check=False)
        named = done.stdout.strip()
    except OSError:
        named = ""
    return named or os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git", "ignore")


def _ignored(rel: str, is_dir: bool, rules: list[tuple[str, str, bool, bool]]) -> bool:
    """The last rule that matches decides; a pattern with a slash is anchored at its own folder."""
    verdict = False
    for base, pattern, negated, folders in rules:
        if folders and not is_dir:
            continue
        inner = rel[len(base) + 1 :] if base else rel
        if base and not rel.startswith(base + "/"):
            continue
        if "/" in pattern:
            hit = _glob(inner, pattern.lstrip("/"))
        else:
            hit = fnmatchcase(inner.rsplit("/", 1)[-1], pattern)
        if hit:
            verdict = not negated
    return verdict


def _glob(path: str, pattern: str) -> bool:
    parts = re.split(r"(\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\])", pattern)
    made = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or (f"(?!/)[{'^' if p[1] == '!' else ''}{p[1 + (p[1] == '!') : -1]}]" if p[:1] == "[" and p[-1:] == "]" else re.escape(p)) for p in parts)
    return re.fullmatch(made, path) is not None


def _listed(root: str, rel: str, weak: list, strong: list) -> tuple[list[tuple], list[tuple[str, int, int]]]:
    """The folders below one, with the rules that hold in them, and its files."""
    folder = os.path.join(root, rel) if rel else root
    weak = weak + [(rel, *r) for r in _rules(os.path.join(folder, ".gitignore"))]
    strong = strong + [(rel, *r) for r in _rules(os.path.join(folder, ".ignore"))]
    rules, folders, files = weak + strong, [], []
    with os.scandir(folder) as entries:
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink() or e.name in PRUNED or _ignored(path, e.is_dir(), rules):
                continue
            if e.is_dir():
                folders.append((path, weak, strong))
            elif e.is_file():
                st = e.stat()
                files.append((path, st.st_mtime_ns, st.st_size))
    return folders, files


def _walked(root: str, most: int | None) -> tuple[list[tuple], list[tuple[str, int, int]]]:
    """What is left to list after ``most`` folders, and the files found."""
    first = [("", *r) for at in (_global_excludes(), os.path.join(root, ".git", "info", "exclude")) for r in _rules(at)]
    work = deque([("", first, [])])
    found: list[tuple[str, int, int]] = []
    listed = 0
    while work and (most is None or listed < most):
        folders, files = _listed(root, *work.popleft())
        work += folders
        found += files
        listed += 1
    return list(work), found


def walk(root: str) -> list[tuple[str, int, int]]:
    """(path, mtime_ns, size) of the files below a folder, by path: hidden ones too, ignored ones and links not.

    Rules come from Git's global file, the repository's own exclude file, and each folder's `.gitignore` and `.ignore`; later ones
    count more, and those of `.ignore` more than all others.
    """
    return sorted(_walked(root, None)[1])


_RULES = "array<struct<base:string,pattern:string,negated:boolean,folders:boolean>>"
_ENTRY = f"path string, mtime_ns long, size long, weak {_RULES}, strong {_RULES}"
_RULE_LIST = pa.list_(pa.struct([("base", pa.string()), ("pattern", pa.string()), ("negated", pa.bool_()), ("folders", pa.bool_())]))


def _list_folders(root: str):
    """Folders with their rules to the entries in them; a folder has no size."""
    keys = ("base", "pattern", "negated", "folders")
    as_rows = lambda rules: [dict(zip(keys, r, strict=True)) for r in rules]

    def run(batches):
        for batch in batches:
            rows = []
            for path, weak, strong in zip(*(batch.column(c).to_pylist() for c in ("path", "weak", "strong")), strict=True):
                try:
                    folders, files = _listed(root, path, [tuple(r[k] for k in keys) for r in weak], [tuple(r[k] for k in keys) for r in strong])
                except OSError:  # it went in the meantime
                    continue
                rows += [(p, None, None, as_rows(w), as_rows(s)) for p, w, s in folders] + [(*f, None, None) for f in files]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), _RULE_LIST, _RULE_LIST)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["path", "mtime_ns", "size", "weak", "strong"])

    return run


def tree_files(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """path, mtime_ns, size of what `walk` finds.

    The driver lists the first folders; those that are left then are listed by tasks, a level at a time, with the rules that they inherit as rows.
    """
    root = os.path.abspath(root).rstrip("/") or "/"
    left, found = _walked(root, DRIVER_FOLDERS if most is None else most)
    columns = ["path", "mtime_ns", "size"]
    files = spark.createDataFrame(sorted(found), "path string, mtime_ns long, size long")
    if not left:
        return files
    frontier = spark.createDataFrame([(p, None, None, w, s) for p, w, s in left], _ENTRY)
    while True:
        level = cut(frontier.repartition("path").mapInArrow(_list_folders(root), _ENTRY), "tree")
        files = files.unionByName(level.filter("size is not null").select(*columns))
        frontier = level.filter("size is null")
        if not frontier.limit(1).count():
            return files


def disk_files(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    """path, mtime_ns, size, language of the tree's files in known languages under the size cap; every: of all files, whatever their language."""
    files = tree_files(spark, root).filter(F.col("size") <= schema.MAX_FILE_BYTES)
    return files.withColumn("language", F.lit("")) if every else with_language(files)


def _open_files(root: str):
    """Rows that begin with a path: the same with the file's content at the end; files that cannot be opened are left out."""

    def run(batches):
        for batch in batches:
            rows, content, size = [], [], 0
            for row, path in enumerate(batch.column(0).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        raw = f.read()
                except OSError:
                    continue
                rows.append(row)
                content.append(raw)
                size += len(raw)
                if size > READ_BYTES:
                    yield _contents(batch, rows, content)
                    rows, content, size = [], [], 0
            yield _contents(batch, rows, content)

    return run


def _contents(batch: pa.RecordBatch, rows: list[int], content: list[bytes]) -> pa.RecordBatch:
    kept = batch.take(pa.array(rows, pa.int32()))
    return pa.RecordBatch.from_arrays([*kept.columns, pa.array(content, pa.binary())], names=[*batch.schema.names, "content"])


def read_texts(spark: SparkSession, root: str, paths: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """path, language, text and what is to be kept of some files of the tree; those that are not UTF-8 or hold a zero byte are left out.

    Tasks open the wanted paths and no others, so the root must be a folder that all nodes see.
    """
    root = os.path.abspath(root).rstrip("/")
    wanted = paths.select("path", "language", *keep).repartition("path")
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return readable(wanted.mapInArrow(_open_files(root), f"{head}, content binary")).select("path", "language", "text", *keep)


def _open_windows(root: str):
    """(path, spans) to (path, line_no, text) of the lines in the spans; a file is read up to the last of them."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wanted, last = sorted((s["first"], s["last"]) for s in spans), max(s["last"] for s in spans)
                try:
                    with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                        text = "".join(line for _, line in zip(range(last + 1), _lines(f), strict=False))
                except (OSError, UnicodeDecodeError):
                    continue
                lines = text.split("\n")
                if len(lines) > last + 1:
                    lines = lines[: last + 1]
                rows += [(path, k, line) for k, line in enumerate(lines) if any(a <= k <= b for a, b in wanted)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["path", "line_no", "text"])

    return run


def _lines(f):
    """Lines with their break, which is a line feed and nothing else."""
    held = ""
    while part := f.read(1 << 16):
        *whole, held = (held + part).split("\n")
        yield from (line + "\n" for line in whole)
    yield held


def read_windows(spark: SparkSession, root: str, spans: DataFrame) -> DataFrame:
    """path, line_no, text of the lines first to last, both from 0, of spans(path, first, last); only their files are opened, none further than needed."""
    by_file = spans.groupBy("path").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return by_file.mapInArrow(_open_windows(os.path.abspath(root).rstrip("/")), "path string, line_no int, text string")


def readable(files: DataFrame) -> DataFrame:
    """The files whose content is UTF-8 without a zero byte, with it as ``text``."""
    text = F.col("content").cast("string")
    return files.filter(F.is_valid_utf8("content")).withColumn("text", text).filter(~F.contains("text", F.lit("\0")))


def parse_diff(text: str) -> list[tuple[str, int, int]]:
    """(path, first line, last line) of the new side of each hunk, lines from 1; deletions have none."""
    out, path = [], None
    for line in text.split("\n"):
        if line.startswith("+++ "):
            name = line[4:].strip()
            path = name[2:] if name.startswith("b/") else None
        elif line.startswith("@@") and path is not None:
            m = re.search(r"\+(\d+)(?:,(\d+))?", line)
            count = int(m.group(2)) if m and m.group(2) is not None else 1
            if m and count:
                out.append((path, int(m.group(1)), int(m.group(1)) + count - 1))
    return out


def hunks_of(diffs: DataFrame) -> DataFrame:
    """path, start, end of the hunks of diffs(text)."""

    def run(batches):
        for batch in batches:
            found = [h for text in batch.column(0).to_pylist() for h in parse_diff(text or "")]
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["path", "start", "end"])

    return diffs.select("text").mapInArrow(run, "path string, start int, end int")


def git_hunks(spark: SparkSession, root: str, since: str = "HEAD") -> DataFrame:
    """Changed lines of the working tree against a commit."""
    if since.startswith("-"):
        raise ValueError(f"not a revision: {since}")
    done = subprocess.run(["git", "-C", root, "diff", "--unified=0", "--no-color", since, "--"], capture_output=True, text=True, check=True)
    return spark.createDataFrame(parse_diff(done.stdout), "path string, start int, end int")


def loads_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m.group(1) or "", plain)
    return json.loads(plain)


def aliases_of(text: str) -> list[tuple[str, str, bool]]:
    """(key, replacement, wildcard) of the path mappings of one configuration; first targets only, none where it cannot be read."""
    try:
        options = loads_jsonc(text).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return []
    out = []
    base = str(options.get("baseUrl") or "").strip("/").removeprefix("./").removeprefix(".")
    for key, targets in (options.get("paths") or {}).items():
        if not targets or not isinstance(targets[0], str):
            continue
        target = targets[0].removeprefix("./")
        wild = key.endswith("*") and target.endswith("*")
        joined = f"{base}/{target}" if base else target
        out.append((key[:-1], joined[:-1], True) if wild else (key, joined, False))
    return out


def alias_table(configs: DataFrame) -> DataFrame:
    """path, key, replacement, wildcard of configs(path, text)."""

    def run(batches):
        for batch in batches:
            found = [(path, *a) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a in aliases_of(text or "")]
            cols = list(zip(*found)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "key", "replacement", "wildcard"])

    return configs.select("path", "text").mapInArrow(run, "path string, key string, replacement string, wildcard boolean")


def read_aliases(root: str) -> list[tuple[str, str, bool]]:
    """aliases_of the root's tsconfig*.json and jsconfig.json, by file name."""
    out = []
    for name in sorted(n for n in os.listdir(root) if re.fullmatch(r"tsconfig.*\.json|jsconfig\.json", n)):
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                out += aliases_of(f.read())
        except (OSError, UnicodeDecodeError):
            continue
    return out

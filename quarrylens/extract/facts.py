"""Facts of one file.  Lines and columns count from 0; columns are UTF-8 bytes.

Languages with brackets or `end` go through a token stream and the scopes in it (`tokens`, `declare`), YAML and TOML through readers of their
own (`data_keys`).  Python goes through its own parser, and files that it refuses through their indentation; Markdown goes line by line.
C and C++ functions span their whole definition; operators and calls with type arguments count; the arguments of Rust macros are tokens, so
they hold no calls.  A file that cannot be read gives no facts.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import lru_cache

from quarrylens import schema
from quarrylens.extract import declare, rules
from quarrylens.extract.data_keys import toml_keys, yaml_keys
from quarrylens.extract.lexer import Places, mask


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    start_line: int
    start_column: int
    end_line: int
    end_column: int
    visibility: str = "unknown"

    @property
    def span(self):
        return self.start_line, self.start_column, self.end_line, self.end_column


def dedupe(symbols: list[Symbol]) -> list[Symbol]:
    """One symbol for each range: the kind of highest priority, the first of equals, in the place of the first."""
    best: dict[tuple, Symbol] = {}
    for s in symbols:
        old = best.get(s.span)
        if old is None or schema.KIND_PRIORITY.get(s.kind, 0) > schema.KIND_PRIORITY.get(old.kind, 0):
            best[s.span] = s
    return list(best.values())


@dataclass(frozen=True)
class Scan:
    """What a file with braces holds: its symbols, and its calls as (line, column, name, whether a receiver stands before it)."""

    symbols: list[Symbol]
    calls: list[tuple]


@lru_cache(maxsize=2)
def _scan(text: str, language: str) -> Scan:
    found, places = declare.find(text, language), Places(text)
    stream = found.stream
    order = sorted(found.declared, key=lambda d: (stream.at[d.first], stream.at[d.at]))
    symbols = [Symbol(d.name.removeprefix("r#") if language == "rust" else d.name, d.kind, *places.of(stream.at[d.first]), *places.of(d.end), d.visibility) for d in order]
    sites = declare.calls(found) if language in schema.CALL_LANGUAGES else []
    return Scan(symbols, [(*places.of(stream.at[k]), stream.tok[k], method) for k, method in sites])


def _braced(text: str, language: str) -> list[Symbol]:
    return _scan(text, language).symbols


#: Words of Python that stand before a parenthesis and call nothing.
_PYTHON_WORDS = frozenset("and as assert async await class def del elif else except exec for from if import in is lambda not or raise return try while with yield print".split())


def _unparsed(text: str):
    """What a Python file shows that its parser refuses, such as one of an older version: declarations by indentation, calls and imports by their look."""
    masked, places = mask(text, "python"), Places(text)
    lines = masked.split("\n")
    symbols, calls, imports = [], [], []
    for m in re.finditer(r"^(?P<in>[ \t]*)(?P<head>(?:async[ \t]+)?(?P<word>def|class)[ \t]+(?P<name>[^\W\d]\w*)[ \t]*)(?P<rest>\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^:\n]*:|:)", masked, re.M):
        if m.group("word") == "def" and m.group("rest") == ":":
            continue
        at, depth = m.start("head"), len(m.group("in").expandtabs())
        first, last = places.line(at), places.line(m.end() - 1)
        for k in range(last + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) <= depth:
                    break
                last = k
        symbols.append(Symbol(m.group("name"), "class" if m.group("word") == "class" else "function", *places.of(at), last, len(text.split("\n")[last].rstrip().encode())))
    bodies = [s for s in symbols if s.kind == "function"]
    for m in re.finditer(r"(?P<before>\w*)(?P<dot>\.)?\s*\b(?P<name>[^\W\d]\w*)[ \t]*\(", masked):
        line, column = places.of(m.start("name"))
        inside = [s for s in bodies if s.start_line < line <= s.end_line]
        head = masked[max(0, m.start("name") - 8) : m.start("name")]
        if inside and m.group("name") not in _PYTHON_WORDS and not re.search(r"\b(?:def|class)\s+$", head):
            caller = max(inside, key=lambda s: s.start_line)
            calls.append((caller.name, caller.start_line, m.group("name"), line, column, m.group("dot") is not None))
    for m in re.finditer(r"^[ \t]*(?:from[ \t]+(?P<module>[.\w]+)[ \t]+import\b|import[ \t]+(?P<names>[^\n;]+))", masked, re.M):
        if m.group("module"):
            imports.append((m.group("module"), *places.of(m.start("module"))))
        else:
            imports += [(n.group(), *places.of(m.start("names") + n.start())) for n in re.finditer(r"[.\w]+", re.sub(r"[ \t]+as[ \t]+\w+", lambda x: " " * len(x.group()), m.group("names")))]
    return symbols, sorted(calls, key=lambda c: c[3:5]), imports


def _python(text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _unparsed(text)
    symbols, calls, imports = [], [], []

    def visit(node, inside_class: bool, caller):
        for child in ast.iter_child_nodes(node):
            here, within = caller, inside_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                symbols.append(Symbol(child.name, kind, child.lineno - 1, child.col_offset, child.end_lineno - 1, child.end_col_offset))
                within = kind == "class"
                if kind != "class":
                    here = (child.name, child.lineno - 1)
            elif isinstance(child, ast.Call) and caller is not None:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    line, column = (f.end_lineno - 1, f.end_col_offset - len(name.encode()))
                    calls.append((*caller, name, line, column, isinstance(f, ast.Attribute)))
            elif isinstance(child, ast.Import):
                imports.extend((a.name, a.lineno - 1, a.col_offset) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append(("." * child.level + (child.module or ""), child.lineno - 1, child.col_offset + 5))
            visit(child, within, here)

    visit(tree, False, None)
    return symbols, sorted(calls, key=lambda c: c[3:5]), imports


def _ended(text: str, language: str) -> list[Symbol]:
    """Ruby and Lua: a declaration ends at its own `end`."""
    places = Places(text)
    return [Symbol(name, kind, *places.of(a), *places.of(b)) for name, kind, a, b in (declare.ruby if language == "ruby" else declare.lua)(text)]


def _markdown(text: str) -> list[Symbol]:
    out, fenced, lines = [], False, text.split("\n")
    for k, line in enumerate(lines):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
        if fenced:
            continue
        m = re.match(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", line)
        if m and m.group(1):
            out.append(Symbol(m.group(1), "section", k, 0, *_line_end(lines, k)))
        elif k and re.match(r"\s{0,3}(=+|-+)\s*$", line) and lines[k - 1].strip() and not re.match(r"\s{0,3}([#>*+-]\s|```|\d+\.)", lines[k - 1]):
            out.append(Symbol(lines[k - 1].strip(), "section", k - 1, 0, *_line_end(lines, k)))
    return out


def _line_end(lines: list[str], k: int) -> tuple[int, int]:
    """A heading takes its line break along."""
    return (k + 1, 0) if k + 1 < len(lines) else (k, len(lines[k].encode()))


def _json(text: str, deep: bool) -> list[Symbol]:
    """A key's range is its whole pair."""
    places, found = Places(text), []
    stack: list[list] = []  # opening bracket, and the pair that is open in it
    last, before = 0, None
    for m in re.finditer(r"\"(?:\\.|[^\"\\])*\"|[{}\[\],:]|[^\s,:{}\[\]\"]+", text):
        token = m.group()
        if token in ("{", "["):
            stack.append([token, None])
        elif token in (",", "}", "]"):
            if stack and stack[-1][1] is not None:
                start, name = stack[-1][1]
                found.append((start, Symbol(name, "key", *places.of(start), *places.of(last))))
                stack[-1][1] = None
            if token != ",":
                del stack[-1:]
        elif token == ":" and stack and stack[-1][0] == "{" and before is not None and before.group()[0] == '"' and (deep or len(stack) == 1):
            stack[-1][1] = (before.start(), before.group()[1:-1])
        if token != ",":
            last = m.end()
        before = m
    return [s for _, s in sorted(found, key=lambda f: f[0])]


def _keys(found: list[tuple[str, int, int, bool]], text: str, deep: bool) -> list[Symbol]:
    """A key's range is its whole pair, a table's its whole table."""
    places = Places(text)
    return [Symbol(name, "key", *places.of(a), *places.of(b)) for name, a, b, top in found if deep or top]


def _yaml(text: str, deep: bool) -> list[Symbol]:
    return _keys(yaml_keys(text), text, deep)


def _toml(text: str, deep: bool) -> list[Symbol]:
    return _keys(toml_keys(text), text, deep)


def symbols_of(text: str, language: str, deep: bool = False) -> list[Symbol]:
    """Symbols of a file; deep: keys at any depth of a data file."""
    try:
        if language == "python":
            got = _python(text)[0]
        elif language in ("ruby", "lua"):
            got = _ended(text, language)
        elif language == "markdown":
            got = _markdown(text)
        elif language in ("json", "yaml", "toml"):
            got = {"json": _json, "yaml": _yaml, "toml": _toml}[language](text, deep)
        elif language in declare.LANGUAGES:
            got = _braced(text, language)
        else:
            got = []
    except (SyntaxError, ValueError, RecursionError):
        return []
    return dedupe([s for s in got if s.name])


def calls_of(text: str, language: str, symbols: list[Symbol]) -> list[tuple]:
    """(caller, caller's line, callee, line, column, is_method); calls outside a function or method are left out."""
    if language not in schema.CALL_LANGUAGES:
        return []
    if language == "python":
        try:
            return _python(text)[1]
        except (SyntaxError, ValueError, RecursionError):
            return []
    sites = _scan(text, language).calls
    bodies = sorted((s for s in symbols if s.kind in ("function", "method")), key=lambda s: (s.span[:2], (-s.end_line, -s.end_column)))
    out, opened, k = [], [], 0
    for line, column, name, method in sorted(sites):
        while k < len(bodies) and bodies[k].span[:2] <= (line, column):
            opened.append(bodies[k])
            k += 1
        while opened and opened[-1].span[2:] <= (line, column):
            opened.pop()
        if opened:
            out.append((opened[-1].name, opened[-1].start_line, name, line, column, method))
    return out


def imports_of(text: str, language: str) -> list[tuple]:
    """(module, line, column) of each import, in order."""
    if language == "python":
        try:
            return _python(text)[2]
        except (SyntaxError, ValueError, RecursionError):
            return []
    plain = mask(text, language, False) if language in schema.CALL_LANGUAGES else ""
    places, out = Places(text), []
    if language == "go":
        for block in re.finditer(r"^[^\S\n]*import\s*(\([^)]*\)|(?:[\w.]+\s+)?\"[^\"\n]+\")", plain, re.M):
            out += [(m.group(1), *places.of(block.start(1) + m.start())) for m in re.finditer(r"[\"`]([^\"`\n]+)[\"`]", block.group(1))]
        return out
    if language not in rules.IMPORTS:
        return []
    for m in re.finditer(rules.IMPORTS[language], plain, re.M):
        group = "crate" if m.groupdict().get("crate") else "module"
        out.append((m.group(group).strip().strip("\"'<>`"), *places.of(m.start(group))))
    return out


def facts_of(text: str, language: str, deep: bool = False) -> tuple[list[Symbol], list[tuple], list[tuple]]:
    """symbols_of, calls_of and imports_of of one file."""
    found = symbols_of(text, language, deep)
    return found, calls_of(text, language, found), imports_of(text, language)

"""Keys of YAML and TOML files, as (name, start, end, whether it is a key of the top level).

Both readers go through the text once.  YAML keeps a stack of open block pairs and list items by indentation, and a stack for flow collections; TOML
reads values by their brackets and quotes.  Scalars of several lines are passed over whole, so nothing inside them looks like a key.
"""

from __future__ import annotations

import re

_SPACES, _REST = re.compile(r"[ \t]*"), re.compile(r"[^\n]*")
_SINGLE, _DOUBLE = re.compile(r"'(?:[^']|'')*'?"), re.compile(r"\"(?:\\.|[^\"\\])*\"?", re.S)
_PLAIN_KEY = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=\S)|(?<=\S)#)*?(?=[ \t]*:(?:\s|$))", re.M)
_FLOW_PLAIN = re.compile(r"(?:[^\s,\[\]{}#&*!|>'\"%@`:]|:(?=[^\s,\[\]{}]))(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*")
_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]+)+(?=\S)|[&!][^\s,\[\]{}]*(?=\s*$)", re.M)
_BLOCK_SCALAR = re.compile(r"[|>][-+0-9]*[ \t]*(?:#[^\n]*)?$", re.M)
_PLAIN_LINE = re.compile(r"(?:[^\n#]|(?<=\S)#)*")


class Yaml:
    """One pass over a stream of documents."""

    def __init__(self, text: str):
        self.text, self.found, self.last = text, [], 0
        self.open: list[list] = []  # column, and the pair's place in found; -1 for a list item

    def read(self) -> list[tuple[str, int, int, bool]]:
        p, text = 0, self.text
        while p < len(text):
            line, p = p, _SPACES.match(text, p).end()
            rest = text[p : p + 4]
            if p >= len(text) or rest[0] in "\n\r#":
                p = _REST.match(text, p).end() + 1
                continue
            if p == line and (re.match(r"(?:---|\.\.\.)(?:\s|$)", rest + "\n") or rest[0] == "%"):
                self._close(-1)
                p += 3 if rest[0] in "-." else 0
                if rest[0] == "%":
                    p = _REST.match(text, p).end() + 1
                    continue
                p = _SPACES.match(text, p).end()
                if p >= len(text) or text[p] in "\n\r#":
                    continue
            p = self._entry(line, p)
        self._close(-1)
        return self.found

    def _close(self, column: int, item: bool = False) -> None:
        """Close what is indented as much or more; a list item leaves the pair of its own column open."""
        while self.open and (self.open[-1][0] > column or self.open[-1][0] == column and not (item and self.open[-1][1] >= 0)):
            _, k = self.open.pop()
            if k >= 0:
                name, start, _, top = self.found[k]
                self.found[k] = (name, start, self.last, top)

    def _entry(self, line: int, p: int) -> int:
        """List items and a pair, or a scalar, from p on; gives the place after it."""
        text = self.text
        while text[p] in "-?" and (p + 1 >= len(text) or text[p + 1] in " \t\n\r"):
            self._close(p - line, item=True)
            mark, column = p, p - line
            if text[mark] == "?":
                self._close(column)
            self.last = p + 1
            p = _SPACES.match(text, p + 1).end()
            if text[mark] == "-":
                self.open.append([column, -1])
            elif p < len(text) and text[p] not in "\n\r#{[|>":  # an explicit key; its value may follow after a colon
                key = (_SINGLE if text[p] == "'" else _DOUBLE if text[p] == '"' else _PLAIN_LINE).match(text, p)
                plain = key.group().rstrip()
                self.open.append([column, len(self.found)])
                self.last = p + len(plain)
                self.found.append((plain[1:-1] if plain[0] in "'\"" else plain, mark, self.last, len(self.open) == 1))
                return _REST.match(text, p).end() + 1
            if p >= len(text) or text[p] in "\n\r#":
                return _REST.match(text, p).end() + 1
        if text[p] == ":" and text[p + 1 : p + 2] in ("", " ", "\n", "\t"):  # the value of an explicit key
            self._close(p - line, item=True)
            self.last = p + 1
            return self._value(p + 1, p - line)
        at = p
        if m := _PROPERTY.match(text, p):
            p = m.end()
        key = (_SINGLE if text[p : p + 1] == "'" else _DOUBLE if text[p : p + 1] == '"' else _PLAIN_KEY).match(text, p)
        after = _SPACES.match(text, key.end()).end() if key else p
        if key and text[after : after + 1] == ":" and text[after + 1 : after + 2] in ("", " ", "\n", "\t", "\r") and "\n" not in key.group():
            self._close(at - line)
            name = key.group()[1:-1] if key.group()[0] in "'\"" else key.group().rstrip()
            self.open.append([at - line, len(self.found)])
            self.found.append((name, at, after + 1, len(self.open) == 1))
            self.last = after + 1
            return self._value(after + 1, at - line)
        self._close(at - line)
        return self._value(p, (self.open[-1][0] if self.open else -1))

    def _value(self, p: int, column: int) -> int:
        """A value that begins on this line, below a key or item at a column."""
        text = self.text
        p = _SPACES.match(text, p).end()
        while m := _PROPERTY.match(text, p):
            p = _SPACES.match(text, m.end()).end()
            self.last = m.end()
        if p >= len(text) or text[p] in "\n\r" or text[p] == "#" and text[p - 1] in " \t":
            return _REST.match(text, p).end() + 1
        if text[p] in "|>" and _BLOCK_SCALAR.match(text, p):
            self.last = p + len(_BLOCK_SCALAR.match(text, p).group().split("#")[0].rstrip())
            return self._deeper(_REST.match(text, p).end() + 1, column, True)
        if text[p] in "{[":
            p = self._flow(p)
        elif text[p] in "'\"":
            p = (_SINGLE if text[p] == "'" else _DOUBLE).match(text, p).end()
            self.last = p
        else:
            plain = _PLAIN_LINE.match(text, p)
            self.last = p + len(plain.group().rstrip())
            commented = text[plain.end() : plain.end() + 1] == "#"
            p = _REST.match(text, p).end() + 1
            return p if commented else self._deeper(p, column, False)
        return _REST.match(text, p).end() + 1

    def _deeper(self, p: int, column: int, block: bool) -> int:
        """Past the lines of a scalar that are indented more; a comment ends a plain one."""
        text = self.text
        while p < len(text):
            start = _SPACES.match(text, p).end()
            stop = _REST.match(text, p).end()
            if start < stop and text[start] != "\r":
                marker = start == p and re.match(r"(?:---|\.\.\.)(?:\s|$)", text[p : p + 4] + "\n")
                if start - p <= column or marker or not block and text[start] == "#":
                    return p
                self.last = p + len(text[p:stop].rstrip())
            p = stop + 1
        return p

    def _flow(self, p: int) -> int:
        """A flow collection from its bracket on, with the pairs in it; gives the place after its end."""
        text, stack, before = self.text, [], None  # before: the scalar that may be a key
        while p < len(text):
            c = text[p]
            if c in " \t\n\r":
                p += 1
                continue
            if c == "#" and text[p - 1] in " \t\n":
                p = _REST.match(text, p).end()
                continue
            if c in "{[":
                stack.append([c, -1])
                before, p = None, p + 1
            elif c in "}],":
                if stack and stack[-1][1] >= 0:
                    name, start, _, top = self.found[stack[-1][1]]
                    self.found[stack[-1][1]] = (name, start, self.last, top)
                    stack[-1][1] = -1
                before, p = None, p + 1
                if c != ",":
                    if stack:
                        stack.pop()
                    self.last = p
                    if not stack:
                        return p
                continue
            elif c == ":" and before is not None and stack[-1][1] < 0:
                stack[-1][1] = len(self.found)
                self.found.append((*before, p + 1, False))
                before, p = None, p + 1
            elif c in "'\"":
                m = (_SINGLE if c == "'" else _DOUBLE).match(text, p)
                before, p = (m.group()[1:-1], p), m.end()
            elif c in "&!*":
                p = re.compile(r"[^\s,\[\]{}]*").match(text, p).end()
                p = max(p, 1)
            elif m := _FLOW_PLAIN.match(text, p):
                plain = m.group().rstrip()
                before, p = (plain, p), p + len(plain)
            else:
                p += 1
            self.last = p
        return p


def yaml_keys(text: str) -> list[tuple[str, int, int, bool]]:
    return Yaml(text).read()


_TOML_BLANK = re.compile(r"(?:\s|#[^\n]*)*")
_TOML_PART = r"(?:[\w-]+|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*')"
_TOML_KEY = re.compile(rf"{_TOML_PART}(?:[ \t]*\.[ \t]*{_TOML_PART})*")
_TOML_HEAD = re.compile(rf"\[\[?[ \t]*(?P<key>{_TOML_KEY.pattern})[ \t]*\]\]?")
_TOML_STRING = re.compile(r"\"\"\"(?:\\.|[^\\])*?\"{3,5}|'''.*?'{3,5}|\"(?:\\.|[^\"\\\n])*\"?|'[^'\n]*'?", re.S)
_TOML_ATOM = re.compile(r"[^\s,\[\]{}#=\"']+(?:[ ](?=\d\d:)\S+)?")


def _unquoted(key: str) -> str:
    return key[1:-1] if key[0] in "\"'" and key[-1] == key[0] and re.fullmatch(_TOML_PART, key) else key


def toml_keys(text: str) -> list[tuple[str, int, int, bool]]:
    """Pairs before the first table and all tables are of the top level; a table reaches to the next one, or to the end."""
    found: list[tuple[str, int, int, bool]] = []
    p, table = 0, None
    while (p := _TOML_BLANK.match(text, p).end()) < len(text):
        if head := _TOML_HEAD.match(text, p):
            if table is not None:
                found.append((*table, text.rfind("\n", 0, p) + 1, True))
            table, p = (_unquoted(head.group("key")), p), head.end()
        elif (key := _TOML_KEY.match(text, p)) and (eq := re.compile(r"[ \t]*=[ \t]*").match(text, key.end())):
            here = len(found)
            found.append((_unquoted(key.group()), p, eq.end(), table is None))
            p = _toml_value(text, eq.end(), found)
            found[here] = (*found[here][:2], p, found[here][3])
        else:
            p = _REST.match(text, p).end()
    if table is not None:
        found.append((*table, len(text), True))
    return sorted(found, key=lambda f: (f[1], -f[2]))


def _toml_value(text: str, p: int, found: list[tuple[str, int, int, bool]]) -> int:
    """The place after a value; the pairs of inline tables are added."""
    stack: list[list] = []
    last = p
    while True:
        p = _TOML_BLANK.match(text, p).end() if stack else _SPACES.match(text, p).end()
        if p >= len(text) or not stack and text[p] in "\r\n#":
            return last
        c = text[p]
        if c in "[{":
            stack.append([c, None])
            p += 1
        elif c in "]},":
            if stack and stack[-1][1] is not None:
                name, at = stack[-1][1]
                found.append((name, at, last, False))
                stack[-1][1] = None
            if c != "," and stack:
                stack.pop()
            p += 1
            if c == ",":
                if not stack:
                    return last
                continue
        elif stack and stack[-1][0] == "{" and stack[-1][1] is None and (key := _TOML_KEY.match(text, p)) and (eq := re.compile(r"[ \t]*=[ \t]*").match(text, key.end())):
            stack[-1][1] = (_unquoted(key.group()), p)
            p = eq.end()
        else:
            m = _TOML_STRING.match(text, p) if c in "\"'" else _TOML_ATOM.match(text, p)
            p = m.end() if m and m.end() > p else p + 1
        last = p
        if not stack:
            return last

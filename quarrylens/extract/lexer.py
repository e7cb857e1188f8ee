"""Masking of comments and strings, and places in lines."""

from __future__ import annotations

import bisect
import re

_C_LIKE = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRINGS = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
# How comments and strings look in each language.
COMMENTS = {
    "python": r"#[^\n]*", "ruby": r"#[^\n]*", "bash": r"(?<![^\s;])#[^\n]*", "lua": r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", "php": _C_LIKE + r"|#[^\n]*", "yaml": r"(?<![^\s])#[^\n]*", "toml": r"#[^\n]*",
}
STRINGS = {
    "python": r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|" + _STRINGS,
    "rust": r"r(?P<hashes>#*)\".*?\"(?P=hashes)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[0-9a-fA-F]+\}|x..|.)|[^'\\\n])'", "go": r"`[^`]*`?|" + _STRINGS,
    "typescript": r"`(?:\\.|[^`\\])*`?|" + _STRINGS, "tsx": r"`(?:\\.|[^`\\])*`?|" + _STRINGS, "javascript": r"`(?:\\.|[^`\\])*`?|" + _STRINGS,
    "java": r"\"\"\".*?(?:\"\"\"|\Z)|" + _STRINGS, "kotlin": r"\"\"\".*?(?:\"\"\"|\Z)|" + _STRINGS, "swift": r"\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\\n])*\"?",
    "csharp": r"@\"(?:[^\"]|\"\")*\"?|" + _STRINGS, "bash": r"\"(?:\\.|[^\"\\])*\"?|'[^']*'?",
}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group())


def mask(text: str, language: str, strings: bool = True) -> str:
    """The text with comments (and strings) blanked; places and line breaks stay."""
    comments, quoted = COMMENTS.get(language, _C_LIKE), STRINGS.get(language, _STRINGS)
    whole = re.compile(f"(?P<comment>{comments})|(?P<quoted>{quoted})", re.S)
    return whole.sub(lambda m: _blank(m) if strings or m.group("comment") else m.group(), text)


class Places:
    """Line and column (0-based, columns in UTF-8 bytes) of character places."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at) - 1

    def of(self, at: int) -> tuple[int, int]:
        line = self.line(at)
        return line, len(self.text[self.starts[line] : at].encode())

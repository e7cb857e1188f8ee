"""Token streams with matched brackets.

A table gives the lexical forms of each language.  Comments leave no tokens; strings are one token each; the code inside templates, and
inside markup in scripts, is read like any other.  Brackets are matched by a pushdown stack that survives wrong ones: a closing bracket
without its opening one is passed over, and what stays open ends where its surroundings end.  In C and C++ each branch of a
conditional directive starts from the stack before the first.
"""

from __future__ import annotations

import re
from functools import lru_cache

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_PLAIN = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\(?:.[^'\n]*)|[^'\\\n])'"
# How comments, strings and words look.  A nested block comment is found by hand (see `_nested`).
LEXICON: dict[str, dict[str, str]] = {
    "rust": {"comment": _LINE, "string": rf"[bc]?r(?P<hash>#*)\".*?\"(?P=hash)|[bc]?\"(?:\\.|[^\"\\])*\"?|b?{_CHAR}", "word": r"r#[^\W\d]\w*|'[^\W\d]\w*|[^\W\d]\w*"},
    "go": {"comment": f"{_LINE}|{_BLOCK}", "string": r"`[^`]*`?|" + _PLAIN},
    "java": {"comment": f"{_LINE}|{_BLOCK}", "string": r"\"\"\".*?(?:(?<!\\)\"\"\"|\Z)|" + _PLAIN},
    "c": {"comment": rf"//(?:\\\r?\n|[^\n])*|{_BLOCK}", "directive": r"#(?:\\\r?\n|/\*.*?\*/|[^\n])*", "string": r"(?:u8|[uUL])?(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"},
    "csharp": {
        "comment": f"{_LINE}|{_BLOCK}", "directive": r"#[^\n]*",
        "string": r"\$*(?P<many>\"{3,}).*?(?P=many)|(?:@\$?|\$@)\"(?:[^\"]|\"\")*\"?|\$\"(?:\{\{|\}\}|\{(?:[^{}\"]|\"(?:\\.|[^\"\\\n])*\")*\}|\\.|[^\"\\\n{}])*\"?|" + _PLAIN,
        "word": r"@?[^\W\d]\w*",
    },
    "php": {"comment": rf"//[^\n]*?(?=\?>|\n|\Z)|#(?!\[)[^\n]*?(?=\?>|\n|\Z)|{_BLOCK}", "string": r"<<<[ \t]*(?P<doc>['\"]?)(?P<mark>\w+)(?P=doc)\n.*?\n[ \t]*(?P=mark)\b|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|\?>.*?(?:<\?(?:php|=)|\Z)", "word": r"\$*[^\W\d]\w*"},
    "kotlin": {"comment": _LINE, "string": r"\"\"\".*?(?:\"\"\"+|\Z)|\"(?:\$\{(?:[^{}\"]|\"(?:\\.|[^\"\\\n])*\"|\{[^{}]*\})*\}|\\.|[^\"\\\n])*\"?|" + _CHAR, "word": r"`[^`\n]+`|[^\W\d]\w*"},
    "swift": {"comment": _LINE, "string": r"(?P<pound>#+)\".*?\"(?P=pound)|\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\\((?:[^()\"]|\"(?:\\.|[^\"\\\n])*\"|\([^()]*\))*\)|\\.|[^\"\\\n])*\"?", "word": r"`\w+`|[^\W\d]\w*"},
    "javascript": {"comment": rf"{_LINE}|{_BLOCK}|\A#![^\n]*", "string": _PLAIN, "word": r"#?[^\W\d][\w$]*|#?\$[\w$]*"},
    "bash": {"comment": r"(?<![^\s;])#[^\n]*", "string": r"<<-?\s*(?P<doc>['\"]?)(?P<mark>\w+)(?P=doc)[^\n]*\n.*?^\t*(?P=mark)$|\$?\"(?:\\.|[^\"\\])*\"?|\$?'[^']*'?|\$\{[^}]*\}|\\.", "word": r"[\w.:@%+/-]+"},
    "lua": {"comment": r"--\[(?P<deep>=*)\[.*?(?:\](?P=deep)\]|\Z)|--[^\n]*", "string": r"\[(?P<long>=*)\[.*?(?:\](?P=long)\]|\Z)|" + _PLAIN},
}
LEXICON["cpp"] = LEXICON["c"] | {"string": r"(?:u8|[uUL])?R\"(?P<raw>[^(\s\\]{0,16})\(.*?\)(?P=raw)\"|" + LEXICON["c"]["string"]}
LEXICON["typescript"] = LEXICON["tsx"] = LEXICON["javascript"]
NESTED_COMMENTS = ("rust", "kotlin", "swift")
TEMPLATES = ("javascript", "typescript", "tsx")
MARKUP = ("javascript", "tsx")

_NUMBER = r"\d(?:[\w.]|(?<=\d)'(?=\w)|(?<=[eEpP])[+-])*"
_PUNCT = r"=>|->|::|\?\.(?!\d)|\?\?=?|\.\.[.=]?|&&=?|\|\|=?|===?|!==?|<=|>=|\+\+|--|[-+*/%&|^]=|:="
#: After these words an expression begins.
OPERATORS = frozenset("return typeof instanceof in of new delete void throw case do else yield await default as is and or not goto co_return co_await co_yield go defer move unsafe async".split())
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TAG, _SPACE, _TEXT = re.compile(r"<(?P<name>[\w$.:-]*)"), re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)+", re.S), re.compile(r"[^<{]*")
_QUOTED, _ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"[\w$:.-]+|[^\s\w]")
_WHITE = re.compile(r"\s*")
_NESTED = re.compile(r"/\*|\*/")
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}


@lru_cache(maxsize=None)
def _master(language: str) -> re.Pattern:
    forms = LEXICON[language]
    parts = [f"(?P<{name}_>{forms[name]})" for name in ("comment", "directive", "string") if name in forms]
    # numbers come before strings where digits may hold quotes
    parts.insert(0, rf"(?P<number_>(?<![\w$]){_NUMBER})" if language in ("c", "cpp") else r"(?P<none_>(?!))")
    parts += [rf"(?P<word_>{forms.get('word', r'[^\W\d]\w*')})", rf"(?P<number2_>{_NUMBER})", rf"(?P<punct_>{_PUNCT}|\S)"]
    return re.compile("|".join(parts), re.S | re.M)


class Stream:
    """Tokens of a text: tok, kind (word, string, number, punct, directive), at, end, fresh (first on its line), match of brackets, up (enclosing bracket)."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.tok: list[str] = []
        self.kind: list[str] = []
        self.at: list[int] = []
        self.end: list[int] = []
        self._lex = _master(language)
        start = 0
        if language == "php":
            opened = re.search(r"<\?(?:php|=)", text)
            start = opened.end() if opened else len(text)
        self._code(start, False)
        self._pair()
        lines = 0
        self.fresh = [True] * len(self.tok)
        for k in range(1, len(self.tok)):
            lines = self.text.find("\n", self.end[k - 1], self.at[k])
            self.fresh[k] = lines >= 0

    def __len__(self) -> int:
        return len(self.tok)

    def __getitem__(self, k: int) -> str:
        return self.tok[k] if 0 <= k < len(self.tok) else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self.tok) and self.kind[k] == "word"

    def _add(self, kind: str, at: int, end: int) -> None:
        self.kind.append(kind)
        self.tok.append(self.text[at:end])
        self.at.append(at)
        self.end.append(end)

    def _mark(self, bracket: str, at: int) -> None:
        """A bracket that the text does not have, around what is one operand."""
        self._add("punct", at, at)
        self.tok[-1] = bracket

    def _expression(self) -> bool:
        """Whether an operand may begin here."""
        if not self.tok:
            return True
        last, kind = self.tok[-1], self.kind[-1]
        return kind == "punct" and last not in (")", "]", "}", "++", "--") or kind == "word" and last in OPERATORS

    def _code(self, p: int, inner: bool) -> int:
        """Tokens from p on; inner: up to the brace that closes what the caller opened.  Gives the place after it."""
        depth, text, size = 0, self.text, len(self.text)
        while (p := _WHITE.match(text, p).end()) < size:
            if self.language in NESTED_COMMENTS and text.startswith("/*", p):
                p = self._nested(p)
                continue
            if self.language in TEMPLATES:
                c = text[p]
                if c == "`":
                    p = self._template(p)
                    continue
                if c == "/" and self._expression() and (m := _REGEX.match(text, p)):
                    self._add("string", p, m.end())
                    p = m.end()
                    continue
                if c == "<" and self.language in MARKUP and self._expression() and re.match(r"<(?:>|[A-Za-z_$][\w$.:-]*(?!\s*(?:,|extends\b)))", text[p : p + 200]) and not re.match(r"<[\w$]*\s*(?:,|extends\b)", text[p : p + 200]):
                    self._mark("(", p)
                    p = self._markup(p)
                    self._mark(")", p)
                    continue
            m = self._lex.match(text, p)
            kind, at, p = m.lastgroup.rstrip("_2"), p, m.end()
            if kind == "comment":
                continue
            self._add(kind, at, p)
            if inner and kind == "punct":
                depth += {"{": 1, "}": -1}.get(m.group(), 0)
                if depth < 0:
                    return p
        return p

    def _nested(self, p: int) -> int:
        depth = 0
        for m in _NESTED.finditer(self.text, p):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def _template(self, p: int) -> int:
        """A template from its back quote on: a string, or the code of its holes in brackets."""
        begin = p
        p += 1
        while p < len(self.text) and self.text[p] != "`":
            if self.text.startswith("${", p):
                if begin >= 0:
                    self._mark("(", begin)
                    begin = -1
                self._add("punct", p, p + 2)
                p = self._code(p + 2, True)
            else:
                p += 2 if self.text[p] == "\\" else 1
        p = min(p + 1, len(self.text))
        if begin >= 0:
            self._add("string", begin, p)
        else:
            self._mark(")", p)
        return p

    def _markup(self, p: int) -> int:
        """An element from its < on; only the code in its braces makes tokens."""
        text = self.text
        p = _TAG.match(text, p).end()
        while p < len(text):
            m = _SPACE.match(text, p)
            p = m.end() if m else p
            if text.startswith("/>", p):
                return p + 2
            if text.startswith(">", p):
                p += 1
                break
            if text.startswith("{", p):
                self._add("punct", p, p + 1)
                p = self._code(p + 1, True)
            elif text.startswith("<", p):
                p = self._markup(p)
            else:
                m = _QUOTED.match(text, p) or _ATTRIBUTE.match(text, p)
                p = m.end() if m else p + 1
        while p < len(text):
            p = _TEXT.match(text, p).end()
            if text.startswith("</", p):
                close = text.find(">", p)
                return close + 1 if close >= 0 else len(text)
            if text.startswith("{", p):
                self._add("punct", p, p + 1)
                p = self._code(p + 1, True)
            elif p < len(text):
                p = self._markup(p)
        return p

    def _pair(self) -> None:
        stack: list[int] = []
        saved: list[list[int]] = []
        self.match: dict[int, int] = {}
        self.up: list[int] = []
        for k, (tok, kind) in enumerate(zip(self.tok, self.kind, strict=True)):
            if kind == "directive":
                word = re.match(r"\s*#\s*(\w*)", tok)
                word = word.group(1) if word else ""
                if word.startswith("if"):
                    saved.append(list(stack))
                elif word in ("else", "elif") and saved:
                    for open_one in stack:
                        if open_one not in saved[-1]:
                            self.match.setdefault(open_one, k)
                    stack = list(saved[-1])
                elif word == "endif" and saved:
                    saved.pop()
            if kind == "punct" and tok in (")", "]", "}"):
                depth = len(stack) - 1
                while depth >= 0 and _OPEN[self.tok[stack[depth]]] != tok:
                    depth -= 1
                if depth >= 0:
                    for wrong in stack[depth + 1 :]:
                        self.match[wrong] = k
                    self.match[stack[depth]] = k
                    self.match[k] = stack[depth]
                    del stack[depth:]
            self.up.append(stack[-1] if stack else -1)
            if kind == "punct" and tok in _OPEN:
                stack.append(k)
        for k in stack:
            self.match[k] = len(self.tok) - 1

    def past(self, k: int) -> int:
        """The token after the bracket that closes k."""
        return max(self.match.get(k, k), k) + 1

    def generics(self, k: int) -> int:
        """The token after the angle brackets that open at k; k itself if there are none."""
        if self[k] != "<":
            return k
        depth, j = 0, k
        while j < len(self.tok):
            t = self.tok[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif t in ("(", "[", "{"):
                j = self.past(j)
                continue
            elif self.kind[j] == "punct" and t not in (",", ".", "::", ":", "?", "&", "*", "|", "=", "=>", "->", "+", "@", "...", "~", "!"):
                return k
            j += 1
        return k

    def back_generics(self, k: int) -> int:
        """The token at which the angle brackets that close at k open; k itself if there are none."""
        depth, j = 0, k
        while j >= 0:
            t = self.tok[j]
            if t == ">":
                depth += 1
            elif t == "<":
                depth -= 1
                if not depth:
                    return j
            elif t in (")", "]"):
                j = self.match.get(j, j)
            elif t in ("{", "}", ";", "(", "["):
                return k
            j -= 1
        return k

    def value_end(self, k: int, stops: tuple[str, ...] = (";", ",")) -> int:
        """The token after the expression that begins at k, in languages that end one with a line."""
        first = k
        while k < len(self.tok):
            t = self.tok[k]
            if t in stops or t in (")", "]", "}"):
                return k
            if k > first and self.fresh[k] and self._ends(k - 1) and not self._continues(k):
                return k
            k = self.past(k) if t in _OPEN else k + 1
        return k

    def _ends(self, k: int) -> bool:
        return self.kind[k] in ("string", "number") or self.tok[k] in (")", "]", "}", "++", "--") or self.kind[k] == "word" and self.tok[k] not in OPERATORS

    def _continues(self, k: int) -> bool:
        return self.kind[k] == "punct" and self.tok[k] not in ("{", "@", "!", "++", "--", "~", "#") or self.tok[k] in ("instanceof", "in", "of", "as", "is", "else", "where", "satisfies")

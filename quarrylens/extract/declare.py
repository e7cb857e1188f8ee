"""Declarations, scopes and call sites in a token stream, for languages with braces and for those with `end`.

Each language family is a function over the stream.  It finds declarations, marks the brace of each type's body (``types``), the names that are declared
and so are no calls (``named``), and the stretches in which a name before a parenthesis is no call: patterns, attributes, macro arguments,
types (``quiet``).  Calls are what is left.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from quarrylens.extract.tokens import OPERATORS, Stream


@dataclass(frozen=True)
class Declaration:
    """First token, place after the end, token of the name."""

    name: str
    kind: str
    first: int
    end: int
    at: int
    visibility: str = "unknown"


@dataclass
class Found:
    stream: Stream
    declared: list[Declaration] = field(default_factory=list)
    types: dict[int, str] = field(default_factory=dict)
    named: set[int] = field(default_factory=set)
    quiet: list[tuple[int, int]] = field(default_factory=list)

    def add(self, name: str, kind: str, first: int, last: int, at: int, visibility: str = "unknown") -> None:
        """A declaration from token first to token last."""
        s = self.stream
        self.declared.append(Declaration(name, kind, first, s.end[min(last, len(s) - 1)], at, visibility))
        self.named.add(at)

    def silence(self, opened: int) -> None:
        self.quiet.append((opened, self.stream.match.get(opened, opened)))


# Words before a declaration that belong to it.
MODIFIERS: dict[str, frozenset[str]] = {
    lang: frozenset(words.split())
    for lang, words in {
        "rust": "pub async const unsafe extern default", "csharp": "public private protected internal static sealed abstract partial readonly unsafe new virtual override async extern ref file required",
        "php": "public private protected static final abstract readonly", "typescript": "abstract async declare", "tsx": "abstract async declare", "javascript": "async",
        "kotlin": "public private internal protected open abstract final sealed data enum annotation inner value companion override suspend inline operator infix tailrec external const expect actual fun noinline crossinline lateinit vararg",
        "swift": "public private fileprivate internal open static final override mutating nonmutating required convenience indirect class lazy weak prefix postfix infix nonisolated distributed",
        "java": "public private protected static final abstract synchronized native strictfp default sealed non-sealed",
    }.items()
}
MEMBER_WORDS = frozenset("public private protected static async override readonly abstract get set declare accessor".split())

# Words before a parenthesis that call nothing, in any language and in each.
_COMMON = "if for while switch return case else do"
NO_CALL: dict[str, frozenset[str]] = {
    lang: frozenset(f"{_COMMON} {words}".split())
    for lang, words in {
        "rust": "match loop in as move unsafe async await fn let mut ref where impl dyn pub crate super self struct enum type trait use mod const static break Fn FnMut FnOnce",
        "go": "go defer select range chan map func var const type struct interface package import fallthrough",
        "javascript": "catch typeof function await yield in new delete throw super import void instanceof with class const let var default extends async as satisfies keyof infer is asserts unique readonly",
        "java": "catch new throw super this synchronized try assert instanceof default import package class interface enum extends implements throws permits",
        "csharp": "catch new throw base this lock using fixed checked unchecked foreach nameof typeof sizeof default when stackalloc in is as await yield delegate",
        "c": "sizeof typeof alignof alignas asm defined goto static_assert typedef struct union enum const volatile _Alignof _Alignas _Generic _Static_assert _Atomic __attribute__ __declspec __typeof__ __asm__ catch new delete "
        "throw try static_cast dynamic_cast const_cast reinterpret_cast decltype typeid noexcept template operator explicit constexpr consteval co_await co_return co_yield requires typename class using namespace and or not",
    }.items()
}
NO_CALL["cpp"] = NO_CALL["c"]
NO_CALL["typescript"] = NO_CALL["tsx"] = NO_CALL["javascript"]

# Words of C and C++ that name a basic type.
BASIC_TYPES = frozenset("int char void float double bool short long signed unsigned size_t ssize_t wchar_t char8_t char16_t char32_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t intptr_t uintptr_t ptrdiff_t auto".split())

_BEFORE_CALL = OPERATORS | frozenset("if while for switch match break range select assert extends until when loop".split())


def _annotated(s: Stream, k: int) -> int:
    """The token before an annotation `@a.b(...)` that ends at k, as the place of its @; k + 1 if none ends there."""
    j = s.match.get(k, k) - 1 if s[k] == ")" else k
    if not s.word(j):
        return k + 1
    while s[j - 1] == "." and s.word(j - 2):
        j -= 2
    if s[j - 1] == ":" and s.word(j - 2) and s[j - 3] == "@":
        j -= 2
    return j - 1 if s[j - 1] == "@" else k + 1


def _modified(s: Stream, k: int) -> int:
    """The first token of the modifiers and annotations before token k."""
    words = MODIFIERS.get(s.language, frozenset())
    while k > 0:
        p = k - 1
        if s.word(p) and s[p] in words and s[p - 1] not in (".", "::"):
            k = p
        elif s[p] == ")" and s[s.match.get(p, p) - 1] in ("pub", "private", "fileprivate", "internal", "public", "open", "unowned") and s.match.get(p, p) < p:
            k = s.match[p] - 1
        elif s.kind[p] == "string" and s[p - 1] == "extern":
            k = p - 1
        elif s.language == "csharp" and s[p] == "]" and s.match.get(p, p) < p and s[s.match[p] - 1] in ("", "{", "}", ";", "]", ")"):
            k = s.match[p]
        elif s.language in ("java", "kotlin", "swift", "php") and (at := _annotated(s, p)) <= p:
            k = at
        elif s.language == "php" and s[p] == "]" and s[s.match.get(p, p) - 1] == "#":
            k = s.match[p] - 1
        else:
            break
    return k


def _body(s: Stream, k: int, stops: tuple[str, ...] = (";",)) -> int:
    """The first brace, or stopping token, from k on at the same nesting; len(s) if there is none."""
    while k < len(s):
        t = s[k]
        if t == "{" or t in stops or t in (")", "]", "}"):
            return k
        k = s.past(k) if t in ("(", "[") else k + 1
    return k


def _member(s: Stream, k: int) -> int:
    """The first token of the member that holds token k: after the last semicolon, block or opening bracket before it."""
    up = s.up[k]
    while k - 1 > up:
        t = s[k - 1]
        if t in (";", "}") or s.kind[k - 1] == "directive" or t == ":" and s[k - 2] in ("public", "private", "protected", "signals", "slots"):
            break
        k = s.match[k - 1] if t in (")", "]") and s.match.get(k - 1, k) < k else k - 1
    return k


def _rust(f: Found) -> None:
    s = f.stream
    for k in range(len(s)):
        t = s.tok[k]
        if t == "#" and s[k + 1] in ("[", "!"):
            f.silence(k + 1 if s[k + 1] == "[" else k + 2)
        elif t == "|" and (s[k - 1] in ("=", "(", ",", "{", "move", "return", "=>", "async", "[") or s[k - 1] == ";"):
            stop = k + 1  # the parameters of a closure are patterns
            while stop < len(s) and s[stop] not in ("|", ";", "}", ")"):
                stop = s.past(stop) if s[stop] in ("(", "[", "{") else stop + 1
            f.quiet.append((k, stop))
        if s.kind[k] != "word" or f.quiet and f.quiet[-1][0] < k < f.quiet[-1][1]:
            continue
        if s[k + 1] == "!" and s[k + 2] in ("(", "[", "{") and t != "macro_rules":
            f.silence(k + 2)  # the arguments of a macro are tokens, not expressions
        elif t == "macro_rules" and s[k + 1] == "!":
            last = s.past(k + 3) - 1
            f.add(s[k + 2], "macro", k, last, k + 2, _rust_seen(s, k, k))
            f.quiet.append((k + 3, last))
        elif t in ("impl", "extern") and s[k - 1] in ("", ";", "{", "}", "]", "unsafe", "default", "pub"):
            body = _body(s, k + 1)
            if s[body] == "{" and (t == "impl" or s.kind[body - 1] == "string" or body == k + 1):
                f.types[body] = "impl"
        elif t in ("struct", "enum", "union", "trait", "mod", "type") and s.word(k + 1) and s[k + 1][0] != "'":
            if t == "union" and s[k + 2] not in ("{", "<", "where") or t == "type" and f.types.get(s.up[k]) == "trait":
                continue
            body = _body(s, k + 2)
            last = s.past(body) - 1 if s[body] == "{" else body
            if t in ("trait", "mod") and s[body] == "{":
                f.types[body] = t
            first = _modified(s, k)
            f.add(s[k + 1], {"trait": "interface", "mod": "module"}.get(t, "class"), first, last, k + 1, _rust_seen(s, first, k))
            if t in ("struct", "enum", "union"):
                f.quiet.append((k, last))
        elif t == "fn" and s.word(k + 1):
            body = _body(s, s.past(s.generics(k + 2)))
            f.named.add(k + 1)
            if s[body] == "{":
                first = _modified(s, k)
                f.add(s[k + 1], "method" if s.up[k] in f.types else "function", first, s.past(body) - 1, k + 1, _rust_seen(s, first, k))
        elif t == "let":
            stop = k + 1
            while stop < len(s) and s[stop] not in ("=", ";", "else", ")", "}"):
                stop = s.past(stop) if s[stop] in ("(", "[", "{") else stop + 1
            f.quiet.append((k, stop))
        elif t == "for" and s[k + 1] != "<":
            stop = k + 1
            while stop < len(s) and s[stop] not in ("in", "{", ";"):
                stop = s.past(stop) if s[stop] in ("(", "[") else stop + 1
            if s[stop] == "in":
                f.quiet.append((k, stop))
        elif t == "match" and s[k - 1] not in (".", "fn"):
            body = _body(s, k + 1)
            if s[body] == "{":
                _arms(f, body)


def _arms(f: Found, body: int) -> None:
    """The patterns of a match are no expressions; their guards are."""
    s, k, close = f.stream, body + 1, f.stream.match[body]
    while k < close:
        arrow, guard = k, None
        while arrow < close and s[arrow] != "=>":
            if s[arrow] == "if" and guard is None:
                guard = arrow
            arrow = s.past(arrow) if s[arrow] in ("(", "[", "{") else arrow + 1
        f.quiet.append((k - 1, guard if guard is not None else arrow))
        k = arrow + 1
        if s[k] == "{" and s[s.past(k)] not in (".", "?", "as"):
            k = s.past(k)
            k += s[k] == ","
            continue
        while k < close and s[k] != ",":
            k = s.past(k) if s[k] in ("(", "[", "{") else k + 1
        k += 1


def _rust_seen(s: Stream, first: int, word: int) -> str:
    if any(s[k] in ("pub", "extern") for k in range(first, word)):
        return "public"
    k = first
    for _ in range(9):
        if s[k - 1] != "]" or s[s.match.get(k - 1, k) - 1] != "#":
            return "private"
        opened = s.match[k - 1]
        if any(s[j] in ("no_mangle", "export_name") for j in range(opened, k)):
            return "public"
        k = opened - 1
    return "private"


def _go(f: Found) -> None:
    s = f.stream
    seen = lambda name: "public" if name[:1].isupper() else "private"
    for k in range(len(s)):
        t = s.tok[k]
        if s.kind[k] != "word":
            continue
        if t == "interface" and s[k + 1] == "{":
            f.silence(k + 1)
        elif t == "func" and s.up[k] < 0 and (s.fresh[k] or s[k - 1] in ("", ";", "}")):
            method = s[k + 1] == "("
            name = s.past(k + 1) if method else k + 1
            if not s.word(name):
                continue
            j = s.past(name + 1) if s[name + 1] == "[" else name + 1
            j, last = s.past(j), s.past(j) - 1
            while j < len(s) and not s.fresh[j] and s[j] not in ("{", ";"):  # results
                if s[j] in ("struct", "interface") and s[j + 1] == "{":
                    j += 1
                j = s.past(j) if s[j] in ("(", "[", "{") else j + 1
                last = j - 1
            if s[j] == "{" and not s.fresh[j]:
                last = s.past(j) - 1
            f.add(s[name], "method" if method else "function", k, last, name, seen(s[name]))
        elif t == "type" and s[k - 1] not in (".", "("):
            specs = []
            if s[k + 1] == "(":
                j, close = k + 2, s.match[k + 1]
                while j < close:
                    specs.append(j)
                    j = s.value_end(j, (";",)) if s[j] != ";" else j
                    j += s[j] == ";"
                    if specs[-1] == j:
                        break
            elif s.word(k + 1):
                specs.append(k + 1)
            for at in specs:
                if not s.word(at) or s[at + 1] == "=":
                    continue
                last = s.value_end(at, (";",)) - 1
                f.add(s[at], "type", at, last, at, seen(s[at]))
                f.quiet.append((at, last))


def _script(f: Found) -> None:
    s = f.stream
    typed = s.language != "javascript"
    methods: list[int] = []
    typed_to = 0  # the end of the last type of a variable
    for k in range(len(s)):
        t = s.tok[k]
        if s.kind[k] != "word":
            if t == "{" and _object(s, k, f):
                f.types[k] = "object"
            if t == "{" and k in f.types:
                methods.append(k)
            continue
        keyword = s[k - 1] not in (".", "?.") and not (s[k + 1] in (":", "?") and s[k - 1] in ("{", ","))
        if keyword and t == "function":
            star = s[k + 1] == "*"
            at = k + 1 + star
            if s.word(at):
                f.named.add(at)
                first = _modified(s, k)
                statement = first == 0 or s[first - 1] in (";", "{", "}", ")", "export", "default", "else", "do") or s.fresh[first] and s._ends(first - 1)
                body = _signature_end(s, s.generics(at + 1))
                if s[body] == "{" or typed and statement:
                    last = s.past(body) - 1 if s[body] == "{" else body if s[body] == ";" else body - 1
                    if not typed or statement and not star:
                        f.add(s[at], "function", first, last, at, _exported(s, first))
        elif keyword and t == "class" and s[k + 1] != "=":
            j = k + 1
            name = j if s.word(j) and s[j] not in ("extends", "implements") else None
            j = s.generics(j + 1) if name is not None else j
            while j < len(s) and s[j] not in ("{", ";", ")", "}"):
                j = s.past(j) if s[j] in ("(", "[") else s.generics(j) if s.generics(j) > j else j + 1
            if s[j] != "{":
                continue
            f.types[j] = "class"
            first = _modified(s, k)
            statement = first == 0 or s[first - 1] in (";", "{", "}", ")", "export", "default", "@") or s.fresh[first] and s._ends(first - 1) or _annotated(s, first - 1) < first
            if name is not None:
                f.named.add(name)
                if not typed or statement:
                    f.add(s[name], "class", first, s.past(j) - 1, name, _exported(s, first))
        elif keyword and typed and t in ("interface", "enum", "module", "type", "namespace") and s.word(k + 1) and not s.fresh[k + 1]:
            first = _modified(s, k - 1 if t == "enum" and s[k - 1] == "const" else k)
            if t == "type":
                j = s.generics(k + 2)
                if s[j] != "=":
                    continue
                end = s.value_end(j + 1, (";",))
                f.quiet.append((j, end))
                if s[j + 1] == "{":
                    f.types[j + 1] = "interface"
                whole = s[j + 1] == "{" and s.past(j + 1) == end  # a lone object type ends with its brace
                f.add(s[k + 1], "type", first, end if s[end] == ";" and not whole else end - 1, k + 1, _exported(s, first))
                continue
            body = k + 2
            while body < len(s) and s[body] not in ("{", ";", "}", ")"):
                body = s.generics(body) if s.generics(body) > body else body + 1
            if s[body] != "{" or t in ("module", "namespace") and s[k + 2] == ".":
                continue
            if t == "interface":
                f.types[body] = "interface"
                f.silence(body)
            if t == "namespace":
                continue
            f.add(s[k + 1], t, first, s.past(body) - 1, k + 1, _exported(s, first))
        elif keyword and t in ("const", "let", "var") and s[k + 1] != "enum":
            typed_to = max(typed_to, _variables(f, k))
        elif s[k + 1] == "=" and k >= typed_to and _value(s, k + 2) >= 0 and not (f.types.get(s.up[k]) == "class") and k not in f.named and s[k - 1] not in ("const", "let", "var"):
            first = _reference(s, k)
            params = s[s.up[k]] == "(" and s[s.past(s.up[k])] in ("{", "=>", ":")
            if not params and s[first - 1] not in ("const", "let", "var", ","):
                f.add(s[k], "function", first, _value(s, k + 2), k)
        if s[k + 1] == ":" and s[k - 1] in ("{", ",") and f.types.get(s.up[k]) == "object" and (last := _value(s, k + 2)) >= 0:
            f.add(s[k], "function", k, last, k)
    for opened in methods:
        _methods(f, opened)


def _object(s: Stream, k: int, f: Found) -> bool:
    """Whether the brace at k opens an object literal."""
    if k in f.types:
        return False
    before = s[k - 1]
    if before in ("=", "(", "[", ",", "?", "&&", "||", "??", "return", "yield", "typeof", "default", "...", "||=", "&&=", "??="):
        return True
    if before == ":":
        first = k - 1
        while first - 1 > s.up[k] and s[first - 1] not in (";", "{", "}"):
            first = s.match[first - 1] if s[first - 1] in (")", "]") and s.match.get(first - 1, k) < k else first - 1
        return s[first] not in ("case", "default")
    return False


def _exported(s: Stream, first: int) -> str:
    before = s[first - 1]
    return "public" if before == "export" or before == "default" and s[first - 2] == "export" else "private"


def _signature_end(s: Stream, k: int) -> int:
    """From the parenthesis of the parameters at k: the brace of the body, or the token after the signature."""
    k = s.past(k)
    if s[k] == ":":
        k += 1
        while k < len(s):
            t = s[k]
            if t == "{" and s[k - 1] not in (":", "|", "&", "=>", "<", ",", "is", "keyof", "extends", "?"):
                return k
            if t in (";", ",", ")", "]", "}", "=") or s.fresh[k] and s._ends(k - 1) and t not in ("|", "&", "{", "=>", "extends", "is", "?", ":"):
                return k
            k = s.past(k) if t in ("(", "[", "{") else s.generics(k) if s.generics(k) > k else k + 1
    return k


def _value(s: Stream, k: int) -> int:
    """The last token of the function or arrow function that begins at k; -1 if none does."""
    if s[k] == "async" and not s.fresh[k + 1]:
        k += 1
    if s[k] == "function":
        if s[k + 1] == "*":
            return -1
        body = _signature_end(s, s.generics(k + 2 if s.word(k + 1) else k + 1))
        return s.past(body) - 1 if s[body] == "{" else -1
    if s.word(k) and s[k + 1] == "=>":
        arrow = k + 1
    else:
        opened = s.generics(k)
        if s[opened] != "(":
            return -1
        arrow = s.past(opened)
        if s[arrow] == ":":
            arrow += 1
            while arrow < len(s) and s[arrow] not in ("=>", ";", "=", ",", ")", "}", "]"):
                arrow = s.past(arrow) if s[arrow] in ("(", "[", "{") else s.generics(arrow) if s.generics(arrow) > arrow else arrow + 1
                if s[arrow] == "=>" and s[arrow - 1] == ")" and s[s.match.get(arrow - 1, arrow) - 1] in (":", "|"):
                    arrow += 1  # a function type as the result
        if s[arrow] != "=>":
            return -1
    return s.past(arrow + 1) - 1 if s[arrow + 1] == "{" else s.value_end(arrow + 1) - 1


def _variables(f: Found, k: int) -> int:
    """The functions that a declaration binds; where the last type in it ends."""
    s, j, typed_to = f.stream, k + 1, 0
    seen = _exported(s, k)
    while s.word(j):
        at, eq = j, j + 1
        if s[eq] in (":", "!"):
            while eq < len(s) and s[eq] not in ("=", ";", ",", ")", "of", "in") and not (s.fresh[eq] and s._ends(eq - 1) and not s._continues(eq)):
                eq = s.past(eq) if s[eq] in ("(", "[", "{") else s.generics(eq) if s.generics(eq) > eq else eq + 1
            typed_to = eq
        if s[eq] == "=" and (last := _value(s, eq + 1)) >= 0:
            f.add(s[at], "function", at, last, at, seen)
        j = s.value_end(eq + 1 if s[eq] == "=" else eq)
        if s[j] != ",":
            break
        j += 1
    return typed_to


def _reference(s: Stream, k: int) -> int:
    """The first token of the member expression that ends at word k."""
    while s[k - 1] in (".", "?.") and k >= 2:
        k -= 2
        while s[k] in (")", "]") and s.match.get(k, k) < k:
            k = s.match[k]
            if s.word(k - 1) and s[k - 1] not in OPERATORS or s[k - 1] in (")", "]"):
                k -= 1
    return k


def _methods(f: Found, opened: int) -> None:
    """Methods directly inside the body of a class, interface or object."""
    s, kind = f.stream, f.types[opened]
    typed, close = s.language != "javascript", s.match[opened]
    k = opened + 1
    while k < close:
        if s[k] in ("{", "[") or s[k] == "(" :
            k = s.past(k)
            continue
        j = k + 1 + (s[k + 1] in ("?", "!"))
        j = s.generics(j)
        before = s[k - 1]
        begins = k - 1 == opened or before in (";", "}", ",") or before in MEMBER_WORDS and s.word(k - 1) and s[k - 2] not in (".", "?.", "=") or before == "*" and s[k - 2] in ("{", ";", "}", ",", "async", "static") or s.fresh[k] and s._ends(k - 1) and kind != "object" or kind == "class" and _annotated(s, k - 1) < k - 1
        if s.word(k) and s[j] == "(" and begins:
            body = _signature_end(s, j)
            if s[body] == "{" or kind != "object":
                f.named.add(k)
            first = k - (before == "*")
            while s.word(first - 1) and s[first - 1] in MEMBER_WORDS and first - 1 > opened:
                first -= 1
            if not typed:
                while (at := _annotated(s, first - 1)) < first and at > opened:
                    first = at
            whole = s[body] == "{"
            if (whole or typed and kind != "object") and s[k][0] != "#" and not (s.language == "javascript" and s[k] == "constructor"):
                f.add(s[k], "method", first, s.past(body) - 1 if whole else body - 1, k, "private")
            k = s.past(body) if whole else max(body, k + 1)
            continue
        k += 1


def _c(f: Found) -> None:
    s = f.stream
    cpp = s.language == "cpp"
    inside: dict[int, str] = {}  # what each brace opens: type, function, list, block, outer
    for k in range(len(s)):
        t = s.tok[k]
        if t in ("__attribute__", "__declspec", "alignas", "noexcept", "decltype") and s[k + 1] == "(":
            f.silence(k + 1)
        if t == "typedef" and s.kind[k] == "word":
            stop = k + 1
            while stop < len(s) and s[stop] != ";":
                stop = s.past(stop) if s[stop] in ("(", "[", "{") else stop + 1
            name = stop - 1
            if s.word(name) and s[name] not in BASIC_TYPES and s[name - 1] not in ("*", "&", "typedef"):
                f.add(s[name], "type", k, stop, name)
        if t != "{":
            continue
        up = s.up[k]
        if up >= 0 and s[up] != "{":
            inside[k] = "list"
            continue
        first = _member(s, k)
        while s[first] in ("public", "private", "protected", "signals", "slots") and s[first + 1] == ":":
            first += 2
        while s[first] == "[" and s[first + 1] == "[":
            first = s.past(first)
        body = first
        while cpp and s[body] == "template" and s[body + 1] == "<":
            body = max(s.generics(body + 1), body + 2)
            while s[body] == "requires":
                body = s.past(body + 1) if s[body + 1] == "(" else body + 1
        within = inside.get(up, "outer")
        last = s.past(k) - 1
        declarator = _declarator(s, body, k) if within in ("outer", "type") else None
        words = [s[j] for j in range(body, min(k, body + 6))]
        if declarator is not None:
            name, start = declarator
            inside[k] = "function"
            f.named.add(start)
            if s[start - 1] != "~":
                qualified = s[start - 1] == "::"
                f.add(name, "method" if qualified or within == "type" else "function", body, last, start)
            _initialisers(f, start, k)
        elif words[:1] == ["namespace"] or words[:2] == ["inline", "namespace"] or s[body] == "extern" and s.kind[min(body + 1, len(s) - 1)] == "string":
            inside[k] = "outer"
        elif "=" not in (s[j] for j in range(body, k)) and (at := next((j for j in range(body, k) if s[j] in ("class", "struct", "union", "enum")), None)) is not None and within != "list" and not _grouped(s, at, k):
            is_enum = s[at] == "enum"
            inside[k] = "list" if is_enum else "type"
            name = at + 1
            while name < k and s[name] in ("class", "struct", "__attribute__", "alignas", "__declspec", "["):
                name = s.past(name + 1) if s[name + 1] == "(" else s.past(name) if s[name] == "[" else name + 1
            while s.word(name + 1) and s[name + 1] != "final":
                name += 1
            if s.word(name) and name < k and s[name + 1] not in ("<", "::"):
                f.add(s[name], "type" if is_enum else "class", at, last, name)
            if not is_enum:
                f.types[k] = "class"
        else:
            inside[k] = "list" if s[k - 1] in ("=", ",", "return") or within == "list" else "block" if within in ("function", "block") else "outer"


def _grouped(s: Stream, at: int, k: int) -> bool:
    """Whether a parenthesis between a type's word and its brace makes it something else than a type."""
    return any(s[j] == "(" and s[j - 1] not in ("__attribute__", "alignas", "__declspec") and s.up[j] == s.up[at] and s[j - 1] != ">" for j in range(at, k)) and ":" not in (s[j] for j in range(at, k))


_CONTROL = frozenset("if for while switch do else try catch return namespace __attribute__ __declspec alignas decltype noexcept throw requires static_assert asm __asm__ __asm".split())


def _declarator(s: Stream, first: int, brace: int) -> tuple[str, int] | None:
    """The name and its token, of the function whose body opens at brace and whose head begins at first."""
    k, groups = first, []
    if s[first] in ("if", "for", "while", "switch", "do", "else", "try", "catch", "return", "namespace", "enum"):
        return None
    while k < brace:
        t = s[k]
        if t == "operator":
            at, name = k, ""
            k += 1
            while k < brace and s[k] != "(" or name == "" and s[k] == "(":
                if s[k] == "(":
                    name, k = "()", s.past(k)
                    break
                name += (" " if s.word(k) and (not name or name[-1].isalnum()) else "") + s[k]
                k += 1
            return ("operator" + name, at) if s[k] == "(" else None
        if t in ("__attribute__", "__declspec", "alignas", "decltype", "noexcept", "throw", "requires") and s[k + 1] == "(":
            k = s.past(k + 1)
            continue
        if t == "<" and s.word(k - 1) and s.generics(k) > k:
            k = s.generics(k)
            continue
        if t == "(":
            at = s.back_generics(k - 1) - 1 if s[k - 1] == ">" else k - 1
            if s.word(at) and s[at] not in _CONTROL and s[at] not in BASIC_TYPES:
                groups.append(at)
                if s.past(k) < brace and s[s.past(k)] in (":", "->"):
                    break
            k = s.past(k)
            continue
        if t in ("=", "[") and not groups or t in (":", "->", ";"):
            break
        k = s.past(k) if t in ("[", "{") else k + 1
    if not groups:
        return None
    at = groups[0]
    if len(groups) > 1 and at == first and s[s.past(at + 1)] not in (":", "->", "{", "const", "override", "final", "&", "&&"):
        at = groups[1]  # the first is a macro before the declaration
    return s[at], at


def _initialisers(f: Found, name: int, brace: int) -> None:
    """The members that a constructor's list names are no calls; what it passes to them can be."""
    s, k = f.stream, name
    while k < brace and s[k] != ":":
        k = s.past(k) if s[k] in ("(", "[") else k + 1
    while k < brace:
        if s[k] in ("(", "{"):
            at = s.back_generics(k - 1) - 1 if s[k - 1] == ">" else k - 1
            f.named.add(at)
        k = s.past(k) if s[k] in ("(", "[", "{") else k + 1


def _member_types(f: Found) -> None:
    """Java and C#: types, and the methods directly inside their bodies."""
    s = f.stream
    java = s.language == "java"
    heads = {"class": "class", "interface": "interface", "enum": None, "record": None if java else "class", "struct": "class"}
    if java:
        heads.pop("struct")
    for k in range(len(s)):
        t = s.tok[k]
        if t == "{" and java and s[k - 1] == ")" and s.match.get(k - 1, k) < k:
            j = s.match[k - 1] - 1
            j = s.back_generics(j) - 1 if s[j] == ">" else j
            while s[j - 1] == "." and s.word(j - 2):
                j -= 2
            if s[j - 1] == "new":
                f.types[k] = "class"
        if s.kind[k] != "word":
            continue
        if t in heads and s.word(k + 1) and s[k - 1] not in (".", "new", "::", "(", "where", ",", ":") and (t != "record" or s[k + 2] in ("(", "<", "{", ":", ";") or s[k + 1] in ("struct", "class")):
            name = k + 1
            if t == "record" and s[k + 1] in ("struct", "class") or s[k - 1] == "@":
                continue
            body = _body(s, name + 1)
            if s[body] == "{":
                f.types[body] = "interface" if t == "interface" else "class"
            elif t != "record":
                continue
            f.named.add(name)
            if heads[t] is not None:
                start = k - 1 if t in ("struct", "class") and s[k - 1] == "record" else k
                f.add(s[name], heads[t], _modified(s, start), s.past(body) - 1 if s[body] == "{" else body, name)
        elif not java and t == "namespace" and s.word(k + 1):
            body = _body(s, k + 1)
            if s[body] == "{" and s[k + 2] != ".":
                f.add(s[k + 1], "module", k, s.past(body) - 1, k + 1)
        elif s.up[k] in f.types and s[(opened := s.generics(k + 1))] == "(" and t not in NO_CALL[s.language] and k not in f.named and s[k - 1] not in heads and (s.word(k - 1) and s[k - 1] not in ("new", "return", "throw", "else") or s[k - 1] in (">", "]", "?", "*", ".") or not java and s[k - 1] == ")" and _tuple(s, k - 1)):
            first = _member(s, k)
            before = s[k - 1]
            head = _level(s, first, k)
            if before in MODIFIERS[s.language] or s[_back_name(s, k) - 1] in ("", "{", "}", ";") or "=" in head or "=>" in head or before == "." and java or "operator" in head or "delegate" in head or _annotated(s, k) < k:
                continue
            after = s.past(opened)
            while s[after] == "[":
                after = s.past(after)
            body = _body(s, after, (";", "=>", "default", "=") if not java else (";", "default", "="))
            if s[body] == "default":
                body = _body(s, body + 1, (";",)) if s[body + 1] != "{" else body
                while s[body] == "{" and s[s.past(body)] == ";":
                    body = s.past(body)
            if s[body] == "=>":
                last = body
                while last < len(s) and s[last] != ";":
                    last = s.past(last) if s[last] in ("(", "[", "{") else last + 1
            elif s[body] == "{":
                last = s.past(body) - 1
            elif s[body] == ";":
                last = body
            else:
                continue
            f.add(t, "method", first, last, k)


def _level(s: Stream, first: int, stop: int) -> list[str]:
    """The tokens from first up to stop that lie in no bracket between them."""
    out, k = [], first
    while k < stop:
        out.append(s.tok[k])
        k = s.past(k) if s[k] in ("(", "[", "{") else k + 1
    return out


def _tuple(s: Stream, k: int) -> bool:
    """Whether the parentheses that close at k are a type at the beginning of a member."""
    at = s.match.get(k, k) - 1
    return s[at] in MODIFIERS["csharp"] or s[at] in ("{", "}", ";", "]")


def _back_name(s: Stream, k: int) -> int:
    """The first token of the dotted name that ends at word k."""
    while s[k - 1] == "." and s.word(k - 2):
        k -= 2
    return k


def _php(f: Found) -> None:
    s = f.stream
    for k in range(len(s)):
        t = s.tok[k].lower()
        if s.kind[k] != "word" or s[k - 1] in ("->", "::", "$", "?->"):
            continue
        if t in ("class", "interface", "trait", "enum") and (s.word(k + 1) and s[k + 1][0] != "$" or t == "class" and s[k - 1] == "new"):
            body = _body(s, k + 1)
            if s[body] != "{":
                continue
            f.types[body] = t
            if s[k - 1] != "new" and t != "enum" and s[k + 1] not in ("extends", "implements"):
                f.add(s[k + 1], "interface" if t == "interface" else "class", _modified(s, k), s.past(body) - 1, k + 1)
        elif t == "namespace" and s.word(k + 1):
            j = k + 1
            while s[j + 1] == "\\" and s.word(j + 2):
                j += 2
            body = j + 1
            if s[body] in ("{", ";"):
                f.add(s.text[s.at[k + 1] : s.end[j]], "module", k, s.past(body) - 1 if s[body] == "{" else body, k + 1)
        elif t == "function":
            at = k + 1 + (s[k + 1] == "&")
            if not s.word(at) or s[at + 1] != "(":
                continue
            body = _body(s, s.past(at + 1))
            method = s.up[k] in f.types
            if s[body] == "{" or method and s[body] == ";":
                f.add(s[at], "method" if method else "function", _modified(s, k), s.past(body) - 1 if s[body] == "{" else body, at)


def _kotlin_head(s: Stream, k: int) -> int:
    """The last token of a type's head from the token after its name, or of its body."""
    k = s.generics(k)
    last = k - 1
    while _modified(s, k + 1) <= k or s[k] in ("constructor", "@"):
        k += 1
    if s[k] == "(":
        k = s.past(k)
        last = k - 1
    if s[k] in (":", "where"):
        while k < len(s) and s[k] not in ("{", ";", "}", ")") and not (s.fresh[k] and s._ends(k - 1) and s[k] not in (",", ":", "where", "by", "{") and s[k - 1] not in ("by", ":", ",", "where")):
            k = s.past(k) if s[k] in ("(", "[") else s.generics(k) if s.generics(k) > k else k + 1
        last = k - 1
    return s.past(k) - 1 if s[k] == "{" else last


def _kotlin(f: Found) -> None:
    s = f.stream
    for k in range(len(s)):
        t = s.tok[k]
        if s.kind[k] != "word" or s[k - 1] in (".", "?.", "::"):
            continue
        if t in ("class", "interface", "object") and s.word(k + 1) and not (t == "object" and s[k - 1] == "companion"):
            f.add(s[k + 1].strip("`"), "class", _modified(s, k), _kotlin_head(s, k + 2), k + 1)
        elif t == "fun" and s[k + 1] != "interface":
            at = s.generics(k + 1)
            while at < len(s) and (s[at + 1] in (".", "?.", "<", "?") or s[at] == "("):
                j = s.past(at) if s[at] == "(" else s.generics(at + 1)
                j += s[j] == "?"
                if s[j] not in (".", "?."):
                    break
                at = j + 1
            if not s.word(at) or s[at + 1] != "(":
                continue
            j = s.past(at + 1)
            last = j - 1
            if s[j] == ":":
                j += 1
                while j < len(s) and s[j] not in ("{", "=", ";", "}", ")", ",") and not (s.fresh[j] and s._ends(j - 1) and s[j] not in ("->", ".", "?", "where")):
                    j = s.past(j) if s[j] in ("(", "[") else s.generics(j) if s.generics(j) > j else j + 1
                last = j - 1
            if s[j] == "where":
                while j < len(s) and s[j] not in ("{", "=", ";", "}"):
                    j += 1
                last = j - 1
            if s[j] == "{":
                last = s.past(j) - 1
            elif s[j] == "=":
                last = _kotlin_value(s, j + 1)
            f.add(s[at].strip("`"), "function", _modified(s, k), last, at)


def _kotlin_value(s: Stream, k: int) -> int:
    """The last token of the expression that begins at k; a lambda or block on the same line goes on."""
    while k < len(s):
        end = s.value_end(k, (";",))
        if s[end] == "{" and not s.fresh[end]:
            k = s.past(end)
            if s[k] in ("else", "catch", "finally", ".", "?.", "?:"):
                continue
            if k >= len(s) or s.fresh[k] and not s._continues(k) or s[k] in (")", "]", "}", ";"):
                return k - 1
            continue
        return end - 1
    return len(s) - 1


def _swift(f: Found) -> None:
    s = f.stream
    for k in range(len(s)):
        t = s.tok[k]
        if s.kind[k] != "word" or s[k - 1] == ".":
            continue
        if t in ("struct", "class", "enum", "actor", "protocol", "extension") and s.word(k + 1) and s[k + 1] not in ("func", "var", "let", "subscript", "final", "override", "init"):
            body = _body(s, k + 2)
            if s[body] != "{":
                continue
            f.types[body] = t
            if t != "extension":
                f.add(s[k + 1], "interface" if t == "protocol" else "class", _modified(s, k), s.past(body) - 1, k + 1)
        elif t == "func":
            at, j = k + 1, k + 2
            if not s.word(at):  # an operator
                while s[j] not in ("(", "<") and s.kind[j] == "punct":
                    j += 1
                if s[j] == "<" and s.generics(j) == j:
                    j += 1
            j = s.generics(j)
            if s[j] != "(":
                continue
            j = s.past(j)
            while j < len(s) and s[j] not in ("{", ";", "}", ")") and not (s.fresh[j] and s._ends(j - 1) and s[j] not in ("->", "throws", "where", "async", "rethrows")):
                j = s.past(j) if s[j] in ("(", "[") else j + 1
            if s[j] == "{":
                name = s[at].strip("`") if s.word(at) else s.text[s.at[at] : s.end[j - 1]].split("(")[0].split("<")[0].strip() or s[at]
                f.add(name, "method" if s.up[k] in f.types else "function", _modified(s, k), s.past(j) - 1, at)


def _bash(f: Found) -> None:
    s = f.stream
    for k in range(len(s)):
        if s.kind[k] != "word" or k in f.named:
            continue
        start = k == 0 or s.fresh[k] or s[k - 1] in (";", "{", "}", "&&", "||", "(", ")", "&", "|", "then", "do", "else")
        if not start:
            continue
        at = k + 1 if s[k] == "function" and s.word(k + 1) else k
        body = at + 1
        if s[body] == "(" and s[body + 1] == ")":
            body += 2
        elif at == k:
            continue
        if s[body] in ("{", "("):
            f.add(s[at], "function", k, s.past(body) - 1, at)


_FAMILIES = {
    "rust": _rust, "go": _go, "javascript": _script, "typescript": _script, "tsx": _script, "c": _c, "cpp": _c, "java": _member_types, "csharp": _member_types, "php": _php, "kotlin": _kotlin, "swift": _swift, "bash": _bash,
}
LANGUAGES = frozenset(_FAMILIES)


def find(text: str, language: str) -> Found:
    found = Found(Stream(text, language))
    _FAMILIES[language](found)
    return found


def calls(f: Found) -> list[tuple[int, bool]]:
    """The token of each called name, and whether a receiver stands before it."""
    s, language = f.stream, f.stream.language
    c_like, quiet = language in ("c", "cpp"), _merged(f.quiet)
    starts = [a for a, _ in quiet]
    out = []
    for k in range(len(s)):
        if s.kind[k] != "word" or k in f.named:
            continue
        t, before = s.tok[k], s[k - 1]
        j, macro = k + 1, False
        if language == "rust" and s[j] == "!" and s[j + 1] in ("(", "[", "{") and t != "macro_rules":
            macro = before != "::"
        elif language == "rust" and s[j] == "::" and s[j + 1] == "<":
            j = s.generics(j + 1)
        elif language in ("typescript", "tsx", "cpp") and s[j] == "<":
            j = s.generics(j)
        elif language == "go" and s[j] == "[":
            j = s.past(j) if not any(s.kind[x] in ("string", "number") for x in range(j, min(s.past(j), len(s)))) else j
        elif language in ("javascript", "typescript", "tsx") and s[j] == "?.":
            j += 1
        called = s[j] == "(" or language in ("javascript", "typescript", "tsx") and s[j][:1] == "`"
        if not (called or macro) or t[0] in "'#" or t in NO_CALL[language] and before not in (".", "?."):
            continue
        if c_like and t in BASIC_TYPES:
            continue
        # two names in a row declare something, but for a new line where lines end statements
        if s.word(k - 1) and (before in ("new", "fn", "func", "function", "class") or before not in _BEFORE_CALL and (language in ("c", "cpp", "java", "rust") or not s.fresh[k])):
            continue
        first = _back_name(s, k)
        if first != k and s[first - 1] == "new" or s[first - 1] == "@" or language == "cpp" and _scoped_new(s, k):
            continue
        if language == "go" and before == "]" and s.match.get(k - 1, k) < k and not _operand(s, s.match[k - 1] - 1):
            continue  # a conversion to a slice, array or map
        p = bisect.bisect_right(starts, k) - 1
        if p >= 0 and quiet[p][0] < k < quiet[p][1]:
            continue
        if macro:
            out.append((k, False))
        else:
            generic = language == "java" and before == ">" and s[s.back_generics(k - 1) - 1] == "."
            out.append((k, before in (".", "?.") or generic or c_like and before == "->"))
    return out


def _operand(s: Stream, k: int) -> bool:
    return k >= 0 and (s.word(k) and s[k] not in OPERATORS and s[k] != "map" or s[k] in (")", "]"))


def _scoped_new(s: Stream, k: int) -> bool:
    while s[k - 1] == "::" and s.word(k - 2):
        k -= 2
    return s[k - 1] == "new" or s[k - 1] == "::" and s[k - 2] == "new"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


# What opens a block that `end` closes, where a statement begins; and words whose `do` belongs to them.
_RUBY_OPEN, _RUBY_LOOP = frozenset("class module def if unless case while until for begin".split()), frozenset("while until for".split())
_RUBY_TOKEN = re.compile(
    r"^=begin\b.*?^=end\b[^\n]*|^__END__\b.*|#[^\n]*"
    r"|(?P<heredoc><<[~-]?(?P<q>['\"`]?)(?P<mark>[A-Z_a-z]\w*)(?P=q))"
    r"|%[wWiIqQrx]?(?:\((?:[^()\\]|\\.)*\)|\[(?:[^\[\]\\]|\\.)*\]|\{(?:[^{}\\]|\\.)*\}|<(?:[^<>\\]|\\.)*>|(?P<d>[|!/])(?:(?!(?P=d)).)*(?P=d))"
    r"|:\"(?:\\.|[^\"\\])*\"|\"(?:\\.|\#\{[^{}]*\}|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"
    r"|\?(?:\\.|[^\s\w]|\w(?!\w))|:[^\W\d]\w*[?!=]?|(?P<word>(?:@@?|\$)?[^\W\d]\w*[?!]?(?!:(?!:))|[^\W\d]\w*:)|(?P<number>\d[\w.]*)|(?P<newline>\n)|(?P<punct>::|=>|==|\S)",
    re.S | re.M,
)
_RUBY_NAME = re.compile(r"[ \t]+(?:(?:self|[^\W\d]\w*)\.)?(?P<name>[^\W\d]\w*[?!]?=?(?![=~>])|[^\W\d]\w*[?!]?|\[\]=?|===?|=~|<=>|<=|>=|<<|>>|!=|!~|\*\*|[+-]@|[-+*/%&|^~<>!`])")
_RUBY_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|\#\{[^{}]*\}|[^/\\\n])+/[a-z]*")


def ruby(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, start, end) of the classes, modules and methods."""
    out: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, tuple | None]] = []
    p, begins, operand, named, loop, waiting = 0, True, False, False, 0, []
    while p < len(text):
        if text[p] in " \t\r\\":
            p += 2 if text.startswith("\\\n", p) else 1
            continue
        literal = not operand or named and text[p - 1 : p] in (" ", "\t") and text[p + 1 : p + 2] not in (" ", "=", "")  # `puts %w[a]`, but `a % b`
        if text[p] == "/" and literal and (m := _RUBY_REGEX.match(text, p)):
            p, begins, operand = m.end(), False, True
            continue
        m = _RUBY_TOKEN.match(text, p)
        if m is None:
            p += 1
            continue
        if m.group()[0] == "%" and not literal or m.group()[0] == "?" and operand or m.group("heredoc") and operand and m.group()[2] not in "~-":
            p, begins, operand, named = p + 1, False, False, False
            continue
        p = m.end()
        word = m.group("word")
        named = word is not None
        if m.group("newline"):
            for mark in waiting:
                close = re.compile(rf"^[ \t]*{mark}\b[^\n]*\n?", re.M).search(text, p)
                p = close.end() if close else len(text)
            waiting, begins, operand, loop = [], True, False, 0
        elif m.group("heredoc"):
            waiting.append(m.group("mark"))
            begins, operand = False, True
        elif word and text[m.start() - 1 : m.start()] != "." and not word.endswith(":"):
            opens = word in _RUBY_OPEN and (begins or word in ("def", "class", "module", "begin", "case") or word in ("if", "unless", "while", "until") and not operand)
            operand = word not in _RUBY_OPEN and word not in ("then", "else", "elsif", "do", "and", "or", "not", "in", "when", "ensure", "rescue")
            begins = word in ("then", "else", "do", "begin", "ensure", "and", "or", "not")
            if word == "end" and stack:
                kind, held = stack.pop()
                if held:
                    out.append((*held, m.end()))
                begins = False
            elif word == "do":
                if loop:
                    loop -= 1
                else:
                    stack.append(("do", None))
            elif opens and word == "def":
                name = _RUBY_NAME.match(text, p)
                if not name:
                    continue
                p = name.end()
                rest = re.compile(r"[ \t]*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?[ \t]*=(?![=~>])[ \t]*").match(text, p)
                if rest and not (name.group("name").endswith("=") and rest.group(1)):
                    out.append((name.group("name"), "method", m.start(), _ruby_line(text, rest.end())))
                    p = rest.end()
                else:
                    stack.append(("def", (name.group("name"), "method", m.start())))
                begins, operand = False, False
            elif opens and word in ("class", "module"):
                name = re.compile(r"[ \t]+(?:::)?(?:\w+::)*(?P<name>[^\W\d]\w*)").match(text, p)
                stack.append((word, (name.group("name"), word, m.start()) if name else None))
                p = name.end() if name else p
                begins, operand = False, True
            elif opens:
                stack.append((word, None))
                loop += word in _RUBY_LOOP
        else:
            t = m.group()
            operand = bool(m.group("number") or word or t[0] in "\"'`:%?" and len(t) > 1 or t in (")", "]", "}"))
            begins = t in (";", "(", "{", "|", "=", "[", ",", "=>") if not word else word.endswith(":")
            if t[0] == "#" or t.startswith("=begin"):
                begins, operand = begins or False, operand
    return sorted(out, key=lambda x: (x[2], -x[3]))


def _ruby_line(text: str, p: int) -> int:
    """The end of an expression that begins at p: its line, and further ones while a bracket is open."""
    depth = 0
    for m in _RUBY_TOKEN.finditer(text, p):
        t = m.group()
        if t == "\n" and depth <= 0 or t == ";" and depth <= 0:
            return len(text[:m.start()].rstrip())
        if t[0] == "#" and depth <= 0:
            return len(text[: m.start()].rstrip())
        depth += t in ("(", "[", "{")
        depth -= t in (")", "]", "}")
    return len(text.rstrip())


def lua(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, start, end) of the functions and methods."""
    s = Stream(text, "lua")
    stack: list[tuple[str, tuple | None]] = []
    out = []
    for k in range(len(s)):
        t = s.tok[k]
        if s.kind[k] != "word" or s[k - 1] in (".", ":") and t != "function":
            continue
        if t == "function":
            if s.word(k + 1):
                at, kind = k + 1, "function"
                while s[at + 1] in (".", ":") and s.word(at + 2):
                    kind = "method" if s[at + 1] == ":" else "function"
                    at += 2
                stack.append((t, (s[at], kind, s.at[k - 1 if s[k - 1] == "local" else k])))
            elif s[k - 1] == "=" and s.word(k - 2):
                stack.append((t, (s[k - 2], "function", s.at[_back_name(s, k - 2)])))
            else:
                stack.append((t, None))
        elif t in ("if", "do", "repeat"):
            stack.append((t, None))
        elif t in ("end", "until") and stack:
            _, held = stack.pop()
            if held:
                out.append((*held, s.end[k]))
    return sorted(out, key=lambda x: (x[2], -x[3]))

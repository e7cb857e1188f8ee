"""YAML and TOML keys: each is given by its name and the very text of its pair."""

import pytest

from quarrylens.extract.data_keys import toml_keys, yaml_keys
from quarrylens.extract.facts import symbols_of

YAML = [
    ("a: |\n  x: 1\n  y: 2\nb: 3\n", [("a", "a: |\n  x: 1\n  y: 2"), ("b", "b: 3")]),
    ("t: >-\n    folded: a\n\n    b: c\n# note\nu: 1\n", [("t", "t: >-\n    folded: a\n\n    b: c"), ("u", "u: 1")]),
    ("{e: 1, f: 2}\n", [("e", "e: 1", False), ("f", "f: 2", False)]),
    ("'a:b': 2\nurl:x: 3\n\"q\": 4\n", [("a:b", "'a:b': 2"), ("url:x", "url:x: 3"), ("q", '"q": 4')]),
    ("s: http://x.y/z # c: d\nr: plain\n  continued: no\n", [("s", "s: http://x.y/z"), ("r", "r: plain\n  continued: no")]),
    ("c: &anc !t\n  - d: 1\n    e:\n    - g: h\n  - - i: j\n", [("c", "c: &anc !t\n  - d: 1\n    e:\n    - g: h\n  - - i: j"), ("d", "d: 1", False), ("e", "e:\n    - g: h", False), ("g", "g: h", False), ("i", "i: j", False)]),
    ("l:\n- m: n\n  o: p\nz: 1\n", [("l", "l:\n- m: n\n  o: p"), ("m", "m: n", False), ("o", "o: p", False), ("z", "z: 1")]),
    ("q: \"multi\n  line: x\"\nf: [2, {g: \"h: i\"},\n  j: k]\n", [("q", 'q: "multi\n  line: x"'), ("f", 'f: [2, {g: "h: i"},\n  j: k]'), ("g", 'g: "h: i"', False), ("j", "j: k", False)]),
    ("y: 0\n? k e y\n: v\nz: 1\n", [("y", "y: 0"), ("k e y", "? k e y\n: v"), ("z", "z: 1")]),
    ("%YAML 1.2\n---\n- v: 1\n  w: 2\n---\n  x: 1\n  y:\n    z: 2\n...\n", [("v", "v: 1", False), ("w", "w: 2", False), ("x", "x: 1"), ("y", "y:\n    z: 2"), ("z", "z: 2", False)]),
    ("<<: *base\n8080: y\ntrue: no\n", [("<<", "<<: *base"), ("8080", "8080: y"), ("true", "true: no")]),
    ("a:\n  b:\n    c: 1\n\n  d: 'it''s: x'\n", [("a", "a:\n  b:\n    c: 1\n\n  d: 'it''s: x'"), ("b", "b:\n    c: 1", False), ("c", "c: 1", False), ("d", "d: 'it''s: x'", False)]),
    ("- a\n- b\n", []), ("", []), ("just text\n", []), ("a: {b: ", [("a", "a: {b:"), ("b", "b:", False)]), ("k: |\n", [("k", "k: |")]), ("é: ü\n", [("é", "é: ü")]),
]
TOML = [
    ('a = """\nx = 1\n[no]\n"""\nb = 2\n', [("a", 'a = """\nx = 1\n[no]\n"""'), ("b", "b = 2")]),
    ("m = '''\nn = 1'''\n\"q r\" = 3 # z = 1\n'l' = 4\n", [("m", "m = '''\nn = 1'''"), ("q r", '"q r" = 3'), ("l", "'l' = 4")]),
    ('d.e = { f = 1, "g" = [ { h = 2 }, "}" ] }\n', [("d.e", 'd.e = { f = 1, "g" = [ { h = 2 }, "}" ] }'), ("f", "f = 1", False), ("g", '"g" = [ { h = 2 }, "}" ]', False), ("h", "h = 2", False)]),
    ("k = [\n  1, # x = 2\n  \"]\",\n]\nl = 1979-05-27 07:32:00\n", [("k", 'k = [\n  1, # x = 2\n  "]",\n]'), ("l", "l = 1979-05-27 07:32:00")]),
    ("r = 1\n[a.b]\nc = 'it\"s'\n[[\"x y\"]]\n  z = true\n", [("r", "r = 1"), ("a.b", "[a.b]\nc = 'it\"s'\n"), ("c", "c = 'it\"s'", False), ("x y", '[["x y"]]\n  z = true\n'), ("z", "z = true", False)]),
    ("", []), ("# only\n", []), ("broken\na = 1\n", [("a", "a = 1")]), ("a = ", [("a", "a = ")]),
]


@pytest.mark.parametrize("read,text,want", [(yaml_keys, *c) for c in YAML] + [(toml_keys, *c) for c in TOML])
def test_keys_and_their_pairs(read, text, want):
    assert [(n, text[a:b], top) for n, a, b, top in read(text)] == [(w[0], w[1], w[2] if len(w) > 2 else True) for w in want]


@pytest.mark.parametrize("language,texts", [("yaml", YAML), ("toml", TOML)])
def test_top_level_and_deep_symbols(language, texts):
    for text, want in texts:
        assert [s.name for s in symbols_of(text, language, True)] == [w[0] for w in want]
        assert [s.name for s in symbols_of(text, language)] == [w[0] for w in want if len(w) < 3]


def test_long_files_take_time_in_proportion():
    import time

    took = []
    for n in (2_000, 8_000):
        began = time.process_time()
        assert len(yaml_keys("".join(f"k{k}:\n  a: [1, {{b: 2}}]\n  t: |\n    x: y\n" for k in range(n)))) == 4 * n
        assert len(toml_keys("".join(f"[t{k}]\na = [1, {{ b = 2 }}]\ns = '''\nx = 1'''\n" for k in range(n)))) == 4 * n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2

import random
import re

from quarrylens.llm.quality_rules import STOP_WORDS, quality_filter, quality_rules

SCHEMA = "doc_id long, text string, n_words string, kept int"
WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(WORD, t)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def corpus():
    rng = random.Random(4)
    rows = [(None, None, "x", 1), (1, "", None, None), (2, " \t\x0b\n", None, None), (3, "a a a a a a", None, None), (4, "é ü ß # $$ <>", None, None), (5, "x" * 20000, None, None)]
    for k in range(150):
        vocab = ["the", "of", "und", "wört", "abc", "de#"][: rng.randint(2, 6)] + ["w%d" % rng.randrange(300) for _ in range(rng.randint(0, 200))]
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", "  ", "\r\n"]) for _ in range(rng.randint(0, 200)))
        rows.append((10 + k, rng.choice(["", "\n", " "]) + text, None, None))
    rows.append((300, "same line here\n" * 400, None, None))
    return rows + [rows[20]]


def test_measures_match_brute_force(spark):
    rows = corpus()
    got = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_prose_is_kept_and_junk_is_not(spark):
    rng = random.Random(5)
    prose = " ".join(rng.choice([*STOP_WORDS[:10], "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(3, 9)))]) for _ in range(200))
    junk = " ".join(w.upper() + "!!" for w in prose.split())
    rows = [(1, prose, None, 7), (2, junk, None, None), (3, prose.replace(" ", "### "), None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = quality_filter(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]


def test_no_python_in_the_plan(spark):
    plan = quality_rules(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []

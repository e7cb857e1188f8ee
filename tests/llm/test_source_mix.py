import random
import re
from collections import defaultdict

import pytest

from quarrylens.llm.source_mix import mix_documents, source_mix, source_targets

SCHEMA = "doc_id long, text string, source string, size int, taken string"


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(by_source, weights=(3, 1, 2)):
    order = sorted((s for s in by_source if s is not None)) + ([None] if None in by_source else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full, left, out = set(), 1.5 * sum(by_source.values()), {}
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(2 * by_source[s] for s in full)
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) > 2 * by_source[s] + 1e-9]
        if not over:
            break
        full |= set(over)
    for s in order:
        out[s] = 2 * by_source[s] if s in full else rest * w[s] / sum(w[x] for x in free)
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = [(None, None, None, 1, "x"), (1, "", "b", None, None), (2, " \t", None, None, None), (3, "a", "Z", None, None)]
    for k in range(600):
        source = rng.choice(["a", "a", "a", "b", "cé", None, "d"])
        rows.append((10 + k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))) + rng.choice(["", " ", "\n"]), source, k, None))
    rows += [rows[50], rows[50], (7, "word " * 3000, "d", None, None)]
    return rows


def test_targets_and_taken(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = source_mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    again = source_mix(df.repartition(3)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by_source = defaultdict(int)
    for _, t, s, _, _ in rows:
        by_source[s] += sizes(t)
    want = targets(by_source)
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by_source[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    text = {r[0]: sizes(r[1]) for r in rows}
    assert all(r.size == text[r.doc_id] for r in got)


def test_mixed_rows_hold_what_was_taken(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA)
    taken = sum(r.taken for r in source_mix(df).collect())
    df = df.selectExpr("*", "1 as times", "2 as rows", "3 as tie", "4 as d")
    mixed = mix_documents(df)
    assert mixed.columns == df.columns
    assert sum(sizes(r.text) for r in mixed.collect()) == taken


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert source_mix(empty).collect() == [] and mix_documents(empty).collect() == []


@pytest.mark.parametrize("first", ["a", "b"])
def test_one_text_in_two_sources(spark, first):
    rows = [(k, f"w{k} " * 49, s, k, None) for s in (("a", "b") if first == "a" else ("b", "a")) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = defaultdict(int)
    for r in mix_documents(df).collect():
        taken[r.source] += sizes(r.text)
    want = targets({"a": 40 * 49, "b": 40 * 49})
    assert all(abs(taken[s] - want[s]) <= 49 / 2 for s in want)


def test_a_group_of_equal_rows_ends_the_budget(spark):
    rows = [(5, "one two three four", "a", 0, None)] * 9000 + [(6, "one two", "b", 0, None)] * 10_000
    df = spark.createDataFrame(rows, SCHEMA)
    want = targets({"a": 36_000, "b": 20_000})
    got = defaultdict(int)
    for r in source_mix(df).collect():
        got[r.doc_id] += r.taken
    assert len(source_mix(df).collect()) == len(rows)
    assert abs(got[5] - want["a"]) <= 2 and abs(got[6] - want["b"]) <= 1
    mixed = mix_documents(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] * (4 if r.doc_id == 5 else 2) for r in mixed} == dict(got)


def test_rows_that_differ_in_another_column_only(spark):
    rows = [(1, "w " * 10, "a", k, None) for k in range(30)] + [(2, "x " * 10, "b", 0, None)] * 30
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "map('k', size) as m")
    once, again = (sorted(map(str, mix_documents(d).collect())) for d in (df, df.repartition(5)))
    assert once == again
    assert abs(len(once) * 10 - 1.5 * 600) <= 10


def test_many_sources(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(1, 30), f"s{rng.randrange(300)}", k, None) for k in range(900)]
    by_source = defaultdict(int)
    for r in rows:
        by_source[r[2]] += sizes(r[1])
    want = targets(by_source)
    got = {r.source: r.target for r in source_targets(spark.createDataFrame([(s, n) for s, n in by_source.items()], "source string, size long")).collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)

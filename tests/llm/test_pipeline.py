"""The pipeline against brute force on a small table of its own, stage by stage."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_minhash_mih import brute as near_brute
from tests.llm.test_quality_rules import brute as quality_brute
from tests.llm.test_secret_ledger import BASE
from tests.llm.test_source_mix import sizes, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    vocab = ["the", "of", "and", "to"] + ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab[:4]) if rng.random() < 0.3 else rng.choice(vocab) for _ in range(n))
    rows = []
    for k in range(120):
        text = prose(rng.randint(30, 160))
        if k % 9 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if k % 5 == 0:
            text += " password=hunter" + str(k) + "x"
        rows.append([k, text])
    for k in range(30):
        words = rows[40 + k % 6][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append([200 + k, " ".join(words)])
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, t in rows] + [(900, None, None, None, None), (901, "", "en", "a", 0)]


def test_each_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)

    def stage(k, df):
        out = cp.STAGES[k][1](spark, df, "")
        if k < 4:
            assert out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    good = stage(0, docs)
    ids = {r.doc_id for r in good.collect()}
    assert not ids & {r[0] for r in rows if quality_brute(r[1])[-1]}
    assert {r[0] for r in rows if not quality_brute(r[1])[-1] and not (r[1] or "").isupper() and "!!" not in (r[1] or "")} == ids

    single = stage(1, good)
    left = [(r.doc_id, r.text, None) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in near_brute(left) if r[3])

    clean = stage(2, single)
    assert clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        want = re.sub(BASE[0][1], lambda m: "[SECRET]" if BASE[0][2](m) else m.group(), before[r.doc_id])
        assert r.text == want and r.n_chars == len(want)

    mixed = stage(3, clean)
    by_source, taken = Counter(), Counter()
    for r in clean.collect():
        by_source[r.source] += sizes(r.text)
    for r in mixed.collect():
        taken[r.source] += sizes(r.text)
    for s, t in targets(by_source).items():
        assert abs(taken[s] - t) <= max(sizes(r.text) for r in clean.collect()) / 2 + 1
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    coded = stage(4, mixed).collect()
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed.collect())
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in coded)


def test_run_reads_the_table(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 50 and out.filter("not round_trip").count() == 0


def test_near_dedup_links_from_a_similarity_of_80(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = ["w%d" % rng.randrange(10**6) for _ in range(54)]
        copy = list(words)
        copy[rng.randrange(5, 49)] = "changed"  # 45 of 55 shingles in common: 0.818
        rows += [(2 * k, " ".join(words), None), (2 * k + 1, " ".join(copy), None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _ in rows], SCHEMA)
    got = sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect())
    assert got == sorted(r[0] for r in near_brute(rows, 80) if r[3]) == list(range(0, 80, 2))


ODD = ("a.b", "_cid", "_text", "_row", "row", "id", "cid", "size", "key", "tie", "kept", "b`q", "n_tokens", "_value", "component_id", "_keep")


@pytest.mark.parametrize("shared", [False, True])
def test_stages_take_extra_columns_of_any_name(spark, shared):
    rows = corpus()
    if shared:  # rows that share a doc_id, with equal and with other texts
        rows += [(0, rows[1][1] + " more words of another text", "en", "a", 1), (3, rows[3][1], "en", "b", 2), (None, rows[7][1], "en", "a", 3), (None, rows[7][1], "en", "a", 3)]
    plain = spark.createDataFrame(rows, SCHEMA)
    docs = plain.select("*", *[F.col("doc_id").cast("string").alias(c) for c in ODD])
    for _, stage in cp.STAGES[:-1]:
        want = Counter((r.doc_id, r.text) for r in stage(spark, plain, "").collect())
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        at = {c: k for k, c in enumerate(out.columns)}
        assert all(r[at[c]] == (None if r[at["doc_id"]] is None else str(r[at["doc_id"]])) for r in got for c in ODD)
        assert Counter((r[at["doc_id"]], r[at["text"]]) for r in got) == want
        docs = spark.createDataFrame(got, out.schema)
        plain = docs.select(*[F.col(c) for c in plain.columns])
    assert cp.STAGES[-1][1](spark, docs, "").count() == docs.count()

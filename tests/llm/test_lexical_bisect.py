import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrylens.llm import lexical_bisect
from quarrylens.llm.lexical_bisect import BLOCK, Graph, bisect, build_index, fit_router, lexical_search, search_index, shard_order, term_counts

DOCS = "doc_id long, text string, n long, shard int, `a.b` string, terms string"
ITEMS = "item_id string, text string, ask int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=10):
    counted = [(r[0], Counter(words(r[1]))) for r in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    many, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, asked in {(r[0], tuple(sorted(set(words(r[1]))))) for r in items}:
        scored = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * many) // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def corpus(n, seed):
    rng = random.Random(seed)
    topics = [[f"t{t}w{k}" for k in range(60)] for t in range(8)]
    common = ["the", "of", "and", "É", "naïve", "x1"]
    docs = []
    for k in range(n):
        topic = rng.choice(topics)
        text = " ".join(rng.choice(topic if rng.random() < 0.6 else common).title() for _ in range(rng.randint(1, 80)))
        docs.append((rng.randrange(10**6) * 2, text + rng.choice(["", "!", "\x00", " —", "_z"]), 1, 2, "x", "y"))
    copies = [(10**7 + k, docs[0][1], 0, 0, None, None) for k in range(n // 3)]
    docs += copies
    rng.shuffle(docs)
    items = [(f"i{k}", " ".join(rng.choice(rng.choice(topics) + common) for _ in range(rng.randint(1, 25))), k) for k in range(30)]
    items += [("copy", docs[0][1], 0), ("topic", " ".join(topics[3]), 0), ("same", "the of", 1), ("same", "of THE the", 2), ("same", "and", 3), ("none", "zzz qqq", 4), ("blank", " !", 5), ("null", None, 6), (None, "t1w1 t1w2", 7)]
    return docs, items


EDGE = [(None, "t1w1 t1w1 the", None, None, None, None), (1, None, None, None, None, None), (3, "", None, None, None, None), (5, " ... ", None, None, None, None), (7, "t2w2 " * 5, 0, 0, "", ""), (7, "t2w2 " * 5, 0, 0, "", "")]


@pytest.fixture()
def small(monkeypatch):
    """Many shards and blocks over little data."""
    for name, value in {"SHARD": 64, "BLOCK": 8, "SAMPLE": 200, "EDGES": 1500, "QUERIES": 7}.items():
        monkeypatch.setattr(lexical_bisect, name, value)


def test_equals_all_scores(spark):
    docs, items = corpus(300, 1)
    got = lexical_search(spark.createDataFrame(docs + EDGE, DOCS), spark.createDataFrame(items + items[:2], ITEMS)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(docs + EDGE, items)


def test_many_shards_slices_and_salted_joins(spark, small, monkeypatch):
    docs, items = corpus(900, 2)
    want = brute(docs + EDGE, items, 3)
    spark_docs, spark_items = spark.createDataFrame(docs + EDGE, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(str(tuple(r)) for r in lexical_search(spark_docs, spark_items, k=3).collect()) == want
    monkeypatch.setattr(lexical_bisect, "BROADCAST_ROWS", 5)
    assert sorted(str(tuple(r)) for r in lexical_search(spark_docs, spark_items, k=3, vocabulary=400).collect()) == want


def test_bounds_spare_shards(spark, small):
    docs, _ = corpus(1500, 3)
    df = spark.createDataFrame(docs, DOCS)
    vocabulary = sorted({w.encode() for t in range(8) for w in (f"t{t}w{k}" for k in range(60))})
    index = build_index(df, vocabulary, 3)
    rows = [(t, sorted(index.number[f"t{t}w{k}".encode()] for k in range(12))) for t in range(8)]
    best, visited = search_index(index, spark.createDataFrame(rows, "ask long, terms array<int>"), 3)
    shards = index.blocks.select("shard").distinct().count()
    assert best.count() == 24 and shards > 12
    assert sum(visited) < 0.8 * shards * len(rows)


def test_bisection_lowers_the_gap_cost():
    rng = random.Random(4)
    lists = [rng.sample(range(30 * (k % 4), 30 * (k % 4) + 30), 12) for k in range(256)]
    values, offs = np.array([t for x in lists for t in x], np.int32), np.arange(0, 12 * 256 + 1, 12)
    graph = Graph.of(values, offs, 4096)
    side = bisect(graph, np.zeros(256, np.int64), 1, rounds=20)
    assert side.sum() == 128

    def gaps(order):
        rank = np.argsort(order)
        at = {}
        for d in order:
            for t in lists[d]:
                at.setdefault(t, []).append(rank[d])
        return sum(math.log2(b - a) for x in at.values() for a, b in zip(x, x[1:]))

    order = shard_order(graph, 4)
    assert sorted(order) == list(range(256))
    assert gaps(order) < 0.75 * gaps(np.arange(256))
    leaves = fit_router(values, offs, 200, 2).leaves(values, offs)
    assert np.bincount(leaves, minlength=4).max() <= 70
    pure = sum(max(Counter(k % 4 for k in range(256) if leaves[k] == leaf).values()) for leaf in range(4))
    assert pure > 200


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical_bisect, "TEXT_BYTES", 100)
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "É", " ", "  ", "-", "漢", "Z9", "\n"]) for _ in range(5000)) + "x" * 500
    assert term_counts(text.encode()) == Counter(w.encode() for w in words(text))
    docs = [(k, "long " * 200_000 + f"w{k}", 0, 0, "", "") for k in range(3)]
    items = [("a", "w1 long", 0)]
    assert sorted(str(tuple(r)) for r in lexical_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(5, 6)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for a, b in ((d.limit(0), i), (d, i.limit(0)), (d.select("doc_id", d.text.substr(1, 0).alias("text")), i)):
        out = lexical_search(a, b)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    assert BLOCK <= 32767  # places inside a block are 16-bit

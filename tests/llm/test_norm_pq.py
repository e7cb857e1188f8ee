import hashlib
import math
import random

import numpy as np
import pytest

from quarrylens.llm import norm_pq
from quarrylens.llm.norm_pq import NormIndex, decode_vectors, encode_vectors, fit_codebooks, vector_codes, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label string, q string, code int, `a.b` int"


def brute(rows, parts=4, codes=256, rounds=4):
    """(vec_id, code, error, label_error, sha) in plain whole numbers."""
    kept = [(i, label, [min(max(math.floor(1024 * x), -(2**63)), 2**63 - 1) for x in e]) for i, e, label, *_ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    size = -(-max(len(q) for _, _, q in kept) // parts)
    kept = [(i, label, q + [0] * (parts * size - len(q))) for i, label, q in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:codes]
    cut = lambda q, p: q[p * size : (p + 1) * size]
    books = [[cut(q, p) for *_, q in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for *_, q in kept:
                groups.setdefault(near(cut(q, p), books[p])[1], []).append(cut(q, p))
            for k, group in groups.items():
                books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found, by_label = [], {}
    for i, label, q in kept:
        hits = [near(cut(q, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in hits)
        found.append((i, "".join(f"{k:02x}" for _, k in hits), min(error, 2**63 - 1), label))
        by_label[label] = by_label.get(label, 0) + min(error, 2**63 - 1)
    return [(i, c, e, min(by_label[label], 2**63 - 1), sha) for i, c, e, label in found]


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def vectors(n, dims, seed, labels=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    out = []
    for k in range(n):
        c, scale = rng.choice(centres), rng.choice([0.01, 0.3, 1, 2])
        out.append((3 * k, [x * scale + rng.gauss(0, 0.05) for x in c], f"l{rng.randrange(labels)}" if k % 9 else None, None, k, 0))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("dims", [8, 10])
def test_equals_plain_rounds(spark, dims):
    rows = vectors(420, dims, dims)
    odd = [
        (1, None, "l0", None, 0, 0), (4, [1.0, None] * 4, "l0", None, 0, 0), (7, [math.nan] * 8, "l1", None, 0, 0), (10, [math.inf] * 8, "l1", None, 0, 0),
        (13, [0.5, -0.5], "l2", None, 0, 0), (16, [], None, None, 0, 0), (None, [0.25] * 8, "l3", None, 0, 0), (3, [0.1] * 8, "l4", None, 0, 0), (19, [-0.0001] * 8, "l4", None, 0, 0),
    ]
    rows = rows + odd + rows[:3] + [(20, [1.0] * 8, "hot", None, 0, 0)] * 150
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert key(vector_codes(df).collect()) == key(brute(rows))


def test_large_components_and_many_labels(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1e300, -1e300, 1e15, 3e12, -7.25e13, 1.5]) for _ in range(4)], f"l{k % 7}", None, 0, 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert key(vector_codes(df, most=2).collect()) == key(brute(rows))


def test_few_rows_and_empty_tables(spark):
    rows = vectors(3, 4, 1)
    assert key(vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()) == key(brute(rows))
    assert vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert vector_codes(spark.createDataFrame([(1, None, None, None, 0, 0)], SCHEMA)).collect() == []
    bare = [(1, [], "x", None, 0, 0), (2, [], "x", None, 0, 0)]
    assert [(r.code, r.error, r.label_error) for r in vector_codes(spark.createDataFrame(bare, SCHEMA)).collect()] == [("00000000", 0, 0)] * 2


def test_annulus_is_exact_and_spares_entries():
    rng = np.random.default_rng(2)
    entries = (rng.normal(size=(256, 6)) * rng.gamma(2, 400, size=(256, 1))).astype(int)
    entries[100:110] = entries[:10]  # ties go to the lower index
    x = (rng.normal(size=(3000, 6)) * rng.gamma(2, 400, size=(3000, 1))).astype(np.int64)
    x[:256] = entries
    index = NormIndex(entries.tolist(), 6)
    code, error = index.nearest(x)
    all_of = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (code == all_of.argmin(1)).all() and (error == all_of.min(1)).all()
    assert index.evaluated < 0.6 * x.shape[0] * 256


def test_equal_norms_and_bounds_are_within():
    entries = [[3, 4], [-3, -4], [4, 3], [5, 0], [0, 5], [0, 0], [10, 0]]
    code, error = NormIndex(entries, 2).nearest(np.array([[5, 0], [0, 0], [-5, 0], [7, 0], [4, 4]], np.int64))
    assert code.tolist() == [3, 5, 1, 3, 0] and error.tolist() == [0, 0, 20, 4, 1]


def test_blocks_change_nothing(spark, monkeypatch):
    rows = vectors(200, 8, 4)
    want = key(brute(rows))
    monkeypatch.setattr(norm_pq, "BLOCK", 40)
    index = NormIndex([[k, -k] for k in range(50)], 2)
    assert index.nearest(np.array([[7, -7], [49, -50]], np.int64))[0].tolist() == [7, 49]
    assert key(vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_codes_stand_for_near_vectors(spark):
    rows = vectors(600, 8, 9)
    whole = whole_vectors(spark.createDataFrame(rows, SCHEMA))
    books = fit_codebooks(whole)
    coded = encode_vectors(whole, books)
    back = {r.vec_id: np.array(r.embedding) for r in decode_vectors(coded, books).collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    for i, e, *_ in rows:
        assert abs(((back[i] - np.array(e)) ** 2).sum() - error[i] / 1024**2) < 8 * (2 * 2 / 1024)
    worst = max(((back[i] - np.array(e)) ** 2).sum() for i, e, *_ in rows)
    assert worst < 1.0

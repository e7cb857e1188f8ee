import math
import random

import pytest

from quarrylens.llm import pivot_topk as pt

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=20, every=20, exact=False):
    good = []
    for i, v, _ in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        import numpy as np

        good.append((i, [math.floor(64 * (x if exact else float(np.float32(x)))) for x in v]))
    out = []
    for q, v in dict(good).items():
        if q % every:
            continue
        scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("cell", [8192, 40])
def test_matches_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(pt, "CELL", cell)
    monkeypatch.setattr(pt, "RING", 16)
    monkeypatch.setattr(pt, "QUERIES", 4096 if cell > 40 else 9)
    rng = random.Random(cell)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], "x") for i in range(600)]
    rows += [(600 + i, [0.1, 0.2, 0.3, 0.1, 0.0, -0.4], None) for i in range(150)]
    rows += [(1000, None, None), (1020, [0.1, None, 0.0, 0.0, 0.0, 0.0], None), (1040, [float("nan")] * 6, None), (1060, [float("inf")] + [0.0] * 5, None), (None, [0.1] * 6, None)]
    rows += [(1080, [0.0] * 6, None), (-20, [0.5, 0.1], None), (1081, [], None)]
    got = sorted(tuple(r) for r in pt.pivot_topk(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], None), (20, [0.5, 0.5], None), (3, [0.1, -1.0], None)]
    got = sorted(tuple(r) for r in pt.pivot_topk(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)
    assert pt.pivot_topk(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_any_size(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1e6) for _ in range(4)], None) for i in range(60)]
    rows += [(100 + i, [rng.gauss(0, 3e8) for _ in range(4)], None) for i in range(21)]
    got = sorted(tuple(r) for r in pt.pivot_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect())
    assert got == brute(rows, exact=True)
    huge = [(0, [1e300, -1.0], None), (1, [1e300, 0.0], None), (2, [-1e300, 0.0], None)]
    got = [tuple(r) for r in pt.pivot_topk(spark.createDataFrame(huge, "vec_id long, embedding array<double>, score string")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, 1 - 2**63)]


def test_repeated_ids_and_equal_vectors(spark):
    rng = random.Random(8)
    same = [0.2, 0.1, -0.3]
    rows = [(20, same, None)] * 30 + [(40, same, None), (40, [0.5, 0.0, 0.1], None)] + [(k, same, None) for k in range(41, 80)]
    rows += [(100 + k, [rng.gauss(0, 0.2) for _ in range(3)], None) for k in range(50)]
    got = {}
    for r in pt.pivot_topk(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    import numpy as np

    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows]
    for q, found in got.items():
        vector = min(v for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(vector, w)), i) for i, w in whole if i != q)[:20]
        assert found == [(i, -s) for s, i in scored]
    assert set(got) == {q for q, _ in whole if q % 20 == 0}


def test_searched_cells_grow_below_the_square(spark, monkeypatch):
    monkeypatch.setattr(pt, "CELL", 64)
    monkeypatch.setattr(pt, "RING", 16)
    pairs = []
    for n in (2000, 8000):
        rng = random.Random(n)
        centres = [[rng.gauss(0, 3) for _ in range(3)] for _ in range(n // 25)]
        rows = [(k, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], None) for k in range(n)]
        out, sent = pt._search_all(spark.createDataFrame(rows, SCHEMA), 20, 5)
        assert sorted(tuple(r) for r in out.collect()) == brute(rows, 5)
        pairs.append(sent.count())
    assert pairs[1] < 12 * pairs[0]  # the square would be 16 times


def test_routing_holds_little_however_many_pivots():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quarrylens.llm import pivot_topk

    width, many, n = 64, 2048, 3000
    rng = np.random.default_rng(3)
    q = rng.integers(-60, 60, (n, width))
    pivots = rng.normal(size=(many, width + 1)) * 60
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(q), pa.list_(pa.int64())), pa.array((q.astype(float) ** 2).sum(1)), pa.array(np.full(n, np.nan))], names=["asked", "q", "norm", "bound"])
    shared = type("S", (), {"value": (pivots, 1e6, width)})
    tracemalloc.start()
    pairs = sum(b.num_rows for b in pivot_topk._route(shared, (np.arange(many, dtype=np.int32), np.zeros(many), np.full(many, 1e9)))([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == many * n and peak < 300 << 20

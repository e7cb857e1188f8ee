import random

import pytest

from quarrylens.llm import minhash_mih as mm

SCHEMA = "doc_id long, text string, cid long"


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[find(i)] = min(best.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), best.get(find(i)), r[0] is not None and r[0] == best.get(find(i))) for i, r in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)] + ["É", "Ab"]
    rows = [(None, None, 1), (0, "", None), (1, " \t\n", 2), (2, "one two", 3), (3, "ONE two", 3), (4, "one", None), (5, "a b c d e", None), (6, "a b c d e f", None)]
    k = 10
    for size in (12, 40, 120, 300):
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(size)] = rng.choice(vocab)
            rows.append((k, " ".join(copy), k))
            k += 1
    for _ in range(40):
        rows.append((k, " ".join(rng.choice(vocab) for _ in range(80)), None))
        k += 1
    rows += [rows[20], (rows[30][0], rows[30][1], None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 1 << 15), (2, 1 << 15), (3, 4)])
def test_matches_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(mm, "HOT_BUCKET", hot)
    rows = corpus(seed)
    got = mm.minhash_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("hot,open_block", [(1 << 15, 2048), (1 << 15, 5), (7, 5)])
def test_copies_linked_only_through_their_source(spark, hot, open_block, monkeypatch):
    monkeypatch.setattr(mm, "OPEN_BLOCK", open_block)
    monkeypatch.setattr(mm, "HOT_BUCKET", hot)
    rng = random.Random(9)
    base = ["b%d" % k for k in range(200)]
    rows = [(500, " ".join(base), None)]
    for k in range(60):
        copy = list(base)
        for p in rng.sample(range(200), 3):
            copy[p] = "x%d" % rng.randrange(10**6)
        rows.append((k, " ".join(copy), None))
    got = mm.minhash_near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_groups_keep_every_row_over_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    key = np.repeat(np.arange(60), [rng.choice([1, 1, 2, 3, 9, 20]) for _ in range(60)])
    for block in (4, 8, 1000):
        for step in (1, 3, 7, 500):
            old, mm.BLOCK = mm.BLOCK, block
            batches = [pa.RecordBatch.from_arrays([pa.array(key[b : b + step]), pa.array(np.arange(len(key))[b : b + step])], names=["key", "row"]) for b in range(0, len(key), step)]
            got, fresh = [], []
            for rows, more in mm._groups(iter(batches)):
                assert len(set(rows.column(0).to_pylist())) == 1
                got += rows.column(1).to_pylist()
                fresh += [] if more else [rows.column(0)[0].as_py()]
            mm.BLOCK = old
            sizes = np.bincount(key)
            assert got == [r for r in range(len(key)) if sizes[key[r]] > 1]
            assert fresh == [k for k in range(60) if sizes[k] > 1]


def test_empty_table(spark):
    assert mm.minhash_near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("percent", [80, 85])
def test_loss_at_the_threshold(percent):
    from math import comb

    j, n = percent / 100, mm.COMPONENTS
    chunk = sum(comb(mm.CHUNK, k) * (1 - j) ** k * j ** (mm.CHUNK - k) for k in range(mm.ERRORS + 1))
    dropped = sum(comb(n, k) * (1 - j) ** k * j ** (n - k) for k in range(mm.distance(percent) + 1, n + 1))
    assert (1 - chunk) ** mm.CHUNKS + dropped < {80: 1.2e-7, 85: 2e-9}[percent]


def test_filter_with_texts_that_share_a_doc_id(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    a, b, c, d = text(80), text(80), text(80), text(80)
    near = d + " end"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (6, b.upper(), 5), (7, c, 6), (7, d, 7), (7, near, 8), (8, near, 9), (9, "", 10), (9, c + " x", 11), (None, a, 12)]
    for turn in (rows, rows[::-1]):
        got = mm.near_dedup_filter(spark.createDataFrame(turn, SCHEMA)).collect()
        sets = sorted((str(r.doc_id), {a: "a", b: "b", c: "c", d: "d", near: "d", "": ""}[r.text]) for r in got)
        assert sets == [("3", "a"), ("5", "b"), ("7", "c"), ("7", "d"), ("9", ""), ("None", "a")]


def test_long_texts_go_block_by_block(monkeypatch):
    import tracemalloc

    import numpy as np

    from quarrylens.llm import minhash_mih

    rng = random.Random(21)
    texts = ["".join(rng.choice(["ab", "É", "Cd", "x" * 40]) + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["y" * 900, " " * 500, "a b c", "z" * 300 + " " + "w" * 700 + " a b c d e f"]
    whole = lambda text: minhash_mih.shingle_sets(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    want = [whole(t) for t in texts]
    monkeypatch.setattr(minhash_mih, "LONG", 64)
    for text, (sets, sizes) in zip(texts, want, strict=True):
        got = whole(text)
        assert (got[0] == sets).all() and (got[1] == sizes).all()
    monkeypatch.setattr(minhash_mih, "LONG", 1 << 20)
    size = 48 << 20
    for text in ((b"word%d other " * (size // 13))[:size], b"q" * size):
        buf = np.frombuffer(text, np.uint8)
        tracemalloc.start()
        minhash_mih.shingle_sets(buf, np.array([0, len(buf)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 14 * size

import hashlib
import random
import time

import numpy as np
import pytest

from quarrylens.llm import suffix_dedup as sd
from quarrylens.llm.gsaca import suffix_array

SCHEMA = "doc_id long, text string, extra string"


def brute(rows, length):
    seen = {}
    raws = [(t or "").encode() for _, t, _ in rows]
    for d, r in enumerate(raws):
        for p in range(len(r) - length + 1):
            seen.setdefault(r[p : p + length], []).append((d, p))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = True
    out = []
    for (i, _, _), r, g in zip(rows, raws, gone):
        spans = int((np.diff(np.append(0, g.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~g])
        out.append((i, len(r), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 20])
def test_suffix_array_matches_sorting(alphabet):
    rng = random.Random(alphabet)
    for _ in range(200):
        s = [rng.randint(1, alphabet) for _ in range(rng.randint(0, 40))]
        assert suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(90))
    rows = [(None, None, "x"), (1, "", None), (2, "short", None), (3, "a" * 700, None), (4, passage, None), (5, passage, None), (5, passage, None)]
    for k in range(40):
        cut = rng.randint(0, 150)
        rows.append((10 + k, " ".join(word() for _ in range(60)) + passage[cut : cut + rng.randint(150, 260)] + " ".join(word() for _ in range(60)), None))
    body = " ".join(word() for _ in range(300))
    for k in range(12):
        p = rng.randint(0, len(body) - 1)
        rows.append((100 + k, body[:p] + "#" + body[p + 1 :], None))
    return rows


@pytest.mark.parametrize("hot,again", [(4096, 4096), (2, 2), (2, 4096)])
def test_matches_brute_force(spark, hot, again, monkeypatch):
    made = sd._hot_marks

    def second(*args):
        monkeypatch.setattr(sd, "HOT", again)
        return made(*args)

    monkeypatch.setattr(sd, "_hot_marks", second)
    for length in (200, 60):
        monkeypatch.setattr(sd, "HOT", hot)
        rows = corpus(length)
        got = sd.suffix_dedup(spark.createDataFrame(rows, SCHEMA), length).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, length)


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_array_work_is_linear():
    """Repeats, runs and few symbols: the place of the end mark aside, every suffix is placed once; sizes double, so does the work."""
    rng = np.random.default_rng(2)
    for make in (lambda n: np.ones(n, np.int64), lambda n: np.tile(rng.integers(1, 5, n // 8), 8), lambda n: np.arange(n) % 2 + 1):
        took = []
        for n in (40_000, 160_000):
            text = make(n)
            began = time.process_time()
            sa = suffix_array(text)
            took.append(time.process_time() - began)
            assert np.array_equal(np.sort(sa), np.arange(n))
        assert took[1] < 10 * took[0] + 0.2


def test_a_text_beyond_one_block(spark):
    block = 4 * sd.CHUNK_BYTES
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, block + 400_000).astype(np.uint8)
    passage = rng.integers(97, 123, 300).astype(np.uint8)
    for at in (block - 150, 1_000, block + 200_000):
        text[at : at + 300] = passage
    raw = text.tobytes()
    parts = list(sd._blocks(text, np.array([0, len(text)]), 200))
    assert [at for _, _, at in parts] == [0, block] and sum(len(p) - 199 for p, _, _ in parts) == len(text) - 199
    rows = [(1, raw.decode(), None), (2, "x " + passage.tobytes().decode() + " y", None)]
    got = {r.doc_id: r for r in sd.suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = raw.replace(passage.tobytes(), b"")
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(raw), 900, 3) and got[2].n_removed == 300
    assert got[1].kept_sha256 == hashlib.sha256(kept).hexdigest()

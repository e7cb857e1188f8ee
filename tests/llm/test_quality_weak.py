import math
import random
import re

import numpy as np

from quarrylens.llm import quality_weak as qw
from quarrylens.llm._common import mix64
from quarrylens.llm.quality_rules import STOP_WORDS
from quarrylens.llm.quality_weak import BAD, GOOD, LABELLERS, NONE, em, pattern, quality_classifier

SCHEMA = "doc_id long, text string, score string, kept int"


def prose(rng, words=150):
    out = []
    for _ in range(words):
        out.append(rng.choice(STOP_WORDS[:16]) if rng.random() < 0.3 else "".join(rng.choice("abcdehinorst") for _ in range(rng.randint(3, 9))))
        if rng.random() < 0.1:
            out[-1] += "."
    return " ".join(out)


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.8
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9]
    votes = np.column_stack([np.where(rng.random(20000) < 0.2, NONE, np.where((rng.random(20000) < a) == truth, GOOD, BAD)) for a in right])
    found, many = np.unique(pattern(votes), return_counts=True)
    post, prior, rate = em(found, many.astype(float), len(LABELLERS))
    assert abs(prior - 0.8) < 0.02
    for k, a in enumerate(right):
        assert abs(rate[k, 1, GOOD] - a) < 0.03 and abs(rate[k, 0, BAD] - a) < 0.05
    said = dict(zip(found.tolist(), post))
    assert np.mean([(said[p] > 0.5) == t for p, t in zip(pattern(votes).tolist(), truth)]) > 0.95


def test_held_out_junk_and_prose(spark):
    rng = random.Random(2)
    rows, good = [(None, None, "x", 1), (1, "", None, None), (2, " \n", None, None)], {}
    for k in range(400):
        text = prose(rng)
        kind = k % 8
        if kind == 5:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 6:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())
        elif kind == 7:
            text = "\n".join([" ".join(text.split()[:12])] * 12)
        rows.append((10 + k, text, None, None))
        good[10 + k] = kind < 5
    rows += [rows[10], (900, prose(rng, 60000), None, None)]
    good[900] = True
    got = quality_classifier(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[None].kept and not by[1].kept and by[2].score == 0.0
    assert all(by[i].kept for i, g in good.items() if g)
    assert np.mean([not by[i].kept for i, g in good.items() if not g]) > 0.9


def test_empty_table(spark):
    assert quality_classifier(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_ratios(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = max(sum(len(w.encode()) for w in words), 1)
    grams = [tuple(w.lower() if w.isascii() else w for w in words[k : k + 3]) for k in range(len(words) - 2)]
    lines = [x for x in text.split("\n") if len(x.encode()) > 2]
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    count = lambda chosen: sum(c in chosen for c in text)
    return [
        len(words), count("#*$%&|<>") / chars, count("!?") / chars, sum("A" <= c <= "Z" for c in text) / chars, sum(w in STOP_WORDS for w in low) / max(len(words), 1),
        (len(grams) - len(set(grams))) / max(len(words) - 2, 1), text.count(".") / max(len(words), 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
    ]


def plain_score(text, w, b):
    """Hashed features and the logistic scorer, one by one."""
    kinds = []
    for c in text.encode():
        kinds.append(ord("A") if 65 <= c <= 90 or 128 <= c < 159 else ord("a") if 97 <= c <= 122 or c >= 159 else ord("0") if 48 <= c <= 57 else c)
    x = [0.0] * qw.DIMS
    for at in range(len(kinds) - 3):
        gram = 0
        for c in kinds[at : at + 4]:
            gram = (gram * 257 + c) % 2**32
        x[gram * 0x9E3779B1 % 2**32 >> 32 - qw.DIMS.bit_length() + 1] += 1
    total = max(sum(x), 1)
    x = [math.sqrt(v / total) for v in x]
    for k, r in enumerate(plain_ratios(text)):
        value = math.log2(1 + r) / 16 if k == 0 else r
        bucket = min(int(value * 20), 19) + 20 * k
        x[int(mix64(np.array([bucket + 99], np.uint64))[0] % np.uint64(qw.DIMS))] += 0.5
    return 1 / (1 + math.exp(-(sum(p * q for p, q in zip(x, w.tolist())) + b)))


def test_scores_match_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)] + ["A B!\n" * 9, "a\nb\na\n\nlong line here\nlong line here", "é# ?é x", "the. The the"]
    rows = [(k, t, None, None) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(qw.ratios(raw, np.array([0, len(raw)]))[0], plain_ratios(t)), t
    w, b = qw.fit(df.select("doc_id", "text"))
    got = {r.doc_id: r for r in quality_classifier(df).collect()}
    for k, t in enumerate(texts):
        assert abs(got[k].score - plain_score(t, w, b)) < 1e-4 and got[k].n_words == len(t.split())

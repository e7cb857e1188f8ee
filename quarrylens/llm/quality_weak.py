"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document.  Expectation-maximisation over
the counts of vote patterns of the whole corpus (at most 3**7 patterns, so the counts are a bounded table)
estimates how often each labeller says what for good and for bad documents; each pattern's posterior is a soft
label.  A logistic scorer over hashed features (4-grams of character classes, and binned ratios) is trained on a
bounded sample of about SAMPLE documents with these labels and scores every document.

Defined results: null or blank text: score 0.0, not kept; texts are read whole; repeated rows: repeated results; an
empty table: empty result; extra columns are ignored; if no document has a word, all score 0.0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import PrefixHash, hashed_grams, lower_ascii, mix64, text_chunks, word_bounds
from quarrylens.llm.quality_rules import STOP_WORDS

DIMS = 2048
SAMPLE = 6000
GOOD, BAD, NONE = 2, 0, 1
LABELLERS = ("symbols", "marks", "capitals", "stop_words", "repetition", "sentences", "lines")
KEEP = 0.5


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SYMBOL, _MARK, _UPPER = _table(b"#*$%&|<>"), _table(b"!?"), _table(range(65, 91))
_STOP = _table(b".")
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = ord("A"), ord("a"), ord("0")
_CLASS[128:159], _CLASS[159:192], _CLASS[192:] = ord("A"), ord("a"), ord("a")


def _stop_hashes() -> np.ndarray:
    raw = np.frombuffer("".join(STOP_WORDS).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in STOP_WORDS])
    return np.unique(PrefixHash(raw, 43).of(np.append(0, ends[:-1]), ends))


_STOPS = _stop_hashes()


def ratios(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of ratios for each document: words, symbols, marks, capitals, stop words, repetition, sentences, line repetition."""
    starts, ends, n_words = word_bounds(buf, offs)
    first = np.cumsum(n_words) - n_words
    per = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offs])
    by_word = lambda flags: np.diff(np.append(0, np.cumsum(flags))[np.append(first, len(starts))])
    chars = np.maximum(by_word(ends - starts), 1)
    words = np.maximum(n_words, 1)
    word = PrefixHash(lower_ascii(buf), 43).of(starts, ends)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    at = np.flatnonzero(np.arange(len(word)) - first[doc] < n_words[doc] - 2)
    gram = mix64(word[at] + mix64(word[np.minimum(at + 1, len(word) - 1)] + mix64(word[np.minimum(at + 2, len(word) - 1)]))) if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((gram, doc[at]))
    g, d = gram[order], doc[at][order]
    same = np.append(False, (g[1:] == g[:-1]) & (d[1:] == d[:-1]))[: len(g)]
    repeated = np.bincount(d[same], minlength=len(n_words)) / np.maximum(n_words - 2, 1)
    breaks = np.flatnonzero(buf == 10)
    lo = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    hi = np.sort(np.concatenate([offs[1:], breaks]))
    keep = hi - lo > 2
    lo, hi = lo[keep], hi[keep]
    line = PrefixHash(buf, 47).of(lo, hi)
    owner = np.searchsorted(offs, lo, side="right") - 1
    order = np.lexsort((line, owner))
    ln, ow = line[order], owner[order]
    again = np.append(False, (ln[1:] == ln[:-1]) & (ow[1:] == ow[:-1]))[: len(ln)]
    lines = np.bincount(ow, minlength=len(n_words))
    dup = np.bincount(ow[again], minlength=len(n_words)) / np.maximum(lines, 1)
    return np.column_stack(
        [n_words, per(_SYMBOL[buf]) / chars, per(_MARK[buf]) / chars, per(_UPPER[buf]) / chars, by_word(np.isin(word, _STOPS)) / words, repeated, per(_STOP[buf]) / words, dup]
    )


def votes(r: np.ndarray) -> np.ndarray:
    """One column a labeller; short documents leave the labellers that need a text undecided."""
    short = r[:, 0] < 20

    def by(value, bad, good, hold=short):
        return np.where(hold, NONE, np.where(bad(value), BAD, np.where(good(value), GOOD, NONE)))

    empty = r[:, 0] == 0
    return np.column_stack(
        [
            by(r[:, 1], lambda x: x > 0.03, lambda x: x < 0.005, empty),
            by(r[:, 2], lambda x: x > 0.08, lambda x: x < 0.02, empty),
            by(r[:, 3], lambda x: x > 0.4, lambda x: x < 0.08, empty),
            by(r[:, 4], lambda x: x < 0.02, lambda x: x > 0.08),
            by(r[:, 5], lambda x: x > 0.4, lambda x: x < 0.1),
            by(r[:, 6], lambda x: x < 0.004, lambda x: (x > 0.02) & (x < 0.3)),
            by(r[:, 7], lambda x: x > 0.4, lambda x: x < 0.2),
        ]
    ).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def em(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 60):
    """Posterior of good for each vote pattern, the prior, and P(vote | class) of each labeller.

    Two classes; abstaining carries no evidence.  Starts from labellers that each know only some kinds of bad
    documents but seldom accuse a good one.
    """
    v = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    prior = 0.8
    rate = np.empty((labellers, 2, 3))  # labeller, class (bad, good), vote
    rate[:, 0], rate[:, 1] = [0.4, 1.0, 0.6], [0.005, 1.0, 0.995]
    for _ in range(rounds):
        log = np.tile(np.log([1 - prior, prior]), (len(v), 1))
        for k in range(labellers):
            log += np.log(rate[k][:, v[:, k]]).T
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(axis=1, keepdims=True)
        weight = post * counts[:, None]
        prior = min(0.98, max(0.02, weight[:, 1].sum() / max(weight.sum(), 1e-9)))
        for k in range(labellers):
            for c in (0, 1):
                bad = weight[v[:, k] == BAD, c].sum() + 1
                good = weight[v[:, k] == GOOD, c].sum() + 1
                rate[k, c] = [bad / (bad + good), 1.0, good / (bad + good)]
    return post[:, 1], prior, rate


def features(buf: np.ndarray, offs: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Hashed features: class 4-grams as root frequencies, and one bin of each ratio."""
    x = hashed_grams(_CLASS[buf], offs, 4, DIMS)
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
    for k in range(r.shape[1]):
        value = np.log2(1 + r[:, 0]) / 16 if k == 0 else r[:, k]
        bucket = np.minimum((value * 20).astype(np.int64), 19) + 20 * k
        slot = (mix64(bucket.astype(np.uint64) + np.uint64(99)) % np.uint64(DIMS)).astype(np.int64)
        x[np.arange(len(x)), slot] += 0.5
    return x


def _patterns(batches):
    for batch in batches:
        for _, buf, offs in text_chunks(batch):
            r = ratios(buf, offs)
            found, many = np.unique(pattern(votes(r))[r[:, 0] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(many.astype(np.int64))], names=["pattern", "n"])


def _training(batches):
    for batch in batches:
        for _, buf, offs in text_chunks(batch):
            r = ratios(buf, offs)
            x = features(buf, offs, r).astype(np.float16)
            on = np.flatnonzero(r[:, 0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(pattern(votes(r))[on]), pa.array([x[k].tobytes() for k in on], pa.binary())], names=["pattern", "x"])


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradient steps with momentum."""
    y = y.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    gw, gb = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + np.float32(b))))
        e = (p - y) / np.float32(len(y))
        gw = np.float32(0.9) * gw + e @ x + np.float32(1e-5) * w
        gb = 0.9 * gb + e.sum()
        w -= np.float32(2.0) * gw
        b -= 2.0 * float(gb)
    return w, float(b)


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for row, buf, offs in text_chunks(batch):
                r = ratios(buf, offs)
                if model is None:
                    p = np.zeros(len(r))
                else:
                    w, b = model
                    logit = (features(buf, offs, r) @ w).astype(np.float64) + b
                    p = np.where(r[:, 0] > 0, 1 / (1 + np.exp(-logit)), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(p)), pa.array(r[:, 0].astype(np.int64)), pa.array(p), pa.array(p >= KEEP)], names=["doc_id", "n_words", "score", "kept"])

    return run


def fit(base: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights and bias of the scorer, learned from base(doc_id, text); None where no document has a word."""
    counted = base.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = sorted(counted.collect())  # 3**7 rows at most
    if not rows:
        return None
    patterns, many = np.array([r.pattern for r in rows]), np.array([r.n for r in rows], float)
    post, _, _ = em(patterns, many, len(LABELLERS))
    space = 1 << 30
    cut = min(space, int(space * SAMPLE / many.sum()) + 1)
    chosen = base.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(space)) < cut).select("text").mapInArrow(_training, "pattern long, x binary").toArrow()
    if not chosen.num_rows:
        return None
    x = np.frombuffer(b"".join(chosen["x"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    soft = dict(zip(patterns.tolist(), post.tolist()))
    y = np.array([soft[p] for p in chosen["pattern"].to_pylist()])
    order = np.lexsort((x[:, 0], x.sum(axis=1), y))
    return train(x[order], y[order])


def quality_classifier(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, score (probability of good), kept for each row of docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(base))
    return base.mapInArrow(_score(shared), "doc_id long, n_words long, score double, kept boolean")

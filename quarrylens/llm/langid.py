"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Byte 2-grams and 3-grams of the lower-cased letters (other characters count as one space) are hashed into DIMS counts, weighed ``log(1 + tf) * idf`` and
normalised.  Each language has up to CENTROIDS centroids (spherical k-means over its training vectors).  The
prediction is the language of the centroid with the greatest cosine, the score that cosine.  A document
further from its centroid than training documents are (their 0.1 percentile, less a margin) is marked
``rejected``; its nearest language is still given.

Training takes documents with a text and a lang whose crc32 of the decimal doc_id is not 2 modulo 4: for
each language SAMPLE of them, chosen by hash (a bounded sample; all if there are fewer; in all TOTAL at most,
shared evenly by many languages, so that every language is learned as long as there are no more than TOTAL).  lang, source and
doc_id play no part in a prediction.

Defined results: null text, or no letter in it: `und`, score 0.0, rejected true; null doc_id: not held out, not
trained on; whole texts are read, in slices where they are long; no training data: `und` for all; repeated rows: repeated
results; empty table: empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import hashed_grams, lower_ascii, text_chunks

DIMS = 4096
CENTROIDS = 4
SAMPLE = 400
TOTAL = 12_000
UNKNOWN = "und"
_PART = 1 << 22


_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def letters(buf: np.ndarray, offs: np.ndarray):
    """Lower-cased letters, each run of other characters as one space; bytes beyond ASCII count as letters."""
    codes = lower_ascii(buf)
    after = np.append(0, codes[:-1]) if len(codes) else codes
    capital = (after == 0xC3) & (codes >= 0x80) & (codes <= 0x9E) & (codes != 0x97)
    codes = codes + (capital * 32).astype(np.uint8)
    letter = _LETTER[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint8(32))[keep]
    return codes, np.append(0, np.cumsum(keep))[offs]


def counts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed 2-gram and 3-gram counts; a long text is counted part by part."""
    codes, cuts = letters(buf, offs)
    if len(codes) > _PART and len(cuts) == 2:
        out = np.zeros((1, DIMS), np.float32)
        for k in (2, 3):
            for at in range(0, len(codes), _PART):
                part = codes[at : at + _PART + k - 1]
                out += hashed_grams(part, np.array([0, len(part)]), k, DIMS)
        return out
    return hashed_grams(codes, cuts, 2, DIMS) + hashed_grams(codes, cuts, 3, DIMS)


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def _samples(batches):
    for batch in batches:
        lang = batch.column(0)
        for row, buf, offs in text_chunks(batch):
            tf = counts(buf, offs).astype(np.float16)
            yield pa.RecordBatch.from_arrays([lang.slice(row, len(tf)), pa.array([x.tobytes() for x in np.minimum(tf, np.float16(60000))], pa.binary())], names=["lang", "tf"])


def spherical_means(vectors: np.ndarray, count: int) -> np.ndarray:
    """Centroids of unit vectors; starts from the vectors farthest from those chosen before."""
    chosen = [vectors.mean(axis=0)]
    while len(chosen) < min(count, len(vectors)):
        cos = np.max(vectors @ np.array(chosen).T, axis=1)
        chosen.append(vectors[int(cos.argmin())])
    centres = np.array(chosen)
    for _ in range(10):
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        near = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([vectors[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return (centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], tf: np.ndarray):
        held = np.array(langs)
        self.idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
        vectors = _vectors(tf, self.idf)
        names, centres, floors = [], [], []
        for name in sorted(set(langs)):
            own = vectors[held == name]
            c = spherical_means(own, CENTROIDS)
            cos = own @ c.T
            near = cos.argmax(axis=1)
            for k in range(len(c)):
                mine = cos[near == k, k]
                floors.append(float(np.quantile(mine, 0.001)) - 0.1 if len(mine) else 0.0)
                names.append(name)
            centres.append(c)
        self.names, self.centres, self.floors = names, np.vstack(centres), np.array(floors)

    def predict(self, tf: np.ndarray):
        """Language, cosine and whether it is rejected."""
        cos = _vectors(tf, self.idf) @ self.centres.T
        best = cos.argmax(axis=1)
        top = cos[np.arange(len(best)), best]
        return [self.names[b] for b in best], np.clip(top, 0, 1).astype(np.float64), top < self.floors[best]


def fit(labelled: DataFrame) -> Model | None:
    """A model from rows (doc_id, text, lang) already restricted to what may be learned from."""
    rows = labelled.filter("text is not null and lang is not null")
    spark = labelled.sparkSession
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(TOTAL).collect()
    if not sizes:
        return None
    space, each = 1 << 30, max(1, min(SAMPLE, TOTAL // len(sizes)))
    # the documents of the least draws of each language: so many that pass a first cut, of a small language all, and then exactly ``each``
    cuts = [(r["lang"], min(space, int(space * (4 * each + 64) / r["count"]) + 1)) for r in sizes]
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(space))
    near = rows.withColumn("draw", draw).join(F.broadcast(spark.createDataFrame(cuts, "lang string, cut long")), "lang").filter("draw < cut")
    chosen = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))).filter(F.col("place") <= each).select("lang", "text")
    table = chosen.mapInArrow(_samples, "lang string, tf binary").toArrow()
    if not table.num_rows:
        return None
    tf = np.frombuffer(b"".join(table["tf"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    names = table["lang"].to_pylist()
    order = sorted(range(len(tf)), key=lambda k: (names[k], tf[k].tobytes()))
    return Model([names[k] for k in order], tf[order])


def _predict(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            ids, held, text = batch.column(0), batch.column(1), batch.column(2)
            for row, buf, offs in text_chunks(batch):
                n = len(offs) - 1
                if model is None:
                    lang, score, far = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
                else:
                    lang, score, far = model.predict(counts(buf, offs))
                    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
                    some = np.append(0, np.cumsum(ascii_letter))
                    for k in np.flatnonzero(some[offs[1:]] == some[offs[:-1]]).tolist():
                        value = text[row + k].as_py() or ""
                        if not any(c.isalpha() for c in value):
                            lang[k], score[k], far[k] = UNKNOWN, 0.0, True
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), held.slice(row, n), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text, lang)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(base.filter(fold != 2))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = base.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")

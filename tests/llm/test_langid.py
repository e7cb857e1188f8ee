import math
import operator
import random
import zlib

from quarrylens.llm import langid
from quarrylens.llm.langid import language_id

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred int"
PARTS = {"en": ["the", "ing", "tion", "wh", "er", "and"], "fr": ["eau", "é", "que", "tion", "ou", "è"], "de": ["sch", "ü", "ung", "der", "ß", "ein"], "ru": ["ст", "ов", "ни", "ко"]}


def corpus():
    rng = random.Random(6)
    rows = []
    for k in range(500):
        lang = rng.choice(list(PARTS))
        text = " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120)))
        if k % 7 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((k, text, lang, "x", 1))
    return rows


def test_held_out_accuracy_and_edges(spark, monkeypatch):
    monkeypatch.setattr(langid, "_PART", 1 << 16)
    rows = corpus()
    odd = [(None, None, "en", None, None), (1001, None, None, None, None), (1002, "123 ... ", "xx", None, None), (1003, "", "en", None, None), (1004, "the thing " * 30000, None, None, None), (1005, "й", None, None, None)]
    got = language_id(spark.createDataFrame(rows + odd + rows[:1], SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd) + 1
    by = {r.doc_id: r for r in got}
    truth = {r[0]: r[2] for r in rows}
    for i in truth:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= by[i].score <= 1
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    assert [by[i].lang_pred for i in (None, 1001, 1002, 1003, 1004)] == ["und"] * 4 + ["en"]
    assert by[1005].lang_pred in truth.values() and by[None].score == 0.0 and not by[None].held_out


def test_prediction_ignores_lang_source_and_id(spark):
    rows = corpus()
    held = {k for k in range(500) if zlib.crc32(str(k).encode()) % 4 == 2}
    changed = [(i, t, "en" if i in held else lang, s, p) for i, t, lang, s, p in rows]
    a = language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    b = language_id(spark.createDataFrame(changed, SCHEMA)).collect()
    assert sorted(a) == sorted(b)


def test_no_training_data(spark):
    got = language_id(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)).collect()
    assert got[0].lang_pred == "und"
    assert language_id(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_vector(text, idf):
    """TF-IDF of hashed byte 2-grams and 3-grams, one by one."""
    low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text).encode()
    seen = bytearray()
    for b in low:
        if 97 <= b <= 122 or b >= 128:
            seen.append(b)
        elif seen and seen[-1] != 32:
            seen.append(32)
    tf = [0.0] * langid.DIMS
    for k in (2, 3):
        for at in range(len(seen) - k + 1):
            gram = 0
            for b in seen[at : at + k]:
                gram = (gram * 257 + b) % 2**32
            tf[gram * 0x9E3779B1 % 2**32 >> 32 - langid.DIMS.bit_length() + 1] += 1
    v = [math.log1p(x) * i for x, i in zip(tf, idf)]
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def test_predictions_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    train = df.filter("crc32(cast(doc_id as string)) % 4 <> 2")
    model = langid.fit(train)
    idf = model.idf.tolist()
    got = {r.doc_id: r for r in language_id(df).collect()}
    for i, text, _, _, _ in rows[:60]:
        v = plain_vector(text, idf)
        cos = [sum(map(operator.mul, v, c)) for c in model.centres.tolist()]
        best = max(cos)
        assert abs(got[i].score - min(max(best, 0), 1)) < 1e-4
        assert best - max([c for c, n in zip(cos, model.names) if n == got[i].lang_pred]) < 1e-4
        assert got[i].rejected == (cos[cos.index(best)] < model.floors[cos.index(best)]) or abs(best - model.floors[cos.index(best)]) < 1e-4


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL", 600)
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n in range(450):
        bits = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(4)]
        rows += [(len(rows) + k, " ".join(rng.choice(bits) + rng.choice(bits) for _ in range(60)), f"l{n:03}", None, None) for k in range(4)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert set(model.names) == {f"l{n:03}" for n in range(450)}
    got = {r.doc_id: r.lang_pred for r in language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[r[0]] == r[2] for r in rows) > 0.95 * len(rows)

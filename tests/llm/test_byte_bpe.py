import base64
import hashlib
import random

import pytest
import regex

from quarrylens.llm import byte_bpe
from quarrylens.llm.byte_bpe import PATTERN, RANKS, ByteBpe, bpe_digests, decode_documents, encode_documents, segments

SCHEMA = "doc_id long, text string, `a.b` string, n_tokens string, _value int"


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        return ByteBpe(f.read(), PATTERN)


def merged(ranks, raw):
    """Plain merging: the pair of least rank, the leftmost of equals, until none is left."""
    parts = [raw[k : k + 1] for k in range(len(raw))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def brute(text):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return [i for m in regex.findall(PATTERN, text) for i in merged(ranks, m.encode())]


TEXTS = [
    None, "", " ", "\n", "a", "It's they'll we'd 'tis ''s x'S", "  two  spaces\t\ttabs \r\n end  ", "日本語のテキスト、数字123と😀", "ß nbsp em\u0085nel\x1cfs\x1dgs", "<|endoftext|> stays text",
    "1234567890 12 3", "écombining ​zero ﻿bom", "....!!!???;;;---", "\x00\x01nul", "'", " '", "''", "don't stop'", "x" * 300, " " * 50 + "x", "x" + "\n" * 40,
]


def test_ids_and_bytes_equal_plain_merging(spark):
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "ж", "漢", "😀", "7", "42", "!", "...", "\t", " ", "ll", "'ll"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = [(k, t, "x", None, k) for k, t in enumerate(texts)] + [(None, "no id", None, "y", None), (1, "", None, None, None)]
    got = bpe_digests(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(i), len(ids := brute(t or "")), len((t or "").encode()), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_segments_change_no_id(bpe):
    rng = random.Random(8)
    parts = [" ", "  ", "\n", " ", " ", "word", "'s", "9", "!?", "é", "\x1c", " \n \t"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        cut = list(segments(text, size=rng.randint(1, 20), run=rng.randint(2, 6)))
        assert "".join(s for s, _ in cut) == text
        ids = [i for s, piece in cut for i in (bpe._piece(s.encode()) if piece else bpe.library.encode_ordinary(s))]
        assert ids == bpe.library.encode_ordinary(text)


def test_very_long_texts(spark, bpe):
    many = 3_000_000
    rng = random.Random(4)
    texts = [" " * many + "end", "\n" * many, "a" + "\t " * (many // 2), "z" * many, "".join(rng.choice(["word ", "other\n", "12 ", "- "]) for _ in range(many // 4))]
    got = {r.doc_id: r for r in bpe_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got[0].n_tokens == len(bpe._piece(b" " * (many - 1))) + len(bpe.library.encode_ordinary(" end"))
    assert got[1].n_tokens == len(bpe._piece(b"\n" * many))
    assert got[4].n_tokens == len(bpe.library.encode_ordinary(texts[4]))


def test_ids_and_bytes_leave_the_operator(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BATCH_IDS", 7)
    docs = spark.createDataFrame([(k, t, f"s{k}", "n", k) for k, t in enumerate(TEXTS)], SCHEMA)
    encoded = encode_documents(docs, keep=("doc_id", "a.b", "n_tokens", "_value"))
    assert encoded.columns == ["doc_id", "a.b", "kept_n_tokens", "_value", "n_tokens", "token_ids"]
    rows = {r.doc_id: r for r in encoded.collect()}
    assert all(rows[k].token_ids == brute(t or "") and rows[k].n_tokens == len(rows[k].token_ids) and rows[k]["a.b"] == f"s{k}" for k, t in enumerate(TEXTS))
    back = {r.doc_id: bytes(r.decoded) for r in decode_documents(encoded).collect()}
    assert back == {k: (t or "").encode() for k, t in enumerate(TEXTS)}
    split = decode_documents(encoded.selectExpr("doc_id", "slice(token_ids, 1, 1) AS token_ids")).filter("doc_id = 7").first()
    assert "日本語".encode().startswith(bytes(split.decoded))
    assert decode_documents(spark.createDataFrame([(1, None)], "doc_id int, token_ids array<long>")).first().decoded is None


def test_invalid_bytes_and_empty_tables(spark):
    odd = spark.sql("SELECT 1L AS doc_id, CAST(X'41FF42' AS STRING) AS text")
    assert odd.transform(bpe_digests).first().decoded_sha256 == hashlib.sha256("A�B".encode()).hexdigest()
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe_digests(empty).count() == 0 and encode_documents(empty).count() == 0

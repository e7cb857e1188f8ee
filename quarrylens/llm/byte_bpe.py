"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is read once on the driver and broadcast (a vocabulary has a fixed size); each worker builds its encoder from it once.
Texts are encoded whole, without special tokens.  A long text is cut into segments at safe boundaries first: no match of the pattern
holds a white space character after another one, so a cut before white space that follows something else changes no match.
A run of white space too long for the library's regular expression is one match up to its last character (all of it
at the end of the text), so it goes to the merges as a piece of its own.  Segments bound the memory of a text; only a single match, such
as a word of many million letters, has to be held whole (some 70 bytes a byte).

Decoding concatenates the raw bytes of the ids, so a character that is split over several ids comes back whole.

Defined results: null text: no ids, decoded to nothing; empty text: the same; invalid UTF-8 counts as U+FFFD; repeated rows: repeated
results; any doc_id, null too, is passed on; null ids decode to null; an id outside the vocabulary fails the task; empty table: empty result;
extra columns are ignored, unless named in ``keep``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a segment, at least, and of a run of white space that goes apart; the library's limit is some 1,000,000.
SEGMENT = 1 << 17
RUN = 1 << 16
#: Ids of a batch that leaves a task.
BATCH_IDS = 1 << 20

_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")


class ByteBpe:
    """Encoder and decoder over the ranks of one file's bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.decimal = {rank: str(rank) for rank in table.values()}
        self.whole = table

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, segment by segment."""
        for segment, piece in segments(text):
            yield self._piece(segment.encode()) if piece else self.library.encode_ordinary(segment)

    def _piece(self, raw: bytes) -> list[int]:
        own = self.whole.get(raw)
        return self.library._core_bpe.encode_single_piece(raw) if own is None else [own]

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def segments(text: str, size: int = SEGMENT, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text cut at safe boundaries; true with a segment that is one match of the pattern by itself."""
    at = 0
    long_run = regex.compile(r"\p{White_Space}{%d,}" % run)
    while at < len(text):
        cut = _SAFE.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        block, begin = text[at:end], 0
        for found in long_run.finditer(block) if len(block) >= run else ():
            last = found.end() if at + found.end() == len(text) else found.end() - 1
            if begin < found.start():
                yield block[begin : found.start()], False
            yield block[found.start() : last], True
            begin = last
        if begin < len(block):
            yield block[begin:], False
        at = end


@functools.lru_cache(maxsize=4)
def coder(ranks: bytes, pattern: str) -> ByteBpe:
    return ByteBpe(ranks, pattern)


def _shared(df: DataFrame, ranks: str, pattern: str):
    with open(ranks, "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern))


def _texts(column) -> Iterator[str]:
    """Texts one by one; null as empty, invalid bytes as U+FFFD."""
    for value in column.cast(pa.large_binary()):
        raw = value.as_buffer()
        yield "" if raw is None else str(raw, errors="replace")


def _encode(shared):
    def run(batches):
        from quarrylens.llm import byte_bpe as here

        bpe = here.coder(*shared.value)
        for batch in batches:
            held, begin, size = [], 0, 0
            for row, text in enumerate(_texts(batch.column(batch.num_columns - 1))):
                held.append([i for part in bpe.encode(text) for i in part])
                size += len(held[-1])
                if size >= BATCH_IDS or row + 1 == batch.num_rows:
                    kept = [c.slice(begin, row + 1 - begin) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(map(len, held), pa.int64()), pa.array(held, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "n_tokens", "token_ids"])
                    held, begin, size = [], row + 1, 0

    return run


def _decode(shared):
    def run(batches):
        from quarrylens.llm import byte_bpe as here

        bpe = here.coder(*shared.value)
        for batch in batches:
            raw = [None if ids.as_py() is None else bpe.decode(ids.as_py()) for ids in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*batch.schema.names[:-1], "decoded"])

    return run


def _digest(shared):
    def run(batches):
        from quarrylens.llm import byte_bpe as here

        bpe = here.coder(*shared.value)
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                ids_hash, raw_hash, many, size, comma = hashlib.sha256(), hashlib.sha256(), 0, 0, ""
                for ids in bpe.encode(text):
                    ids_hash.update((comma + ",".join([bpe.decimal[i] for i in ids])).encode())
                    raw = bpe.decode(ids)
                    raw_hash.update(raw)
                    many, size, comma = many + len(ids), size + len(raw), ","
                rows.append((many, size, ids_hash.hexdigest(), raw_hash.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))] if rows else [batch.column(0), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256"])

    return run


def _with_kept(df: DataFrame, keep: tuple[str, ...], value: F.Column, run, added: str, names: tuple[str, ...]) -> DataFrame:
    """The kept columns, whatever their names, and those that run adds in place of value."""
    held = df.select(*(F.col(f"`{c}`").alias(f"_kept{k}") for k, c in enumerate(keep)), value.alias("_value"))
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in held.schema.fields[:-1])
    out = held.mapInArrow(run, head + added)
    return out.select(*(F.col(f"_kept{k}").alias(f"kept_{c}" if c in names else c) for k, c in enumerate(keep)), *names)


def encode_documents(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens and token_ids."""
    return _with_kept(docs, keep, F.col("text").cast("string"), _encode(_shared(docs, ranks, pattern)), "n_tokens long, token_ids array<int>", ("n_tokens", "token_ids"))


def decode_documents(encoded: DataFrame, ranks: str = RANKS, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and decoded, the bytes of token_ids."""
    return _with_kept(encoded, keep, F.col("token_ids").cast("array<int>"), _decode(_shared(encoded, ranks, pattern)), "decoded binary", ("decoded",))


def bpe_digests(docs: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_sha256 (decimal ids, comma-joined) and decoded_sha256, each text encoded and decoded segment by segment."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(_digest(_shared(docs, ranks, pattern)), "doc_id long, n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string")

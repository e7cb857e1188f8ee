"""Matches of regular expressions with code-point places, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,hit:string,extra:string>>"


def matches(text: F.Column, pattern: str, group: int | None = None) -> F.Column:
    """All leftmost non-overlapping matches as structs (start, end, hit, extra): code points, end exclusive.

    The pattern must not match the empty string.  extra is the given capture group, or null.  The text between
    matches comes from splitting at the pattern, so places are sums of lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    extra = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else F.transform(hits, lambda h: F.lit(None).cast("string"))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), extra.alias("extra"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, row):
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.length(row["hit"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), row["hit"].alias("hit"), row["extra"].alias("extra"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def matches_where(text: F.Column, guard: F.Column, pattern: str, group: int | None = None) -> F.Column:
    """matches(), and no spans at all where the cheap guard is false."""
    return F.when(guard, matches(text, pattern, group)).otherwise(F.array().cast(SPAN))


def kinded(spans: F.Column, kind: str, place: int) -> F.Column:
    """Spans as sortable structs (start, place of the kind, end, kind)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: F.Column) -> F.Column:
    """kind:start:end by start, then place of the kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: F.Column, spans: F.Column, mask: str) -> F.Column:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        parts = F.when(fresh, F.concat(acc["parts"], F.array(before, F.lit(mask)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    folded = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.struct(acc["at"].alias("at"), F.array_join(acc["parts"], "").alias("head")))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(folded["head"], F.substring(text, (folded["at"] + 1).cast("int"), F.length(text).cast("int"))))

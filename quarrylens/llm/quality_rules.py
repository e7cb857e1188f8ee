"""Quality rules: a threshold table compiled into one projection of built-in functions.

Base measures: words are runs of characters other than U+0020 and U+0009 to U+000D; n_repeat_words are the words in
three-word windows that occur twice or more in the text, the first included; n_dup_lines are lines with a word that
equal an earlier one.  Everything is an expression over one row, so a document never leaves its task; repeated
windows are found by sorting the row's own window hashes (64 bits), only where a row has any.

RULES is the table: measure, comparison, threshold.  A document is kept if it does not fail the base rule and no
row of the table rejects it.

Defined results: null or blank text: all measures 0, base_failed; very long texts are measured whole; repeated
rows give repeated results; empty table: empty result; extra columns are ignored, or kept by `quality_filter`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import whole_row

SPACE = "[ \\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent short words of the languages in scope.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as", "be", "this", "by", "from", "at", "or",
    "le", "la", "les", "de", "des", "et", "un", "une", "est", "que", "qui", "dans", "pour", "du", "en", "par",
    "der", "die", "das", "und", "ist", "ein", "eine", "von", "mit", "den", "dem", "zu", "nicht", "auf", "im",
    "el", "los", "las", "y", "una", "por", "con", "para", "del", "se", "no", "su",
)

#: measure, comparison that rejects, threshold
RULES: tuple[tuple[str, str, float], ...] = (
    ("mean_word_chars", "<", 2.0),
    ("mean_word_chars", ">", 15.0),
    ("symbol_ratio", ">", 0.04),
    ("stop_ratio", "<", 0.01),
    ("dup_line_ratio", ">", 0.40),
    ("mark_ratio", ">", 0.10),
    ("upper_ratio", ">", 0.45),
)


def _words(text: F.Column) -> F.Column:
    """Words of a text: split at spaces, without the empty pieces at its ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _windows(words: F.Column) -> F.Column:
    at = F.sequence(F.lit(1), F.size(words) - 2)
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))


def _sorted_windows(hashes: F.Column) -> F.Column:
    """(hash, place) by hash, or nothing where no hash occurs twice."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), pairs)


def _repeat_words(pairs: F.Column) -> F.Column:
    """Words covered by windows whose hash occurs twice or more.  pairs must be a plain column: the lambdas look into it."""
    alike = F.transform(pairs, lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last"))
    return F.aggregate(F.array_sort(F.filter(alike, lambda i: i.isNotNull())), start, step, lambda acc: acc["n"])


def quality_measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and every measure of docs(text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # explode of one element: a later filter cannot be pushed below it, which would evaluate these arrays anew inside lambdas
    words = docs.select(*keep, text.alias("_text")).select("*", F.explode(F.array(_words(F.col("_text")))).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike("[^ \\x09-\\x0D]"))
    one = words.select(
        *keep, "_text", F.size("_words").cast("long").alias("n_words"), F.array_join("_words", "").alias("_solid"), _windows(F.col("_words")).alias("_hashes"),
        lines.alias("_lines"), F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
    )
    one = one.select("*", F.explode(F.array(_sorted_windows(F.col("_hashes")))).alias("_pairs"))
    return one.select(
        *keep,
        "n_words",
        F.length("_solid").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_pairs").isNull(), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_pairs"))).alias("n_repeat_words"),
        "n_stop",
        F.length(F.regexp_replace("_solid", "[^!?]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_solid", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
    )


def compile_rules(rules=RULES) -> F.Column:
    """The table as one boolean expression: true where any row rejects."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    measure = {
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / chars,
        "stop_ratio": F.col("n_stop") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "mark_ratio": F.col("n_marks") / chars,
        "upper_ratio": F.col("n_upper") / chars,
        "n_words": F.col("n_words"),
    }
    rejects = F.lit(False)
    for name, op, bound in rules:
        value = measure[name]
        rejects = rejects | {"<": value < bound, ">": value > bound, "<=": value <= bound, ">=": value >= bound}[op]
    return rejects


def quality_rules(docs: DataFrame, rules=RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, the measures, base_failed and kept."""
    measured = quality_measures(docs, *keep)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~compile_rules(rules))


def quality_filter(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that are kept."""
    whole = docs.select(whole_row(docs).alias("_row"), "text")
    return quality_rules(whole, rules, ("_row",)).filter("kept").select("_row.*")

"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is a blob, addressed by the SHA-256 of its text.  The ledger is a table of (blob,
rule, findings), one row for each blob and rule version that was ever scanned.  A run scans only the blobs of which
some rule version is not in the ledger, runs only those rules, appends the findings, and joins them
back to all paths.  All of it is built-in functions; a blob that is a third of all rows is scanned once, and findings go
back to paths by `spread_join`, so that its rows never meet in one task and texts without findings are not shuffled a second time
while the findings are few.

RULES are the rule versions.  A rule's key holds its version and a hash of its definition, so a changed rule is never taken for
one that was run.  Base kinds: assign, access, hex; further rules add spans and never change these.
`named_ledger` is the ledger of a table's path: a later run over the same path scans only what is new there.

Defined results: null text is the empty text; repeated rows each get the blob's findings; very long texts are scanned
whole; an empty table gives an empty result; extra columns are ignored or kept by `redact_secrets`.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm._common import shared_dir, spread_join, whole_row, written
from quarrylens.llm._spans import listed, masked, matches_where


@dataclass(frozen=True)
class Rule:
    """One version of a rule.  guard: a cheap test a text must pass; least: characters that ``group`` (or the match) must have."""

    kind: str
    version: int
    pattern: str
    guard: str
    group: int | None = None
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        body = repr((self.pattern, self.guard, self.group, self.least)).encode()
        return f"{self.kind}@{self.version}:{zlib.crc32(body):08x}"


# The base patterns.  Repeats that cannot give back characters are possessive, and runs too short to count are
# left out by the pattern itself where that gives the same matches.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*+[:=]\\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)", "[:=]", 1, 6, True),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}+", "AKIA", None, 20, True),
    Rule("hex", 1, "[0-9a-f]{24,}+", "[0-9a-f]{24}", None, 24, True),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "-----BEGIN", None, 1),
    Rule("bearer", 1, "(?i:bearer)\\x20++[A-Za-z0-9._~+/-]{20,}+=*+", "(?i:bearer)\\x20", None, 1),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+", "eyJ", None, 1),
)
#: Findings of so many blobs are broadcast to the paths.
FEW = 100_000
_KEEP = "array<struct<start:bigint,end:bigint>>"


def _found(rule: Rule, text: F.Column) -> F.Column:
    spans = matches_where(text, text.rlike(rule.guard), rule.pattern, rule.group)
    long = F.filter(spans, lambda s: F.length(s["extra" if rule.group else "hit"]) >= rule.least)
    return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, rule, spans of blobs(blob, text, todo), todo the keys of the rules to run on it."""
    each = F.array(
        *[
            F.when(F.array_contains("todo", rule.key), F.struct(F.lit(rule.key).alias("rule"), _found(rule, F.col("text")).cast(_KEEP).alias("spans")))
            for rule in rules
        ]
    )
    done = blobs.select("blob", F.explode(F.filter(each, lambda f: f.isNotNull())).alias("f"))
    return done.select("blob", "f.rule", "f.spans")


def update_ledger(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan what is new in versions(blob, text), append it to the ledger and give the ledger's rows of these rules.

    The ledger is a folder of Parquet files, or none yet.
    """
    spark = versions.sparkSession
    wanted = [r.key for r in rules]
    schema = f"blob string, rule string, spans {_KEEP}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    blobs = versions.select("blob", "text")
    if exists:
        seen = spark.read.schema(schema).parquet(ledger).filter(F.col("rule").isin(wanted)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        asked = versions.select("blob").distinct().join(seen, "blob", "left")
        asked = asked.select("blob", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
        todo = blobs.join(asked, "blob").dropDuplicates(["blob"])
    else:
        todo = blobs.dropDuplicates(["blob"]).withColumn("todo", F.array(*map(F.lit, wanted)))
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).filter(F.col("rule").isin(wanted))


def named_ledger(spark, path: str) -> str:
    """The ledger's folder for the table at a path."""
    return f"{shared_dir(spark).rstrip('/')}/quarry-op5-ledger-{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def secret_findings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), ledger: str | None = None, rules=RULES) -> DataFrame:
    """The kept columns, the text as ``_text``, and ``_found``: all spans as (start, place, end, kind).

    Without a ledger a new one is begun in the shared folder.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark).rstrip('/')}/quarry-op5-ledger-{uuid.uuid4().hex}"
    paths = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")).withColumn("_blob", F.sha2("_text", 256))
    found = update_ledger(paths.select(F.col("_blob").alias("blob"), F.col("_text").alias("text")), ledger, rules)
    found = found.filter(F.size("spans") > 0).dropDuplicates(["blob", "rule"])  # a rerun task may have appended twice
    places = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.key, k)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), places[F.col("rule")].alias("place"), s["end"].alias("end"), kinds[F.col("rule")].alias("kind")))
    by_blob = found.select("blob", spans.alias("spans")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_found"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    by_blob = written(by_blob.withColumnRenamed("blob", "_blob"), "op5-findings")
    return spread_join(paths, by_blob, ["_blob"], "left", most=FEW).select(*keep, "_text", F.coalesce("_found", none).alias("_found"))


def secret_scan(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs(doc_id, text)."""
    rows = secret_findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ("doc_id",), ledger, rules)
    of = lambda kind: F.size(F.filter("_found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in rules if r.base]
    return rows.select(
        "doc_id", *[of(k) for k in base], F.sha2(listed(F.filter("_found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed(F.col("_found")).alias("spans")
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", ledger: str | None = None, rules=RULES) -> DataFrame:
    """docs with every secret in text replaced by the mask; null texts stay null."""
    rows = secret_findings(docs.select(whole_row(docs).alias("_row"), "text"), ("_row",), ledger, rules)
    text = F.when(F.col("_row.text").isNotNull(), masked(F.col("_text"), F.col("_found"), mask))
    return rows.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")

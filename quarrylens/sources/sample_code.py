"""Source code written from the driver's part table, one file a row, so that extraction runs over a whole table.

Each file opens with as many empty lines as p_size modulo 7, then a template of one of five languages, in which {k} is the part's key
and {n} its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.functions.tables import dealt

# Language, ending, text.
TEMPLATES = (
    ("rust", "rs", "use crate::dep_{k};\npub struct S{k};\nimpl S{k} {\n    fn {n}(&self) {\n        helper_{k}();\n        self.{n}_x();\n    }\n}\n"),
    ("go", "go", "package p\nimport \"dep/{n}\"\ntype T{k} struct {\n}\nfunc F{k}() {\n\thelper_{k}()\n\tx.{n}()\n}\n"),
    ("python", "py", "import dep_{k}\nclass C{k}:\n    def {n}(self):\n        é = helper_{k}()\n        self.{n}_x()\n"),
    ("typescript", "ts", "import { a } from './dep_{k}';\nexport class C{k} {\n  {n}(): void {\n    helper_{k}();\n    this.{n}_x();\n  }\n}\n"),
    ("java", "java", "import dep.D{k};\n@Sold\npublic class C{k} {\n  void {n}() {\n    helper_{k}();\n    this.{n}_x();\n  }\n}\n"),
)


def name_of() -> F.Column:
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))


def source_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text."""
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"), "p_partkey")
    which = (F.col("p_partkey") % len(TEMPLATES)).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in TEMPLATES]), which + 1)
    key = F.col("p_partkey").cast("string")
    body = F.replace(F.replace(pick(2), F.lit("{k}"), key), F.lit("{n}"), name_of())
    lead = F.repeat(F.lit("\n"), (F.col("p_size") % 7).cast("int"))
    return part.select(F.concat(F.lit("part/f"), key, F.lit("."), pick(1)).alias("path"), pick(0).alias("language"), F.concat(lead, body).alias("text"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text of a JSON file for each supplier."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{\n  "s'), key, F.lit('": {"inner'), key, F.lit('": ['), key, F.lit(']},\n  "plain": "a:b"\n}\n'))
    return dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey").select(F.concat(F.lit("s"), key, F.lit(".json")).alias("path"), F.lit("json").alias("language"), text.alias("text"))


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff of two hunks for each customer; the second deletes lines only."""
    key, many = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    count = F.when(many == 1, "").otherwise(F.concat(F.lit(","), many.cast("string")))
    text = F.concat(F.lit("diff --git a/x b/x\n+++ b/c"), key, F.lit(".rs\n@@ -1,2 +"), (F.col("c_custkey") % 90 + 1).cast("string"), count, F.lit(" @@\n+x\n@@ -9,3 +40,0 @@\n-y\n+++ /dev/null\n@@ -1 +1 @@\n"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(text.alias("text"))


def config_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and text of a compiler configuration with comments and trailing commas for each supplier."""
    key = F.col("s_suppkey").cast("string")
    text = F.concat(
        F.lit('{ // paths\n "compilerOptions": {"baseUrl": "./b'), key, F.lit('", /* two */ "paths": {"@s'), key, F.lit('/*": ["./src'), key, F.lit('/*", "other/*"],\n "one": ["// no comment"], "none": [],}}}')
    )
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("tsconfig."), key, F.lit(".json")).alias("path"), text.alias("text"))

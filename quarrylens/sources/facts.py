"""Fact tables: from a snapshot folder, or derived from the driver's tables.

The derived tables hold no source code; their columns are formulas over documents, part, lineitem, orders and
events, every row of them, so that each operator meets ambiguity, externals, self calls, cycles, imports across layers and
unresolved ones.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylens.functions.tables import cut
from quarrylens.sources.tree import disk_files, read_texts, read_windows

#: Spans are broadcast up to so many.
SPANS = 100_000


class Facts:
    """files, symbols, calls, imports, usage, lines and aliases of one repository."""

    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    usage: DataFrame
    aliases: list[tuple[str, str, bool]]

    def texts(self, lang: str | None = None) -> DataFrame:
        """path and text of every file that can be read, or of those in one language."""
        raise NotImplementedError

    def windows(self, spans: DataFrame) -> DataFrame:
        """path, line_no, text of the lines first to last, both from 0, of spans(path, first, last)."""
        lines = F.split("text", "\n")
        near = self.texts().join(F.broadcast(spans), "path") if spans.limit(SPANS + 1).count() <= SPANS else self.texts().join(spans, "path")
        places = F.filter(F.sequence(F.greatest("first", F.lit(0)), F.greatest(F.least(F.col("last"), F.size(lines) - 1), F.lit(0))), lambda k: (k >= F.col("first")) & (k <= F.col("last")) & (k < F.size(lines)))
        one = near.select("path", lines.alias("lines"), F.explode(places).alias("line_no")).dropDuplicates(["path", "line_no"])
        return one.select("path", "line_no", F.get("lines", F.col("line_no")).alias("text"))


class Snapshot(Facts):
    """Facts of a snapshot that the store holds; with the root of its tree, files are opened in tasks, without one their lines are a table."""

    def __init__(self, tables: dict[str, DataFrame], aliases: list[tuple[str, str, bool]] = (), root: str | None = None):
        self.__dict__.update(tables)
        self.aliases, self.root = list(aliases), root

    def texts(self, lang: str | None = None) -> DataFrame:
        spark = self.files.sparkSession
        if self.root is None:
            gap = F.col("line_no") - F.coalesce(F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no")), F.lit(0))
            each = self.lines.select("path", "line_no", F.concat(F.repeat(F.lit("\n"), gap), F.col("text")).alias("text"))
            each = each.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "").alias("text"))
            return each if lang is None else each.join(self.files.filter(F.col("language") == lang).select("path"), "path", "left_semi")
        paths = disk_files(spark, self.root, every=True)
        if lang is not None:
            paths = paths.join(self.files.filter(F.col("language") == lang).select("path"), "path", "left_semi")
        return read_texts(spark, self.root, paths).select("path", "text")

    def windows(self, spans: DataFrame) -> DataFrame:
        return super().windows(spans) if self.root is None else read_windows(self.files.sparkSession, self.root, spans)


class Derived(Facts):
    """Facts derived from the driver's tables."""

    aliases = [("@docs/", "", True), ("@root", "src0/src/doc_0", False)]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _files(self) -> DataFrame:
        lang, kind = F.col("lang"), F.col("doc_id") % 50
        ext = F.when(lang == "en", ".rs").when(lang == "fr", ".py").when(lang == "de", ".go").otherwise(".sh")
        tag = F.col("doc_id").cast("string")
        path = (
            F.when(kind == 7, F.concat("source", F.lit("/app_"), tag, F.lit("/Main.tsx")))
            .when(kind == 11, F.concat("source", F.lit("/tests/doc_"), tag, ext))
            .when(kind == 13, F.concat("source", F.lit("/src/doc_"), tag, F.lit(".test"), ext))
            .otherwise(F.concat("source", F.lit("/src/doc_"), tag, ext))
        )
        language = F.when(lang == "en", "rust").when(lang == "fr", "python").when(lang == "de", "go").otherwise("bash")
        docs = self.table("documents")
        return docs.select("doc_id", path.alias("path"), (F.col("doc_id") * 1_000_000_000).alias("mtime_ns"), F.octet_length("text").cast("long").alias("size"), language.alias("language"))

    @cached_property
    def files(self) -> DataFrame:
        return self._files.select("path", "mtime_ns", "size", "language")

    @cached_property
    def _spread(self) -> int:
        """Over how many files the symbols lie: a fifth of them, 200 at least."""
        return max(200, self.table("documents").count() // 5)

    @property
    def _paths(self) -> DataFrame:
        return self._files.select(F.col("doc_id").alias("_doc"), F.col("path").alias("file_path"))

    @cached_property
    def _symbols(self) -> DataFrame:
        part = self.table("part").withColumn("_doc", F.col("p_partkey") % self._spread)
        plain = F.replace("p_name", F.lit(" "), F.lit("_"))
        name = (
            F.when(F.col("p_partkey") % 500 == 1, "main").when(F.col("p_partkey") % 3 == 0, plain).otherwise(F.concat(plain, F.lit("_"), F.col("p_partkey").cast("string")))
        )
        size = F.col("p_size")
        kind = F.when(size % 8 == 0, "method").when(size % 8 == 1, "class").when(size % 8 == 2, "macro").when(size % 8 == 3, "key").when(size % 8 == 4, "section").otherwise("function")
        start = F.floor(F.col("p_partkey") / self._spread) * 10
        visibility = F.when(F.col("p_type") == "ECONOMY", "public").when(F.col("p_type") == "SMALL", "unknown").otherwise("private")
        return part.join(self._paths, "_doc").select(
            F.col("p_partkey").alias("partkey"), "file_path", name.alias("name"), kind.alias("kind"), start.cast("int").alias("start_line"), F.lit(0).alias("start_column"),
            (start + size % 10).cast("int").alias("end_line"), size.cast("int").alias("end_column"), visibility.alias("visibility"),
        )

    @cached_property
    def symbols(self) -> DataFrame:
        return self._symbols.drop("partkey")

    @cached_property
    def calls(self) -> DataFrame:
        # orders meet their callee before the far more lineitems do, and those lose their keys before they move again
        callee = self._symbols.select(F.col("partkey").alias("_callee"), F.col("name").alias("_name"))
        orders = self.table("orders").select("o_orderkey", "o_custkey").join(callee, F.col("o_custkey") == F.col("_callee")).select("o_orderkey", "_name")
        outside = F.concat(F.lit("ext_"), F.col("l_suppkey").cast("string"))
        sold = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("is_method"), F.when((F.col("l_linenumber") == 7) | (F.col("l_quantity") > 6), outside).otherwise(F.col("_name")).alias("callee_name"),
        )
        caller = self._symbols.filter(F.col("kind").isin("function", "method")).select(
            F.col("partkey").alias("_caller"), "file_path", F.col("name").alias("caller_name"), F.col("start_line").alias("caller_start_line")
        )
        return sold.join(caller, F.col("l_partkey") == F.col("_caller")).select(
            "file_path", "caller_name", "caller_start_line", "callee_name",
            (F.col("caller_start_line") + F.col("l_linenumber")).cast("int").alias("site_line"), (F.col("l_suppkey") % 80).cast("int").alias("site_column"),
            F.lit("syntactic").alias("resolution"), "is_method",
        )

    def held(self) -> Derived:
        """The same facts with the calls written once, for a query that asks for them more than once."""
        out = Derived(self.spark, self.sf_dir)
        out.__dict__ |= self.__dict__ | {"calls": cut(self.calls, "calls")}
        return out

    @cached_property
    def imports(self) -> DataFrame:
        events = self.table("events").withColumn("_doc", F.col("user_id") % self._spread)
        number = F.floor(F.col("value") * 100).cast("long") % self._spread
        target, folder = number.cast("string"), F.concat(F.lit("src"), (number % 20).cast("string"), F.lit("/src/doc_"))
        kind, outside = F.col("event_type"), F.concat(F.lit("pkg_"), (F.col("user_id") % 10).cast("string"))
        module = (
            F.when(F.col("event_id") % 4 != 0, outside).when(kind == "view", F.concat(F.lit("./doc_"), target)).when(kind == "click", F.concat(F.lit("../../"), folder, target))
            .when(kind == "purchase", F.concat(F.lit("@docs/"), folder, target)).when(kind == "signup", F.concat(F.lit("crate::doc_"), target, F.lit("::item"))).otherwise(outside)
        )
        return events.join(self._paths, "_doc").select(
            "file_path", module.alias("module"), F.col("event_id").cast("int").alias("site_line"), F.lit(0).alias("site_column"), F.lit("syntactic").alias("resolution")
        )

    @cached_property
    def usage(self) -> DataFrame:
        size = F.floor(F.col("value") * 100).cast("long")
        return self.table("events").select(
            (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_unix_ns"), F.col("event_type").alias("command"), (F.col("user_id") % 50).cast("int").alias("candidate_files"),
            size.alias("candidate_bytes"), F.floor(size / 4).cast("long").alias("estimated_baseline_tokens"), F.col("user_id").cast("long").alias("returned_tokens"),
            F.lit("json").alias("output_format"), F.lit(None).cast("string").alias("query"), F.col("event_id").alias("seq"),
        )

    def texts(self, lang: str | None = None) -> DataFrame:
        files = self._files if lang is None else self._files.filter(F.col("language") == lang)
        return self.table("documents").select("doc_id", "text").join(files.select("doc_id", "path"), "doc_id").select("path", "text")

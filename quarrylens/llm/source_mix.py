"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the wanted total, by weight and never above CAP times its size (what a
full source leaves is shared again by weight: water filling).  Complete epochs take every document; the
rest of the target is a weighted sample without replacement: each document draws an exponential key divided by its
quality weight (`quality_weight`), documents are sorted within the source by key, and sizes are prefix-summed
up to the token budget.  The document that crosses the budget is taken if that lands nearer to it.

No task holds a source, nor all sources.  Sources are numbered by range partitions, the water level is found by
aggregates over the source table, one row each.  Keys fall into BINS bins of equal probability, bin totals are summed per
source first, and only the documents of the one bin that a source's budget ends in are sorted; equal rows of it
count as one with a number, however many they are.  Draws are hashes of the document, so reruns agree.

Defined results: null or blank text has size 0, is never counted and stays once in `mix_documents`; very long texts are counted
whole; a null source is a source of its own, last in order; sources without words have target 0; rows of one source with
equal key and text are told apart by a hash of the row (`mix_documents`), and rows that are equal altogether share what
their group takes; an empty table gives an empty result; extra columns are ignored, or kept by `mix_documents` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm._common import named, parts, spread_join, whole_row, written

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CAP = 2.0
BINS = 4096
SEED = 20240607
BLOCK = 4096


def word_count(text: F.Column) -> F.Column:
    """Number of runs of characters other than U+0020 and U+0009 to U+000D; 0 for null."""
    pieces = F.split(text, "[ \\x09-\\x0D]+")
    edges = F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(pieces) - edges).cast("long")


def quality_weight(length: F.Column, size: F.Column) -> F.Column:
    """Weight between 0.5 and 1.5 of a text of so many characters and words: higher the nearer the mean word length is to that of prose."""
    mean = length / F.greatest(size, F.lit(1))
    return F.when(size == 0, F.lit(1.0)).otherwise(0.5 + F.exp(-F.pow((mean - 6.0) / 4.0, 2)))


def _numbered(sources: DataFrame) -> DataFrame:
    """source, source_size and place, the number of the source in order of code points, null last."""
    ranged = sources.repartitionByRange(parts(sources.sparkSession), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "op6-sources")
    many = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("many"))  # one row a partition
    before = F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = many.select("part", before.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("inside", inside).join(F.broadcast(offset), "part").select("source", "source_size", (F.col("offset") + F.col("inside") - 1).alias("place"))


def source_targets(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, target: one row a source.

    A source is full at the water level w if w times its weight exceeds its limit; what the others share is the
    wanted total less the limits of the full ones, so the level rises with each round until none more is full.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    named = _numbered(sums).withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    named = written(named.drop("place"), "op6-weights")
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("limit")
        row = named.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("full"), F.sum("source_size").alias("size"), F.sum(F.when(full, F.col("limit"))).alias("spent"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if row.full is None or row.full == before:
            break
        if not row.open:
            level = float("inf")
            break
        level, before = (row.size * total - (row.spent or 0.0)) / row.open, row.full
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return named.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def _draws(doc_id: F.Column, text: F.Column, size: F.Column) -> F.Column:
    """A document's key: exponential, divided by its weight."""
    u = (F.pmod(F.xxhash64(doc_id, text, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / quality_weight(F.length(text), size)


def _bin(key: F.Column) -> F.Column:
    return F.least(F.floor((1 - F.exp(-key)) * BINS), F.lit(BINS - 1)).cast("int")


def _drawn(docs: DataFrame, tie: F.Column) -> DataFrame:
    """doc_id, source, size, key, bin and tie of each row of docs."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    sized = docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), word_count(text).alias("size"), tie.alias("tie"))
    keyed = sized.select("doc_id", "source", "size", _draws(F.col("doc_id"), F.col("text"), F.col("size")).alias("key"), "tie")
    return keyed.select("doc_id", "source", "size", "key", _bin(F.col("key")).alias("bin"), "tie")


def _goals(drawn: DataFrame, weights, total, cap) -> DataFrame:
    """For each source: its size, target, complete epochs, the rest of the target, the bin the rest ends in, and the words below that bin."""
    targets = source_targets(drawn, weights, total, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = written(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "op6-targets")
    bins = drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    running = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("upto", running).withColumn("below", F.col("upto") - F.col("bin_size"))
    plan = bins.withColumnRenamed("source", "s").join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # the bin that the rest ends in: it begins below the rest and reaches it
    ends = plan.filter((F.col("below") < F.col("rest")) & (F.col("upto") >= F.col("rest"))).select(F.col("source").alias("s"), F.col("bin").alias("end_bin"), "below")
    goals = targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "end_bin", "below")
    return written(goals, "op6-goals")


def _aimed(drawn: DataFrame, goals: DataFrame) -> DataFrame:
    """drawn with the goals of its source, and ``more``: what it takes beyond the epochs where its bin settles that (else null)."""
    known = goals.withColumns({"_none": F.col("s").isNull(), "_named": F.coalesce("s", F.lit(""))}).drop("s")
    joined = spread_join(drawn.withColumns({"_none": F.col("source").isNull(), "_named": F.coalesce("source", F.lit(""))}), known, ["_none", "_named"]).drop("_none", "_named")
    # rest = 0: nothing more; no end bin: the rest is not reached by rounding, so everything once more
    more = F.when(F.col("rest") <= 0, 0).when(F.col("end_bin").isNull() | (F.col("bin") < F.col("end_bin")), 1).when(F.col("bin") > F.col("end_bin"), 0)
    return joined.withColumn("more", more)


def _last(aimed: DataFrame) -> DataFrame:
    """Groups of equal rows of the bins that budgets end in: source, doc_id, key, tie and size, how many rows, and how many of them are taken."""
    same = ["source", "doc_id", "key", "tie", "size", "source_size", "target", "epochs", "rest", "below"]
    groups = aimed.filter("more is null").groupBy(*same).agg(F.count(F.lit(1)).alias("many"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("below") + F.coalesce(F.sum(F.col("many") * F.col("size")).over(order), F.lit(0))
    # the j-th row begins at c + j * size and is taken if half of it at least lies below the rest
    fit = F.floor((2 * F.col("rest") - 2 * F.col("c") - F.col("size")) / (2 * F.greatest(F.col("size"), F.lit(1)))) + 1
    return groups.withColumn("c", c).withColumn("hits", F.least(F.greatest(fit, F.lit(0)), F.col("many")).cast("long")).drop("c", "rest", "below")


def _repeated(rows: DataFrame, many: str) -> DataFrame:
    """Each row as often as its column says; large numbers go to several tasks in blocks."""
    blocks = F.ceil(F.col(many) / BLOCK).cast("int")
    few = rows.filter(F.col(many) <= BLOCK).withColumn("_n", F.col(many).cast("int"))
    split = rows.filter(F.col(many) > BLOCK).withColumn("_block", F.explode(F.sequence(F.lit(1), blocks)))
    split = split.withColumn("_n", F.least(F.lit(BLOCK), F.col(many) - BLOCK * (F.col("_block") - 1)).cast("int"))
    split = split.repartition("_block").drop("_block")
    out = few.filter("_n > 0").unionByName(split)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_copy", "_n")


def source_mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source)."""
    drawn = written(_drawn(docs, F.lit(0)), "op6-drawn")
    aimed = _aimed(drawn, _goals(drawn, weights, total, cap))
    taken = lambda more: (F.col("size") * (F.col("epochs") + more)).cast("long").alias("taken")
    settled = aimed.filter("more is not null").select("doc_id", "size", "source_size", "target", taken(F.col("more")))
    last = written(_last(aimed), "op6-last")
    hit = _repeated(last.withColumn("n", F.col("hits")), "n").select("doc_id", "size", "source_size", "target", taken(F.lit(1)))
    left = _repeated(last.withColumn("n", F.col("many") - F.col("hits")), "n").select("doc_id", "size", "source_size", "target", taken(F.lit(0)))
    return settled.unionByName(hit).unionByName(left)


def _row_hash(docs: DataFrame) -> F.Column:
    """A hash of the whole row; columns that cannot be hashed enter as JSON."""
    plain = [c.name for c in docs.schema.fields if "map<" not in c.dataType.simpleString() and c.dataType.typeName() != "variant"]
    rest = [c for c in docs.columns if c not in plain]
    return F.xxhash64(*map(named, plain), *([F.to_json(F.struct(*map(named, rest)))] if rest else []))


def mix_documents(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it.

    Whether a row is taken once more is known from its bin, so texts are not shuffled but for those of the bins that budgets end in.
    """
    held = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), _row_hash(docs).alias("tie"))
    drawn = written(_drawn(held.drop("row"), F.col("tie")), "op6-drawn")
    goals = _goals(drawn, weights, total, cap)
    last = written(_last(_aimed(drawn, goals)).select("source", "doc_id", "key", "tie", "many", "hits"), "op6-last")

    sized = held.withColumn("size", word_count(F.col("text"))).withColumn("key", _draws(F.col("doc_id"), F.col("text"), F.col("size")))
    aimed = _aimed(sized.select("row", "doc_id", "source", "size", "key", "tie", _bin(F.col("key")).alias("bin")), goals)
    # one pass over the texts; only rows that are equal and share what their group takes are gathered in another
    same = {"_a": F.col("source").isNull(), "_b": F.coalesce("source", F.lit("")), "_c": F.col("doc_id").isNull(), "_d": F.coalesce("doc_id", F.lit(0)), "_e": F.col("key"), "_f": F.col("tie")}
    ended = last.withColumns(same).select(*same, "many", "hits")
    known = spread_join(aimed.withColumns(same).drop("doc_id", "source", "key", "tie"), ended, list(same), "left")
    once = F.when(F.col("size") == 0, 1).when(F.col("more").isNotNull(), F.col("epochs") + F.col("more")).when(F.col("hits") == 0, F.col("epochs")).when(F.col("hits") == F.col("many"), F.col("epochs") + 1)
    known = known.withColumn("n", once.cast("int"))
    out = known.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
    if last.filter("hits > 0 and hits < many").limit(1).count():
        torn = known.filter("n is null").groupBy(*same, "epochs", "many", "hits").agg(F.first("row").alias("row"))
        torn = torn.select("row", (F.col("many") * F.col("epochs") + F.col("hits")).alias("n"))
        out = out.unionByName(_repeated(torn, "n").select("row.*"))
    return out

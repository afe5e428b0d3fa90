"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source documents are ordered by key through ranges of the key's leading
digits: the words of each (source, range) are summed, the sums are accumulated over ranges, and inside a range over documents, so
that each document knows how many of its source's words come before it. A source's target is met by whole epochs over it and a last
one cut at the exact word. Ranges split a hot source evenly, as keys are random, and their number follows the number of documents;
their sums are accumulated in groups of ranges and over groups, so that no task meets all ranges of a source.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in order; a null
doc_id is keyed by its text, so that many of them don't fall in one range (equal texts do); repeated rows and equal keys are ordered by doc_id and size; no documents give no rows; without
any words all targets are 0; other columns pass through apply_mix and are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import WORD, Scratch, small

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
#: A source is repeated at most so often.
MOST_EPOCHS = 3
#: Documents of a range, about; a range is ordered within one task.
RANGE_DOCS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size and target of each source of sized (source, size).

    Targets share all words by weight, capped at most times the source's size, the excess reshared by weight. Sources reach their
    cap in the order of cap / weight, so the final share of a unit of weight is the largest, over that order, of what is left
    beyond the capped ones for each unit of weight not yet capped. One row per source is all that meets in a window here.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    per = per.withColumn("unit", left / F.sum("weight").over(after))
    per = per.withColumn("unit", F.max("unit").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("unit") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string")))
    return F.md5(F.concat(named, F.lit(f":{seed}")).cast("binary"))


def digits_for(documents: int, per_range: int = RANGE_DOCS) -> int:
    """Leading hex digits of the key that make a range, so that a range holds about per_range documents even of one source."""
    digits = 1
    while 16**digits * per_range < documents and digits < 8:
        digits += 1
    return digits


def plan(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, per_range: int = RANGE_DOCS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of it, repeats counted) of each document."""
    return taken(_sized(docs, seed, per_range), weights, most).drop("key", "epochs", "last")


def _sized(docs: DataFrame, seed: str, per_range: int) -> DataFrame:
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = sized.withColumn("range", F.substring("key", 1, digits_for(docs.count(), per_range)))
    # Texts are read once for their sizes; the windows, sums and joins after that use this narrow table.
    return Scratch(docs.sparkSession, "mix").table(sized, "sized")


def _before(size: str, of: list[str], by: str) -> Column:
    """The sum of size over the rows before this one."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def taken(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The plan for sized documents (doc_id, source, size, key, range): theirs, and epochs (whole ones), last (words of the cut one) and taken."""
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = Scratch(sized.sparkSession, "ranges").table(ranges.withColumn("group", F.expr("substring(range, 1, length(range) div 2)")), "ranges")
    groups = ranges.groupBy("source", "group").agg(F.sum("range_size").alias("group_size"))
    groups = groups.select("source", "group", _before("group_size", ["source"], "group").alias("group_start"))
    goal = targets(ranges.select("source", F.col("range_size").alias("size")), weights, most).withColumnRenamed("source", "source_")
    goal = small(goal, ranges.select("source").distinct().count(), 512)
    groups = groups.join(goal, F.col("source").eqNullSafe(F.col("source_"))).withColumnRenamed("group", "group_").drop("source")
    starts = ranges.withColumn("range_start", _before("range_size", ["source", "group"], "range"))
    starts = starts.join(groups, F.col("source").eqNullSafe(F.col("source_")) & (F.col("group") == F.col("group_")))
    starts = starts.withColumn("range_start", F.col("range_start") + F.col("group_start")).drop("source_", "group_", "group", "group_start", "range_size")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = starts.withColumnRenamed("source", "source_").withColumnRenamed("range", "range_")
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("range") == F.col("range_"))).drop("source_", "range_")
    words = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size") - F.col("range_start") - F.col("inside")
    placed = placed.withColumn("epochs", epochs).withColumn("last", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("last")).drop("range_start", "inside", "range")


def apply_mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, per_range: int = RANGE_DOCS) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns; rows repeat.

    The document at a source's cut is taken whole if at least half of it is, so a source's words stay within half a document of its
    target. What the plan decides for a source is its number of whole epochs and the last key of the cut one: one row per source,
    which meets the texts without a shuffle of them. Rows alike in doc_id share a key and are taken alike.
    """
    planned = taken(_sized(docs, seed, per_range), weights, most)
    cut = F.max(F.when((F.col("last") * 2 >= F.col("size")) & (F.col("size") > 0), F.col("key")))
    cuts = planned.groupBy("source").agg(F.first("epochs").alias("epochs"), cut.alias("cut"))
    cuts = Scratch(docs.sparkSession, "mix").table(cuts.withColumnRenamed("source", "cut_source"), "cuts")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the plan's
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = docs.select(F.col("source").alias("s"), key_of(F.col("doc_id"), F.col("text"), seed).alias("k"), (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0).alias("any"), row.alias("row"))
    met = rows.join(small(cuts, cuts.count(), 512), F.col("s").eqNullSafe(F.col("cut_source")))
    times = F.when(F.col("any"), F.col("epochs") + F.coalesce((F.col("k") <= F.col("cut")).cast("long"), F.lit(0))).otherwise(0)
    return met.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*(F.col(f"row.{n}").alias(c) for c, n in names.items()))

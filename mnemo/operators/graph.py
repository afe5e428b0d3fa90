"""The bi-temporal edge graph: states and events of (subject, predicate) pairs over world time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T

KEY = ("container_tag", "subject", "predicate")


def folded(object_: Column) -> Column:
    """Case of ASCII letters aside."""
    return F.translate(object_, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def supersede(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new edges with is_latest, ids of stored edges they replace).

    An event replaces nothing and is latest. A state is not latest beside a stored latest state of the same object or a later one,
    and replaces the others, those as old as it included. New states of one batch are compared with each other by the same rule,
    in the order of valid_from and id.
    """
    order = F.row_number().over(Window.partitionBy(*KEY, "singular").orderBy(F.desc("valid_from"), F.desc("id")))
    ranked = new.withColumn("_place", order)
    old = stored.where(F.coalesce("is_latest", F.lit(True))).select(*KEY, F.col("id").alias("old_id"), folded(F.col("object")).alias("old_object"), F.col("valid_from").alias("old_from"))
    states = ranked.where("singular").select(*KEY, "id", folded(F.col("object")).alias("mine"), "valid_from")
    # What decides is an aggregate per pair and object, never the meeting of all new with all stored edges of a pair.
    newest = old.groupBy(*KEY).agg(F.max("old_from").alias("old_from"))
    known = old.select(*KEY, F.col("old_object").alias("mine")).distinct().withColumn("same", F.lit(True))
    met = states.join(newest, list(KEY)).join(known, [*KEY, "mine"], "left")
    beaten = met.where(F.coalesce("same", F.lit(False)) | (F.col("valid_from") < F.col("old_from"))).select("id").distinct().withColumn("_beaten", F.lit(True))
    per = states.groupBy(*KEY, "mine").agg(F.max("valid_from").alias("at"))
    first = per.groupBy(*KEY).agg(F.max(F.struct("at", "mine")).alias("top"))
    second = per.join(first, list(KEY)).where(F.col("mine") != F.col("top.mine")).groupBy(*KEY).agg(F.max("at").alias("next"))
    against = old.join(first, list(KEY)).join(second, list(KEY), "left")
    replaced = against.where(F.when(F.col("old_object") != F.col("top.mine"), F.col("top.at")).otherwise(F.col("next")) >= F.col("old_from")).select("old_id").distinct()
    latest = ~F.col("singular") | ((F.col("_place") == 1) & F.col("_beaten").isNull())
    return ranked.join(beaten, "id", "left").withColumn("is_latest", latest).drop("_place", "_beaten"), replaced


def resolve(edges: DataFrame, t: int) -> DataFrame:
    """Per pair: timeline (objects as they change, each with its first date), current and current_from at t, and singular."""
    w = Window.partitionBy(*KEY).orderBy("valid_from", "captured_at", "id")
    seen = edges.withColumn("before", F.lag(folded(F.col("object"))).over(w)).withColumn("place", F.row_number().over(w))
    changed = F.when(F.col("before").isNull() | (F.col("before") != folded(F.col("object"))), F.struct("place", "object", "valid_from"))
    per = seen.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(changed)).alias("changes"),
        F.max_by(F.struct("object", "valid_from"), F.when(F.col("valid_from") <= t, F.col("place"))).alias("now"),
        F.min_by(F.struct("object", "valid_from"), "place").alias("first"),
        F.max("singular").alias("singular"),
    )
    current = F.coalesce("now", "first")
    return per.select(*KEY, F.transform("changes", lambda c: F.struct(c["object"], c["valid_from"])).alias("timeline"), current["object"].alias("current"), current["valid_from"].alias("current_from"), "singular")


def rendered(resolved: DataFrame) -> DataFrame:
    """resolved with a line of text for each pair."""
    dated = lambda x: F.concat(x["object"], F.lit(" ("), F.from_unixtime(x["valid_from"], "yyyy-MM-dd"), F.lit(")"))
    since = F.from_unixtime("current_from", "yyyy-MM-dd")
    earlier = F.array_join(F.transform(F.filter("timeline", lambda x: folded(x["object"]) != folded(F.col("current"))), dated), ", ")
    pair = F.concat(F.lit("- "), "subject", F.lit(" "), "predicate")
    state = F.when(earlier == "", F.concat(pair, F.lit(": "), "current", F.lit(" (as of "), since, F.lit(")"))).otherwise(F.concat(pair, F.lit(": CURRENT = "), "current", F.lit(" (since "), since, F.lit("); earlier: "), earlier))
    event = F.concat(pair, F.lit(" over time: "), F.array_join(F.transform("timeline", dated), ", "), F.lit(" — most recent: "), "current", F.lit(" ("), since, F.lit(")"))
    return resolved.withColumn("line", F.when(F.col("singular"), state).otherwise(event))


def groups_of(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges of the pairs that have a hit."""
    return edges.join(hits.select(*KEY).distinct(), list(KEY), "left_semi")


def instances(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct objects, first kept, of the event pair with the best hit."""
    best = hits.where(~F.col("singular")).orderBy(F.desc("score"), *KEY).limit(1).select(*KEY)
    first = Window.partitionBy(*KEY, F.lower("object")).orderBy("valid_from", "id")
    return edges.where(~F.col("singular")).join(best, list(KEY), "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("valid_from", "id")


def instance_counts(edges: DataFrame) -> DataFrame:
    """instances of each pair: its distinct objects."""
    return edges.groupBy(*KEY).agg(F.count_distinct(F.lower("object")).alias("instances"))


def keyed(edges: DataFrame) -> DataFrame:
    """Edges with normalised subject and predicate and their statement."""
    out = edges.withColumn("subject", T.graph_key(F.col("subject"))).withColumn("predicate", T.graph_key(F.col("predicate")))
    return out.withColumn("statement", T.edge_statement(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")))

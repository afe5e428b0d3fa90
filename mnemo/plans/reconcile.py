"""Reconciliation: what new facts do to the stored memories of their namespace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import times
from mnemo.operators import memory
from mnemo.operators import predicates as P
from mnemo.operators import search as S
from mnemo.plans.providers import Judge, judged
from mnemo.sources.warehouse import Warehouse


#: Neighbours of a fact that are looked at to tell which documents of a batch depend on each other.
REACH = 20
#: Times that a demotion is tried. Fixed value.
TRIES = 3


def tried(step: Callable[[], None], tries: int = TRIES) -> None:
    """Runs a step again when it fails, so many times in all; the last failure is raised."""
    for left in reversed(range(tries)):
        try:
            return step()
        except Exception:
            if not left:
                raise


def decided(facts: DataFrame, memories: DataFrame, judge: Judge, now: int) -> DataFrame:
    """facts (id, container_tag, statement, embedding, ..) with action and target, the id of the memory it applies to.

    Neighbours are a fact's five nearest active memories of the namespace at 0.75 or above.
    """
    live = memories.where(P.active(now) & F.col("embedding").isNotNull()).withColumn("container_tag", F.coalesce("container_tag", F.lit(P.DEFAULT_TAG)))
    near = S.nearest(facts, live, S.NEIGHBOURS, P.FLOORS["reconcile"], id_="id").join(live.select("id", "statement"), "id")
    lists = near.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "statement"))).alias("near"))
    met = facts.join(lists, "id", "left")
    verdict = met.withColumn("v", judged(F.col("statement"), F.transform("near", lambda n: n["statement"]), judge))
    acted = verdict.withColumn("a", memory.action(F.col("v.relation"), F.col("v.confidence"), F.col("v.ref"), F.coalesce(F.array_size("near"), F.lit(0))))
    return acted.withColumn("action", F.col("a.action")).withColumn("target", F.get("near", F.col("a.ref") - 1)["id"]).drop("near", "v", "a")


def index_memories(warehouse: Warehouse, facts: DataFrame, judge: Judge, now: int) -> None:
    """Stores facts (id, container_tag, statement, kind, confidence, document_id, embedding) as their verdicts say.

    Verdicts are asked once and written down. Facts that replace nothing go first, then the replaced memories are demoted, and only
    when that has succeeded the replacing facts follow: an old and a new memory are never both latest. Of several facts of one batch
    that replace the same memory the last id stays latest and the others count as replaced by it.
    """
    text, until = times.expiry(F.col("statement"))
    dated = facts.withColumn("valid_until", until).withColumn("statement", text)
    staged = warehouse.stage(decided(dated, warehouse.current("memories"), judge, now).where("action <> 'drop'"))
    rows = warehouse.spark.read.parquet(staged).withColumns({
        "is_latest": F.lit(True), "needs_review": F.col("action") == "needs_review", "supersedes": F.when(F.col("action") == "update", F.col("target")),
        "extends": F.when(F.col("action") == "extend", F.col("target")), "learned_at": F.lit(now), "created_at": F.lit(now),
    })
    warehouse.insert("memories", rows.where("action <> 'update'"))
    heir = F.last("id").over(Window.partitionBy("target").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    updates = rows.where("action = 'update'").withColumn("heir", heir)
    pairs = updates.select(F.col("target").alias("old_id"), F.col("heir").alias("new_id"), F.col("heir").alias("seq"))
    old = warehouse.current("memories").join(pairs.select(F.col("old_id").alias("id")).distinct(), "id", "left_semi")
    # Versions of a row alike in everything are one row, so a demotion that failed halfway may be written again.
    tried(lambda: warehouse.write("memories", memory.superseded(old, pairs, now)))
    beaten = F.col("id") != F.col("heir")
    warehouse.insert("memories", updates.withColumns({"is_latest": ~beaten, "superseded_by": F.when(beaten, F.col("heir")), "superseded_at": F.when(beaten, F.lit(now))}))
    warehouse.remove(staged)


def dependencies(facts: DataFrame, order: DataFrame, memories: DataFrame, now: int, reach: int = REACH) -> DataFrame:
    """early and late: documents of a batch of which the later must see what the earlier has done to the memories.

    facts are the batch's, order is (document_id, container_tag, captured_at) of its documents. Documents depend on each other if facts
    of theirs are near each other, or near the same stored memory, of which the earlier may leave another state. A fact with as many
    neighbours as are looked at may have more of them: all documents of its namespace then depend on the one before.
    """
    tag = F.coalesce("container_tag", F.lit(P.DEFAULT_TAG)).alias("container_tag")
    mine = facts.where(F.col("embedding").isNotNull()).select("id", tag, "embedding", "document_id")
    live = memories.where(P.active(now) & F.col("embedding").isNotNull()).select("id", tag, "embedding")
    of = mine.select(F.col("id").alias("query_id"), F.col("document_id").alias("document"))
    within = S.nearest(mine, mine, reach, P.FLOORS["reconcile"], id_="id").join(of, "query_id")
    stored = S.nearest(mine, live, reach, P.FLOORS["reconcile"], id_="id").join(of, "query_id")
    place = order.select(F.col("document_id").alias("document"), tag, F.struct("captured_at", "document_id").alias("at"))
    pairs = within.select("document", "id").join(of.select(F.col("query_id").alias("id"), F.col("document").alias("other")), "id").where("document <> other").select("document", "other").distinct()
    other = place.select(F.col("document").alias("other"), F.col("at").alias("other_at"))
    pairs = pairs.join(place, "document").join(other, "other").select(F.least("at", "other_at")["document_id"].alias("early"), F.greatest("at", "other_at")["document_id"].alias("late"))

    def chained(rows: DataFrame, by: str) -> DataFrame:
        """Each document after the one before it that shares by: what depends on all of them waits for the last."""
        before = F.lag("document").over(Window.partitionBy(by).orderBy("at"))
        return rows.withColumn("early", before).where("early is not null").select("early", F.col("document").alias("late"))

    same = chained(stored.select("document", "id").distinct().join(place, "document"), "id")
    crowded = within.unionByName(stored).where(F.col("rank") >= reach).select("document").join(place.select("document", "container_tag"), "document").select("container_tag").distinct()
    return pairs.unionByName(same).unionByName(chained(place.join(crowded, "container_tag", "left_semi"), "container_tag")).distinct()


def in_order(warehouse: Warehouse, facts: DataFrame, order: DataFrame, judge: Judge, now: int, reach: int = REACH) -> int:
    """index_memories for facts of several documents as if these had come one by one; returns in how many rounds.

    A round takes all documents that depend on none still waiting, so documents that have nothing to do with each other go together,
    and only a chain of documents about the same things takes a round each. facts is read several times: a written table.
    """
    read, staged = warehouse.spark.read.parquet, []

    def keep(df: DataFrame) -> DataFrame:
        staged.append(warehouse.stage(df))
        return read(staged[-1])

    waiting = keep(facts.select("document_id").distinct())
    if waiting.count() < 2:  # nothing to wait for
        index_memories(warehouse, facts, judge, now)
        warehouse.remove(staged[0])
        return 1
    order = order.join(waiting, "document_id", "left_semi")
    pairs = keep(dependencies(facts, order, warehouse.current("memories"), now, reach))
    rounds = 0
    while waiting.limit(1).count():
        ready = keep(waiting.join(pairs.select(F.col("late").alias("document_id")), "document_id", "left_anti"))
        index_memories(warehouse, facts.join(ready, "document_id", "left_semi"), judge, now)
        waiting = keep(waiting.join(ready, "document_id", "left_anti"))
        pairs = keep(pairs.join(ready.withColumnRenamed("document_id", "early"), "early", "left_anti"))
        rounds += 1
    for path in staged:
        warehouse.remove(path)
    return rounds

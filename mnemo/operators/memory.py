"""Memories: what a new fact does to stored ones, and reads of the current and past state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.operators import predicates as P


def action(relation: Column, confidence: Column, ref: Column, neighbours: Column) -> Column:
    """struct(action, ref) for a verdict on a fact with so many neighbours: ref counts from 1, anything else is no reference."""
    target = F.when((ref >= 1) & (ref <= neighbours), ref)
    high = confidence == "high"
    name = (
        F.when((relation == "UPDATE") & high & target.isNotNull(), "update").when(relation == "UPDATE", "needs_review")
        .when((relation == "DUPLICATE") & high, "drop").when((relation == "EXTEND") & target.isNotNull(), "extend").otherwise("new")
    )
    return F.struct(name.alias("action"), F.when(name.isin("update", "extend"), target).alias("ref"))


def distinct_statements(facts: DataFrame, cap: int, by: list[str], order: str = "seq") -> DataFrame:
    """The first of statements that are alike but for case and edges, within by, and at most cap of them in order."""
    key = F.lower(F.trim("statement"))
    first = facts.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy(order))).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_n") <= cap).drop("_n")


def superseded(memories: DataFrame, pairs: DataFrame, at: int) -> DataFrame:
    """memories with those in pairs (old_id, new_id, seq) demoted; of several pairs for one memory the last counts."""
    last = pairs.groupBy(F.col("old_id").alias("id")).agg(F.max_by("new_id", "seq").alias("by"))
    met = memories.join(last, "id", "left")
    hit = F.col("by").isNotNull()
    return (
        met.withColumn("is_latest", F.when(hit, False).otherwise(F.col("is_latest"))).withColumn("superseded_by", F.coalesce("by", "superseded_by"))
        .withColumn("superseded_at", F.when(hit, F.lit(at)).otherwise(F.col("superseded_at"))).drop("by")
    )


def as_of(memories: DataFrame, tag: str, t: int, limit: int = 200) -> DataFrame:
    """What was known in a namespace at t, newest first."""
    return memories.where(P.in_tag(tag) & P.as_of(t)).orderBy(F.desc("learned_at"), "id").limit(limit)


def provenance(statements: DataFrame, memories: DataFrame, evidence: DataFrame, scopes: list[str]) -> DataFrame:
    """statement, kind, confidence and evidence (quotes in order) of the latest memories that say the statements in visible scopes."""
    met = memories.where(P.in_scopes(scopes) & F.coalesce("is_latest", F.lit(True))).join(statements.select("statement").distinct(), "statement", "left_semi")
    quotes = evidence.join(met.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("id", "quote", "document_id", "chunk_id"))).alias("evidence"))
    return met.join(quotes, met["id"] == quotes["memory_id"], "left").select("statement", "kind", "confidence", "evidence")


def evidence_spans(facts: DataFrame, chunks: DataFrame, least: int = 8) -> DataFrame:
    """fact_id, chunk_index, char_start and char_end of each fact's trimmed quote in the first chunk of its document that holds it."""
    quoted = facts.select("fact_id", "doc_id", F.trim("evidence").alias("quote")).where(F.length("quote") >= least)
    met = quoted.join(chunks, "doc_id").withColumn("at", F.expr("instr(content, quote)")).where("at > 0")
    first = met.groupBy("fact_id").agg(F.min(F.struct("chunk_index", "at", F.length("quote").alias("n"))).alias("f"))
    return first.select("fact_id", "f.chunk_index", (F.col("f.at") - 1).alias("char_start"), (F.col("f.at") - 1 + F.col("f.n")).alias("char_end"))


def absent(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """The first of new rows per key that the stored table doesn't have."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def forgotten(memories: DataFrame, evidence: DataFrame, tag: str, id_: str) -> tuple[DataFrame, DataFrame]:
    """Memories and evidence without one memory, if the namespace owns it."""
    gone = memories.where((F.col("id") == id_) & P.in_tag(tag)).select("id")
    return memories.join(gone, "id", "left_anti"), evidence.join(gone.withColumnRenamed("id", "memory_id"), "memory_id", "left_anti")


def without_document(frames: dict[str, DataFrame], tag: str, document: str) -> dict[str, DataFrame]:
    """Tables without the rows of a document in a namespace, by each table's own column for it."""
    column = {"documents": "id"}
    return {name: df.where(P.unless((F.col(column.get(name, "document_id")) == document) & (P.in_tag(tag) if "container_tag" in df.columns else F.lit(True)))) for name, df in frames.items()}


def promoted(memories: DataFrame, tag: str, id_: str, to: str, new_id: str, now: int) -> DataFrame:
    """The copy of a memory for a shared scope: it extends its original, is latest and not under review."""
    own = memories.where((F.col("id") == id_) & P.in_tag(tag))
    return own.withColumns({"extends": F.col("id"), "container_tag": F.lit(to), "is_latest": F.lit(True), "needs_review": F.lit(False), "created_at": F.lit(now), "id": F.lit(new_id)})


def claimed(rows: DataFrame, tag: str) -> DataFrame:
    return rows.withColumn("container_tag", F.coalesce("container_tag", F.lit(tag)))


def latest_filled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_latest", F.coalesce("is_latest", F.lit(True)))


def profile(memories: DataFrame, now: int, durable: tuple[str, ...] = ("preference", "personal_fact", "policy", "relationship"), recent_days: int = 7, most_durable: int = 250, most_recent: int = 80) -> DataFrame:
    """static_text and dynamic_text per namespace: durable facts, and those learned in the last days, newest first, active ones only."""
    live = memories.where(P.active(now)).withColumn("container_tag", F.coalesce("container_tag", F.lit(P.DEFAULT_TAG)))
    newest = Window.partitionBy("container_tag", "part").orderBy(F.desc("learned_at"), "id")
    part = F.explode(F.filter(F.array(F.when(F.col("kind").isin(*durable), "static"), F.when(F.col("learned_at") >= now - recent_days * 86_400, "dynamic")), lambda p: p.isNotNull()))
    ranked = live.withColumn("part", part).withColumn("n", F.row_number().over(newest))
    ranked = ranked.where(F.col("n") <= F.when(F.col("part") == "static", most_durable).otherwise(most_recent))
    lines = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("n", "statement")))), lambda x: x["statement"]), "\n")
    return ranked.groupBy("container_tag").agg(lines("static").alias("static_text"), lines("dynamic").alias("dynamic_text"))


def map_edges(facts: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type) and edges (from, to) of facts and the documents they come from."""
    nodes = facts.select("id", F.col("statement").alias("label"), F.lit("fact").alias("type")).unionByName(documents.join(facts.select(F.col("document_id").alias("id")), "id", "left_semi").select("id", F.col("title").alias("label"), F.lit("document").alias("type")))
    return nodes, facts.where("document_id is not null").select(F.col("id").alias("from"), F.col("document_id").alias("to"))


def timeline(documents: DataFrame, tag: str, before: int | None = None, limit: int = 60, source: str | None = None) -> DataFrame:
    """A namespace's documents, newest first, those captured before a time alone."""
    rows = documents.where(P.in_tag(tag))
    rows = rows if before is None else rows.where(F.col("captured_at") < before)
    rows = rows if source is None else rows.where(F.col("source") == source)
    return rows.orderBy(F.desc("captured_at"), "id").limit(limit)


def events_of(events: DataFrame, tag: str, limit: int) -> DataFrame:
    """A namespace's audit events, newest first."""
    return events.where(F.col("container_tag") == tag).orderBy(F.desc("ts"), "id").limit(limit)


def event_counts(events: DataFrame) -> DataFrame:
    """n and newest of the audit events of each namespace."""
    return events.groupBy("container_tag").agg(F.count("*").alias("n"), F.max("ts").alias("newest"))

"""Maintenance: backfill, rebuild, distilling anew, claiming of untagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import memory
from mnemo.operators import predicates as P
from mnemo.plans.ingest import facts_of
from mnemo.plans.providers import Distiller, Embedder, HashedWords, Judge, Merger, Sentences, embedded
from mnemo.plans.reconcile import index_memories
from mnemo.sources.warehouse import Warehouse

#: Stored texts below this aren't distilled anew. Fixed value.
LEAST_STORED = 200


def backfill(warehouse: Warehouse, tag: str, chunks: DataFrame, facts: DataFrame, now: int) -> dict[str, int]:
    """Adds what an older index of a namespace holds and the tables lack; counts of rows added. A second run adds nothing.

    chunks: id, doc_id, title, source, reference, captured_at, container_tag, chunk_index, content, embedding;
    facts: id, doc_id, fact, kind, container_tag, captured_at, is_latest, valid_until, embedding. The kind "fact" becomes "unknown".
    """
    own, said = chunks.where(P.in_tag(tag)), facts.where(P.in_tag(tag))
    first = own.groupBy("doc_id").agg(F.min(F.struct("chunk_index", "id", "title", "source", "reference", "captured_at")).alias("f"))
    documents = first.select(F.col("doc_id").alias("id"), F.lit(tag).alias("container_tag"), "f.title", "f.source", "f.reference", "f.captured_at", F.lit("done").alias("processing_state"), F.lit(now).alias("created_at"))
    parts = own.withColumn("document_id", F.col("doc_id")).withColumn("container_tag", F.lit(tag)).withColumn("dim", F.size("embedding"))
    memories = memory.latest_filled(said).select(
        "id", F.lit(tag).alias("container_tag"), F.when(F.coalesce("kind", F.lit("fact")) == "fact", "unknown").otherwise(F.col("kind")).alias("kind"), F.col("fact").alias("statement"), "is_latest", F.lit(False).alias("needs_review"),
        "valid_until", F.col("captured_at").alias("learned_at"), F.col("doc_id").alias("document_id"), F.lit(now).alias("created_at"), "embedding",
    )
    added = {}
    for name, rows in {"documents": documents, "chunks": parts, "memories": memories}.items():
        new = memory.absent(rows, warehouse.current(name))
        added[name] = new.count()
        if added[name]:
            warehouse.write(name, new)
    return added


def rebuild(warehouse: Warehouse, tag: str, embedder: Embedder | None = None) -> dict[str, int]:
    """Computes all vectors of a namespace anew, under the same ids; counts of rows."""
    embedder, counts = embedder or HashedWords(), {}
    titles = warehouse.current("documents", "title").withColumnRenamed("id", "document_id")
    chunks = warehouse.current("chunks").where(P.in_tag(tag)).join(titles, "document_id", "left")
    rows = {
        "chunks": chunks.withColumn("embedding", embedded(T.embed_input(F.col("title"), F.col("content")), embedder)).withColumn("dim", F.lit(embedder.dim)),
        "memories": warehouse.current("memories").where(P.in_tag(tag)).withColumn("embedding", embedded(F.col("statement"), embedder)),
        "edges": warehouse.current("edges").where(P.in_tag(tag)).withColumn("embedding", embedded(F.col("statement"), embedder)),
    }
    for name, df in rows.items():
        counts[name] = warehouse.current(name).where(P.in_tag(tag)).count()
        if counts[name]:
            warehouse.write(name, df)
    return counts


def redistil(warehouse: Warehouse, tag: str, now: int, judge: Judge, distiller: Distiller | None = None, embedder: Embedder | None = None, least: int = LEAST_STORED, merger: Merger | None = None) -> None:
    """Replaces the facts of a namespace's documents by those of their stored texts; other namespaces keep theirs.

    Texts are chunks in order, set off by blank lines. The new facts are extracted and written down before the old ones go.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    texts = warehouse.current("chunks").where(P.in_tag(tag)).groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))
    docs = texts.where(F.length("content") >= least).withColumn("container_tag", F.lit(tag))
    read, phases = warehouse.spark.read.parquet, []

    def kept_rows(df: DataFrame) -> DataFrame:
        phases.append(warehouse.stage(df))
        return read(phases[-1])

    facts, evidence = facts_of(docs, distiller or Sentences(), embedder or HashedWords(), kept_rows, f"r{now}", least, merger)
    staged, quotes = warehouse.stage(facts), warehouse.stage(evidence)
    redone = warehouse.stage(docs.select("id"))
    old = warehouse.current("memories").where(P.in_tag(tag)).join(read(redone).withColumnRenamed("id", "document_id"), "document_id", "left_semi")
    old = old.join(read(staged).select("id"), "id", "left_anti")
    gone = warehouse.stage(old)
    warehouse.write("memory_evidence", warehouse.current("memory_evidence").join(read(gone).select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), deleted=True)
    warehouse.write("memories", read(gone), deleted=True)
    index_memories(warehouse, read(staged), judge, now)
    warehouse.insert("memory_evidence", read(quotes).join(warehouse.current("memories").select(F.col("id").alias("memory_id")), "memory_id", "left_semi"))
    for path in (*phases, staged, quotes, redone, gone):
        warehouse.remove(path)


def claim(warehouse: Warehouse, tag: str) -> None:
    """Puts rows without a namespace into tag."""
    for name in ("documents", "chunks", "memories", "edges"):
        warehouse.write(name, memory.claimed(warehouse.current(name).where("container_tag is null"), tag))


def fill_latest(warehouse: Warehouse) -> None:
    warehouse.write("memories", memory.latest_filled(warehouse.current("memories").where("is_latest is null")))

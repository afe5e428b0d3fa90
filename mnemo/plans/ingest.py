"""Ingest: documents to stored chunks and facts. One narrow job up to the dedup; nothing of it is collected."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.functions.urls import canonical_url
from mnemo.operators import chunking
from mnemo.operators.memory import absent, evidence_spans
from mnemo.plans.edges import edges_of, index_edges
from mnemo.plans.providers import Distiller, EdgeExtractor, Embedder, HashedWords, Judge, Merger, Sentences, embedded
from mnemo.plans.facts import document_facts
from mnemo.plans.reconcile import in_order
from mnemo.plans.retrieve import chunk_indexes
from mnemo.sources.warehouse import Warehouse

#: Shorter documents aren't distilled. Fixed value.
LEAST_DISTILLED = 280


def prepared(docs: DataFrame) -> DataFrame:
    """docs without credentials, with the content_hash of their whole text and canonical_url."""
    clean = docs.withColumn("content", T.scrub(F.col("content")))
    return clean.withColumn("content_hash", F.sha2("content", 256)).withColumn("canonical_url", canonical_url("reference"))


def fresh(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """The first of docs per namespace and hash, and per namespace and URL, that stored has neither of."""
    by_hash = Window.partitionBy("container_tag", "content_hash").orderBy("captured_at", "id")
    # Most documents may have no URL: each is a group of its own then, not one of a group of nulls.
    by_url = Window.partitionBy("container_tag", F.coalesce("canonical_url", F.concat(F.lit("id:"), "id"))).orderBy("captured_at", "id")
    first = docs.withColumn("_n", F.row_number().over(by_hash)).where("_n = 1").withColumn("_n", F.row_number().over(by_url)).where("_n = 1").drop("_n")
    return first.join(stored.select("container_tag", "content_hash"), ["container_tag", "content_hash"], "left_anti").join(stored.select("container_tag", "canonical_url").where("canonical_url is not null"), ["container_tag", "canonical_url"], "left_anti")


def facts_of(docs: DataFrame, distiller: Distiller, embedder: Embedder, stage: Callable[[DataFrame], DataFrame], mark: str = "m", least: int = LEAST_DISTILLED, merger: Merger | None = None) -> tuple[DataFrame, DataFrame]:
    """Facts with vectors and their evidence from documents (id, container_tag, content); ids are of document, mark and place."""
    found = document_facts(docs.where(F.length("content") >= least), distiller, stage, merger)
    found = found.select("id", "container_tag", "place", F.struct("statement", "kind", "confidence", "evidence").alias("f"))
    fact_id = F.concat_ws("-", "id", F.lit(mark), "place")
    facts = found.select(fact_id.alias("id"), "container_tag", "f.statement", "f.kind", "f.confidence", F.col("id").alias("document_id"), embedded(F.col("f.statement"), embedder).alias("embedding"))
    evidence = found.where("f.evidence is not null").select(F.concat_ws("-", "id", F.lit("e" if mark == "m" else f"{mark}e"), "place").alias("id"), fact_id.alias("memory_id"), F.col("id").alias("document_id"), F.col("f.evidence").alias("quote"))
    return facts, evidence


def fact_key(statements: Column) -> Column:
    """The first statements of a document in at most 600 characters, as context for its chunks' vectors."""
    return F.nullif(F.substring(F.array_join(F.slice(statements, 1, 8), "; "), 1, 600), F.lit(""))


def described(title: Column, content: Column, describe: Callable[[str, str], str | None]) -> Column:
    """A line about each document, or null; a call to each."""

    @F.pandas_udf("string")
    def run(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([describe(t or "", c or "") for t, c in zip(titles, contents, strict=True)], dtype=object)

    return run(title, content)


def spanned(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence with chunk_id, char_start and char_end of its quote in the first of its document's chunks that holds it, where one does."""
    quotes = evidence.select(F.col("id").alias("fact_id"), F.col("document_id").alias("doc_id"), F.col("quote").alias("evidence"))
    own = chunks.join(evidence.select("document_id").distinct(), "document_id", "left_semi").select(F.col("document_id").alias("doc_id"), "chunk_index", "content")
    found = evidence_spans(quotes, own).withColumnRenamed("fact_id", "id")
    return evidence.join(found, "id", "left").withColumn("chunk_id", F.when(F.col("chunk_index").isNotNull(), F.concat_ws("-", "document_id", "chunk_index"))).drop("chunk_index")


def ingest(
    warehouse: Warehouse, docs: DataFrame, now: int, embedder: Embedder | None = None, distiller: Distiller | None = None, judge: Judge | None = None, extractor: EdgeExtractor | None = None, fact_keys: bool = False, least: int = LEAST_DISTILLED, indexed: bool = False,
    distill: bool = True, smart: bool = True, describe: Callable[[str, str], str | None] | None = None, merger: Merger | None = None,
) -> None:
    """Stores what is new of docs: documents, chunks with vectors, facts with evidence, and edges if there is an extractor.

    With a judge, facts are reconciled with the memories of their namespace, those of earlier documents of the batch included, else
    they are added; without distill there are none. With fact_keys, chunks are embedded beside the document's facts, with describe
    (of title and content) beside a line about it. A merger unites the facts of a document's segments. smart: chunkers by the kind of text. indexed: the new chunks are added to the warehouse's indexes, which build_indexes has made.
    """
    embedder, distiller = embedder or HashedWords(), distiller or Sentences()
    new = fresh(prepared(docs), warehouse.current("documents"))
    rows = new.withColumn("processing_state", F.lit("done")).withColumn("created_at", F.lit(now))
    read, staged = warehouse.spark.read.parquet, []

    def kept_rows(df: DataFrame) -> DataFrame:
        staged.append(warehouse.stage(df))
        return read(staged[-1])

    facts, evidence = facts_of(new if distill else new.limit(0), distiller, embedder, kept_rows, least=least, merger=merger)
    facts, evidence = (warehouse.stage(df) for df in (facts, evidence))
    ids = new.select("id", "container_tag", "title")
    if fact_keys:
        said = read(facts).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.substring_index("id", "-", -1).cast("int").alias("place"), "statement"))).alias("s"))
        ids = ids.join(said.select("id", fact_key(F.transform("s", lambda x: x["statement"])).alias("context")), "id", "left")
    if describe is not None:
        lines = warehouse.stage(new.select("id", described(F.col("title"), F.col("content"), describe).alias("line")))
        before = [F.col("context")] if fact_keys else []
        ids = ids.join(read(lines), "id", "left").withColumn("context", F.nullif(F.concat_ws("\n", "line", *before), F.lit(""))).drop("line")
    context = F.col("context") if fact_keys or describe is not None else None
    parts = chunking.chunks(new, smart).join(ids, "id")
    chunks = parts.select(
        F.concat_ws("-", "id", "chunk_index").alias("id"), F.col("id").alias("document_id"), "container_tag", "chunk_index", "content",
        F.lit(embedder.dim).alias("dim"), embedded(T.embed_input(F.col("title"), F.col("content"), context), embedder).alias("embedding"),
    )
    # Documents go last: until then a failed run is repeated whole, and inserts skip what it had written.
    if indexed:
        added = warehouse.stage(absent(chunks, warehouse.current("chunks", "document_id")))
        warehouse.insert("chunks", read(added))
        for index in chunk_indexes(warehouse):
            index.add(read(added))
        warehouse.remove(added)
    else:
        warehouse.insert("chunks", chunks)
    if judge is None:
        known = {"is_latest": F.lit(True), "needs_review": F.lit(False), "learned_at": F.lit(now), "created_at": F.lit(now)}
        warehouse.insert("memories", read(facts).withColumns(known))
    else:
        in_order(warehouse, read(facts), new.select(F.col("id").alias("document_id"), "container_tag", "captured_at"), judge, now)
    kept = warehouse.current("memories").select(F.col("id").alias("memory_id"))
    quoted = read(evidence).join(kept, "memory_id", "left_semi")
    warehouse.insert("memory_evidence", spanned(quoted, warehouse.current("chunks", "document_id", "chunk_index", "content")))
    if extractor is not None:
        index_edges(warehouse, edges_of(new, extractor), embedder)
    warehouse.insert("documents", rows)
    for path in (*staged, facts, evidence, *([lines] if describe is not None else [])):
        warehouse.remove(path)

"""The edge graph's jobs: extraction and storage, resolution for a question, counting of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.functions import times
from mnemo.operators import graph
from mnemo.operators import predicates as P
from mnemo.operators import search as S
from mnemo.plans.providers import EdgeExtractor, Embedder, HashedWords, embedded, extracted_edges
from mnemo.sources.warehouse import Warehouse

#: Shorter documents have no edges extracted. Fixed value.
LEAST_TEXT = 280


def edges_of(docs: DataFrame, extractor: EdgeExtractor, least: int = LEAST_TEXT) -> DataFrame:
    """Edges of documents (id, container_tag, captured_at, content), keyed and with their statement; a day counts from its start."""
    long = docs.where(F.length("content") >= least)
    found = extracted_edges(T.head(F.col("content"), "graph"), times.date_text(F.col("captured_at")), extractor)
    each = long.select("id", "container_tag", "captured_at", F.posexplode(found).alias("place", "e"))
    rows = each.select(
        F.concat_ws("-", "id", F.lit("g"), "place").alias("id"), "container_tag", "e.subject", "e.predicate", "e.object",
        F.coalesce(times.day_start(F.col("e.date")), "captured_at").alias("valid_from"), "e.singular", "captured_at", F.col("id").alias("document_id"),
    )
    return graph.keyed(rows)


def index_edges(warehouse: Warehouse, edges: DataFrame, embedder: Embedder | None = None) -> None:
    """Stores edges that aren't there yet; states that they replace are demoted first."""
    fresh = edges.join(warehouse.current("edges", "is_latest").select("id"), "id", "left_anti")
    new, replaced = graph.supersede(fresh, warehouse.current("edges"))
    staged = warehouse.stage(new.withColumn("embedding", embedded(F.col("statement"), embedder or HashedWords())))
    gone = warehouse.stage(replaced)
    old = warehouse.current("edges").join(warehouse.spark.read.parquet(gone).withColumnRenamed("old_id", "id"), "id", "left_semi")
    warehouse.write("edges", old.withColumn("is_latest", F.lit(False)))
    warehouse.insert("edges", warehouse.spark.read.parquet(staged))
    warehouse.remove(staged)
    warehouse.remove(gone)


def _hits(edges: DataFrame, question: str, floor: float, limit: int, embedder: Embedder | None) -> DataFrame:
    return S.dense(edges, (embedder or HashedWords()).embed([question])[0], limit, floor, id_="id")


def resolved_for(edges: DataFrame, tag: str, question: str, t: int, limit: int = 20, embedder: Embedder | None = None) -> DataFrame:
    """The pairs that a question's nearest edges belong to, as of t, each with a line of text; timelines are of all their edges."""
    own = edges.where(P.in_tag(tag))
    return graph.rendered(graph.resolve(graph.groups_of(_hits(own, question, P.FLOORS["edges"], limit, embedder), own), t))


def instances_for(edges: DataFrame, tag: str, question: str, limit: int = 20, embedder: Embedder | None = None) -> DataFrame:
    """The distinct events of the question's best pair of events."""
    own = edges.where(P.in_tag(tag))
    return graph.instances(_hits(own, question, P.FLOORS["events"], limit, embedder), own)


def latest(edges: DataFrame, tag: str, most: int = 2000) -> DataFrame:
    return edges.where(P.in_tag(tag) & F.coalesce("is_latest", F.lit(True))).orderBy(F.desc("valid_from"), "id").limit(most)

"""What a flag does to retrieval: the same documents indexed twice, one flag apart, asked the same golden questions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators import evaluate
from mnemo.operators import predicates as P
from mnemo.operators import search as S
from mnemo.plans.engine import Engine
from mnemo.plans.providers import Embedder, HashedWords, embedded
from mnemo.plans.services import Config, Transport, over_http
from mnemo.sources.warehouse import Warehouse

#: Flags that can be compared; the first two change what is stored, the last how it is searched.
FLAGS = ("smart_chunking", "contextual", "hybrid_search")


def documents_for(chunks: DataFrame, questions: DataFrame, documents: int = S.DOCUMENTS, embedder: Embedder | None = None, hybrid_search: bool = False, hits: int = S.HITS, floor: float = P.FLOORS["chunks"]) -> DataFrame:
    """query_id, doc_id and rank: the documents of many questions (query_id, query) in chunks (id, doc_id, content, embedding), in one job.

    Every question meets every chunk once. With hybrid_search hits are those of fused dense and sparse ranks and no floor applies. A
    question without words or hits has no row; null questions and chunks without a vector are left out.
    """
    embedder = embedder or HashedWords()
    asked = questions.where("query is not null").select(F.lit("").alias("tag"), F.col("query_id").alias("id"), "query", embedded(F.col("query"), embedder).alias("embedding"))
    # Ids of questions are told from those of chunks, as nearest passes over what is alike in id.
    asked = asked.withColumn("id", F.struct(F.lit(0).alias("side"), F.col("id").cast("string").alias("id")))
    rows = chunks.where("embedding is not null").select(F.lit("").alias("tag"), F.struct(F.lit(1).alias("side"), F.col("id").cast("string").alias("id")).alias("id"), "embedding")
    most = max(2 * hits, 40) if hybrid_search else hits
    near = S.nearest(asked, rows, most, -1.0 if hybrid_search else floor, "tag", "id")
    found = near.select(F.col("query_id.id").alias("query_id"), F.col("id.id").alias("id"), "rank")
    if hybrid_search:
        words = S.term_frequencies(questions.where("query is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("query").alias("text")), "query_id")
        tf = S.asked_frequencies(chunks.withColumn("id", F.col("id").cast("string")), words, "id", "content")
        sparse = S.sparse(tf, S.idf(tf, chunks.count()), words, most, "id").select("query_id", "id", "rank")
        found = S.placed(S.fuse([found, sparse], ["query_id", "id"])).where(F.col("rank") <= hits)
    return S.documents_of(found.join(chunks.select(F.col("id").cast("string").alias("id"), "doc_id"), "id"), documents)


def measured(warehouse: Warehouse, golden: DataFrame, embedder: Embedder | None = None, hybrid_search: bool = False, most: int = 10) -> DataFrame:
    """The hit rates of golden questions (query_id, query, doc_id, title) on a warehouse, as one row."""
    titles = warehouse.current("documents", "title").select(F.col("id").alias("doc_id"), "title")
    chunks = warehouse.current("chunks", "document_id", "content", "embedding").withColumnRenamed("document_id", "doc_id")
    asked = golden.select(F.col("query_id").cast("string").alias("query_id"), "query", "doc_id", "title")
    results = documents_for(chunks, asked, most, embedder, hybrid_search).join(titles, "doc_id")
    return evaluate.hit_rates(evaluate.ranks(asked, results, most))


def compared(spark: SparkSession, root: str, docs: DataFrame, golden: DataFrame, flag: str, now: int, config: Config = Config(), post: Transport = over_http) -> DataFrame:
    """The hit rates without and with a flag side by side, with their differences: one row.

    docs are written down once under root and indexed from there into two warehouses that differ in the flag alone, without distilling;
    a flag that only changes the search is measured on one. The files stay until the caller removes root, as the row is read from them.
    """
    if flag not in FLAGS:
        raise ValueError(f"{flag!r} is none of {', '.join(FLAGS)}")
    snapshot = Warehouse(spark, f"{root}/snapshot").stage(docs)
    built: dict[str, Engine] = {}

    def run(on: bool) -> DataFrame:
        chosen = replace(config, distill=False, **{flag: on})
        side = "one" if flag == "hybrid_search" else ("on" if on else "off")
        if side not in built:
            built[side] = Engine(Warehouse(spark, f"{root}/{side}"), chosen, post)
            built[side].ingest(spark.read.parquet(snapshot), now)
        engine = built[side]
        return measured(engine.warehouse, golden, engine.questions, chosen.hybrid_search)

    return evaluate.compared(run, flag)

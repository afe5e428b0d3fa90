"""Retrieval: a planned, scoped search over chunks, grouped by document and reranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import predicates as P
from mnemo.operators import search as S
from mnemo.operators.cells import Cells
from mnemo.operators.memory import provenance
from mnemo.operators.postings import Postings
from mnemo.plans.providers import Embedder, HashedWords, Reranker
from mnemo.sources.warehouse import Warehouse


def retrieve(chunks: DataFrame, plan: P.Plan, scopes: list[str], limit: int = 8, embedder: Embedder | None = None, question: str | None = None, relevance: Column | None = None, reranker: Reranker | None = None, hybrid_search: bool = False, cells: Cells | None = None, probes: int | None = None, words: Postings | None = None) -> DataFrame:
    """Documents for a plan: hits of its query and, if it differs, of the question; without any, once more without constraints.

    With cells, a stored index of the chunks' vectors, vectors are searched there (exactly, or in so many probes), with words, an
    inverted index of their contents, words are; without them every visible chunk is scored.

    With hybrid_search hits are those of fused ranks and no floor applies. A reranker's, or a given column's, relevance orders documents.
    """
    embedder = embedder or HashedWords()
    hits, limit = (S.LISTY_HITS, max(limit, 20)) if plan.listy else (S.HITS, limit)
    visible = chunks.where(P.in_scopes(scopes))
    asked = list(dict.fromkeys(q.strip() for q in (plan.query, question or plan.query)))
    vectors = embedder.embed(asked)

    def search(where: Column, floor: float) -> DataFrame:
        best = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
        if hybrid_search:
            return S.first_of([hybrid(visible, q, hits, where, embedder, cells, probes, words).withColumn("hit_pos", best) for q in asked])
        return S.first_of([dense(visible, v, hits, floor, where, cells, probes).withColumn("hit_pos", best) for v in vectors])

    found = search(P.planned(plan), P.FLOORS["chunks"])
    if plan.constrained and not found.limit(1).count():
        found = search(F.lit(True), P.FLOORS["fallback"])
    titles = found.groupBy("doc_id").agg(F.min("title").alias("title"))
    grouped = S.by_document(found, max(limit, S.DOCUMENTS)).join(titles, "doc_id")
    body = F.array_join(F.transform("chunks", lambda c: c["content"]), " ")
    if reranker is not None:
        relevance = S.reranked(plan.query, T.head(body, "rerank"), reranker)
    score = relevance if relevance is not None else T.title_overlap(F.lit(plan.query), T.head(body, "rerank"))
    return S.rerank(grouped, plan.query, score, P.FLOORS["rerank"]).limit(limit)


def facts_for(memories: DataFrame, question: str, scopes: list[str], now: int, limit: int = S.FACTS, embedder: Embedder | None = None) -> DataFrame:
    """The active facts of visible scopes nearest to a question, with their score."""
    vector = (embedder or HashedWords()).embed([question])[0]
    return S.dense(memories.where(F.col("embedding").isNotNull()), vector, limit, P.FLOORS["facts"], P.in_scopes(scopes) & P.active(now), id_="id")


def dense(chunks: DataFrame, vector: list[float], limit: int, floor: float, where: Column | None = None, cells: Cells | None = None, probes: int | None = None) -> DataFrame:
    """The chunks nearest to a vector with their score: of a stored index if there is one, else all are scored."""
    if cells is None:
        return S.dense(chunks, vector, limit, floor, where, id_="id")
    kept = chunks if where is None else chunks.where(where)
    asked = chunks.sparkSession.createDataFrame([("question", None, [float(x) for x in vector])], "id string, container_tag string, embedding array<float>")
    # The index knows ids and vectors; what may be found is settled by the chunks' own columns, before the best are taken.
    found = cells.search(asked, limit, floor, probes, kept.select("id"), itself=True, tagged=False).select("id", "score")
    return kept.join(F.broadcast(found), "id")


def hybrid(chunks: DataFrame, question: str, limit: int, where: Column | None = None, embedder: Embedder | None = None, cells: Cells | None = None, probes: int | None = None, words: Postings | None = None) -> DataFrame:
    """Chunks (id, content, embedding) by the fusion of their dense and sparse ranks; each list is of at least 40; no floor applies.

    An inverted index weighs words by all chunks that it has, the search without one by those that may be found.
    """
    kept, most = chunks if where is None else chunks.where(where), max(2 * limit, 40)
    nearest = dense(kept, (embedder or HashedWords()).embed([question])[0], most, -1.0, None, cells, probes)
    ranked = nearest.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
    asked = S.term_frequencies(chunks.sparkSession.createDataFrame([(0, question)], "query_id int, text string"), "query_id")
    if words is not None:
        sparse = words.search(asked, most, among=kept.select("id")).select("id", "rank")
    else:
        tf = S.asked_frequencies(kept, asked, "id", "content")
        sparse = S.sparse(tf, S.idf(tf, kept.count()), asked, most, "id").select("id", "rank")
    return kept.join(S.fuse([ranked, sparse], ["id"]), "id").orderBy(F.desc("score"), "id").limit(limit)


def answered(warehouse: Warehouse, question: str, scopes: list[str], now: int, limit: int = 8, plan: P.Plan | None = None, embedder: Embedder | None = None, hybrid_search: bool = False, indexed: bool = False, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, facts with their provenance) for a question on the warehouse; limit is held between 1 and 50. indexed: by the warehouse's indexes."""
    documents = warehouse.current("documents", "title", "reference", "source", "captured_at").withColumnRenamed("id", "doc_id")
    chunks = warehouse.current("chunks").withColumnRenamed("document_id", "doc_id").join(documents, "doc_id")
    cells, words = chunk_indexes(warehouse) if indexed else (None, None)
    found = retrieve(chunks, plan or P.Plan(question), scopes, max(1, min(limit, 50)), embedder, question, hybrid_search=hybrid_search, cells=cells, probes=probes, words=words)
    memories = warehouse.current("memories")
    facts = facts_for(memories, question, scopes, now, embedder=embedder).select("statement", "score")
    known = provenance(facts, memories, warehouse.current("memory_evidence"), scopes)
    return found, facts.join(known, "statement", "left").orderBy(F.desc("score"), "statement")


def chunk_indexes(warehouse: Warehouse) -> tuple[Cells, Postings]:
    """The indexes of a warehouse's chunks: of their vectors and of their words. build_indexes makes them, ingest adds to them."""
    return Cells(warehouse.spark, f"{warehouse.root}/_indexes/chunk_vectors"), Postings(warehouse.spark, f"{warehouse.root}/_indexes/chunk_words")


def build_indexes(warehouse: Warehouse, cells: int | None = None) -> tuple[Cells, Postings]:
    """Makes both indexes anew from the stored chunks. Erased chunks stay in an index until then; a search finds none that aren't stored."""
    vectors, words = chunk_indexes(warehouse)
    for index in (vectors, words):
        warehouse.remove(index.root)
    chunks = warehouse.current("chunks", "container_tag", "content", "embedding")
    words.add(chunks)
    return Cells.build(chunks, vectors.root, cells), words

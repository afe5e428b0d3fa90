"""The engine of a configuration: its flags decide what ingest and retrieval do, its model and its embedder are asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.plans import planner
from mnemo.plans.ingest import LEAST_DISTILLED, ingest
from mnemo.plans.providers import Distiller, EdgeExtractor, Judge, Merger
from mnemo.plans.retrieve import answered
from mnemo.plans.services import Config, SharedUsage, Transport, blurb, over_http
from mnemo.sources import readers
from mnemo.sources.blobs import Blobs
from mnemo.sources.warehouse import Warehouse


class Engine:
    """Ingest and answers as a Config says.

    distill: facts are taken from documents. memory_graph: they are reconciled with stored ones. fact_augmented_keys, contextual: what
    chunks are embedded beside. smart_chunking: chunkers by the kind of text. temporal_graph: edges are extracted. fetch_web_bodies:
    pages' bodies, where given, are appended. blob_dir: texts without credentials are kept as blobs. hybrid_search: dense and sparse ranks are fused.
    multi_query: a question is split into several, whose documents are united. Without a model the offline stand-ins given, or the
    engine's own, take its part; steps that only a model can do are left out.
    """

    def __init__(self, warehouse: Warehouse, config: Config = Config(), post: Transport = over_http, distiller: Distiller | None = None, judge: Judge | None = None, extractor: EdgeExtractor | None = None, indexed: bool = False, merger: Merger | None = None):
        self.warehouse, self.config, self.indexed = warehouse, config, indexed
        self.usage = SharedUsage(warehouse.spark)
        self.complete = config.make_complete(post, self.usage)
        model = config.make_answers(post, self.usage)
        self.distiller, self.judge, self.extractor, self.merger = (given or model for given in (distiller, judge, extractor, merger))
        self.passages, self.questions = (config.make_embedder(post, task) for task in ("retrieval.passage", "retrieval.query"))

    def _describe(self) -> Callable[[str, str], str | None] | None:
        complete = self.complete
        return (lambda title, content: blurb(title, content, complete)) if self.config.contextual and complete else None

    def ingest(self, docs: DataFrame, now: int, bodies: DataFrame | None = None, least: int = LEAST_DISTILLED) -> None:
        """Stores docs; bodies (reference, body) are those of fetched pages."""
        c = self.config
        if c.fetch_web_bodies and bodies is not None:
            docs = readers.enriched(docs, bodies)
        ingest(
            self.warehouse, docs, now, self.passages, self.distiller, self.judge if c.memory_graph else None, self.extractor if c.temporal_graph else None,
            c.fact_augmented_keys, least, self.indexed, c.distill, c.smart_chunking, self._describe(), self.merger,
        )
        if c.blob_dir:
            Blobs(self.warehouse.spark, c.blob_dir).put_all(docs.select(F.col("id").alias("key"), F.encode(T.scrub(F.col("content")), "UTF-8").alias("content")))

    def answered(self, question: str, scopes: list[str], now: int, limit: int = 8, context: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(documents, facts) for a question: of its plan, and with multi_query of the plans of its parts, earlier parts first."""
        c = self.config
        parts = planner.decomposed(question, self.complete) if c.multi_query else [question]
        found = [answered(self.warehouse, q, scopes, now, limit, planner.planned(q, self.complete, context), self.questions, c.hybrid_search, self.indexed) for q in parts]
        documents, facts = (rows[0] if len(found) == 1 else planner.union_by(rows, key) for rows, key in zip(zip(*found, strict=True), ("doc_id", "statement"), strict=True))
        return documents, facts

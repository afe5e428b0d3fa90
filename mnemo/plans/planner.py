"""From a question to what is searched for: plans, sub-queries and questions with the conversation before them."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.functions import parsing
from mnemo.operators import predicates as P
from mnemo.plans.retrieve import retrieve
from mnemo.plans.services import wrapped

Complete = Callable[[str], str]
#: Most parts of a question. Fixed value.
PARTS = 5


def _epoch(day: str | None, end: bool = False) -> int | None:
    if day is None:
        return None
    return int(datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp()) + (86_399 if end else 0)


def planned(question: str, complete: Complete | None = None, context: str | None = None) -> P.Plan:
    """The model's plan for a question, in the light of the conversation before it; the raw question without a model or on any failure."""
    if complete is None:
        return P.Plan(question)
    try:
        before = f"\nThe conversation so far:\n{wrapped(context)}" if context else ""
        raw = complete(f"Plan a search: a JSON object of query, source, after, before (YYYY-MM-DD) and listy.{before}\nQuestion: {question}")
        found = parsing.plan(raw, question)
        return P.Plan(found["query"], found["source"], _epoch(found["after"]), _epoch(found["before"], True), found["listy"])
    except Exception:  # a question is answered without a plan rather than not at all
        return P.Plan(question)


def decomposed(question: str, complete: Complete | None = None) -> list[str]:
    """The question and at most PARTS sub-queries, each once."""
    try:
        parts = parsing.strings(complete(f"Split this question into at most {PARTS} searches, as a JSON array of texts; one is enough if it is simple.\n{question}")) if complete else []
    except Exception:
        parts = []
    return list(dict.fromkeys([question, *(p.strip() for p in (parts or [])[:PARTS] if p.strip())]))


def union_by(results: list[DataFrame], key: str) -> DataFrame:
    """The rows of several results, those of earlier ones first; of each key its first."""
    every = None
    for place, df in enumerate(results):
        marked = df.withColumn("_list", F.lit(place))
        every = marked if every is None else every.unionByName(marked)
    row = F.struct("_list", *(c for c in results[0].columns if c != key))
    first = every.groupBy(key).agg(F.min(row).alias("v"))
    return first.select(key, *(F.col(f"v.{c}").alias(c) for c in results[0].columns if c != key))


def retrieve_with_context(chunks: DataFrame, question: str, scopes: list[str], complete: Complete | None = None, context: str | None = None, limit: int = 8, **options) -> DataFrame:
    """Documents for a question that may lean on what was said before it."""
    return retrieve(chunks, planned(question, complete, context), scopes, limit, question=question, **options)


def shown(plan: P.Plan) -> str:
    """A plan as JSON, for whoever wants to see it."""
    return json.dumps({"query": plan.query, "source": plan.source, "after": plan.after, "before": plan.before, "listy": plan.listy})

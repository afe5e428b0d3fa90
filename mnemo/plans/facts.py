"""Facts of documents in two phases: what each segment says, then, keyed by document, what the document says.

A segment is a row of its own, so a very long document is not one model call after another in one task, and a merge sees the
statements alone. Defined cases: a document without text has no facts; a null statement is no fact; statements alike within a document
are told apart by their places; other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.operators.chunking import SEGMENT, paragraphs
from mnemo.operators.memory import distinct_statements
from mnemo.plans.providers import DOCUMENT_FACTS, FACT, SEGMENT_FACTS, Distiller, Merger


def segments_of(docs: DataFrame) -> DataFrame:
    """id, container_tag, segment (from 0) and text of each segment of docs (id, container_tag, content), dealt over all tasks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: paragraphs(text or "", SEGMENT, 0))

    rows = docs.select("id", "container_tag", F.posexplode(cut("content")).alias("segment", "text"))
    # A call to a model costs far more than moving its text; without this a long document's segments stay in one task.
    return rows.repartition("id", "segment")


def said(segments: DataFrame, distiller: Distiller) -> DataFrame:
    """id, container_tag, segment, failed and facts (at most SEGMENT_FACTS) of each segment; a failure on a document's first is raised."""

    @F.pandas_udf(f"struct<failed:boolean,facts:array<{FACT}>>")
    def run(places: pd.Series, texts: pd.Series) -> pd.DataFrame:
        out = []
        for place, text in zip(places, texts, strict=True):
            try:
                out.append((False, (distiller.distil(text) or [])[:SEGMENT_FACTS]))
            except Exception:
                if not place:
                    raise
                out.append((True, []))
        return pd.DataFrame(out, columns=["failed", "facts"])

    return segments.withColumn("_r", run("segment", "text")).select("id", "container_tag", "segment", "_r.failed", "_r.facts")


def numbered(segments: DataFrame) -> DataFrame:
    """id, container_tag, many (whether the document has several segments), seq and the fact's fields, of said's rows before a document's first failure."""
    own = Window.partitionBy("id")
    placed = segments.withColumn("_cut", F.min(F.when(F.col("failed"), F.col("segment"))).over(own)).withColumn("many", F.max("segment").over(own) > 0)
    kept = placed.where("_cut is null or segment < _cut")
    rows = kept.select("id", "container_tag", "many", "segment", F.posexplode("facts").alias("_p", "_f")).where("_f.statement is not null")
    return rows.select("id", "container_tag", "many", (F.col("segment").cast("long") * SEGMENT_FACTS + F.col("_p")).alias("seq"), "_f.*")


def merge_answers(listed: Column, merger: Merger) -> Column:
    """What a merger makes of each document's statements, a call to each; null where it fails."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for statements in lists:
            try:
                out.append(merger.merge(list(statements)))
            except Exception:  # facts as they were found are better than none
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(listed)


def merged(facts: DataFrame, merger: Merger | None, stage: Callable[[DataFrame], DataFrame], cap: int = DOCUMENT_FACTS) -> DataFrame:
    """id, container_tag, place and the fact's fields: at most cap facts of each document, of numbered's rows.

    Documents of one segment keep their facts. For others the merger is asked once with all their statements in order. A statement of
    its answer that is one of theirs has the kind, confidence and evidence of the last that says so; any other is unknown, of confidence
    0.5 and without evidence. Where it fails or answers nothing, and without a merger, the first of statements alike but for case
    and edges stay. stage writes rows down and reads them back, so that a model is asked once.
    """
    fields = ("statement", "kind", "confidence", "evidence")
    several = facts.where("many")
    latest = Window.partitionBy("id", "statement").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = several.withColumns({c: F.last(c).over(latest) for c in fields[1:]})
    left, answered = known, None
    if merger is not None:
        listed = several.groupBy("id", "container_tag").agg(F.array_sort(F.collect_list(F.struct("seq", "statement"))).alias("_s"))
        asked = listed.select("id", "container_tag", merge_answers(F.transform("_s", lambda x: x["statement"]), merger).alias("said"))
        good = stage(asked).where(F.size("said") > 0)
        left = known.join(good.select("id"), "id", "left_anti")
        rows = good.select("id", "container_tag", F.posexplode(F.slice("said", 1, cap)).alias("place", "statement"))
        meta = known.groupBy("id", "statement").agg(*(F.first(c).alias(c) for c in fields[1:]), F.lit(True).alias("_met"))
        met = rows.join(meta, ["id", "statement"], "left")
        answered = met.select("id", "container_tag", "place", "statement", F.when(F.col("_met"), F.col("kind")).otherwise("unknown").alias("kind"), F.when(F.col("_met"), F.col("confidence")).otherwise(0.5).alias("confidence"), "evidence")
    once = distinct_statements(left, cap, ["id"]).drop("many").unionByName(facts.where("not many").drop("many"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("seq")) - 1
    kept = once.select("id", "container_tag", place.alias("place"), *fields).where(F.col("place") < cap)
    return kept if answered is None else kept.unionByName(answered)


def document_facts(docs: DataFrame, distiller: Distiller, stage: Callable[[DataFrame], DataFrame], merger: Merger | None = None) -> DataFrame:
    """Both phases on docs (id, container_tag, content); what the distiller has said is written down before it is merged."""
    return merged(numbered(stage(said(segments_of(docs), distiller))), merger, stage)

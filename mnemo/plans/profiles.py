"""Standing profiles of namespaces, with a cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.operators import memory
from mnemo.operators import predicates as P
from mnemo.plans.providers import Newest, Summariser
from mnemo.sources.warehouse import Warehouse

#: Seconds that a profile stays good. Fixed value.
FRESH = 3600


def compiled(memories: DataFrame, now: int, summariser: Summariser | None = None) -> DataFrame:
    """container_tag, static_text, dynamic_text and computed_at: a summary of each part of each namespace's profile, none of an empty part."""
    summariser = summariser or Newest()

    def summed(part: str) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: summariser.summarise(part, t) if t else "")

        return run(F.col(f"{part}_text"))

    return memory.profile(memories, now).select("container_tag", summed("static").alias("static_text"), summed("dynamic").alias("dynamic_text"), F.lit(now).cast("long").alias("computed_at"))


def refresh(warehouse: Warehouse, tag: str, now: int, summariser: Summariser | None = None) -> None:
    own = warehouse.current("memories").where(P.in_tag(tag)).withColumn("container_tag", F.lit(tag))
    warehouse.write("profiles", compiled(own, now, summariser).withColumn("id", F.lit(tag)))


def profile(warehouse: Warehouse, tag: str, now: int, summariser: Summariser | None = None) -> DataFrame:
    """The namespace's profile, compiled if the stored one is older than an hour; no row without memories."""
    if not warehouse.current("profiles").where((F.col("id") == tag) & (F.col("computed_at") > now - FRESH)).limit(1).count():
        refresh(warehouse, tag, now, summariser)
    return warehouse.current("profiles").where(F.col("id") == tag)


def invalidate(warehouse: Warehouse, tag: str) -> None:
    warehouse.write("profiles", warehouse.current("profiles").where(F.col("id") == tag), deleted=True)


def prompt_block(static_text: Column, dynamic_text: Column) -> Column:
    """Both parts under headings, without those that are empty."""
    part = lambda title, text: F.when(F.coalesce(F.trim(text), F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), text))
    return F.concat_ws("\n\n", part("About the user", static_text), part("Recently", dynamic_text))

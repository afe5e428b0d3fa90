"""The corpus pipeline: five stages from documents to token ids, each working on what the one before has kept.

Defined cases, by the stages' operators: null and empty texts are scored like any (the classifier's end token alone), copies of
nothing, hold no item, are taken 0 times by the mix and so aren't in the result; rows alike in doc_id are judged by their texts; a
null doc_id stays and comes first; an empty table makes an empty result; all other columns, whatever their names, pass through the
first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemo.llm import decontam, mixing, neardup, quality, token_store
from mnemo.llm.common import Scratch, prepare, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest doc_id."""
    return neardup.representatives(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's summary of the documents, read back from its files."""
    return token_store.store_and_read(docs)


STAGES = [("quality", good), ("neardup", distinct), ("decontam", unleaked), ("mixing", mixed), ("tokens", tokens)]

#: No SQL expresses the classifier, the sketches or the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written and reread before the next."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if place:
            scratch.drop(STAGES[place - 1][0])
        scratch.release()
    return docs

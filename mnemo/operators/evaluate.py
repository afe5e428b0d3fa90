"""Retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of the approximate percentiles that bracket an exact one.
ACCURACY = 10_000

def ranks(golden: DataFrame, results: DataFrame, most: int = 10) -> DataFrame:
    """query_id and rank of the target (by doc_id, or by title where they agree) among the first results; -1 on a miss."""
    by_id = golden.join(results, ["query_id", "doc_id"]).select("query_id", "rank")
    named = golden.where(F.coalesce("title", F.lit("")) != "").select("query_id", "title")
    by_title = named.join(results.select("query_id", "title", "rank"), ["query_id", "title"]).select("query_id", "rank")
    best = by_id.unionByName(by_title).where(F.col("rank") <= most).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return golden.select("query_id").distinct().join(best, "query_id", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))


def hit_rates(ranked: DataFrame) -> DataFrame:
    """n, h1, h3, h10, miss and mrr, rounded to 6 places."""
    at = lambda k: F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 6)
    mrr = F.round(F.avg(F.when(F.col("rank") >= 1, 1.0 / F.col("rank")).otherwise(0.0)), 6)
    return ranked.agg(F.count("*").alias("n"), at(1).alias("h1"), at(3).alias("h3"), at(10).alias("h10"), F.sum((F.col("rank") < 1).cast("long")).alias("miss"), mrr.alias("mrr"))


def p95(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The value at index min(n * 95 // 100, n - 1) of each group's sorted values, exactly.

    Approximate percentiles, whose error in rank has a bound, bracket the value; only values inside the bracket, a few in ten
    thousand, are then sorted within a group, by how often they occur. Nulls don't count.
    """
    step = 1 / ACCURACY
    v = F.col(column)
    bounds = values.where(v.isNotNull()).groupBy(*by).agg(F.percentile_approx(column, [0.95 - 3 * step, 0.95 + 3 * step], ACCURACY).alias("_b"), F.count("*").alias("_n"))
    met = values.where(v.isNotNull()).join(bounds, by)
    below = F.when(v < F.col("_b")[0], F.lit(1)).otherwise(0)
    kept = F.when((v >= F.col("_b")[0]) & (v <= F.col("_b")[1]), v)
    # One row for each value in the bracket, and one (null) that counts what is below it.
    counted = met.withColumn("_v", kept).groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.sum(below).alias("_below"), F.first("_n").alias("_n"))
    upto = F.sum(F.when(F.col("_v").isNull(), F.col("_below")).otherwise(F.col("_c"))).over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()))
    index = F.least(F.expr("_n * 95 div 100"), F.col("_n") - 1)
    return counted.withColumn("_upto", upto).where(F.col("_v").isNotNull() & (F.col("_upto") > index)).groupBy(*by).agg(F.min("_v").alias("p95"))


def score(mrr: Column, latency_ms: Column, tokens: Column) -> Column:
    """0 to 100: MRR, of which latency and injected tokens can cost up to 15 % each."""
    part = lambda x: 0.15 * F.greatest(F.lit(0.5), F.least(F.lit(1.0), 2000.0 / x))
    return F.round(100 * mrr * (0.7 + part(latency_ms) + part(tokens)))


def injected_tokens(contents: Column, facts: Column) -> Column:
    """About four characters to a token, over the first 8 contents of at most 900 characters and the first 10 facts."""
    length = lambda a, n, most: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.least(F.length(x), F.lit(most)))
    return F.round((length(contents, 8, 900) + length(facts, 10, 1 << 30)) / 4).cast("long")


def complete(gold: Column, got: Column) -> Column:
    """Whether all of gold was got; nothing to get is complete."""
    return F.size(F.array_except(gold, got)) == 0


def accuracy(judged: DataFrame) -> DataFrame:
    """n and accuracy by question_type."""
    return judged.groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def failures(judged: DataFrame) -> DataFrame:
    """n of wrong answers by cause: synthesis where the gold was retrieved (column retrieved), else retrieval."""
    cause = F.when(F.col("retrieved"), "synthesis").otherwise("retrieval")
    return judged.where(~F.col("correct")).groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def latencies(runs: DataFrame, column: str) -> DataFrame:
    """n, mean, median, p95, least and most of a column of seconds, and runs per minute of all the time together."""
    v = F.col(column)
    half = F.percentile(column, F.lit(0.5))
    all_ = runs.where(v.isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(half, 6).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(60 * F.count("*") / F.sum(v), 6).alias("per_minute"))
    return all_.join(p95(runs.select(F.lit(0).alias("_g"), column), column, ["_g"]).drop("_g"))  # a row beside a row


def strided(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """At most n rows, at equal steps of their order: the same at every run.

    Places come from counts of range partitions, so no task sees all rows in order.
    """
    total = rows.count()
    stride = max(1, total // max(n, 1))
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_in", place).join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_in"))
    return placed.where((F.col("_at") % stride == 0) & (F.col("_at") < stride * n)).drop("_part", "_in", "_before", "_at")


def first_per(rows: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each value of by."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def golden(documents: DataFrame, ask: Callable[[str, str], str | None], n: int) -> DataFrame:
    """query_id, query, doc_id and title: a question on each of at most n documents (doc_id, title, reference, content) at equal steps, by ask(title, content)."""

    @F.pandas_udf("string")
    def run(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([ask(t, c) for t, c in zip(titles, contents, strict=True)], dtype=object)

    asked = strided(documents, n, "reference", "doc_id").withColumn("query", run(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return asked.where(F.length(F.trim("query")) > 0).select(F.col("doc_id").alias("query_id"), F.trim("query").alias("query"), "doc_id", "title")


def judged(answers: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """answers (question_type, question, answer, response) with correct: whether a model's verdict on the response contains yes."""

    @F.pandas_udf("boolean")
    def run(kinds: pd.Series, questions: pd.Series, expected: pd.Series, responses: pd.Series) -> pd.Series:
        return pd.Series(["yes" in complete(verdict_prompt(*row)).lower() for row in zip(kinds, questions, expected, responses, strict=True)], dtype=bool)

    return answers.withColumn("correct", run("question_type", "question", "answer", "response"))


#: What counts as correct besides equality, by type of question.
ALLOWANCES = {
    "temporal-reasoning": "A count of days, weeks or months may be off by one.",
    "knowledge-update": "Earlier values may be named as long as the updated one is the answer.",
    "single-session-preference": "The expected answer is a rubric; the response has to use what it says about the user, not all of its points.",
}


def verdict_prompt(kind: str, question: str, expected: str, response: str) -> str:
    allowance = ALLOWANCES.get(kind, "A part of the expected answer isn't enough; an equivalent of it is.")
    return f"Does the response answer the question as expected? Say yes or no.\n{allowance}\nQuestion: {question}\nExpected: {expected}\nResponse: {response}"


def compared(run: Callable[[bool], DataFrame], flag: str) -> DataFrame:
    """The metrics of two runs, one without and one with a flag (one row each), side by side with their differences."""
    off, on = run(False), run(True)
    sides = off.select(*(F.col(c).alias(f"{c}_off") for c in off.columns)).join(on.select(*(F.col(c).alias(f"{c}_on") for c in on.columns)))  # a row beside a row
    return sides.select(F.lit(flag).alias("flag"), *sides.columns, *(F.round(F.col(f"{c}_on") - F.col(f"{c}_off"), 6).alias(f"{c}_change") for c in off.columns))

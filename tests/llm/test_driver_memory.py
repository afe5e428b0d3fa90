"""What the driver has to hold and to run: it serves one pipeline after another, and its memory is the smallest of all."""

import tracemalloc

import numpy as np

from mnemo.llm import quality
from mnemo.llm.common import Scratch, components


def test_a_table_is_counted_while_it_is_written(spark):
    scratch = Scratch(spark, "counted")
    table, n = scratch.counted(spark.range(1000).withColumnRenamed("id", "x"), "all")
    assert n == table.count() == 1000
    assert scratch.counted(table, "some", table.x % 10 == 0)[1] == 100
    assert scratch.counted(table.where("x < 0"), "none")[1] == 0
    assert scratch.counted(spark.createDataFrame([], "x long"), "empty")[1] == 0


def test_rounds_of_components_have_no_queries_for_counts(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a long, b long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("components", "components")
    try:
        rows = components(edges, Scratch(spark, "rounds"), "c")
        jobs = len(tracker.getJobIdsForGroup("components"))
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert {tuple(r) for r in rows.collect()} == {*((i, 0) for i in range(65)), (100, 100), (101, 100)}
    assert jobs < 80


def test_a_learner_holds_its_sample_in_narrow_arrays():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, 8, np.uint8)) for _ in range(20_000)]
    examples = [(b" ".join(words[i] for i in rng.integers(0, len(words), 400)), int(i % 2)) for i in range(200)]
    tracemalloc.start()
    quality.train(examples, quality.Params(epochs=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 38e6

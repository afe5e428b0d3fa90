import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import postings, search
from mnemo.operators.postings import Postings
from mnemo.sources import folders


def texts(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(["the"] * rng.randint(0, 9) + rng.choices(words, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 80)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Only-Once, été!"), (n + 3, "the " * 500), (None, "w1 w2 w3 the")]


@pytest.fixture(scope="module")
def both(spark):
    """An index of two batches, and what counting all texts gives."""
    rows, index = texts(), Postings(spark, folders.fresh(spark, "p"), buckets=4)
    docs = spark.createDataFrame(rows, "id long, content string")
    index.add(docs.where("id < 150"))
    index.add(docs.where("id >= 150 or id is null"))
    return index, docs


@pytest.mark.parametrize(("skip", "block"), [(True, 1024), (True, 16), (False, 16), (None, 16)])
def test_scores_are_those_of_counting(spark, both, monkeypatch, skip, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SAMPLE_EVERY", 2)
    index, docs = both
    if block == 16:
        index = Postings(spark, folders.fresh(spark, "p"), buckets=4)
        index.add(docs)
    asked = [(1, "the w1"), (2, "w250 w3 w3 the the"), (3, "été nothing"), (4, "absent words"), (5, " ".join(f"w{k}" for k in range(0, 300, 7)))]
    asked = search.term_frequencies(spark.createDataFrame(asked, "query_id int, text string"), "query_id")
    tf = search.term_frequencies(docs, "id", "content")
    want = search.sparse(tf, search.idf(tf, docs.count()), asked, 12, "id").select("query_id", "id", "score", "rank")
    rows = lambda df: sorted((r.query_id, r.rank, r.id is None, r.id or 0, r.score) for r in df.collect())
    assert rows(index.search(asked, 12, skip)) == rows(want)


def test_a_search_reads_folders_of_its_words_and_no_texts(spark, both):
    index, _ = both
    asked = spark.createDataFrame([(1, "w5", 1)], "query_id int, token string, tf long")
    found = index.search(asked, 3, skip=False)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 3 and "content" not in plan
    bucket = asked.select(index._bucket().alias("b")).first().b
    assert "bucket#" in plan and index.blocks(list(index.batches()), [bucket]).where("token = 'w5'").count() > 0
    read = {f.split("bucket=")[1].split("/")[0] for f in index.blocks(list(index.batches()), [bucket]).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert read == {str(bucket)}


def test_what_is_not_finished_does_not_count(spark, both):
    index, docs = both
    held = index.batches()
    assert sum(held.values()) == docs.count() and len(held) == 2
    fs, p = folders.path_of(spark, f"{index.root}/blocks/batch=broken")
    docs.sparkSession.read.parquet(f"{index.root}/blocks").where("bucket = 1").drop("batch", "bucket").write.parquet(f"{index.root}/blocks/batch=broken/bucket=1")
    assert fs.exists(p) and index.batches() == held
    asked = spark.createDataFrame([(1, "the", 1)], "query_id int, token string, tf long")
    assert index.search(asked, 1).first().id == 403


def test_empty(spark):
    index = Postings(spark, folders.fresh(spark, "p"))
    asked = spark.createDataFrame([(1, "the", 1)], "query_id int, token string, tf long")
    assert index.search(asked, 3).count() == 0
    index.add(spark.createDataFrame([], "id long, content string"))
    assert index.search(asked, 3).count() == 0

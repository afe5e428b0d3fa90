"""Documents scored in their own tasks, against the joins of words."""

import random

import pytest

from mnemo.operators import search


@pytest.mark.parametrize(("scores", "weights"), [(1_000_000, 2_000_000), (2_000, 2_000_000), (1_000_000, 10)])
def test_best_is_what_the_joins_give(spark, monkeypatch, scores, weights):
    monkeypatch.setattr(search, "SCORES", scores)
    monkeypatch.setattr(search, "MOST_WEIGHTS", weights)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(["the"] * rng.randint(0, 4) + rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    # Copies tie, ids come twice or are null, texts are null, empty or without a word asked for.
    rows += [(1000 + i, "the w1 w1 copy") for i in range(40)] + [(7, "w1 w2 twice"), (None, "w3 the"), (None, "w3 w4"), (400, None), (401, ""), (402, "Only-Once, été!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = [(1, "the w1"), (2, "w50 w3 w3 the the"), (3, "été nothing"), (4, "absent words"), (None, "w2 w9 w30"), (5, " ".join(words[::3]))]
    asked = search.term_frequencies(spark.createDataFrame(asked, "query_id int, text string"), "query_id")
    tf = search.term_frequencies(docs)
    want = search.sparse(tf, search.idf(tf, docs.count()), asked, 12).select("query_id", "doc_id", "score", "rank")
    got = search.sparse_best(docs, asked, 12)
    listed = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got.columns == want.columns and listed(got) == listed(want)
    assert search.sparse_best(docs.where("false"), asked, 12).count() == 0 and search.sparse_best(docs, asked.where("false"), 12).count() == 0

"""The kept edge state against graph.resolve, whatever the order in which edges arrive."""

import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import edge_state, graph

FIELDS = "id string, container_tag string, subject string, predicate string, object string, valid_from long, captured_at long, singular boolean"


def lists(rows):
    return sorted(((r.container_tag, r.subject, r.predicate, r.current, r.current_from, r.singular) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_state_is_resolve_under_any_arrival(spark, tmp_path, seed):
    rnd = random.Random(seed)
    edges = [
        (f"e{i}", rnd.choice(["a", None]), rnd.choice(["me", "you", None]), "lives in", rnd.choice(["Rome", "rome", "Oslo", None, ""]), rnd.choice([None, *range(0, 60, 3)]), rnd.randrange(5), rnd.random() < 0.5)
        for i in range(150)
    ]
    rnd.shuffle(edges)
    state = edge_state.EdgeState(spark, str(tmp_path / "s"), period=10)
    assert state.current(5).collect() == state.timeline().collect() == []
    cuts = sorted(rnd.sample(range(150), 3))
    for a, b in zip([0, *cuts], [*cuts, 150]):
        state.add(spark.createDataFrame(edges[a:b], FIELDS))
    state.add(spark.createDataFrame([], FIELDS))
    state.add(spark.createDataFrame(edges[:2], FIELDS))  # again
    every = spark.createDataFrame(edges, FIELDS).cache()
    for t in (-5, 0, 9, 10, 37, 1000):
        assert lists(state.current(t).collect()) == lists(graph.resolve(every, t).collect())
    got: dict = {}
    for r in state.timeline().orderBy("valid_from", "captured_at", "id").collect():
        got.setdefault((r.container_tag, r.subject, r.predicate), []).append((r.object, r.valid_from))
    want = {(r.container_tag, r.subject, r.predicate): [(c.object, c.valid_from) for c in r.timeline] for r in graph.resolve(every, 0).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_a_batch_makes_only_its_own_pieces_anew_and_a_torn_one_does_not_count(spark, tmp_path):
    row = lambda i, at: (f"e{i}", "a", "me", "is", f"o{i}", at, at, True)
    state = edge_state.EdgeState(spark, str(tmp_path / "s"), period=100)
    state.add(spark.createDataFrame([row(i, i * 100) for i in range(6)], FIELDS))
    before = {r.piece: r.batch for r in state.pieces().collect()}
    state.add(spark.createDataFrame([row(9, 250)], FIELDS))
    after = {r.piece: r.batch for r in state.pieces().collect()}
    assert [p for p in after if after[p] != before[p]] == [2]
    # Its log is there, its summaries aren't.
    spark.createDataFrame([row(11, 350)], FIELDS).withColumn("piece", F.lit(3)).write.partitionBy("piece").parquet(str(tmp_path / "s/log/batch=99999999999999999999ffffffx"))
    assert state.current(399).first().current == "o3"
    assert state.current(299).first().current == "o9"

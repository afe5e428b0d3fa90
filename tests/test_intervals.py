import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import intervals, memory

FACTS = "id string, container_tag string, learned_at long, superseded_at long, valid_until long, needs_review boolean"


@pytest.mark.parametrize("seed", range(3))
def test_spans_cover_each_second_once(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a, b in ((rng.randint(0, 1000), rng.randint(0, 1000)) for _ in range(300))] + [(0, 1023), (5, 5), (7, 8), (0, 1)]
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("s", intervals.spans(F.col("a"), F.col("b"), 10))
    for r in df.collect():
        seconds = [t for s in r.s for t in range(s.span << s.level, (s.span + 1) << s.level)]
        assert sorted(seconds) == list(range(r.a, r.b)) and len(r.s) <= 20


def test_golden_times(spark):
    rows = [("a", "t", 10, 20, None, False), ("b", "t", 10, None, 30, False), ("c", "t", 10, None, None, True), ("d", "u", 10, None, None, False)]
    probes = spark.createDataFrame([(t, "t", t) for t in (5, 15, 25, 35)], "probe_id int, container_tag string, t long")
    found = intervals.as_of_many(spark.createDataFrame(rows, FACTS), probes)
    assert sorted((r.probe_id, r.rank, r.id) for r in found.collect()) == [(15, 1, "a"), (15, 2, "b"), (25, 1, "b")]


@pytest.mark.parametrize("small", [True, False])
def test_each_probe_is_as_of(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(intervals, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    at = lambda: rng.choice([None, *(rng.randint(-50, 5000) for _ in range(5))])
    rows = [(f"m{k}", rng.choice(["t", "u", None, "default"]), at(), at(), at(), rng.choice([None, False, False, True])) for k in range(300)]
    rows += [(f"h{k}", "t", 100, None, None, False) for k in range(200)]  # one moment, never ended
    df = spark.createDataFrame(rows, FACTS)
    probes = [(k, rng.choice(["t", "u", None]), rng.choice([None, 100, 99, *(rng.randint(-60, 5100) for _ in range(5))])) for k in range(60)]
    found = {}
    for r in intervals.as_of_many(df, spark.createDataFrame(probes, "probe_id int, container_tag string, t long"), 40).orderBy("probe_id", "rank").collect():
        found.setdefault(r.probe_id, []).append(r.id)
    def known(tag, t):
        ok = [(-l, i) for i, g, l, s, v, n in rows if (g or "default") == (tag or "default") and not n and l is not None and l <= t and (s is None or s > t) and (v is None or v > t)]
        return [i for _, i in sorted(ok)][:40]

    want = {k: known(tag, t) for k, tag, t in probes if t is not None}
    assert found == {k: x for k, x in want.items() if x}
    tag, t = next((tag, t) for _, tag, t in probes if t is not None and tag == "t")
    assert [r.id for r in memory.as_of(df, tag, t, 40).collect()] == known(tag, t)


def test_no_probes_and_no_rows(spark):
    probes = spark.createDataFrame([], "probe_id int, container_tag string, t long")
    facts = spark.createDataFrame([("a", "t", 1, None, None, None)], FACTS)
    assert intervals.as_of_many(facts, probes).count() == 0
    assert intervals.as_of_many(facts.limit(0), spark.createDataFrame([(1, "t", 3)], "probe_id int, container_tag string, t long")).count() == 0


@pytest.mark.parametrize("step", [1, 60])
def test_totals_are_those_of_the_meetings(spark, step):
    rng = random.Random(4)
    at = lambda: rng.choice([None, *(rng.randint(-50, 5000) for _ in range(5))])
    rows = [(f"m{k}", rng.choice(["t", "u", None, "default"]), at(), at(), at(), rng.choice([None, False, True])) for k in range(300)]
    probes = [(k % 70, rng.choice(["t", "u", None]), rng.choice([None, 100, *(rng.randint(-60, 5100) // step * step for _ in range(5))])) for k in range(90)]
    df, asked = spark.createDataFrame(rows, FACTS), spark.createDataFrame(probes, "probe_id int, container_tag string, t long")
    met = intervals.as_of_many(df, asked, None).groupBy("probe_id").agg(F.count("*").alias("known"), F.min("learned_at").alias("oldest"), F.max("learned_at").alias("newest"))
    got = intervals.known_at_many(df, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, met.collect())) and met.count() > 40
    assert intervals.known_at_many(df, asked.limit(0)).count() == 0 == intervals.known_at_many(df.limit(0), asked).count()


def test_many_probes_of_many_rows_are_no_pairs(spark):
    """40,000 rows that 40,000 probes all meet: 1.6 billion meetings."""
    df = spark.range(40_000).selectExpr("cast(id as string) as id", "'t' as container_tag", "id % 500 as learned_at", "cast(null as long) as superseded_at", "cast(null as long) as valid_until", "false as needs_review")
    probes = spark.range(40_000).selectExpr("id as probe_id", "'t' as container_tag", "1000 + id % 700 as t")
    found = intervals.known_at_many(df, probes).agg(F.count("*"), F.min("known"), F.max("known"), F.min("oldest"), F.max("newest")).first()
    assert tuple(found) == (40_000, 40_000, 40_000, 0, 499)


@pytest.mark.parametrize("limit,step", [(1, 1), (3, 1), (3, 60), (7, 60)])
def test_newest_are_the_first_of_the_meetings(spark, limit, step):
    rng = random.Random(limit + step)
    at = lambda: rng.choice([None, *(rng.randint(-50, 3000) for _ in range(5))])
    rows = [(f"m{k}", rng.choice(["t", "t", "u", None, "v"]), s, None if rng.random() < 0.2 else s + rng.choice([0, 5, 400, 3000]), at() if rng.random() < 0.2 else None, None) for k in range(900) for s in [rng.randint(-90, 3000) // 30 * 30]]
    rows += [(f"h{k:04}", "v", 700, rng.choice([900, 1000 + k, None]), None, False) for k in range(600)]  # one moment
    probes = [(k % 120, rng.choice(["t", "u", "v", "w"]), rng.randint(-90, 3100) // step * step) for k in range(160)]  # some ids twice
    df, asked = spark.createDataFrame(rows, FACTS), spark.createDataFrame(probes, "probe_id int, container_tag string, t long")
    met = {}
    for r in sorted(intervals.as_of_many(df, asked, None).collect(), key=lambda r: (-r.learned_at, r.id)):
        met.setdefault(r.probe_id, []).append((r.t, r.id, r.learned_at))
    found = intervals.as_of_many(df, asked, limit, ["learned_at"])
    assert set(found.columns) == {"probe_id", "t", "id", "learned_at", "rank"}
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.probe_id, r.rank)):
        got.setdefault(r.probe_id, []).append((r.rank, r.id, r.learned_at))
    assert got == {k: [(rank, i, at) for rank, (_, i, at) in enumerate(x[:limit], 1)] for k, x in met.items()} and len(got) > 60


def _most_rows(plan):
    """The most rows that a step of an executed plan made."""
    name, made = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    children = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([made.get().value() if made.isDefined() else 0, *map(_most_rows, children)])


@pytest.mark.parametrize("ended", [True, False])
def test_newest_of_many_probes_of_many_rows_are_no_pairs(spark, ended):
    """3,000 rows that 3,000 probes all meet: 9,000,000 meetings."""
    end = "3000 + id" if ended else "cast(null as long)"
    df = spark.range(3_000).selectExpr("id", "'t' as container_tag", "id % 500 as learned_at", f"{end} as superseded_at", "cast(null as long) as valid_until", "false as needs_review")
    probes = spark.range(3_000).selectExpr("id as probe_id", "'t' as container_tag", "500 + id % 2500 as t")
    found = intervals.as_of_many(df, probes, 2)
    rows = found.collect()
    assert sorted((r.probe_id, r.rank, r.id) for r in rows) == [(p, k, (499, 999)[k - 1]) for p in range(3_000) for k in (1, 2)]
    assert _most_rows(found._jdf.queryExecution().executedPlan()) < 150_000

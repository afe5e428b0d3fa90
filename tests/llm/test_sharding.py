import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mnemo.llm import sharding
from tests.llm.test_llm import documents, frame, odd


def heap_of_groups(sizes, shards):
    heap, out = [(0, j) for j in range(shards)], []
    for size in sizes:
        load, j = heapq.heappop(heap)
        out.append(j)
        heapq.heappush(heap, (load + size, j))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_turns_are_those_of_the_heap(seed):
    rng = random.Random(seed)
    shards = rng.choice([1, 2, 5, 40])
    counts = {rng.randint(16, rng.choice([40, 4000])): rng.choice([1, 1, 2, 30, 500, 3000]) for _ in range(60)} | {10**6: rng.randint(1, 3)}
    got = []
    for (size, n), (s, starts, cycles) in zip(sorted(counts.items(), reverse=True), sharding.schedule(sorted(counts.items(), reverse=True), shards), strict=True):
        assert s == size and starts[0] == 0
        for start, end, cycle in zip(starts, [*starts[1:], n], cycles, strict=True):
            got += [cycle[k % len(cycle)] for k in range(end - start)]
    assert got == heap_of_groups([s for s, n in sorted(counts.items(), reverse=True) for _ in range(n)], shards)


def check(rows, plan, shards):
    """Sizes, groups, slots, and each shard's load by the heap over all groups."""
    got = plan.collect()
    byte = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(byte(t)) + 16, zlib.crc32(byte(t))) for i, t, _ in rows)
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    slots, of, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        of[r.doc_id, r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    together = defaultdict(set)
    for i, t, _ in rows:
        together[byte(t)] |= of[i, len(byte(t)) + 16, zlib.crc32(byte(t))]
    assert all(len(s) == 1 for s in together.values())
    totals = Counter()
    for _, t, _ in rows:
        totals[byte(t)] += len(byte(t)) + 16
    want = Counter()
    for size, j in zip(sorted(totals.values(), reverse=True), heap_of_groups(sorted(totals.values(), reverse=True), shards), strict=True):
        want[j] += size
    assert loads == want


def test_groups_and_loads(spark):
    rng = random.Random(1)
    rows = [(i, t, "a") for i, t in documents(spark).items()]
    rows += [(1000 + k, "the same " * 20, "b") for k in range(150)]  # a third of all rows
    rows += [(2000 + k, f"{k:05d} of one length", "c") for k in range(400)]  # one size for most groups
    rng.shuffle(rows)
    check(rows, sharding.plan(frame(spark, rows)), 40)
    check(rows, sharding.plan(frame(spark, rows), shards=7, per_range=2), 7)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    check(rows, sharding.plan(odd(spark)), 40)
    assert sharding.plan(odd(spark).limit(0)).count() == 0


def test_assign_keeps_columns(spark, tmp_path):
    docs = odd(spark)
    out = sharding.assign(docs, 4)
    assert out.columns == [*docs.columns, "shard"]
    assert out.drop("shard").exceptAll(docs).count() == 0 and out.count() == docs.count()
    out.write.partitionBy("shard").parquet(str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    spread = back.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.countDistinct("shard").alias("n"))
    assert spread.where("n > 1").count() == 0

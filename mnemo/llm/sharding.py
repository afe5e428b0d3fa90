"""Sharding by longest processing time: groups of equal texts, largest first, each to the shard with the least load.

The plain method takes one group after another from a heap of shards. Groups of the same size are alike to it, so what has to be taken
in order is not the groups but the distinct sizes of groups with their numbers: D distinct sizes need at least D(D+1)/2 bytes of
input, so there are at most sqrt(2 * bytes) of them (14 million at 100 TB), in one stream through one task that holds the heap of
shards alone. For each size that task says which shards take turns from which rank on; a group finds its own rank among the groups
of its size, in the order of the digest of their text, and with it its shard. The result is exactly that of the heap over all groups.

Texts are read once, for size, crc32 and digest; what follows is narrow. Ranks are found in ranges of the digest's leading digits
whose counts are accumulated in two levels, so neither a size that most groups share nor a shard that most rows fall to is one task.
A group of copies is one row behind the map-side sum; the join back to its documents is one that adaptive execution splits.

A group is never split, so one that is larger than a shard's share makes its shard as large as itself. Slots number a shard's rows
without gaps in the order of a hash of their id, which is a random order for whoever reads a shard from its beginning.

Defined cases: a null text has no bytes and is grouped with empty ones; a null doc_id is ordered by its text's crc32; repeated rows
have slots of their own; no documents give no rows; other columns, whatever their names, pass through assign and aren't used.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, small
from mnemo.llm.mixing import RANGE_DOCS, digits_for

SHARDS = 40
#: Bytes of a row besides its text.
ROW_BYTES = 16


def turns(loads: list[int], size: int, n: int) -> tuple[list[int], list[list[int]]]:
    """Which shards take n groups of one size: from rank starts[i] on the shards of cycles[i] in turn. Adds to loads.

    A heap would take the n smallest of the numbers loads[j] + m * size. By their quotient by size, each shard has one of them at every
    quotient from its own load's on, so between two such quotients the same shards take turns, in the order of remainder and number.
    """
    quotients = sorted({x // size for x in loads})
    starts, cycles, done = [], [], 0
    for place, level in enumerate(quotients):
        cycle = [j for _, j in sorted((x % size, j) for j, x in enumerate(loads) if x // size <= level)]
        rest = n - done
        take = min(rest, (quotients[place + 1] - level) * len(cycle)) if place + 1 < len(quotients) else rest
        starts.append(done)
        cycles.append(cycle)
        done += take
        if done == n:
            break
    for start, end, cycle in zip(starts, [*starts[1:], n], cycles, strict=True):
        whole, more = divmod(end - start, len(cycle))
        for at, j in enumerate(cycle):
            loads[j] += (whole + (at < more)) * size
    return starts, cycles


def schedule(sizes: Iterable[tuple[int, int]], shards: int = SHARDS) -> Iterator[tuple[int, list[int], list[list[int]]]]:
    """For (size, number of groups) from the largest size down: size, and the starts and cycles of its turns."""
    heap = [(0, j) for j in range(shards)]
    for size, n in sizes:
        if n <= 2 * shards:
            taken = []
            for _ in range(n):
                load, j = heap[0]
                heapq.heapreplace(heap, (load + size, j))
                taken.append(j)
            yield size, [0], [taken]
        else:
            loads = [load for _, load in sorted((j, load) for load, j in heap)]
            yield size, *turns(loads, size, n)
            heap = [(load, j) for j, load in enumerate(loads)]
            heapq.heapify(heap)


def _scheduled(sizes: DataFrame, shards: int) -> DataFrame:
    """size, starts and cycles for rows (size, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held: list[tuple] = []
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], ["total", "starts", "cycles"])
        for row in schedule(every, shards):
            held.append(row)
            if len(held) == 4096:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return sizes.repartition(1).sortWithinPartitions(F.desc("total")).mapInArrow(run, "total bigint, starts array<bigint>, cycles array<array<int>>")


def ranked(rows: DataFrame, by: str, key: str, then: list[Column], digits: int, scratch: Scratch, name: str) -> DataFrame:
    """rows with rank: how many rows of the same by come before in the order of key (hex digits) and then."""
    rows = rows.withColumn("range", F.substring(key, 1, digits))
    upper = F.substring("range", 1, digits // 2)
    counts = scratch.table(rows.groupBy(by, "range").agg(F.count("*").alias("c")).withColumn("upper", upper), f"{name}-counts")
    before = lambda of, order: Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    uppers = counts.groupBy(by, "upper").agg(F.sum("c").alias("u")).withColumn("above", F.coalesce(F.sum("u").over(before([by], "upper")), F.lit(0)))
    starts = counts.withColumn("below", F.coalesce(F.sum("c").over(before([by, "upper"], "range")), F.lit(0))).join(uppers, [by, "upper"])
    starts = starts.select(by, "range", (F.col("above") + F.col("below")).alias("start"))
    inside = F.row_number().over(Window.partitionBy(by, "range").orderBy(key, *then))
    placed = rows.withColumn("inside", inside).join(small(starts, counts.count(), 192), [by, "range"])
    return placed.withColumn("rank", (F.col("start") + F.col("inside") - 1).cast("long")).drop("range", "inside", "start")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _grouped(groups: DataFrame, scratch: Scratch, shards: int, per_range: int) -> DataFrame:
    """digest and shard of groups (digest, total)."""
    sizes = groups.groupBy("total").agg(F.count("*").alias("n"))
    planned = scratch.table(_scheduled(sizes, shards), "planned")
    width = planned.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(F.flatten("cycles"))), F.lit(0)).alias("turns")).first()
    places = ranked(groups, "total", "digest", [], digits_for(groups.count(), per_range), scratch, "groups")
    met = places.join(small(planned, 1, 384 * width.n + 16 * width.turns), "total")
    at = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    cycle = F.element_at("cycles", at)
    turn = F.pmod(F.col("rank") - F.element_at("starts", at), F.size(cycle).cast("long")).cast("int") + 1
    return scratch.table(met.select("digest", F.element_at(cycle, turn).alias("shard")), "places")


def _placed(docs: DataFrame, scratch: Scratch, shards: int, per_range: int) -> tuple[DataFrame, DataFrame]:
    """The narrow table of documents, and digest and shard of each group of equal texts."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), digest(F.col("text")).alias("digest"))
    narrow = scratch.table(narrow, "narrow")
    groups = scratch.table(narrow.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    return narrow, _grouped(groups, scratch, shards, per_range)


def plan(docs: DataFrame, shards: int = SHARDS, per_range: int = RANGE_DOCS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the shard of a document isn't a function of its id) of each document."""
    scratch = Scratch(docs.sparkSession, "shards")
    narrow, places = _placed(docs, scratch, shards, per_range)
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("crc "), F.col("text_crc32").cast("string")))
    placed = narrow.join(places.hint("merge"), "digest").select("doc_id", "size", "text_crc32", "shard", F.md5(named.cast("binary")).alias("key"))
    placed = scratch.table(placed, "placed")
    slots = ranked(placed, "shard", "key", [F.col("doc_id"), F.col("text_crc32")], digits_for(placed.count(), per_range), scratch, "slots")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def assign(docs: DataFrame, shards: int = SHARDS, per_range: int = RANGE_DOCS, column: str = "shard") -> DataFrame:
    """docs, all their columns, with their shard in one more; written with partitionBy(column) that is a folder for each shard."""
    scratch = Scratch(docs.sparkSession, "shards")
    _, places = _placed(docs, scratch, shards, per_range)
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the plan's
    rows = docs.select(digest(F.col("text")).alias("digest"), F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).alias("row"))
    met = rows.join(places.hint("merge"), "digest")
    return met.select(*(F.col(f"row.{n}").alias(c) for c, n in names.items()), F.col("shard").alias(column))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes, four bits at a time."""
    table = [0] * 16
    for k in range(16):
        c = k
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[k] = c
    nibbles = rf"list_filter(list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), ''), lambda h: strpos('0123456789ABCDEF', h) - 1), lambda v: v >= 0)"
    step = f"lambda c, v: xor(list_extract({table}, (xor(c, v) & 15) + 1)::bigint, c >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform({nibbles}, lambda v: v::bigint)), {step}), 4294967295::bigint)"


def oracle_sql(shards: int = SHARDS) -> str:
    return f"""with recursive docs as (
  select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + {ROW_BYTES} as size from documents),
coded as (select doc_id, size, md5(t) as digest, {crc32_sql('t')} as crc from docs),
totals as (select digest, sum(size)::bigint as total from coded group by digest),
groups as (select *, row_number() over (order by total desc, digest) as i from totals),
steps as (
  select 0::bigint as i, ''::varchar as digest, 0::bigint as shard, list_transform(range({shards}), lambda x: 0::bigint) as loads
  union all
  select g.i, g.digest, list_position(s.loads, list_min(s.loads))::bigint - 1,
         list_transform(s.loads, lambda x, k: x + case when k = list_position(s.loads, list_min(s.loads)) then g.total else 0 end)
  from steps s join groups g on g.i = s.i + 1)
select c.doc_id, c.size::bigint as size, c.crc as text_crc32, 'bytes' as law, s.shard::integer as shard,
       row_number() over (partition by s.shard order by md5(coalesce(c.doc_id::varchar, 'crc ' || c.crc)), c.doc_id, c.crc) - 1 as slot, null::integer as grown_shard
from coded c join steps s on s.digest = c.digest"""

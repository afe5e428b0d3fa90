"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

Each document's failures are a set of filters, one of 32. A table of 32 sets by 120 orders says once which step removes a document
of a set first. Tasks look their documents up in it and count removals by part, order and step, in all and by label; the arrays of
tasks are added in two rounds, so that their number doesn't meet in one task. All that is reported follows from those removals:
what a filter removes as the first is what fails it, what it removes as the last is what fails it alone.

Texts are read once. What comes from that pass (32 bytes of digest and four bits) is written down; copies are found by SHA-256 of
the text, whose groups pass on their smallest doc_id, so a group that holds a third of all rows is one row behind the map-side
aggregate, and its join is one that adaptive execution splits.

Defined cases: a null text is an empty one, and its copy; a null source is the part "", as is an empty one; a null doc_id is neither
larger nor smaller than another and has no label; rows alike in doc_id and text aren't copies of each other by that; a document
with several label rows is good or toxic if any says so; no documents give no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, arrow_map, small, texts

LETTERS = "ABCDE"
#: Parts whose counts a task holds at once (17 KB each); beyond that it passes them on and goes on from zero.
PARTS_HELD = 256
#: Tasks in which the arrays of all tasks are added before they are added by element.
ADDERS = 32
_CAPITALS, _LATER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """The thresholds of filters A to D; E fails copies of a document with a smaller id."""

    words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    signs: bytes = b"#$%&*|"

    def failed(self, text: bytes) -> int:
        """The failures of a text, A as bit 0 to D as bit 3."""
        words = text.split()  # of bytes: at ASCII white space alone
        capitals = len(text) - len(text.translate(None, _CAPITALS))
        points = len(text.translate(None, _LATER_BYTES))
        return (
            (len(words) < self.words)
            | (100 * len(set(words)) < self.distinct_percent * len(words)) << 1
            | (100 * capitals > self.capital_percent * points) << 2
            | (len(text.translate(None, self.signs)) < len(text)) << 3
        )


def orders(letters: str = LETTERS) -> list[str]:
    return ["".join(p) for p in itertools.permutations(letters)]


def first_failures(letters: str = LETTERS) -> np.ndarray:
    """For each set of failed filters (bits) and order: the step, from 0, that removes such a document; the number of filters if none does."""
    bits = np.array([[1 << letters.index(x) for x in order] for order in orders(letters)])
    fails = (np.arange(1 << len(letters))[:, None, None] & bits) > 0
    return np.where(fails.any(2), fails.argmax(2), len(letters))


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part and failed (bits of the filters, A the lowest) of each document."""

    def start() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [x or b"" for x in texts(batch)]
            digests = pa.array([hashlib.sha256(x).digest() for x in rows], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([limits.failed(x) for x in rows], pa.int32()), digests], ["doc_id", "part", "failed", "digest"])

        return each

    read = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "audit")
    kind = read.schema["doc_id"].dataType.simpleString()
    judged = scratch.table(arrow_map(read, f"doc_id {kind}, part string, failed int, digest binary", start), "judged")
    firsts = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    firsts = scratch.table(firsts, "firsts")
    met = judged.join(small(firsts, firsts.count(), 64), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("doc_id", "part", (F.col("failed") + F.when(copy, 16).otherwise(0)).alias("failed"), F.xxhash64("digest").alias("spread"))


def labelled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed, and whether the document is labelled good (quality 1) and toxic (1)."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("marked"), F.lit(0).cast("long").alias("zero"), "good", "toxic")
    # Rows without an id meet no label; they are dealt out by their text, not to the one task of a null key.
    spread = F.when(F.col("doc_id").isNull(), F.col("spread")).otherwise(0)
    met = judged.withColumn("spread", spread).join(small(marks, labels.count(), 64), (F.col("doc_id") == F.col("marked")) & (F.col("spread") == F.col("zero")), "left")
    return met.select("part", "failed", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def removals(marked: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part and counts, an array of removals by (all, good, toxic), order and step (the last step is: kept), of all documents of a part.

    marked has part, failed, good and toxic.
    """
    shape = (3, len(orders(letters)), len(letters) + 1)
    cells = int(np.prod(shape[1:]))

    def flushed(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.ravel() for x in held.values()], pa.list_(pa.int64()))], ["part", "counts"])
        held.clear()
        return out

    def lookups(batches):
        table, held = first_failures(letters), {}
        at = np.arange(shape[1]) * shape[2]
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, code = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            failed, good, toxic = (batch.column(k).to_numpy() for k in (1, 2, 3))
            cell = code[:, None] * cells + at + table[failed]
            for k, which in enumerate((slice(None), good == 1, toxic == 1)):
                found = np.bincount(cell[which].ravel(), minlength=cells * len(names)).reshape(len(names), cells)
                for name, row in zip(names, found, strict=True):
                    held.setdefault(name, np.zeros((3, cells), np.int64))[k] += row
            if len(held) > PARTS_HELD:
                yield flushed(held)
        if held:
            yield flushed(held)

    def sums(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[name] = held.get(name, 0) + counts.values.to_numpy()
            if len(held) > PARTS_HELD:
                yield flushed(held)
        if held:
            yield flushed(held)

    schema = "part string, counts array<bigint>"
    partial = marked.select("part", "failed", "good", "toxic").mapInArrow(lookups, schema).repartition(ADDERS).mapInArrow(sums, schema)
    summed = partial.select("part", F.posexplode("counts")).groupBy("part", "pos").agg(F.sum("col").alias("n"))
    return summed.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda x: x["n"]).alias("counts"))


def report(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The rows of the audit for each part's array of removals: 600 of a part with five filters."""
    names, n = orders(letters), len(letters)
    which = np.array([[letters.index(x) for x in order] for order in names])  # the filter of each order and step

    def rows(frames):
        for frame in frames:
            for part, flat in zip(frame["part"], frame["counts"], strict=True):
                every, good, toxic = np.asarray(flat, np.int64).reshape(3, len(names), n + 1)
                removed = every[:, :n]
                fails = np.array([removed[which[:, 0] == f, 0][0] for f in range(n)])
                alone = np.array([removed[which[:, -1] == f, -1][0] for f in range(n)])
                over_orders = np.array([removed[which == f].sum() for f in range(n)])
                found = {
                    "kept": every.sum(1)[:, None] - removed.cumsum(1), "removed": removed, "redundant": fails[which] - removed, "unique_fails": alone[which],
                    "good_lost": good[:, :n], "toxic_lost": toxic[:, :n], "shapley": over_orders[which],
                }
                yield pd.DataFrame({"part": part, "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))} | {k: v.ravel() for k, v in found.items()})

    numbers = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.mapInPandas(rows, f"part string, filter_order string, step int, {numbers}")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row for each part, order of the five filters and step."""
    return report(removals(labelled(failures(docs, limits), labels)))


SQL = r"""with facts as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
judged as (
  select f.part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(f.doc_id > min(f.doc_id) over (partition by t), false)] as fails
  from facts f left join marks m on m.doc_id = f.doc_id),
sets as (select part, good, toxic, fails, count(*) as n from judged group by all),
letters as (select unnest(range(1, 6)) as x),
orders as (
  select [a.x, b.x, c.x, d.x, e.x] as seq from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
met as (
  select part, good, toxic, fails, n, array_to_string(list_transform(seq, lambda x: chr(cast(64 + x as integer))), '') as filter_order, s.x as step, seq[s.x] as f,
         coalesce(nullif(list_position(list_transform(seq, lambda x: fails[x]), true), 0), 6) as gone
  from sets, orders, letters s),
steps as (
  select part, filter_order, step, f, sum(case when gone > step then n else 0 end) as kept, sum(case when gone = step then n else 0 end) as removed,
         sum(case when fails[f] and gone < step then n else 0 end) as redundant, sum(case when fails[f] and len(list_filter(fails, lambda x: x)) = 1 then n else 0 end) as unique_fails,
         sum(case when gone = step and good then n else 0 end) as good_lost, sum(case when gone = step and toxic then n else 0 end) as toxic_lost
  from met group by all)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
       cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
       cast(sum(removed) over (partition by part, f) as bigint) as shapley
from steps"""

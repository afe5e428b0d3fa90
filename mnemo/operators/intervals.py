"""As-of join: what held at each of many times, by equality of interval pieces, without comparing every time with every interval.

An interval of whole seconds is cut into the largest aligned spans of 2^level seconds that it covers, two at most on each level; a time lies
in exactly one span of each level. A row and a time meet if and only if one of the row's spans is one of the time's, so the join
is one of equal keys (namespace, level, span), each meeting is made once, and an interval that is long or still open costs no
more spans than twice the levels. Intervals are cut off at the first and last time asked for, and levels reach no further.
What is asked of all rows that a time meets (totals, the newest) is found for each span first, so that their pairs are never made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.operators import predicates as P

BROADCAST_BYTES = 16 << 20


def spans(start: Column, end: Column, levels: int) -> Column:
    """array of struct(level, span) that together are [start, end), each second once; empty if end <= start. 0 <= start, end < 2^levels."""

    def at(level: Column) -> Column:
        # The aligned spans within are lo to hi - 1; those at the ends whose larger span isn't within are this level's.
        ends = F.struct(F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level).alias("lo"), F.call_function("shiftright", end, level).alias("hi"))

        def odd(x: Column) -> Column:
            some = x["lo"] < x["hi"]
            span = lambda s: F.struct(level.alias("level"), s.alias("span"))
            return F.array(F.when(some & (x["lo"] % 2 == 1), span(x["lo"])), F.when(some & (x["hi"] % 2 == 1), span(x["hi"] - 1)))

        return F.transform(F.array(ends), odd)[0]

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda s: s.isNotNull())


def covers(t: Column, levels: int) -> Column:
    """array of struct(level, span) of the span of each level that a second lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", t, level).alias("span")))


def _unit(times: DataFrame) -> int:
    """The greatest number that divides all of a column of whole numbers; 1 if all are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = 0
        for batch in batches:
            found = int(np.gcd.reduce(batch.column(0).to_numpy(), initial=found))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], ["unit"])

    return math.gcd(*(r.unit for r in times.mapInArrow(run, "unit long").distinct().collect())) or 1  # a number of each task at most


def _bounded(rows: DataFrame, start: Column, end: Column, probes: DataFrame, tag: str) -> tuple[DataFrame, Column, int]:
    """rows with _tag and the units _from to _to - 1 that they hold in; the spans (level, span) of a probe's t; the number of levels.

    Units are of the length that divides all times asked for: days, if all are days apart.
    """
    first, last = probes.agg(F.min("t"), F.max("t")).first()
    first, last = first or 0, last or 0
    unit = _unit(probes.select(F.col("t") - first))
    levels = ((last - first) // unit + 1).bit_length()
    # The first time asked for that isn't before a second.
    upto = lambda x: ((x + (unit - 1) - F.pmod(x + (unit - 1), F.lit(unit))) / unit).cast("long")
    lo = F.greatest(F.coalesce(start, F.lit(first)), F.lit(first)) - first
    hi = F.least(F.coalesce(end, F.lit(last + 1)), F.lit(last + 1)) - first
    bounded = rows.withColumns({"_tag": F.coalesce(tag, F.lit(P.DEFAULT_TAG)), "_from": upto(lo), "_to": upto(F.greatest(hi, F.lit(0)))})
    return bounded, covers(((F.col("t") - first) / unit).cast("long"), levels), levels


def _spanned(bounded: DataFrame, levels: int) -> DataFrame:
    """A row for each span of a bounded row, with _level and _span."""
    cut = bounded.withColumn("_s", F.explode(spans(F.col("_from"), F.col("_to"), levels)))
    return cut.withColumn("_level", F.col("_s.level")).withColumn("_span", F.col("_s.span")).drop("_s", "_from", "_to")


def _probes(probes: DataFrame) -> DataFrame:
    return probes.where("t is not null").select("probe_id", F.coalesce("container_tag", F.lit(P.DEFAULT_TAG)).alias("probe_tag"), F.col("t").cast("long").alias("t"))


_KEYS = ["_tag", "_level", "_span"]


def meets(rows: DataFrame, start: Column, end: Column, probes: DataFrame, tag: str = "container_tag") -> DataFrame:
    """probe_id, t and the columns of rows for each probe (probe_id, container_tag, t) and row of its namespace with start <= t < end.

    A null start is the beginning of time, a null end its end; a null namespace is the default one; a null t meets nothing.
    """
    probes = _probes(probes)
    bounded, covered, levels = _bounded(rows, start, end, probes, tag)
    cut = _spanned(bounded, levels)
    keyed = probes.withColumn("s", F.explode(covered)).select("probe_id", "t", F.col("probe_tag").alias("_tag"), F.col("s.level").alias("_level"), F.col("s.span").alias("_span"))
    if probes.count() * (levels + 1) * 96 <= BROADCAST_BYTES:
        return cut.join(F.broadcast(keyed), _KEYS).drop(*_KEYS)
    return cut.join(keyed.hint("merge"), _KEYS).drop(*_KEYS)


def _points(probes: DataFrame, covered: Column) -> DataFrame:
    """probe_tag, t and _tag, _level and _span of each span of each time asked for in a namespace."""
    asked = probes.select("probe_tag", "t").distinct().withColumn("s", F.explode(covered))
    return asked.select("probe_tag", "t", F.col("probe_tag").alias("_tag"), F.col("s.level").alias("_level"), F.col("s.span").alias("_span"))


def totals(rows: DataFrame, start: Column, end: Column, value: Column, probes: DataFrame, tag: str = "container_tag") -> DataFrame:
    """probe_id, n, least and most: of the rows that a probe meets, how many there are and the least and greatest value; none for one that meets nothing.

    Rows are added up by their spans before they meet probes, and probes of one namespace and time are one, so no meeting is a row:
    the work is that of the rows and of the probes, not of their pairs.
    """
    probes = _probes(probes)
    bounded, covered, levels = _bounded(rows.withColumn("_value", value), start, end, probes, tag)
    per = _spanned(bounded, levels).groupBy(*_KEYS).agg(F.count("*").alias("n"), F.min("_value").alias("least"), F.max("_value").alias("most"))
    at = _points(probes, covered).join(per, _KEYS).groupBy("probe_tag", "t").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    # Repeated ids are one, as they are for who groups by them.
    return probes.join(at, ["probe_tag", "t"]).groupBy("probe_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


#: Rows in a run of _shortened, as a multiple of the limit.
RUN = 4


def _shortened(bounded: DataFrame, limit: int) -> DataFrame:
    """bounded rows, sorted by _tag and falling _from, without units in which `limit` rows that come before them in their namespace hold too.

    Such units can't be among the newest. Not all of them are found, so this leaves less to do and decides nothing. A task goes through its
    rows in runs: all rows of a run hold from its first row's _from on, and `limit` of them until its limit-th last _to. With what
    the runs before have filled, if they touch, that is one stretch, and a row that ends in it ends where it begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, since, until = None, 0, 0  # the units that are filled, of this namespace
        for batch in batches:
            if not batch.num_rows:
                continue
            tags, start, end = batch.column("_tag"), batch.column("_from").to_numpy(), batch.column("_to").to_numpy().copy()
            changes = np.flatnonzero(pc.not_equal(tags.slice(1), tags.slice(0, len(tags) - 1)).to_numpy(zero_copy_only=False)) + 1
            for a, b in pairwise([0, *changes.tolist(), len(tags)]):
                if tags[a].as_py() != tag:
                    tag, since, until = tags[a].as_py(), 0, 0
                for i in range(a, b, RUN * limit):
                    ends = end[i : min(i + RUN * limit, b)]
                    held = int(np.partition(ends, -limit)[-limit]) if len(ends) >= limit else 0
                    if since < until:
                        ends[(ends > since) & (ends <= until)] = since  # in end itself
                    if held > start[i]:
                        since, until = int(start[i]), max(held, until) if since <= held else held
            batch = batch.set_column(batch.schema.get_field_index("_to"), "_to", pa.array(end))
            yield batch.filter(pa.array(end > start))

    return bounded.mapInArrow(run, bounded.schema)


def newest(rows: DataFrame, start: Column, end: Column, probes: DataFrame, limit: int, columns: list[str] | None = None, id_: str = "id", tag: str = "container_tag") -> DataFrame:
    """Of what meets gives each probe, the `limit` rows of the latest start, then of the smallest id, with their place as rank.

    Of rows' columns the id and those named are kept, or all. No more than `limit` rows of a span meet probes, and probes of one namespace and
    time are one: the work is that of the rows and of the probes, not of their pairs.
    """
    probes = _probes(probes)
    bounded, covered, levels = _bounded(rows.withColumn("_start", start), start, end, probes, tag)
    if columns is not None:
        bounded = bounded.select(*dict.fromkeys([id_, *columns]), "_tag", "_start", "_from", "_to")
    order = [F.desc("_start"), F.col(id_)]
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    dealt = bounded.where("_from < _to").repartitionByRange("_tag", *order).sortWithinPartitions("_tag", *order)
    kept = best(_spanned(_shortened(dealt, max(limit, 1)), levels), *_KEYS).drop("rank")
    at = best(_points(probes, covered).hint("merge").join(kept, _KEYS).drop(*_KEYS), "probe_tag", "t").drop("rank")
    # Repeated ids are one, as they are for who groups by them.
    return best(probes.hint("merge").join(at, ["probe_tag", "t"]).drop("probe_tag"), "probe_id").drop("_start")


def _known(memories: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Memories that may be known, from when and until when."""
    # The end is the earlier one that is there.
    return memories.where(~F.coalesce("needs_review", F.lit(False))).where("learned_at is not null"), F.col("learned_at"), F.least("superseded_at", "valid_until")


def known_at_many(memories: DataFrame, probes: DataFrame) -> DataFrame:
    """probe_id, known, oldest and newest: of the memories that as_of_many gives each probe, their number, and when the first and the last was learned."""
    found = totals(*_known(memories), F.col("learned_at"), probes)
    return found.select("probe_id", F.col("n").alias("known"), F.col("least").alias("oldest"), F.col("most").alias("newest"))


def as_of_many(memories: DataFrame, probes: DataFrame, limit: int | None = 200, columns: list[str] | None = None) -> DataFrame:
    """probe_id, t and the memories that were known then in the probe's namespace: memory.as_of for each probe.

    With limit, those learned last, then of the smallest id, with their place as rank, and of their columns id and those named, or all;
    None gives all memories whole, without a rank.
    """
    return meets(*_known(memories), probes) if limit is None else newest(*_known(memories), probes, limit, columns)

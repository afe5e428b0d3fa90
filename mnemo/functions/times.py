"""Dates as epoch seconds; sessions run in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
# Words for numbers in relative windows, and days of each unit.
NUMBERS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split())}
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def date_text(epoch: Column) -> Column:
    return F.from_unixtime(epoch, "yyyy-MM-dd")


def day_start(text: Column) -> Column:
    """YYYY-MM-DD to the epoch of its midnight; null if it is no date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def day_end(text: Column) -> Column:
    return day_start(text) + (DAY - 1)


def expiry(fact: Column) -> tuple[Column, Column]:
    """(text, valid_until) of a fact with a suffix [until YYYY-MM-DD]; an impossible date leaves the text as it is."""
    suffix = r"\s*\[until (\d{4}-\d{2}-\d{2})\]\s*$"
    until = day_end(F.nullif(F.regexp_extract(fact, suffix, 1), F.lit("")))
    return F.when(until.isNotNull(), F.trim(F.regexp_replace(fact, suffix, ""))).otherwise(fact), until


def lenient_noon(text: Column) -> Column:
    """Y/M/D or Y-M-D at the start of a text, to noon of that day; null if there is none."""
    part = lambda i: F.lpad(F.regexp_extract(text, r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})", i), 2 if i > 1 else 4, "0")
    return day_start(F.concat_ws("-", part(1), part(2), part(3))) + DAY // 2


def relative_window(question: str, now: int | None) -> tuple[int, int] | None:
    """(from, to) epochs of 'this year', 'this month' or 'last/past N days/weeks/months/years' in a question."""
    if now is None:
        return None
    q, at = question.lower(), datetime.fromtimestamp(now, timezone.utc)
    if "this year" in q:
        return int(at.replace(month=1, day=1, hour=0, minute=0, second=0).timestamp()), now
    if "this month" in q:
        return int(at.replace(day=1, hour=0, minute=0, second=0).timestamp()), now
    m = re.search(r"\b(?:past|last)\s+(?:(\d+|" + "|".join(NUMBERS) + r")\s+)?(day|week|month|year)s?\b", q)
    if not m:
        return None
    n = 1 if m[1] is None else int(m[1]) if m[1].isdigit() else NUMBERS[m[1]]
    return int((at - timedelta(days=n * UNIT_DAYS[m[2]])).timestamp()), now


def intervals(events: list[tuple[str, int]], now: int | None = None) -> list[tuple[str, str, int, int, int]]:
    """(earlier, later, days, weeks, months) of each pair of a few dated events, and of each with today if given."""
    ordered = sorted(events, key=lambda e: (e[1], e[0])) + ([("today", now)] if now is not None else [])
    out = []
    for i, (a, s) in enumerate(ordered):
        for b, t in ordered[i + 1 :]:
            days = (t - s) // DAY
            out.append((a, b, days, days // 7, days // 30))
    return out


def window_of(question: Column, now: Column) -> Column:
    """(from, to) as a struct, as relative_window says; null without a window, without a question or now, or for a number too large to count."""
    q, at = F.lower(question), F.timestamp_seconds(now)
    asked = r"\b(?:past|last)\s+(?:(\d+|" + "|".join(NUMBERS) + r")\s+)?(day|week|month|year)s?\b"
    number, unit = F.regexp_extract(q, asked, 1), F.regexp_extract(q, asked, 2)
    pick = lambda key, values: F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in values.items()))
    n = F.when(number == "", 1).otherwise(F.coalesce(pick(number, NUMBERS), number.try_cast("int")))
    since = F.when(q.contains("this year"), F.unix_timestamp(F.date_trunc("year", at)))
    since = since.when(q.contains("this month"), F.unix_timestamp(F.date_trunc("month", at))).otherwise(now - n.cast("long") * pick(unit, UNIT_DAYS) * DAY)
    return F.when(since.isNotNull() & now.isNotNull(), F.struct(since.cast("long").alias("from"), now.cast("long").alias("to")))


def interval_pairs(events: DataFrame, *by: str, most: int = 12, now: int | None = None) -> DataFrame:
    """earlier, later (as text), days, weeks and months between any two of a list's first dated events (label, at), and from each to now if given.

    A list is what events have the same values of by (null is a value); it is a summary to be read, so it has its first so many
    events by time and label, and is never large. Events without a time are passed over.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("at", "label"))
    listed = events.where("at is not null").select(*by, F.col("label").cast("string").alias("label"), "at", place.alias("place")).where(F.col("place") <= most)
    ends = listed.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("label").alias("later"), F.col("at").alias("until"), F.col("place").alias("_place"))
    met = F.col("_place") > F.col("place")
    for c in by:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    pairs = listed.join(ends, met).select(*by, F.col("label").alias("earlier"), "later", (F.col("until") - F.col("at")).alias("seconds"))
    if now is not None:
        pairs = pairs.unionByName(listed.select(*by, F.col("label").alias("earlier"), F.lit("today").alias("later"), (F.lit(now) - F.col("at")).alias("seconds")))
    days = F.floor(F.col("seconds") / DAY)
    return pairs.select(*by, "earlier", "later", days.alias("days"), F.floor(days / 7).alias("weeks"), F.floor(days / 30).alias("months"))

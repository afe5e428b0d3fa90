"""Filter predicates as Columns. A negated leaf on a missing value is not a reason to drop a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TAG = "default"
#: Least scores of each search. Fixed values.
FLOORS = {"chunks": 0.30, "facts": 0.30, "fallback": 0.45, "rerank": 0.15, "reconcile": 0.75, "edges": 0.25, "events": 0.30}


@dataclass(frozen=True)
class Plan:
    """A search plan: what to look for, and constraints on source and capture time (epochs, both ends included)."""

    query: str
    source: str | None = None
    after: int | None = None
    before: int | None = None
    listy: bool = False

    @property
    def constrained(self) -> bool:
        return self.source is not None or self.after is not None or self.before is not None


def unless(condition: Column) -> Column:
    """True but where condition is true: null counts as not true."""
    return ~F.coalesce(condition, F.lit(False))


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def matches(must: tuple[Column, ...] = (), must_not: tuple[Column, ...] = (), should: tuple[Column, ...] = ()) -> Column:
    """All of must, none of must_not, and one of should if there is any; nulls are no match."""
    any_of = [reduce(lambda a, b: a | b, (F.coalesce(s, F.lit(False)) for s in should))] if should else []
    return every(*(F.coalesce(m, F.lit(False)) for m in must), *map(unless, must_not), *any_of)


def in_tag(tag: str, column: Column | None = None) -> Column:
    """Rows of a namespace; rows without one belong to the default namespace."""
    return in_scopes([tag], column)


def in_scopes(scopes: list[str], column: Column | None = None) -> Column:
    column = F.col("container_tag") if column is None else column
    scopes = list(scopes) or [DEFAULT_TAG]
    inside = column.isin(*scopes)
    return F.coalesce(inside, F.lit(DEFAULT_TAG in scopes))


def active(now: Column | int) -> Column:
    """Facts that are the latest, unexpired (still good at now itself) and not under review; missing values pass."""
    now = F.lit(now) if isinstance(now, int) else now
    return every(unless(~F.col("is_latest")), unless(F.col("valid_until") < now), unless(F.col("needs_review")))


def planned(plan: Plan) -> Column:
    found = [F.col("source") == plan.source] if plan.source is not None else []
    found += [F.col("captured_at") >= plan.after] if plan.after is not None else []
    found += [F.col("captured_at") <= plan.before] if plan.before is not None else []
    return matches(tuple(found))


def as_of(t: Column | int) -> Column:
    """Facts known and not yet superseded at t, and valid beyond it."""
    t = F.lit(t) if isinstance(t, int) else t
    after = lambda c: F.col(c).isNull() | (F.col(c) > t)
    return every(unless(F.col("needs_review")), F.col("learned_at") <= t, after("superseded_at"), after("valid_until"))

"""Tolerant parsing of what models answer. Plain functions, and Arrow UDFs over them for columns."""

from __future__ import annotations

import json
import re
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

# Kinds of facts; anything else is unknown.
KINDS = ("preference", "personal_fact", "project_fact", "policy", "decision", "task", "event", "claim", "quote", "relationship")
SOURCES = ("web", "chat", "meeting", "note", "file", "email")
LEAST_BYTES = 8


def _between(raw: str, opening: str, closing: str) -> Any:
    a, b = raw.find(opening), raw.rfind(closing)
    if a < 0 or b <= a:
        return None
    try:
        return json.loads(raw[a : b + 1])
    except ValueError:
        return None


def _statement(item: Any) -> str | None:
    if isinstance(item, str):
        return item
    if isinstance(item, dict):
        named = next((item[k] for k in ("statement", "fact", "text") if isinstance(item.get(k), str)), None)
        return named if named is not None else next((v for v in item.values() if isinstance(v, str)), None)
    return None


def facts(raw: str | None, cap: int = 10) -> list[str] | None:
    """Statements of an array of strings or objects; failing that, the quoted strings; None without any array or string."""
    parsed = _between(raw or "", "[", "]")
    if isinstance(parsed, list):
        found = [_statement(x) for x in parsed]
    else:
        found = [m.replace('\\"', '"') for m in re.findall(r'"((?:[^"\\]|\\.)*)"', raw or "")]
        if not found:
            return None
    clean = [s.strip() for s in found if s]
    return [s for s in clean if len(s.encode()) >= LEAST_BYTES][:cap]


def typed_facts(raw: str | None, cap: int = 10) -> list[dict] | None:
    """Facts with kind, confidence in 0 to 1 (0.5 by default) and evidence."""
    parsed = _between(raw or "", "[", "]")
    if not isinstance(parsed, list):
        plain = facts(raw, cap)
        return plain and [{"statement": s, "kind": "unknown", "confidence": 0.5, "evidence": None} for s in plain]
    out = []
    for item in parsed:
        statement = (_statement(item) or "").strip()
        if len(statement.encode()) < LEAST_BYTES:
            continue
        more = item if isinstance(item, dict) else {}
        kind = str(more.get("kind", "")).strip().lower()
        confidence = more.get("confidence")
        number = isinstance(confidence, (int, float)) and not isinstance(confidence, bool)
        evidence = more.get("evidence")
        out.append({"statement": statement, "kind": kind if kind in KINDS else "unknown", "confidence": min(1.0, max(0.0, float(confidence))) if number else 0.5, "evidence": evidence if isinstance(evidence, str) else None})
    return out[:cap]


def classifications(raw: str | None, n: int) -> list[dict]:
    """One verdict for each of n facts by its 1-based i; NEW, no reference and low confidence where there is none."""
    out = [{"relation": "NEW", "ref": 0, "confidence": "low"} for _ in range(n)]
    parsed = _between(raw or "", "[", "]")
    for item in parsed if isinstance(parsed, list) else ():
        i = item.get("i") if isinstance(item, dict) else None
        if isinstance(i, int) and 1 <= i <= n:
            relation = str(item.get("relation", "NEW")).upper()
            ref = item.get("ref")
            out[i - 1] = {"relation": relation if relation in ("NEW", "DUPLICATE", "UPDATE", "EXTEND") else "NEW", "ref": ref if isinstance(ref, int) and ref > 0 else 0, "confidence": "high" if str(item.get("confidence", "")).lower() == "high" else "low"}
    return out


def edges(raw: str | None, date: str | None) -> list[dict]:
    """Edges (subject, predicate, object, date, singular) of a model's answer; a missing or impossible date is the document's.

    Names become keys; an edge with an empty part is left out; singular is true unless the answer denies it.
    """
    parsed, out = _between(raw or "", "[", "]"), []
    for item in parsed if isinstance(parsed, list) else ():
        if not isinstance(item, dict):
            continue
        subject, predicate = (edge_key(str(item.get(k) or "")) for k in ("subject", "predicate"))
        object_ = str(item.get("object") or "").strip()
        if not (subject and predicate and object_):
            continue
        said = item.get("singular", True)
        singular = said.strip().lower() != "false" if isinstance(said, str) else said is not False
        out.append({"subject": subject, "predicate": predicate, "object": object_, "date": calendar_day(item.get("date")) or calendar_day(date), "singular": singular})
    return out


def edge_key(name: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", name.strip()).strip("_").lower()


def calendar_day(text: Any) -> str | None:
    """text if it is a day of the calendar as YYYY-MM-DD."""
    try:
        return datetime.strptime(text, "%Y-%m-%d").strftime("%Y-%m-%d") if isinstance(text, str) else None
    except ValueError:
        return None


def strings(raw: str | None) -> list[str]:
    parsed = _between(raw or "", "[", "]")
    return [s.strip() for s in parsed if isinstance(s, str) and s.strip()] if isinstance(parsed, list) else [m for m in re.findall(r'"([^"]+)"', raw or "")]


def dated_events(raw: str | None) -> list[tuple[str, str]]:
    parsed = _between(raw or "", "[", "]")
    rows = [(x.get("event"), x.get("date")) for x in parsed if isinstance(x, dict)] if isinstance(parsed, list) else []
    return [(e, d) for e, d in rows if isinstance(e, str) and isinstance(d, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d)]


def plan(raw: str | None, question: str, sources: tuple[str, ...] = SOURCES) -> dict:
    """A search plan; whatever is missing or wrong falls back on the question without constraints."""
    parsed = _between(raw or "", "{", "}")
    got = parsed if isinstance(parsed, dict) else {}
    text = lambda k: got[k].strip() if isinstance(got.get(k), str) and got[k].strip() else None
    date = lambda k: d if (d := text(k)) and re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", d) else None
    return {"query": text("query") or question, "source": s if (s := text("source")) in sources else None, "after": date("after"), "before": date("before"), "listy": got.get("listy") is True}


@F.pandas_udf(ArrayType(StringType()))
def facts_udf(raw: pd.Series) -> pd.Series:
    return raw.map(facts)


@F.pandas_udf(ArrayType(StructType().add("statement", StringType()).add("kind", StringType()).add("confidence", DoubleType()).add("evidence", StringType())))
def typed_facts_udf(raw: pd.Series) -> pd.Series:
    return raw.map(typed_facts)

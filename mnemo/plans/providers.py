"""What models do, as protocols, and deterministic stand-ins that need none."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemo.functions import parsing
from mnemo.operators.chunking import SEGMENT, paragraphs

#: Most facts of a segment and of a document. Fixed values.
SEGMENT_FACTS, DOCUMENT_FACTS = 10, 50
#: A fact as Spark's type.
FACT = "struct<statement:string,kind:string,confidence:double,evidence:string>"


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Distiller(Protocol):
    def distil(self, text: str) -> list[dict]: ...


class Merger(Protocol):
    def merge(self, statements: list[str]) -> list[str] | None:
        """The statements of a document's segments as one list without repetitions; nothing if it can't."""


class Judge(Protocol):
    def judge(self, facts: list[tuple[str, list[str]]]) -> list[dict]:
        """A verdict (relation, ref from 1, confidence) on each fact beside its stored neighbours, nearest first."""


class EdgeExtractor(Protocol):
    def edges(self, text: str, date: str | None) -> list[dict]: ...


class Summariser(Protocol):
    def summarise(self, part: str, statements: str) -> str: ...


class Reader(Protocol):
    def read(self, content: bytes, name: str) -> str | None:
        """The text of a file or image, or None."""


class Reranker(Protocol):
    def relevance(self, question: str, texts: list[str]) -> list[float]:
        """How well each text answers the question, 0 to 1."""


class Ocr(Reader, Protocol):
    """A reader of images and scanned documents."""


#: One completed prompt of a model.
Complete = Callable[[str], str]


class HashedWords:
    """Unit vectors of hashed lower-case words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in re.findall(r"\w{2,}", (text or "").lower()):
                v[zlib.crc32(word.encode()) % self.dim] += 1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return out


class Sentences:
    """A fact for each sentence of enough length."""

    def __init__(self, least: int = 20, most: int = 10):
        self.least, self.most = least, most

    def distil(self, text: str) -> list[dict]:
        found = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]", text or "")]
        return [{"statement": s, "kind": "claim", "confidence": 0.5, "evidence": s} for s in found if len(s) >= self.least][: self.most]


class SameWords:
    """Of statements with the same words, case and punctuation aside, the longest, where the first of them stood."""

    def merge(self, statements: list[str]) -> list[str]:
        best: dict[str, str] = {}
        for statement in statements:
            key = " ".join(re.findall(r"\w+", statement.lower()))
            if len(statement) > len(best.get(key, "")):
                best[key] = statement
        return list(best.values())


class SameKey:
    """Verdicts by rule: equal text is a duplicate, `key: other value` or `key is other value` an update, more words an extension."""

    def judge(self, facts: list[tuple[str, list[str]]]) -> list[dict]:
        return [self._one(fact, near) for fact, near in facts]

    def _one(self, fact: str, near: list[str]) -> dict:
        words, key = self._words(fact), self._key(fact)
        for relation, holds in (
            ("DUPLICATE", lambda n: self._words(n) == words),
            ("UPDATE", lambda n: key is not None and self._key(n) == key),
            ("EXTEND", lambda n: set(self._words(n)) < set(words)),
        ):
            for i, n in enumerate(near):
                if holds(n):
                    return {"relation": relation, "ref": i + 1, "confidence": "high"}
        return {"relation": "NEW", "ref": 0, "confidence": "low"}

    @staticmethod
    def _words(text: str) -> list[str]:
        return re.findall(r"\w+", text.lower())

    @staticmethod
    def _key(text: str) -> str | None:
        found = re.match(r"(.+?)(?::| is | lives in | works at )", text.lower())
        return found.group(0).strip() if found else None


class Triples:
    """Edges from lines `subject | predicate | object`, with ` | YYYY-MM-DD` and ` | event` where they apply."""

    def edges(self, text: str, date: str | None) -> list[dict]:
        rows = [[p.strip() for p in line.split("|")] for line in (text or "").split("\n") if line.count("|") >= 2]
        said = [{"subject": r[0], "predicate": r[1], "object": r[2], "date": next((x for x in r[3:] if x[:1].isdigit()), None), "singular": "event" not in r[3:]} for r in rows]
        return parsing.edges(json.dumps(said), date)


class Newest:
    """The statements themselves, newest first."""

    def summarise(self, part: str, statements: str) -> str:
        return statements


class Answers:
    """All of the above by one model that completes prompts; what can't be parsed counts as no answer."""

    def __init__(self, complete: Complete):
        self.complete = complete

    def distil(self, text: str) -> list[dict]:
        return parsing.typed_facts(self.complete(f"List the lasting facts of this text as a JSON array of statement, kind, confidence, evidence.\n{text}")) or []

    def merge(self, statements: list[str]) -> list[str] | None:
        listing = "\n".join(f"- {s}" for s in statements)
        return parsing.facts(self.complete(f"These facts are from parts of one document. Unite those that say the same, drop none that says something else, and answer with a JSON array of statements.\n{listing}"), DOCUMENT_FACTS)

    def judge(self, facts: list[tuple[str, list[str]]]) -> list[dict]:
        asked = [{"i": i + 1, "fact": fact, "stored": near} for i, (fact, near) in enumerate(facts)]
        raw = self.complete(f"For each fact say whether it is NEW, DUPLICATE, UPDATE or EXTEND of which stored one: a JSON array of i, relation, ref, confidence.\n{json.dumps(asked)}")
        return parsing.classifications(raw, len(facts))

    def edges(self, text: str, date: str | None) -> list[dict]:
        return parsing.edges(self.complete(f"List who stands in which relation to what, as a JSON array of subject, predicate, object, date, singular.\n{text}"), date)

    def summarise(self, part: str, statements: str) -> str:
        return self.complete(f"Sum up these {part} facts in a short paragraph.\n{statements}").strip()


def judged(statement: Column, neighbours: Column, judge: Judge) -> Column:
    """Verdicts, a call to a batch; facts without neighbours are NEW without a call, and so is a batch whose call fails."""

    @F.pandas_udf("struct<relation:string,ref:int,confidence:string>")
    def run(facts: pd.Series, near: pd.Series) -> pd.DataFrame:
        out = [{"relation": "NEW", "ref": 0, "confidence": "low"} for _ in facts]
        asked = [i for i, n in enumerate(near) if n is not None and len(n)]
        if asked:
            try:
                verdicts = judge.judge([(facts.iloc[i], list(near.iloc[i])) for i in asked])
            except Exception:  # a model's failure must not lose facts
                verdicts = []
            for i, verdict in zip(asked, verdicts, strict=False):
                out[i] = verdict
        return pd.DataFrame(out, columns=["relation", "ref", "confidence"])

    return run(statement, neighbours)


def extracted_edges(text: Column, date: Column, extractor: EdgeExtractor) -> Column:
    @F.pandas_udf("array<struct<subject:string,predicate:string,object:string,date:string,singular:boolean>>")
    def run(texts: pd.Series, dates: pd.Series) -> pd.Series:
        return pd.Series([extractor.edges(t, d) for t, d in zip(texts, dates, strict=True)], dtype=object)

    return run(text, date)


def embedded(text: Column, embedder: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(column.fillna("").tolist()))

    return run(text)


def distil_segments(text: str | None, distiller: Distiller) -> list[dict]:
    """The facts of each segment of one text in order, without statements alike but for case and edges; plans.facts does so for many.

    A failure on the first segment is raised; after one on a later segment the facts so far are kept.
    """
    segments, found = paragraphs(text or "", SEGMENT, 0), []
    for place, segment in enumerate(segments):
        try:
            found += (distiller.distil(segment) or [])[:SEGMENT_FACTS]
        except Exception:
            if not place:
                raise
            break
    if len(segments) > 1:
        first: dict[str, dict] = {}
        for fact in found:
            first.setdefault(fact["statement"].strip().lower(), fact)
        found = list(first.values())
    return found[:DOCUMENT_FACTS]

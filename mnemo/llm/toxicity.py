"""Toxicity: a counterfactual-regularised classifier.

Documents are sets of features: words (letters lower-cased) and their prefixes. A bounded, hash-chosen sample of labelled
documents selects the features that its likelihood ratio ties to the label; a logistic model over their presence is trained on
it in numpy. Wherever a labelled text names a group, training penalises the change of score that swapping the term for each other of
its kind, or for a neutral word, makes, so that naming a group neither raises nor lowers a score. As a corpus may name few groups or
only in attacks, the same penalty also holds for carriers: some words of each labelled text with a group's term in place of one of
them. A swap's change needs no label and carriers have none; the labels are those of the table and no others, and so are the
words that have weight.
For a linear model that change is a sum over the features that the swap removes
and adds, whatever else the text says, so equal changes are held once, weighted by the texts that make them; there are at most as
many as pairs of terms and ways in which their prefixes overlap with other words. Scoring reads whole texts; a document's log-odds is
the sum over its distinct features of the model.

Defined cases: null and empty texts have no feature and get the model's base score; null labels are not learned from; repeated
rows are scored each; other columns are never read. Without both classes in the sample the score is the share of label 1 (0.5
without any).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import MEMO_WORDS, arrow_map, held_out, texts
from mnemo.llm.quality import sample

THRESHOLD = 0.5

#: Group terms by kind; terms of a kind are swapped for each other. Fixed values.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary",
    "orientation": "gay lesbian bisexual straight queer heterosexual homosexual",
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic sikh",
    "origin": "black white asian african arab latino hispanic european american chinese indian mexican immigrant immigrants refugee refugees native",
    "ability": "disabled blind deaf autistic elderly old young",
    "de": "frauen m\u00e4nner muslime christen juden t\u00fcrken ausl\u00e4nder fl\u00fcchtlinge schwule lesben behinderte",
    "fr": "femmes hommes musulmans chr\u00e9tiens juifs arabes africains immigr\u00e9s r\u00e9fugi\u00e9s homosexuels handicap\u00e9s",
    "es": "mujeres hombres musulmanes cristianos jud\u00edos \u00e1rabes africanos inmigrantes refugiados homosexuales discapacitados",
}
KINDS = {term: kind for kind, terms in IDENTITY.items() for term in terms.split()}
#: Words without a group that any term is swapped for as well. Fixed values.
NEUTRAL = {"de": "leute", "fr": "gens", "es": "personas"}
#: Words of a carrier, at most.
CARRIER_WORDS = 12
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|-_"


@dataclass(frozen=True)
class Params:
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: A feature is selected if its G statistic reaches this, and most_features of them at most by it.
    least_g: float = 18.0
    most_features: int = 4096
    epochs: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    #: Weight of the squared change of score between a text and its counterfactual copies.
    fairness: float = 4.0
    #: Bounds of the training sample: documents, and characters of them in all.
    max_docs: int = 8000
    max_chars: int = 24_000_000


def features(word: bytes, p: Params) -> list[bytes]:
    """The word without punctuation at its edges, its letters A-Z lower-cased, and its prefixes by characters."""
    word = word.lower().strip(_EDGES)
    if not word:
        return []
    text = word.decode("utf-8", "replace")
    return [word, *((text[:n] + "*").encode("utf-8", "replace") for n in p.prefixes if len(text) >= n)]


def found_in(text: bytes, p: Params, memo: dict[bytes, list[bytes]]) -> set[bytes]:
    out: set[bytes] = set()
    for word in set(text.split()):
        if (f := memo.get(word)) is None:
            f = memo[word] = features(word, p)
        out.update(f)
    return out


def g_statistic(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a feature in a of pos and b of neg documents, signed: above 0 if it is commoner in the first."""
    total, seen = pos + neg, a + b

    def part(k, n, expected):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / expected), 0) + np.where(n - k > 0, (n - k) * np.log((n - k) / (n - expected)), 0)

    g = 2 * (part(a, pos, seen * pos / total) + part(b, neg, seen * neg / total))
    return np.where(a * neg >= b * pos, g, -g)


def carriers(examples: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, str]]:
    """For each text some of its words, one of which a term replaces, and the term; a hash of the text chooses. Labels aren't read."""
    terms = sorted(KINDS)
    for text, _ in examples:
        if words := text.split():
            h = zlib.crc32(text)
            start = h % max(1, len(words) - CARRIER_WORDS + 1)
            part, term = words[start : start + CARRIER_WORDS], terms[(h >> 8) % len(terms)]
            part[(h >> 16) % len(part)] = term.encode()
            yield b" ".join(part), term


def swapped(text: bytes, term: str, other: str) -> bytes:
    """The text, word by word, with other wherever it has term."""
    return b" ".join(other.encode() if w.lower().strip(_EDGES) == term.encode() else w for w in text.split())


def changes(text: bytes, term: str, column: dict[bytes, int], p: Params, memo: dict[bytes, list[bytes]]) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each counterfactual copy of the text: the model's features that it lacks and those that it has more, none where nothing changes."""
    kind = KINDS[term]
    rest = found_in(swapped(text, term, ""), p, memo)
    columns = lambda word: tuple(sorted(column[f] for f in features(word.encode(), p) if f in column and f not in rest))
    away = columns(term)
    out = []
    for other in (*IDENTITY[kind].split(), NEUTRAL.get(kind, "person")):
        if other != term:
            come = columns(other)
            pair = tuple(c for c in away if c not in come), tuple(c for c in come if c not in away)
            if any(pair):
                out.append(pair)
    return out


def train(examples: list[tuple[bytes, int]], p: Params = Params()) -> tuple[dict[bytes, float], float]:
    """The model: weights by feature, and the base log-odds."""
    labels = np.array([y for _, y in examples], np.float64)
    pos = int(labels.sum())
    neg = len(labels) - pos
    if not pos or not neg:
        share = min(max(pos / len(labels), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return {}, float(np.log(share / (1 - share)))
    counts: dict[bytes, list[int]] = {}
    memo: dict[bytes, list[bytes]] = {}
    # Toxic texts first: a feature that marks toxicity is in some toxic text.
    for y in (1, 0):
        for text, label in examples:
            if label == y:
                for f in found_in(text, p, memo):
                    if (c := counts.get(f)) is not None:
                        c[1 - y] += 1
                    elif y:
                        counts[f] = [1, 0]
                if len(memo) > MEMO_WORDS // 2:
                    memo.clear()
    names = [f for f, (a, b) in counts.items() if a >= 3]
    table = np.array([counts[f] for f in names], np.float64).reshape(-1, 2)
    g = g_statistic(table[:, 0], table[:, 1], pos, neg) if names else np.zeros(0)
    chosen = sorted(np.nonzero(g >= p.least_g)[0], key=lambda k: (-g[k], names[k]))[: p.most_features]
    column = {names[k]: i for i, k in enumerate(chosen)}
    for term in KINDS:  # always features, so that the penalty holds them
        column.setdefault(term.encode(), len(column))
    n = len(column)
    rows, cols, at = [], [], 0
    swaps: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()  # texts by the features a swap takes from them and gives them
    memo.clear()
    for text, _ in examples:
        own = found_in(text, p, memo)
        if len(memo) > MEMO_WORDS // 2:
            memo.clear()
        mine = [column[f] for f in own if f in column]
        rows += [at] * len(mine)
        cols += mine
        at += 1
        for term in sorted(t for f in own if (t := f.decode("utf-8", "replace")) in KINDS):
            swaps.update(changes(text, term, column, p, memo))
    for text, term in carriers(examples):
        swaps.update(changes(text, term, column, p, memo))
        if len(memo) > MEMO_WORDS // 2:
            memo.clear()
    rows_, cols_ = np.array(rows, np.int64), np.array(cols, np.int64)
    pairs = sorted(swaps)
    share = np.array([swaps[k] for k in pairs], np.float64) / max(1, sum(swaps.values()))
    sides = [(k, c, sign) for k, pair in enumerate(pairs) for sign, side in zip((-1.0, 1.0), pair) for c in side]
    pair_, col_, sign_ = (np.array([x[i] for x in sides], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    w, base = np.zeros(n), float(np.log(pos / neg))
    squares, base_squares = np.full(n, 1e-8), 1e-8
    weight = np.where(labels == 1, 0.5 / pos, 0.5 / neg)
    for _ in range(p.epochs):
        z = base + np.bincount(rows_, w[cols_], len(labels))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = np.bincount(cols_, err[rows_], n) + p.decay * w
        if pairs and p.fairness:
            change = np.bincount(pair_, sign_ * w[col_], len(pairs))
            grad += p.fairness * np.bincount(col_, sign_ * (share * change)[pair_], n)
        squares += grad**2
        base_squares += err.sum() ** 2
        w -= p.rate * grad / np.sqrt(squares)
        base -= p.rate * err.sum() / np.sqrt(base_squares)
    return {f: float(w[i]) for f, i in column.items() if w[i]}, float(base)


def score_documents(docs: DataFrame, model: tuple[dict[bytes, float], float], p: Params = Params()) -> DataFrame:
    """doc_id and score of every row of docs, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # most_features weights at most

    def start():
        weights, base = shared.value

        class Memo(dict):
            def __missing__(self, word: bytes) -> tuple[bytes, ...] | None:
                value = tuple(f for f in features(word, p) if f in weights) or None
                if len(word) <= 64:
                    self[word] = value
                return value

        memo = Memo()

        def logit(text: bytes | None) -> float:
            if not text:
                return base
            if len(memo) > MEMO_WORDS:
                memo.clear()
            hits = set(map(memo.__getitem__, text.split()))
            hits.discard(None)
            return base + sum(weights[f] for f in sorted({f for hit in hits for f in hit}))

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = np.clip(np.array([logit(t) for t in texts(batch)], np.float64), -30, 30)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

        return each

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", start)


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learned from the labels of documents that aren't held out."""
    model = train(sample(docs, labels, "toxic", p.max_docs, p.max_chars), p)
    return score_documents(docs, model, p).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

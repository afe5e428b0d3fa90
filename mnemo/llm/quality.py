"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed features (the word, its character n-grams with word
boundaries, by characters and not bytes); an adjacent repeat of a word counts as one more token with a vector of its own. A document's
vector is the mean over its tokens and an end token; a softmax layer turns it into class probabilities. Vectors and layer are
trained together by stochastic gradient descent in numpy on a bounded, hash-chosen sample of labelled documents. Because the
layer is linear, a trained model folds into one number per feature, so scoring is a sum over all words of the whole text.

Defined cases: null and empty texts have the end token alone, so they get that token's score; null labels and labels of unknown
documents are not learned from; a document with several labels counts by their mean, ties as 1; repeated rows are scored each;
columns other than doc_id and text are never read, and keep_good passes them on. Without both
classes in the sample the score is the share of label 1 in it (0.5 without any).
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import MEMO_WORDS, arrow_map, held_out, texts, trim

THRESHOLD = 0.3
_END, _REPEAT = 0, 1
_RESERVED = 2


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 17
    dim: int = 8
    shortest: int = 2
    longest: int = 4
    epochs: int = 5
    rate: float = 0.1
    #: Bounds of the training sample: documents, and characters of them in all.
    max_docs: int = 4000
    max_chars: int = 10_000_000
    seed: int = 7


def features(word: bytes, p: Params) -> np.ndarray:
    """Buckets of a word: itself and the n-grams of its characters between boundary marks."""
    marked = b"<" + word + b">"
    span = p.buckets - _RESERVED
    at = starts(marked)
    found = [zlib.crc32(marked)]
    for n in range(p.shortest, p.longest + 1):
        found += [zlib.crc32(marked[a:b], n) for a, b in zip(at, at[n:])]
    return np.array(found, np.int64) % span + _RESERVED


def starts(text: bytes) -> range | list[int]:
    """Where the characters of UTF-8 bytes start, and where they end."""
    return range(len(text) + 1) if text.isascii() else [*(i for i, byte in enumerate(text) if byte & 0xC0 != 0x80), len(text)]


def document(words: list[bytes], memo: dict[bytes, np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """A document as (features, weights); the weights sum to 1."""
    repeats = sum(map(operator.eq, words, words[1:]))
    tokens = len(words) + repeats + 1
    found, weights = [np.array([_END, _REPEAT])], [np.array([1.0, repeats]) / tokens]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, n in counts.items():
        if (f := memo.get(w)) is None:
            f = memo[w] = features(w, p)
        found.append(f)
        weights.append(np.full(len(f), n / tokens / len(f)))
    every, each = np.concatenate(found), np.concatenate(weights)
    unique, inverse = np.unique(every, return_inverse=True)
    return unique.astype(np.int32), np.bincount(inverse, each)


def train(examples: list[tuple[bytes, int]], p: Params = Params()) -> np.ndarray:
    """The folded model: for each feature its contribution to the log-odds of label 1."""
    labels = np.array([y for _, y in examples], np.int64)
    if len(set(labels.tolist())) < 2:
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        return np.full(p.buckets, np.log(share / (1 - share)), np.float32)
    memo: dict[bytes, np.ndarray] = {}
    docs = []
    for text, _ in examples:
        docs.append(document(text.split(), memo, p))
        if len(memo) > MEMO_WORDS // 4:
            memo.clear()
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim)).astype(np.float32)
    layer = np.zeros((2, p.dim), np.float32)
    total, step = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(docs)):
            f, w = docs[i]
            rate = p.rate * (1 - step / total)
            step += 1
            hidden = w.astype(np.float32) @ vectors[f]
            logits = layer @ hidden
            prob = np.exp(logits - logits.max())
            prob /= prob.sum()
            prob[labels[i]] -= 1
            back = prob @ layer
            layer -= rate * np.outer(prob, hidden)
            # A feature's step is divided by its weight's scale, so that rare n-grams learn as fast as the mean of a document moves.
            vectors[f] -= rate * (w * len(f)).clip(0, 10).astype(np.float32)[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32)


def learned(docs: DataFrame, labels: DataFrame, p: Params) -> np.ndarray:
    """The model of the labelled documents; what learning held of the driver's memory is given back, as the driver goes on for long."""
    model = train(sample(docs, labels, "quality", p.max_docs, p.max_chars), p)
    trim()
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_chars: int) -> list[tuple[bytes, int]]:
    """Labelled texts for a learner, never of held-out documents: the first max_docs in the order of a hash of doc_id, as far as max_chars go."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    picked = docs.select("doc_id", "text").where("doc_id is not null and text is not null").join(F.broadcast(chosen), "doc_id")
    sized = picked.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).select("doc_id", "n", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    sizes = sorted(sized.collect(), key=lambda r: (r.h, r.doc_id))  # max_docs rows at most
    within, used = [], 0
    for row in sizes:
        if used + row.n <= max_chars:
            within.append(row.doc_id)
            used += row.n
    if not within:
        return []
    keep = docs.sparkSession.createDataFrame([(i,) for i in within], "doc_id long")
    rows = picked.join(F.broadcast(keep), "doc_id").select("doc_id", "text", "y").distinct().collect()
    return [(r.text.encode("utf-8", "surrogatepass"), r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def logits(weights: np.ndarray, p: Params):
    """A function from a batch to the log-odds of its texts; it remembers words' values from batch to batch."""

    own, span, crc32 = weights[_RESERVED:].tolist(), p.buckets - _RESERVED, zlib.crc32

    class Memo(dict):
        def __missing__(self, word: bytes) -> float:
            # The mean of the word's features, as features() has them.
            marked = b"<" + word + b">"
            total, count = own[crc32(marked) % span], 1
            at = starts(marked)
            for n in range(p.shortest, p.longest + 1):
                for a, b in zip(at, at[n:]):
                    total += own[crc32(marked[a:b], n) % span]
                count += max(0, len(at) - n)
            value = total / count
            if len(word) <= 64:
                self[word] = value
            return value

    memo, end, repeat = Memo(), float(weights[_END]), float(weights[_REPEAT])

    def of(batch: pa.RecordBatch) -> np.ndarray:
        found = []
        for text in texts(batch):
            words = text.split() if text else []
            if len(memo) > MEMO_WORDS:
                memo.clear()
            repeats = sum(map(operator.eq, words, words[1:]))
            found.append((sum(map(memo.__getitem__, words)) + repeats * repeat + end) / (len(words) + repeats + 1))
        return np.array(found, np.float64)

    return of


def score_documents(docs: DataFrame, model: np.ndarray, p: Params = Params()) -> DataFrame:
    """doc_id and score of every row of docs, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * 4 bytes, whatever the corpus

    def start():
        of = logits(shared.value, p)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(of(batch), -30, 30))))], ["doc_id", "score"])

    return arrow_map(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", start)


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by a model learned from the labels of documents that aren't held out."""
    model = learned(docs, labels, p)
    return score_documents(docs, model, p).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject.

    The verdict is computed beside the row, in the same pass: no join by doc_id, so repeated ids keep their own verdicts.
    """
    model = learned(docs, labels, p)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cut = np.log(threshold / (1 - threshold))

    def start():
        of = logits(shared.value, p)
        return lambda batch: batch.filter(pa.array(of(batch) >= cut))

    return arrow_map(docs, docs.schema, start)

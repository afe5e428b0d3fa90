"""Substring dedup: difference-cover anchors.

A window of 50 words that also starts in a document with a smaller doc_id is a repeat; words covered by repeats go. Comparing all
windows would move every position of the corpus, so only those at the positions of a difference cover modulo 31 are hashed over
20 words: for any two starts of equal 50-word windows, some shift below 31 brings both to cover positions, and the 20 words there
lie inside both windows. So every repeat shares an aligned anchor, at 6 of 31 positions. Anchors seen in two different texts are
extended: the windows that contain one are hashed in full (two independent 64-bit polynomials), each window's smallest doc_id is
found, and a window is covered where that is smaller than its own.

Rows per hash are combined before they are shuffled and a document sends a hash once, with its first position (its other positions
are found again where its text is read), so neither a passage in a third of all documents nor a word repeated a million times makes
a hot task; exact copies of a text are settled by their digest alone. No group is ever listed.

Defined cases: null and empty texts have no words (kept digest of the empty string); documents of fewer than 50 words lose nothing;
a null doc_id is never smaller than another, and such documents lose nothing; rows alike in doc_id don't cover each other; other
columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, Windows, WordHashes, arrow_map, small, texts

WINDOW = 50
#: A perfect difference set: every residue modulo PERIOD is a difference of two members. Fixed values.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
_SECOND = 0xD6E8FEB86659FD93


class _Reader:
    """Hashes of a text's anchors and windows."""

    def __init__(self):
        self.words, self.second, self.one, self.two = WordHashes(), WordHashes(seed=1), Windows(), Windows(_SECOND)
        self.cover = np.zeros(PERIOD, bool)
        self.cover[list(COVER)] = True

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the anchors."""
        found = self.one.hashes(self.words.of(words), ANCHOR)
        at = np.nonzero(self.cover[np.arange(len(found)) % PERIOD])[0].astype(np.int32)
        return found[at], at

    def windows(self, words: list[bytes]) -> np.ndarray:
        return self.one.hashes(self.words.of(words), WINDOW)

    def windows_again(self, words: list[bytes]) -> np.ndarray:
        """The independent second hash of each window."""
        return self.two.hashes(self.second.of(words), WINDOW)


def anchors(docs: DataFrame) -> DataFrame:
    """h, doc_id and first: the anchors of each document, each with its first position."""

    def start():
        read = _Reader()

        def each(batch: pa.RecordBatch):
            h, d, p = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                values, at = read.anchors(words)
                values, first = np.unique(values, return_index=True)
                h.append(values)
                d.append(np.full(len(values), doc, np.int64))
                p.append(at[first])
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(d)), pa.array(np.concatenate(p))], ["h", "doc_id", "first"])

        return each

    return arrow_map(docs.select("doc_id", "text"), "h long, doc_id long, first int", start)


def windows_at(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, text_id and start of each 50-word window with an anchor like those at places; of equal ones in a document the first."""

    def start():
        read = _Reader()

        def each(batch: pa.RecordBatch):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, text_id, places, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), texts(batch)):
                words = text.split()
                count = len(words) - WINDOW + 1
                if count <= 0:
                    continue
                values, at = read.anchors(words)
                firsts = places.values.to_numpy(zero_copy_only=False)
                # Places come by doc_id; a row alike in doc_id with another text may be shorter.
                known = np.searchsorted(at, firsts[firsts <= at[-1]])
                at = at[np.isin(values, values[known])]
                edge = np.zeros(len(words) + PERIOD + 1, np.int32)
                np.add.at(edge, np.maximum(at - (PERIOD - 1), 0), 1)
                np.add.at(edge, at + 1, -1)
                starts = np.nonzero(np.cumsum(edge)[:count] > 0)[0].astype(np.int32)
                one, first = np.unique(read.windows(words)[starts], return_index=True)
                starts = starts[first]
                for column, value in zip(out, (one, read.windows_again(words)[starts], np.full(len(one), doc, np.int64), np.full(len(one), text_id, np.int64), starts)):
                    column.append(value)
            if out[0]:
                h1, h2, doc_ids, text_ids, starts = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(doc_ids), pa.array(text_ids), pa.array(starts)], ["h1", "h2", "doc_id", "text_id", "start"])

        return each

    return arrow_map(docs.select("doc_id", "text_id", "places", "text"), "h1 long, h2 long, doc_id long, text_id long, start int", start)


def _in_runs(lists: DataFrame) -> DataFrame:
    """doc_id, text_id and runs (first, length, first, length, ...) of the integers in starts."""

    def start():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs = []
            for starts in batch.column(2):
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                edges = np.nonzero(np.concatenate([[True], np.diff(at) != 1]))[0]
                runs.append(np.stack([at[edges], np.diff(np.append(edges, len(at)))], 1).ravel().tolist())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int32()))], ["doc_id", "text_id", "runs"])

        return each

    return arrow_map(lists.select("doc_id", "text_id", "starts"), "doc_id long, text_id long, runs array<int>", start)


def digest(docs: DataFrame) -> DataFrame:
    """The result rows of documents with the first starts of their covered windows (column runs, null if none) and whether all their windows are (copy)."""

    def start():
        read = _Reader()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, removed, sha = [], [], []
            for runs, copy, text in zip(batch.column(1), batch.column(2).to_pylist(), texts(batch)):
                words = text.split() if text else []
                n.append(len(words))
                kept = words
                if len(words) >= WINDOW and copy:
                    kept = []
                elif len(words) >= WINDOW and runs.is_valid:
                    firsts = np.concatenate([np.arange(a, a + k) for a, k in runs.values.to_numpy(zero_copy_only=False).reshape(-1, 2).tolist()])
                    found = read.windows(words)
                    at = np.nonzero(np.isin(found, found[firsts]))[0]
                    edge = np.zeros(len(words) + 1, np.int32)
                    edge[at] += 1
                    edge[at + WINDOW] -= 1
                    covered = np.cumsum(edge)[:-1] > 0
                    kept = [words[i] for i in np.nonzero(~covered)[0].tolist()]
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

        return each

    return arrow_map(docs.select("doc_id", "runs", "copy", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string", start)


def _marked(docs: DataFrame) -> DataFrame:
    digest_ = F.md5(F.col("text").cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_.alias("digest"), F.conv(F.substring(digest_, 1, 15), 16, 10).cast("long").alias("text_id"), "text")


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_id, runs (of first starts of covered windows) and copy (all windows are covered), for the documents that have any."""
    marked = _marked(docs.where("doc_id is not null and text is not null"))
    own = ["doc_id", "text_id"]

    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = scratch.table(firsts, "firsts")
    copies = marked.select(*own, "digest").join(small(firsts, firsts.count(), 80), "digest").where("doc_id > first").select(*own).distinct()
    copies = scratch.table(copies, "copies")
    rest = marked.join(small(copies, copies.count(), 40), own, "left_anti")

    every = scratch.table(anchors(rest), "anchors", compression="zstd")  # texts are hashed for them once
    shared = scratch.table(every.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h"), "shared")
    scratch.release()
    hit = every.join(shared.hint("merge"), "h").groupBy("doc_id").agg(F.sort_array(F.collect_list("first")).alias("places"))
    places = scratch.table(hit, "places")
    scratch.drop("shared", "anchors")
    scratch.release()

    windows = scratch.table(windows_at(rest.join(_fitting(places, "places"), "doc_id")), "windows")
    scratch.drop("places")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = scratch.table(least, "least")
    scratch.release()
    covered = windows.join(least.hint("merge"), ["h1", "h2"]).where("doc_id > least").groupBy(*own).agg(F.collect_list("start").alias("starts"))
    covered = _in_runs(covered).withColumn("copy", F.lit(False))
    out = scratch.table(covered.unionByName(copies.select(*own, F.lit(None).cast("array<int>").alias("runs"), F.lit(True).alias("copy"))), "out")
    scratch.drop("firsts", "copies", "windows", "least")
    scratch.release()
    return out


def _fitting(df: DataFrame, column: str) -> DataFrame:
    """A written table of integer lists, for broadcast if all of it is small."""
    rows, values = df.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size(column), F.lit(0))), F.lit(0))).first()
    return small(df, 1, int(values) * 4 + rows * 80)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    found = _fitting(repeats(docs, Scratch(docs.sparkSession, "substring")), "runs")
    id_type = docs.schema["doc_id"].dataType
    met = _marked(docs).join(found, ["doc_id", "text_id"], "left").select(F.col("doc_id").cast(id_type).alias("doc_id"), "runs", "copy", "text")
    return digest(met)

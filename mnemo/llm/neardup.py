"""MinHash near-dedup on fast similarity sketches.

A document's set is its distinct five-word shingles, ASCII letters lower-cased. The sketch has COORDINATES bins filled in rounds:
in round i every shingle is hashed to a bin and a value, and a bin keeps the least (round, value) it gets, so later rounds only fill
what is empty; from round COORDINATES on, round COORDINATES + b sends every shingle to bin b, so each coordinate fills however
small the set. Coordinates then agree with the probability of the Jaccard similarity and concentrate as well as independent ones.
Bands of ROWS coordinates are hash keys; at a similarity of 0.75 a pair misses all 60 bands of 5 with a probability of 1e-7.

Documents with equal sets are one class. Every pair of classes that shares a band's key is a candidate, and what counts is which
classes end up connected, so a candidate whose ends are connected already needs no look. Each class is verified against a pivot: of the
smallest classes of its keys the one it shares most keys with; then, where a key still has classes of several components, against a
class of another component. Nearly all copies are settled by these linear passes. For keys that are still open all pairs are verified
on full sets, in blocks of bounded size: a pair of blocks is one group of rows, its intersections are a matrix product, and it
returns a spanning forest of its links. A large component has blocks of its own, which never meet each other. So no candidate is
lost, exact copies never multiply, pairs are not emitted for being in a group, and what a task holds is bounded. Links make the
final components. What stays quadratic is a set of classes that share open keys and are linked by no pivot: in blocks, n^2 / 1024^2 of them.

Defined cases: null and empty texts and those of white space have the empty set, link with nothing and are kept; fewer than five
words make one shingle of all; a null doc_id is dropped from linking, is its own component (null) and kept; rows alike in doc_id
are told apart by their sets, each has the component of its own set, and components that have the same smallest doc_id stay two;
other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch, Windows, WordHashes, arrow_map, components, mix, small, texts

SHINGLE = 5
COORDINATES, ROWS = 300, 5
BANDS = COORDINATES // ROWS
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Bounds of a block: documents, and shingles of them in all (a document alone may have more).
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
#: Classes that meet one copy of their pivot in a group of rows: a product with one row gains nothing from more.
STAR_DOCS = 128
_U = np.uint64


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self):
        self.hashes, self.windows = WordHashes(), Windows()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, _U)
        values = self.hashes.of(words)
        # A short text's one shingle is as long as it is; its length keeps it apart from others.
        return np.unique(self.windows.hashes(values, min(SHINGLE, len(values))) + _U(max(0, SHINGLE - len(values))))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: t values of 64 bits, round above hash."""
    out = np.full(t, np.iinfo(np.uint64).max, _U)
    first, n = 0, len(shingles)
    # What a batch of rounds computes beyond the round that fills all bins changes nothing: later rounds lose to earlier ones.
    batch = max(1, min(t, -(-int(t * 6) // n)))
    while first < t:
        rounds = np.arange(first, min(t, first + batch), dtype=_U)
        h = mix(shingles[None, :] ^ mix((rounds + _U(1)) * _U(0x9E3779B97F4A7C15))[:, None])
        bins = ((h >> _U(32)) * _U(t)) >> _U(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << _U(32)) | (h & _U(0xFFFFFFFF))).ravel())
        first += len(rounds)
        if (out >> _U(32)).max() < t:
            return out
    for b in np.nonzero(out >> _U(32) > t)[0]:
        h = mix(shingles ^ mix(np.array([t + b + 1], _U) * _U(0x9E3779B97F4A7C15)))
        out[b] = (_U(t + b) << _U(32)) | (h & _U(0xFFFFFFFF)).min()
    return out


def bands(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of the sketch; the band's place is part of it."""
    m = mix(coordinates).reshape(-1, rows)
    keys = np.arange(1, len(m) + 1, dtype=_U) * _U(0xD1B54A32D192ED03)
    for c in range(rows):
        keys = mix(keys ^ m[:, c])
    return keys


def text_id() -> Column:
    """Tells rows alike in doc_id apart by their text."""
    return F.xxhash64("text")


def identity(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    x, y = mix(shingles ^ _U(0x2545F4914F6CDD1D)), mix(shingles + _U(0x632BE59BD9B4E019))
    return int(np.add.reduce(x).view(np.int64)), int(np.add.reduce(y).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text), n_shingles, set_a and set_b (128 bits that tell sets apart; null for the empty set) and bands (null likewise)."""

    def start():
        shingles = Shingler()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, keys, lengths = [], [], [], [], []
            for text in texts(batch):
                s = shingles(text)
                n.append(len(s))
                lengths.append(BANDS if len(s) else 0)
                if not len(s):
                    a.append(None)
                    b.append(None)
                    continue
                x, y = identity(s)
                a.append(x)
                b.append(y)
                keys.append(bands(sketch(s)))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), lists], ["doc_id", "text_id", "n_shingles", "set_a", "set_b", "bands"])

        return each

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_id().alias("text_id"), "text")
    return arrow_map(rows, "doc_id long, text_id long, n_shingles long, set_a long, set_b long, bands array<long>", start)


def links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, or of those across if side has both 0 and 1: pairs of places."""
    across = 0 < side.sum() < len(side)
    left = np.nonzero(side == 0)[0] if across else np.arange(len(sets))
    right = np.nonzero(side == 1)[0] if across else left
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1  # what one set alone has is in no intersection
    owner, inverse = owner[shared], inverse[shared]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    inverse = np.cumsum(np.concatenate([[0], np.diff(inverse) != 0])) if len(inverse) else inverse
    total = int(inverse[-1]) + 1 if len(inverse) else 0
    inter = np.zeros((len(left), len(right)), np.float64)
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
    wide = max(256, 4_000_000 // len(sets))
    for low in range(0, total, wide):
        a, b = np.searchsorted(inverse, [low, low + wide])
        o, v = owner[a:b], inverse[a:b] - low
        one = np.zeros((len(left), min(wide, total - low)), np.float32)
        mine = row_of[o] >= 0
        one[row_of[o[mine]], v[mine]] = 1
        if across:
            two = np.zeros((len(right), one.shape[1]), np.float32)
            mine = col_of[o] >= 0
            two[col_of[o[mine]], v[mine]] = 1
        else:
            two = one
        inter += one @ two.T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    linked = 100 * inter >= percent * union
    root = np.arange(len(sets))
    out = []
    for i, place in enumerate(left):
        near = right[linked[i]]
        near = near[near != place]
        for r in np.unique(root[near]):
            if r != root[place]:
                out.append((int(place), int(near[root[near] == r][0])))
        if len(near):
            merged = np.union1d(root[near], root[place])
            root[np.isin(root, merged)] = merged[0]
    return out


def verify(blocks: DataFrame) -> DataFrame:
    """Links (a, b) found in rows (cluster, i, j, side, class, shingles) that are partitioned and sorted by cluster, i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        ids: list[int] = []
        sides: list[int] = []
        sets: list[np.ndarray] = []

        def flush() -> list[tuple[int, int]]:
            if len(ids) < 2 or (held[1] != held[2] and len(set(sides)) < 2):
                return []
            return [(ids[a], ids[b]) for a, b in links(sets, np.array(sides))]

        for batch in batches:
            found = []
            for *key, side, one, s in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if tuple(key) != held:
                    if held:
                        found += flush()
                    held = tuple(key)
                    ids, sides, sets = [], [], []
                ids.append(one)
                sides.append(side)
                sets.append(np.frombuffer(s, _U))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held and (found := flush()):
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = blocks.select("cluster", "i", "j", "side", "class", "shingles").repartition("cluster", "i", "j")
    return dealt.sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """class, n_shingles and shingles (as bytes) of the rows (class, set_a, set_b, text) whose text has the class's set."""

    def start():
        shingles = Shingler()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out: list[list] = [[], [], []]
            for one, a, b, text in zip(*(batch.column(i).to_pylist() for i in range(3)), texts(batch)):
                s = shingles(text)
                if len(s) and identity(s) == (a, b):
                    for column, value in zip(out, (one, len(s), s.tobytes())):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["class", "n_shingles", "shingles"]) if out[0] else None

        return each

    return arrow_map(docs.select("class", "set_a", "set_b", "text"), "class long, n_shingles long, shingles binary", start)


def _parts(docs: str, shingles: str, most: int) -> Column:
    """Blocks for so many classes, most in one, with so many shingles in all."""
    return F.greatest(F.ceil(F.col(docs) / most), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _by_pivots(pairs: DataFrame, sets: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links between classes and their pivots, for rows (class, pivot), one per key they share: each class meets the pivot it shares most keys with."""
    counted = pairs.groupBy("class", "pivot").agg(F.count("*").alias("shared"))
    chosen = counted.groupBy("class").agg(F.min(F.struct((-F.col("shared")).alias("minus"), "pivot"))["pivot"].alias("pivot"))
    chosen = scratch.table(chosen, f"{name}-chosen")
    met = chosen.join(sets.select("class", "n_shingles"), "class")
    stars = met.groupBy("pivot").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")).select("pivot", _parts("n", "all", STAR_DOCS).alias("parts"))
    # A pivot's members are dealt to bounded groups, and the pivot goes to each of them.
    members = chosen.join(stars, "pivot").select(F.col("pivot").alias("cluster"), F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("i"), F.lit(1).alias("side"), "class")
    centres = stars.select(F.col("pivot").alias("cluster"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.lit(0).alias("side"), F.col("pivot").alias("class"))
    rows, n = scratch.counted(members.unionByName(centres).withColumn("j", F.lit(-1)), name)
    scratch.drop(f"{name}-chosen")
    return verify(sets.select("class", "shingles").join(small(rows, n, 48), "class"))


def _by_blocks(hits: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links among the classes of rows (key, class, comp), of all pairs that share a key and aren't of one component comp."""
    firsts = hits.groupBy("key").agg(F.min("class").alias("first"))
    chains = components(hits.join(firsts, "key").select(F.col("class").alias("a"), F.col("first").alias("b")), scratch, "chains")
    placed = hits.select("class", "comp").distinct().join(chains.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class").join(sets.select("class", "n_shingles"), "class")
    placed = scratch.table(placed, "placed")
    sized = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all"))
    big = (F.col("n") >= BLOCK_DOCS) | (F.col("all") >= BLOCK_SHINGLES)
    sized = scratch.table(sized.withColumn("group", F.when(big, F.col("comp")).otherwise(-1)), "sized")
    groups = sized.groupBy("cluster", "group").agg(F.sum("n").alias("n"), F.sum("all").alias("all")).withColumn("parts", _parts("n", "all", BLOCK_DOCS))
    order = Window.partitionBy("cluster").orderBy("group")  # a row for each large component of a cluster, at most one for each block
    groups = groups.withColumn("low", F.coalesce(F.sum("parts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    groups = groups.withColumn("blocks", F.sum("parts").over(Window.partitionBy("cluster")).cast("int")).select("cluster", "group", "parts", "low", "blocks")
    rows = placed.join(sized.select("cluster", "comp", "group"), ["cluster", "comp"]).join(groups, ["cluster", "group"])
    rows = rows.withColumn("own", (F.col("low") + F.pmod(F.xxhash64("class"), F.col("parts"))).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    same = (F.col("group") >= 0) & (F.col("other") >= F.col("low")) & (F.col("other") < F.col("low") + F.col("parts"))
    rows = rows.where(~same).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "class")
    rows, n = scratch.counted(rows, "pairs")
    return verify(sets.select("class", "shingles").join(small(rows, n, 48), "class"))


def grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_id, n_shingles, root (of the component, null for a set that is alone) and component_id of each row of docs."""
    seen = scratch.table(sketches(docs), "seen")
    some = seen.where("doc_id is not null and n_shingles > 0")
    classes = some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count("*").alias("copies"))
    classes = scratch.table(classes.select(F.monotonically_increasing_id().alias("class"), "set_a", "set_b", "copies", "first.*"), "classes")

    keys = classes.select("class", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.min("class").alias("pivot"), F.max("class").alias("last")).where("pivot < last").drop("last")
    met, n = scratch.counted(met, "met")
    hits = scratch.table(keys.join(small(met, n, 40), "key"), "hits")
    scratch.release()
    wanted, n = scratch.counted(hits.select("class").distinct().join(classes.select("class", "doc_id", "set_a", "set_b"), "class"), "wanted")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(small(wanted, n, 80), "doc_id")
    sets = scratch.table(shingle_sets(read), "sets")
    scratch.drop("met", "wanted")

    edges = scratch.table(_by_pivots(hits.where("class <> pivot").select("class", "pivot"), sets, scratch, "stars-0"), "links-0")
    for step in (1, 2, 3):
        comps = components(edges, scratch, f"comps-{step}").select(F.col("node").alias("class"), "root")
        if step == 3:
            break
        at = hits.select("key", "class").join(comps, "class", "left").select("key", "class", F.coalesce("root", "class").alias("comp"))
        at = scratch.table(at, f"at-{step}")
        ends = F.min(F.struct("comp", "class")).alias("low"), F.max(F.struct("comp", "class")).alias("high")
        still, n = scratch.counted(at.groupBy("key").agg(*ends).where("low.comp < high.comp"), f"open-{step}")
        if not n:
            break
        if step == 1:
            # Classes outside the high component meet its class, those of it the low one.
            pairs = at.join(small(still, n, 60), "key").select("class", F.when(F.col("comp") == F.col("high.comp"), F.col("low.class")).otherwise(F.col("high.class")).alias("pivot"))
            more = _by_pivots(pairs, sets, scratch, "stars-1")
        else:
            more = _by_blocks(at.join(small(still.select("key"), n, 24), "key", "left_semi"), sets, scratch)
        # What is connected already is a link to its root, so the next components start from stars.
        edges = comps.select(F.col("class").alias("a"), F.col("root").alias("b")).union(scratch.table(more, f"links-{step}"))
    roots = comps

    linked = classes.select("class", "set_a", "set_b", "doc_id", "copies").join(small(roots, roots.count(), 32), "class", "left")
    linked = scratch.table(linked.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "class")), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member, n = scratch.counted(linked.join(least, "root").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "root", "component_id"), "member")
    out = seen.select("doc_id", "text_id", "n_shingles", "set_a", "set_b").join(small(member, n, 64), (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & F.col("doc_id").isNotNull(), "left")
    scratch.drop("classes", "hits", "sets", "at-1", "at-2", "open-1", "open-2", "links-0", "links-1", "links-2", "stars-0", "stars-1", "pairs", "chains", "placed", "sized", "linked", "comps-1", "comps-2", "comps-3")
    scratch.release()
    return out.select("doc_id", "text_id", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    found = grouped(docs, Scratch(docs.sparkSession, "neardup"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: one of its smallest doc_id. Rows with a null doc_id all stay.

    A row is judged by its doc_id and its text: of rows alike in doc_id those of different components stay, of several texts of one
    component the one of the least hash, and of rows alike in both one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "representatives")
    found = scratch.table(grouped(docs, scratch).where("doc_id is not null").groupBy("doc_id", "text_id", "root", "component_id").agg(F.count("*").alias("n")), "found")
    kept = found.where("doc_id = component_id and root is not null").groupBy("root").agg(F.min("text_id").alias("least"))
    judged = found.join(kept, "root", "left").withColumn("gone", (F.col("doc_id") != F.col("component_id")) | F.coalesce(F.col("text_id") != F.col("least"), F.lit(False)))
    judged, n = scratch.counted(judged.where("gone or n > 1").select(F.col("doc_id").alias("id_"), F.col("text_id").alias("text_"), "gone"), "judged", F.col("gone"))
    scratch.drop("seen", "member", "found")
    same = (F.col("doc_id").cast("long") == F.col("id_")) & (text_id() == F.col("text_"))
    gone, twice = judged.where("gone").drop("gone"), judged.where("not gone").drop("gone")
    left = docs.join(small(gone, n, 40), same, "left_anti")
    n = twice.count()
    if not n:
        return left
    # Repeated rows are rare and met only here; alike rows go through one aggregate, not a window over all texts.
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    row = F.struct(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
    again = left.join(small(twice, n, 40), same, "left_semi").select(F.col("doc_id").alias("k"), text_id().alias("t"), row.alias("row"))
    one = again.groupBy("k", "t").agg(F.first("row").alias("row")).select(*(F.col(f"row.{v}").alias(c) for c, v in names.items()))
    return left.join(small(twice, n, 40), same, "left_anti").unionByName(one)

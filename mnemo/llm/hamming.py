"""Exact top-k search over binary codes: incremental multi-index hashing.

An embedding's code is the signs of its coordinates, 64 to a word. The code is cut into segments of at most log2(rows) bits (longer
ones would make probes that mostly find nothing); an index has each distinct code once per segment, by the segment's value. In round r
every open query probes, in each segment, all values at a distance of r from its own. Two codes that differ in at most m * r + a bits
(m segments) differ by at most r in one of the segments 0 to a or by less than r in a later one, so once round r has probed those,
everything up to that distance has been seen. The kth distance verified in earlier rounds is a bound on the true one: a query
probes no segment beyond the a that covers its bound, and no pair beyond the bound leaves the join. A query closes once its kth
verified distance is covered. Rounds go on until all are closed, at the latest when r is a segment's length; results are exact.

Equal codes are one class that keeps its k smallest ids, and equal queries are asked once, so a vector shared by a third of all rows
is one entry; a pair is verified in the first segment of least distance only. Rounds are written to the shared folder.

Defined cases: null vectors and ids are in no result, null coordinates and NaN count as sign 0; zero is positive; vectors of another
length than the longest are padded with sign 0; ties go to the smaller id; repeated rows are repeated results.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.llm.common import Scratch

K = 10
QUERY_EVERY = 100


def code_of(vector: Column, dim: int) -> Column:
    """The signs of a vector as an array of longs, as even as can be and at most 64 bits to a long."""
    words, each = [], _word_bits(dim)
    for low in range(0, dim, each):
        bits = [F.when(F.coalesce(F.get(vector, F.lit(i)) >= 0, F.lit(False)) & ~F.coalesce(F.isnan(F.get(vector, F.lit(i))), F.lit(False)), F.lit(1 << (i - low) if i - low < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(low, min(low + each, dim))]
        total = bits[0]
        for b in bits[1:]:
            total = total.bitwiseOR(b)
        words.append(total)
    return F.array(*words)


def _word_bits(dim: int) -> int:
    return -(-dim // -(-dim // 64))


def _segments(dim: int, rows: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each segment; none crosses a word."""
    length = max(4, min(16, int(math.log2(max(rows, 2)))))
    out = []
    each = _word_bits(dim)
    for word in range(-(-dim // each)):
        bits = min(each, dim - each * word)
        pieces = -(-bits // length)
        low = 0
        for i in range(pieces):
            n = bits // pieces + (i < bits % pieces)
            out.append((word, low, n))
            low += n
    return out


def _value(code: str, segment: tuple[int, int, int]) -> Column:
    word, low, bits = segment
    return F.shiftright(F.get(F.col(code), F.lit(word)), low).bitwiseAND(F.lit((1 << bits) - 1))


def _distance(a: str, b: str, segment: tuple[int, int, int]) -> Column:
    return F.bit_count(_value(a, segment).bitwiseXOR(_value(b, segment)))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id and distance: the k nearest rows of each query by the Hamming distance of codes."""
    scratch = Scratch(rows.sparkSession, "hamming")
    valid = rows.where(F.col(id_).isNotNull() & F.col(vector).isNotNull())
    dim = valid.agg(F.max(F.size(vector))).first()[0] or 1
    dim, least_rows = max(dim, 1), min(k, valid.count())

    def coded(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_).alias("id"), code_of(F.col(vector), dim).alias("code"))

    ranked = coded(rows).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    classes = scratch.table(ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = scratch.table(coded(queries), "asked")
    count = classes.count()
    segments, words = _segments(dim, count), -(-dim // _word_bits(dim))
    index = classes.select("code", "ids", F.explode(F.array(*(F.struct(F.lit(i).alias("segment"), _value("code", s).alias("value")) for i, s in enumerate(segments)))).alias("at"))
    index = scratch.table(index.select("at.segment", "at.value", F.col("code").alias("other"), "ids"), "index")
    open_ = scratch.table(asked.select("code").distinct().withColumn("bound", F.lit(dim)), "open")
    done = None
    best = None
    for r in range(max(s[2] for s in segments) + 1):
        probes = []
        for i, s in enumerate(segments):
            if r <= s[2]:
                masks = ",".join(str(sum(1 << b for b in bits)) for bits in combinations(range(s[2]), r))
                needed = open_.where(F.col("bound") >= len(segments) * r + i)
                probe = needed.select("code", "bound", F.explode(F.split(F.lit(masks), ",").cast("array<bigint>")).alias("mask"))
                probes.append(probe.select("code", "bound", F.lit(i).alias("segment"), _value("code", s).bitwiseXOR(F.col("mask")).alias("value")))
        every = probes[0]
        for p in probes[1:]:
            every = every.unionByName(p)
        pairs = every.join(index.hint("merge"), ["segment", "value"])  # neither side has a bound
        # The probed segment differs by r; the pair is taken there only if no segment differs by less, nor an earlier one by as little.
        total = sum((F.bit_count(F.get("code", F.lit(w)).bitwiseXOR(F.get("other", F.lit(w)))) for w in range(words)), F.lit(0))
        taken = total <= F.col("bound")
        for i, s in enumerate(segments):
            taken = taken & (_distance("code", "other", s) >= F.when(F.col("segment") > i, r + 1).otherwise(r))
        near = pairs.where(taken).select("code", "ids", total.alias("distance"))
        near = near.select("code", "distance", F.explode("ids").alias("id"))
        if best is not None:
            near = near.unionByName(best)
        w = Window.partitionBy("code").orderBy("distance", "id")
        kept = scratch.table(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), f"round{r}")
        covered = len(segments) * (r + 1) - 1
        kth = kept.where(F.col("rank") == least_rows).select("code", F.col("distance").cast("int").alias("bound"))
        closed = kth.where(F.col("bound") <= covered).select("code")
        last = r == max(s[2] for s in segments)
        settled = kept if last else kept.join(closed, "code", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        best = kept.join(closed, "code", "left_anti").drop("rank")
        open_ = scratch.table(open_.select("code").join(kth, "code", "left").withColumn("bound", F.coalesce("bound", F.lit(dim))).where(F.col("bound") > covered), f"open{r}")
        if not open_.count():
            break
    result = asked.withColumnRenamed("id", "query_id").join(done, "code")
    return result.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias(id_), F.col("distance").cast("long").alias("distance"))

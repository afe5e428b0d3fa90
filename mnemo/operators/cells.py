"""A stored index of vectors in cells: a search reads the cells that can hold its hits, not the table.

Cells are those of k-means on directions, learned from a bounded sample; every row is stored in the cell of its nearest centre with its
angle to it, files ordered by cell and angle. By the triangle inequality for angles, a row of a cell whose centre is at angle t from
a query is at least |t - its own angle| away, so a cell, or a range of a cell's rows, can be left out once k better hits are known.

search(.., probes=None) is exact: the nearest cells give k hits, then all cells that may hold a better one are read. With probes it reads
so many nearest cells of each query and no others, and may miss hits. On directions without clusters no bound leaves much out: the
exact search then reads everything, once.

Queries and the rows of a cell meet in blocks of bounded size on both sides, a matrix product each, and each block passes on k rows
of a query at most: neither a cell nor a namespace with a third of all rows is one task.

Defined cases: rows and queries with a null vector or one of length 0 have no direction and are neither indexed nor found; a null
namespace meets no other; rows alike are all kept; an empty table makes an index without cells, which finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.operators import search as S
from mnemo.sources.folders import path_of

#: Cells are as many as the square root of the rows, at most so many; the sample has so many rows for each of them.
MOST_CELLS, SAMPLE = 4096, 64
#: Rows of a block on either side of a product.
BLOCK_ROWS = 4096
#: Pairs of a vector and a cell that a task looks at at a time.
PAIRS = 1_000_000
#: Cells from which an exact search takes its first hits.
FIRST = 2
#: Scores are rounded to six digits; bounds leave room for that and for the angles' own rounding.
ROOM = 2e-6


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def directed(vector: str | Column) -> Column:
    """Whether a vector has a direction: not null, without null or NaN, of a length above 0."""
    v = F.col(vector) if isinstance(vector, str) else vector
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.coalesce((squares > 0) & ~F.isnan(squares) & (squares < math.inf), F.lit(False))


def near_cells(batch: pa.RecordBatch, column: int, centres: np.ndarray, least: np.ndarray, most: np.ndarray, cells: np.ndarray, places: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of PAIRS pairs at most, with a column of each vector's nearest cells, nearest first: cell, angle and the best score that it can hold."""
    size = max(1, PAIRS // max(1, len(cells)))
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        vectors = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
        angles = np.arccos(np.clip(_units(vectors) @ centres.T, -1, 1))
        order = angles.argsort(1, kind="stable")[:, :places]
        angle = np.take_along_axis(angles, order, 1)
        best = np.cos(np.maximum(np.maximum(angle - most[order], least[order] - angle), 0))
        kinds = (("cell", cells[order].astype(np.int32)), ("angle", angle), ("best", best))
        found = pa.StructArray.from_arrays([pa.array(v.ravel()) for _, v in kinds], [name for name, _ in kinds])
        offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * order.shape[1])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, found)], [*part.schema.names, "c"])


class Cells:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._centres: np.ndarray | None = None

    @classmethod
    def build(cls, rows: DataFrame, root: str, cells: int | None = None, id_: str = "id", tag: str = "container_tag", vector: str = "embedding", seed: int = 7) -> Cells:
        """An index of rows in a new folder. The centres' sample is bounded: SAMPLE rows a cell, in the order of a hash of the id."""
        self, kept = cls(rows.sparkSession, root), rows.where(directed(vector))
        n = kept.count()
        k = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, n))
        if n:
            sample = kept.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.xxhash64(F.col(id_).cast("string"), F.lit(seed)).alias("h")).orderBy("h").limit(k * SAMPLE)
            # The sample is cut once and is small: a hundred iterations don't read the table.
            sample.select("features").write.parquet(f"{self.root}/sample")
            found = KMeans(k=k, distanceMeasure="cosine", maxIter=12, seed=seed).fit(self.spark.read.parquet(f"{self.root}/sample"))
            centres = _units(np.array(found.clusterCenters()))
        else:
            centres = np.zeros((0, 1))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/centres")
        self.add(kept, id_, tag, vector)
        return self

    def centres(self) -> np.ndarray:
        """One row for each cell, MOST_CELLS at most; they never change."""
        if self._centres is None:
            self._centres = _matrix([r.centre for r in sorted(self.spark.read.parquet(f"{self.root}/centres").collect())])
        return self._centres

    def add(self, rows: DataFrame, id_: str = "id", tag: str = "container_tag", vector: str = "embedding") -> None:
        """Appends rows to the cells of their nearest centres; centres stay. A batch is there once its summary is."""
        centres, batch = self.centres(), f"{uuid.uuid4().hex[:12]}"

        @F.pandas_udf("cell int, angle double")
        def place(vectors: pd.Series) -> pd.DataFrame:
            size, at, angle = max(1, PAIRS // max(1, len(centres))), np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for low in range(0, len(vectors), size):
                cosines = _units(_matrix(vectors.iloc[low : low + size])) @ centres.T
                at[low : low + size] = cosines.argmax(1)
                angle[low : low + size] = np.arccos(np.clip(cosines.max(1), -1, 1))
            return pd.DataFrame({"cell": at, "angle": angle})

        placed = rows.where(directed(vector)).select(F.col(id_).alias("id"), F.col(tag).alias("tag"), F.col(vector).alias("vector"), place(F.col(vector)).alias("p"))
        placed = placed.select("id", "tag", "vector", "p.angle", "p.cell")
        path = f"{self.root}/rows/batch={batch}"
        # Ranges split a cell of many rows by angle, and rows of the same angle by id: no cell is one task, and files hold narrow ranges.
        placed.repartitionByRange("cell", "angle", F.xxhash64("id")).sortWithinPartitions("cell", "angle").write.partitionBy("cell").parquet(path)
        if len(centres):
            summary = self.spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
            summary.coalesce(1).write.parquet(f"{self.root}/summary/batch={batch}")

    def _has(self, name: str) -> bool:
        fs, p = path_of(self.spark, f"{self.root}/{name}")
        return fs.exists(p)

    def summary(self) -> dict[int, tuple[int, float, float]]:
        """cell -> number of rows, least and greatest angle to the centre."""
        if not self._has("summary"):
            return {}
        rows = self.spark.read.parquet(f"{self.root}/summary").groupBy("cell").agg(F.sum("n"), F.min("least"), F.max("most")).collect()
        return {r[0]: (r[1], r[2], r[3]) for r in rows}

    def rows(self) -> DataFrame:
        """id, tag, vector, angle and cell of all rows of finished batches."""
        batches = self.spark.read.parquet(f"{self.root}/summary").select("batch").distinct()
        return self.spark.read.parquet(f"{self.root}/rows").join(F.broadcast(batches), "batch", "left_semi").drop("batch")

    def _asked(self, queries: DataFrame, held: dict[int, tuple[int, float, float]], places: int | None = None) -> DataFrame:
        """queries (query_id, tag, q) with their nearest cells that have rows, so many or all: each cell's angle from the query and the best score it can hold."""
        cells = np.array(sorted(held))
        centres = self.centres()[cells]
        least, most = (np.array([held[c][k] for c in cells.tolist()]) for k in (1, 2))
        places = len(cells) if places is None else max(0, min(places, len(cells)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from near_cells(batch, 2, centres, least, most, cells, places)

        asked = queries.select("query_id", "tag", "q")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        near = asked.mapInArrow(run, f"{columns}, c array<struct<cell: int, angle: double, best: double>>")
        return near.select("query_id", "tag", "q", F.posexplode("c").alias("place", "c")).select("query_id", "tag", "q", "place", "c.*")

    def probed(self, queries: DataFrame, probes: int, id_: str = "id", tag: str = "container_tag", vector: str = "embedding") -> DataFrame:
        """query_id and cell of the cells that a search with so many probes reads."""
        return self._asked(_queries(queries, id_, tag, vector), self.summary(), probes).select("query_id", "cell")

    def _scored(self, asked: DataFrame, held: dict, k: int, floor: float, among: DataFrame | None, itself: bool, tagged: bool) -> DataFrame:
        """query_id, id and score: for each query, cell and block the k best at least as good as low; asked has low besides _asked's columns."""
        kind = self.spark.read.parquet(f"{self.root}/rows").schema["id"].dataType.simpleString()
        # One row for each cell: which cells are read at all, the angles that any of their queries needs, and how many queries there are.
        reach = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("low") - ROOM))) + math.sqrt(ROOM)
        wanted = asked.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.col("angle") - reach).alias("lo"), F.max(F.col("angle") + reach).alias("hi")).collect()
        if not wanted:
            return self.spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, score double")
        rows = self.rows().where(F.col("cell").isin([r.cell for r in wanted]))
        if len(wanted) <= 32:  # few enough for the files' statistics to be asked
            narrow = F.lit(False)
            for r in wanted:
                narrow = narrow | ((F.col("cell") == r.cell) & F.col("angle").between(r.lo, r.hi))
            rows = rows.where(narrow)
        dealt = self.spark.createDataFrame([(r.cell, math.ceil(held[r.cell][0] / BLOCK_ROWS), math.ceil(r.n / BLOCK_ROWS), r.lo, r.hi) for r in wanted], "cell int, blocks int, asks int, lo double, hi double")
        rows = rows.join(F.broadcast(dealt), "cell").where(F.col("angle").between(F.col("lo"), F.col("hi")))
        if among is not None:
            rows = rows.join(among.select("id"), "id", "left_semi")
        block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        v = rows.select("cell", block("id", "blocks").alias("block"), every("asks").alias("ask"), "id", "tag", "vector")
        q = asked.join(F.broadcast(dealt), "cell").select("cell", every("blocks").alias("block"), block("query_id", "asks").alias("ask"), "query_id", "tag", "q", "low")

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(left) and len(right):
                vectors, ids, tags = _units(_matrix(right["vector"])), right["id"].to_numpy(), right["tag"].to_numpy()
                for at in range(0, len(left), 256):
                    part = left.iloc[at : at + 256]
                    scores = np.round(_units(_matrix(part["q"])) @ vectors.T, 6)
                    for row, query, of, low in zip(scores, part["query_id"], part["tag"], part["low"], strict=True):
                        ok = row >= max(floor, low - ROOM)
                        if tagged:
                            ok &= tags == of
                        if not itself:
                            ok &= ids != query
                        found = np.flatnonzero(ok)
                        if len(found) > k:  # ties at the k-th are kept for the ids to decide
                            found = found[row[found] >= np.partition(row[found], len(found) - k)[len(found) - k]]
                        chosen = sorted(found, key=lambda j: (-row[j], ids[j]))[:k]
                        out += [(query, ids[j], float(row[j])) for j in chosen]
            return pd.DataFrame(out, columns=["query_id", "id", "score"])

        keys = ["cell", "block", "ask"]
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {kind}, score double"
        return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInPandas(best, schema)

    def search(
        self, queries: DataFrame, k: int, floor: float = 0.0, probes: int | None = None, among: DataFrame | None = None, itself: bool = False, tagged: bool = True, id_: str = "id", tag: str = "container_tag", vector: str = "embedding"
    ) -> DataFrame:
        """query_id, id, score and rank: the k best rows of each query at floor or above, of its namespace if tagged.

        probes None is exact. among (id) are the rows that may be found, all if None. itself: whether a row of the query's own id counts.
        Which cells are read is settled when this is called; the hits are a lazy DataFrame.
        """
        held = self.summary()
        given = _queries(queries, id_, tag, vector)
        if not held:
            return self.spark.createDataFrame([], f"query_id {given.schema['query_id'].dataType.simpleString()}, id {queries.schema[id_].dataType.simpleString()}, score double, rank int")
        asked = self._asked(given, held, probes).withColumn("low", F.lit(float(floor)))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        first = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if probes is not None:
            return first(self._scored(asked, held, k, floor, among, itself, tagged))
        path = f"{self.root}/asked/{uuid.uuid4().hex[:12]}"
        first(self._scored(asked.where(F.col("place") < FIRST), held, k, floor, among, itself, tagged)).write.parquet(path)
        near = self.spark.read.parquet(path)
        known = near.groupBy(F.col("query_id").alias("known_id")).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("kth"))
        rest = asked.drop("low").where(F.col("place") >= FIRST).join(known, F.col("query_id") == F.col("known_id"), "left")
        rest = rest.withColumn("low", F.greatest(F.lit(float(floor)), "kth")).where(F.col("best") >= F.col("low") - ROOM).drop("known_id", "kth")
        return first(near.drop("rank").unionByName(self._scored(rest, held, k, floor, among, itself, tagged)))


def _queries(queries: DataFrame, id_: str, tag: str, vector: str) -> DataFrame:
    return queries.where(directed(vector)).select(F.col(id_).alias("query_id"), F.col(tag).alias("tag"), F.col(vector).alias("q"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, hits and recall: the share of the exact hits (query_id, id) that were found."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return met.agg(F.countDistinct("query_id").alias("queries"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def neighbours(cells: Cells, queries: DataFrame, k: int = S.NEIGHBOURS, floor: float = 0.75, **names: str) -> DataFrame:
    """search.nearest by the index: for each query its k nearest rows of the same namespace at floor or above, itself excluded."""
    return cells.search(queries, k, floor, **names)

"""Kept state of the edge graph: what graph.resolve says, without sorting every edge of a pair at each read.

Edges are logged by the piece of time (PERIOD seconds of valid_from) they belong to. A pair's piece has a summary (first and last
edge, whether any is singular) and rows of those edges that change the object within it. A batch, late edges included, makes anew the
pieces that it touches, from the log's folders of those times alone; others stay. What a pair has at a time is the last edge of
its newest piece before that time, or of the one piece that the time cuts, which is read from the log; a timeline is the changes
of all pieces, of which a piece's first counts if the piece before ends with another object. So no task holds all edges of a pair, but
those of one piece of time.

A batch is written under a name of its own and counts once its summaries are whole, so one that fails is as if it had never come.
One writer at a time. Defined cases: null keys are keys like any; an edge without valid_from comes before all others and is never in
force at a time, as in resolve; a null object changes nothing and whatever follows it does; edges added twice change nothing; other columns are not
kept; an empty state has no pairs.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.operators.graph import KEY, folded
from mnemo.sources.folders import path_of

#: Seconds of a piece.
PERIOD = 30 * 86_400
#: The piece of edges without a time.
TIMELESS = -(1 << 40)


def _same(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & a[name].eqNullSafe(b[name])
    return found


class EdgeState:
    def __init__(self, spark: SparkSession, root: str, period: int = PERIOD):
        self.spark, self.root, self.period = spark, root.rstrip("/"), period

    def _batches(self) -> list[str]:
        fs, p = path_of(self.spark, f"{self.root}/pieces")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(path_of(self.spark, f"{self.root}/pieces/{n}/_SUCCESS")[1]))

    def _read(self, kind: str, batches: list[str]) -> DataFrame:
        """Rows of batches with their batch; a batch's own folders are named, so those of unfinished ones are not read."""
        return self.spark.read.option("basePath", f"{self.root}/{kind}").parquet(*(f"{self.root}/{kind}/{b}" for b in batches))

    def add(self, edges: DataFrame) -> None:
        """Adds edges (container_tag, subject, predicate, object, valid_from, captured_at, id, singular)."""
        # Names are of one width, so their order is that of their times.
        batch = f"batch={time.time_ns():020d}{uuid.uuid4().hex[:6]}x"
        piece = F.coalesce(F.floor(F.col("valid_from") / self.period), F.lit(TIMELESS)).cast("long")
        named = edges.select(*KEY, "object", "valid_from", "captured_at", "id", "singular", piece.alias("piece"))
        # Rows meet by their piece of time, so a folder has few files; a piece with many rows is split again.
        named.hint("rebalance", "piece").write.partitionBy("piece").parquet(f"{self.root}/log/{batch}")
        schema = named.select(*KEY, "object", "valid_from", "captured_at", "id", "singular", "piece").schema
        mine = self.spark.read.schema(schema).parquet(f"{self.root}/log/{batch}")
        times = [r.piece for r in mine.select("piece").distinct().collect()]  # as many as there are pieces of time
        if not times:
            return
        # One shuffle serves all: a piece's edges, whether the batch touches it, their changes and the summary, which stands at the change that opens it.
        log = self._read("log", [*self._batches(), batch]).where(F.col("piece").isin(times)).withColumn("piece", F.col("piece").cast("long"))
        w = Window.partitionBy(*KEY, "piece").orderBy("valid_from", "captured_at", "id")
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = log.withColumn("touched", F.max(F.col("batch") == batch.removeprefix("batch=")).over(every)).where("touched")
        # An edge that came twice stands beside itself.
        whole = F.struct("valid_from", "captured_at", "id", "object")
        once = own.withColumn("again", F.lag(whole).over(w).eqNullSafe(whole)).withColumn("singular", F.max("singular").over(every)).where(~F.col("again"))
        order, value = F.struct("valid_from", "captured_at", "id"), F.struct("object", "valid_from")
        placed = once.withColumn("before", F.lag(folded(F.col("object"))).over(w)).withColumn("opens", F.row_number().over(w) == 1)
        placed = placed.withColumn("last_at", F.last(order).over(every)).withColumn("last", F.last(value).over(every))
        changes = placed.where(F.col("before").isNull() | (F.col("before") != folded(F.col("object"))))
        at = F.when(F.col("opens"), F.struct(order.alias("first_at"), value.alias("first"), "last_at", "last", "singular"))
        changes.select(*KEY, "piece", "object", "valid_from", "captured_at", "id", "opens", at.alias("summary")).write.parquet(f"{self.root}/changes/{batch}")
        opened = self._read("changes", [batch]).where("opens")
        opened.select(*KEY, "piece", "summary.*").write.parquet(f"{self.root}/pieces/{batch}")

    def _none(self, columns: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in KEY) + f", {columns}")

    def pieces(self) -> DataFrame:
        """The newest summary of each pair's pieces, with the batch that made it."""
        rows = self._read("pieces", self._batches())
        newest = rows.groupBy(*KEY, "piece").agg(F.max_by(F.struct("first_at", "first", "last_at", "last", "singular", "batch"), "batch").alias("v"))
        return newest.select(*KEY, "piece", "v.*")

    def current(self, t: int) -> DataFrame:
        """Per pair: current, current_from at t (the first edge's if none is that old) and singular."""
        cut = t // self.period
        if not self._batches():
            return self._none("current string, current_from bigint, singular boolean")
        pieces = self.pieces()
        whole = pieces.select(
            *KEY, F.when((F.col("piece") < cut) & (F.col("piece") != TIMELESS), F.col("last_at")).alias("at"), F.col("last").alias("now"), "first_at", "first", "singular"
        )
        edges = self._read("log", self._batches()).where((F.col("piece") == cut) & (F.col("valid_from") <= t))
        part = edges.select(*KEY, F.struct("valid_from", "captured_at", "id").alias("at"), F.struct("object", "valid_from").alias("now"))
        both = whole.unionByName(part, allowMissingColumns=True)
        per = both.groupBy(*KEY).agg(F.max_by("now", "at").alias("now"), F.min_by("first", "first_at").alias("first"), F.max("singular").alias("singular"))
        found = F.coalesce("now", "first")
        return per.select(*KEY, found["object"].alias("current"), found["valid_from"].alias("current_from"), "singular")

    def timeline(self) -> DataFrame:
        """A row for each change of a pair's object: object, valid_from, captured_at and id of the edge that made it."""
        if not self._batches():
            return self._none("object string, valid_from bigint, captured_at bigint, id string")
        before = F.lag(folded(F.col("last.object"))).over(Window.partitionBy(*KEY).orderBy("piece"))
        pieces = self.pieces().select(*KEY, "piece", F.col("batch").alias("made_in"), before.alias("before"))
        changes = self._read("changes", self._batches())
        met = changes.join(pieces, _same(changes, pieces, (*KEY, "piece")) & (changes["batch"] == pieces["made_in"]))
        counts = ~changes["opens"] | pieces["before"].isNull() | (pieces["before"] != folded(changes["object"]))
        return met.where(counts).select(*(changes[c] for c in (*KEY, "object", "valid_from", "captured_at", "id")))

"""What the operators share: reading tables, words, scratch tables in the cluster's shared folder, size-checked joins, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A small side is broadcast only if its rows, at a fixed width, stay below this; otherwise the join is shuffled.
BROADCAST_BYTES = 16 << 20
BATCH_ROWS = 250
#: Words remembered by a worker while it scans; the memo is emptied beyond that, which changes no result.
MEMO_WORDS = 150_000


def prepare(spark: SparkSession) -> None:
    """Sets the session's rows to an Arrow batch for long texts. Queries call it, as any application should; operators leave the session as it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from every learner: crc32 of its id as text divides by 5. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may fall back on a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mnemo-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables of one run, in Parquet under the shared folder: they cut lineage and survive lost executors.

    What a lazy result still reads can't go before that is used: the folder is deleted when the application ends, tables no longer
    needed before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def counted(self, df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
        """The table of df and how many of its rows are what (all by default), counted while they are written.

        A count afterwards would be a query of its own, and each query costs the driver threads, broadcasts and what Spark keeps of it.
        A task that is run again may be counted again, so the number is never too small and 0 only of none.
        """
        seen = Observation()
        held = self.table(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")), name)
        return held, seen.get["n"]

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files and broadcasts of finished stages now, not at the next chance collection; the JVM's heap shrinks with it."""
        gc.collect()
        self.spark._jvm.System.gc()


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows of at most row_bytes each fit in limit; else left to a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df.hint("merge")


class WordHashes(dict):
    """Memo of word bytes -> 64-bit hash."""

    def __init__(self, seed: int = 0, lower: bool = False):
        super().__init__()
        self.seed, self.lower = seed, lower

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


_BASE = 0x9E3779B97F4A7C15


class Windows:
    """Hashes of every window of m values in a sequence of 64-bit values: a polynomial modulo 2**64 in an odd base, from one prefix sum."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = np.uint64(base | 1), np.uint64(pow(base | 1, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))

    def hashes(self, values: np.ndarray, m: int) -> np.ndarray:
        n = len(values) - m + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._reach(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:], dtype=np.uint64)
        return mix((sums[m:] - sums[:-m]) * self.down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Gives memory that is free in this process back to the system; workers outlive tasks and share a budget with their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]]) -> DataFrame:
    """mapInArrow with state per task: start() is called once in a task and returns what maps each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            out = each(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
        del each
        trim()

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of edges (a, b) of long ids: rows (node, root) for each node with an edge, root the smallest id of its component.

    Rounds of: link all smaller neighbours of a node to the smallest, then let each node skip to its parent's parent.
    Each round is written to the shared folder and counted on the way; nothing is collected but counts. Loops and null ends are ignored. A giant component
    has all its nodes below one root: only parents that have a parent themselves are looked up, so a root is in no join's key but
    where those are too many to broadcast, and there adaptive execution splits it.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v")
    state = scratch.table(ordered.distinct(), f"{name}-0")
    step = 0
    while True:
        parents, wide = scratch.counted(state.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), f"{name}-p{step}", F.col("n") > 1)
        above = parents.select(F.col("u").alias("m"), F.col("m").alias("mm"))
        above, deep = scratch.counted(above.join(parents.select("m").distinct(), "m", "left_semi"), f"{name}-a{step}")
        if not deep and not wide:
            out = scratch.table(parents.select(F.col("u").alias("node"), F.col("m").alias("root")).union(parents.select("m", "m").distinct()), name)
            scratch.drop(f"{name}-{step}", f"{name}-p{step}", f"{name}-a{step}")
            scratch.release()
            return out
        linked = state.join(parents.select("u", "m"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", "e.m").where("u <> m").distinct()
        jumped = linked.join(small(above, deep, 32), "m", "left").select("u", F.coalesce("mm", "m").alias("v")).where("u <> v").distinct()
        new = scratch.table(jumped, f"{name}-{step + 1}")
        scratch.drop(f"{name}-{step}", f"{name}-p{step}", f"{name}-a{step}")
        state, step = new, step + 1

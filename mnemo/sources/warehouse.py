"""A warehouse of change logs in Parquet.

Every table is a log of row versions (seq, deleted); its current state is each id's newest version. Writes append a batch under a new
sequence number; erasure rewrites the log without the rows, so their bytes are gone, and a generation pointer is switched last.
A compacted table has one version of each id in files that are ranged and sorted by what is asked for (PAYLOAD), with Bloom filters:
reads of it need no aggregate, and filters on any column reach the files and pass over those that can't have a row. Later batches are
laid over it by id until the next compaction. Folders are reached through Spark and Hadoop's file system alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.memory import absent
from mnemo.sources.schemas import SCHEMAS


#: What tables are asked for by: the first columns range and sort a compacted table's files, all get Bloom filters.
PAYLOAD = {
    "documents": ("container_tag", "captured_at", "source", "content_hash", "canonical_url"), "chunks": ("container_tag", "document_id"),
    "memories": ("container_tag", "learned_at", "document_id", "statement"), "memory_evidence": ("memory_id", "document_id"),
    "edges": ("container_tag", "subject", "predicate", "document_id"), "audit_events": ("container_tag", "ts"), "profiles": ("container_tag",),
    "acl_entries": ("principal", "scope"), "entity_aliases": ("container_tag", "alias"), "jobs": ("container_tag",),
}
#: Rows of a page. Fixed value.
PAGE = 256
#: The folder of a compacted table's rows in its generation.
SINGLE = "single"


@dataclass(frozen=True)
class Cursor:
    """A place in a table as it was: its generation, the last batch that counts, and the last id that was passed on."""

    name: str
    generation: str
    seq: int
    after: str | None = None


class SnapshotGone(RuntimeError):
    """The table has been compacted, or rows erased, since the cursor was made."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Files.
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _generations(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self._fs(f"{self.root}/{name}/{s.getPath().getName()}/_COMMITTED")[0].exists(self._fs(f"{self.root}/{name}/{s.getPath().getName()}/_COMMITTED")[1]))

    def _commit(self, folder: str) -> None:
        fs, p = self._fs(f"{folder}/_COMMITTED")
        fs.create(p, True).close()

    def _files(self, name: str, *paths: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}, seq bigint, deleted boolean").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*paths)

    def _log(self, name: str) -> DataFrame:
        generations = self._generations(name)
        if not generations:
            return self.spark.createDataFrame([], f"{SCHEMAS[name]}, seq bigint, deleted boolean")
        return self._files(name, f"{self.root}/{name}/{generations[-1]}")

    def _layers(self, name: str) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of a compacted table, log of what came since), or (None, the whole log)."""
        generations = self._generations(name)
        folder = f"{self.root}/{name}/{generations[-1]}" if generations else ""
        if not folder or not self._fs(f"{folder}/{SINGLE}")[0].exists(self._fs(f"{folder}/{SINGLE}")[1]):
            return None, self._log(name)
        fs, p = self._fs(folder)
        later = [f"{folder}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() != SINGLE]
        return self._files(name, f"{folder}/{SINGLE}"), self._files(name, *later) if later else None

    def ensure(self) -> None:
        """Creates each table that isn't there."""
        for name in SCHEMAS:
            if not self._generations(name):
                self._rewrite(name, self.spark.createDataFrame([], f"{SCHEMAS[name]}, seq bigint, deleted boolean"))

    def migrate(self, steps: dict[int, Callable[[Warehouse], None]] | None = None) -> list[int]:
        """Runs the steps that haven't run on this warehouse, in the order of their versions, and returns those versions.

        The first version makes the tables; a column added at the end of a schema needs no step, as older files read as null there.
        A step's mark is written behind it, so one that fails runs again and must bear that.
        """
        done = []
        for version, step in sorted(({1: Warehouse.ensure} | (steps or {})).items()):
            fs, mark = self._fs(f"{self.root}/_versions/{version:06d}")
            if not fs.exists(mark):
                step(self)
                fs.create(mark, True).close()
                done.append(version)
        return done

    def _rewrite(self, name: str, log: DataFrame, single: bool = False) -> None:
        old = self._generations(name)
        folder = f"{self.root}/{name}/{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        if single:
            # The id splits a namespace that has many rows.
            order = [*PAYLOAD[name][:2], "id"]
            writer = log.repartitionByRange(*order).sortWithinPartitions(*order).write
            kinds = dict(log.dtypes)
            for column in ("id", *PAYLOAD[name]):
                if kinds[column] == "string":
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer.parquet(f"{folder}/{SINGLE}")
        else:
            log.write.parquet(f"{folder}/base")
        self._commit(folder)
        for g in old:
            fs, p = self._fs(f"{self.root}/{name}/{g}")
            fs.delete(p, True)

    # Reads and writes.
    def current(self, name: str, *columns: str, until: int | None = None) -> DataFrame:
        """Each id's newest version, unless that is a deletion: all columns of it, or id and those named.

        Rows of a compacted table count as they are unless their id came again since, so filters on any column go to its files.
        The id is the grouping key itself, so that filters on it and semi joins by it go below the aggregate and to the files. The
        versions' other columns meet in one struct, of which none can be pruned later: who needs no texts or vectors names columns.
        With until, batches of a later sequence number don't count.
        """
        every = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        chosen = [c for c in every if c != "id" and (not columns or c in columns)]
        single, log = self._layers(name)
        if until is not None:
            single, log = (rows if rows is None else rows.where(F.col("seq") <= until) for rows in (single, log))
        if single is not None:
            single = single.select("id", *chosen)
            if log is None:
                return single
            again = log.select(F.col("id").alias("_again")).distinct()
            single = single.join(again, F.col("id").eqNullSafe(F.col("_again")), "left_anti")
        newest = log.groupBy("id").agg(F.max_by(F.struct(*chosen, "deleted"), "seq").alias("v"))
        newest = newest.where(~F.col("v.deleted")).select("id", *(F.col(f"v.{c}").alias(c) for c in chosen))
        return newest if single is None else single.unionByName(newest)

    def cursor(self, name: str) -> Cursor:
        """The start of the table as it is now."""
        self.ensure()
        return Cursor(name, self._generations(name)[-1], time.time_ns())

    def page(self, at: Cursor, size: int = PAGE, where: Column | None = None, *columns: str) -> tuple[DataFrame, Cursor | None]:
        """The next rows of a cursor's table by id, at most size, and the cursor behind them; None once there are no more.

        Pages are of the table as it was when the cursor was made: batches written since, deletions included, don't count. A
        page is found by its ids, so none is read twice and passing over those before costs no sort of them. If rows have been erased or
        the table compacted meanwhile, the old batches are gone, and SnapshotGone says so; the caller begins anew.
        """
        if self._generations(at.name)[-1:] != [at.generation]:
            raise SnapshotGone(f"{at.name} has been rewritten since the cursor was made")
        rows = self.current(at.name, *columns, until=at.seq)
        rows = rows if at.after is None else rows.where(F.col("id") > at.after)
        rows = rows if where is None else rows.where(where)
        ids = [r.id for r in rows.select("id").orderBy("id").limit(size).collect()]  # a page's
        if not ids:
            return rows.limit(0), None
        found = rows.where(F.col("id").between(ids[0], ids[-1])).orderBy("id")
        return found, replace(at, after=ids[-1]) if len(ids) == size else None

    def write(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        """Appends versions of rows; columns that rows lack are null."""
        if not self._generations(name):
            self.ensure()
        parts = [c.split() for c in SCHEMAS[name].split(", ")]
        chosen = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in parts), F.lit(time.time_ns()).alias("seq"), F.lit(deleted).alias("deleted"))
        chosen.write.parquet(f"{self.root}/{name}/{self._generations(name)[-1]}/{time.time_ns():020d}-{uuid.uuid4().hex[:6]}")

    def insert(self, name: str, rows: DataFrame) -> None:
        """Appends the rows whose id isn't there yet."""
        self.write(name, absent(rows, self.current(name)))

    def update(self, name: str, where: Column, **values: Column) -> None:
        self.write(name, self.current(name).where(where).withColumns(values))

    def erase(self, name: str, where: Column) -> None:
        """Removes all versions of the ids that any version of matches, from the files as well."""
        log = self._log(name)
        gone = log.where(where).select("id").distinct()
        self._rewrite(name, log.join(gone, "id", "left_anti"))

    def compact(self, name: str) -> None:
        self._rewrite(name, self.current(name).withColumn("seq", F.lit(time.time_ns())).withColumn("deleted", F.lit(False)), single=True)

    def stage(self, rows: DataFrame) -> str:
        """Writes rows down beside the tables and returns their path; what a model or a clock has said is then said once."""
        path = f"{self.root}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def drop(self, name: str) -> None:
        self.remove(f"{self.root}/{name}")

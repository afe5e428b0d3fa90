"""Original files by document, in a folder that Hadoop's file system reaches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Blobs:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{re.sub('[^A-Za-z0-9_-]', '', key) or 'blob'}"

    def _file(self, key: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def put(self, key: str, content: bytes) -> str:
        """Stores content under key and returns its path."""
        fs, p = self._file(key)
        out = fs.create(p, True)
        out.write(bytearray(content))
        out.close()
        return self.path(key)

    def put_all(self, rows: DataFrame) -> None:
        """Stores rows (key, content as bytes), each under its key's allowed characters, without passing through the driver.

        They are rows of Parquet under _many, in which get looks after its own files; of a key stored twice either may be found.
        """
        name = F.regexp_replace("key", "[^A-Za-z0-9_-]", "")
        rows.select(F.when(name == "", "blob").otherwise(name).alias("key"), "content").sortWithinPartitions("key").write.mode("append").parquet(f"{self.root}/_many")

    def get(self, key: str) -> bytes | None:
        fs, p = self._file(key)
        if not fs.exists(p):
            return self._of_many(key)
        return bytes(self.spark.read.format("binaryFile").load(self.path(key)).first()["content"])

    def _of_many(self, key: str) -> bytes | None:
        many = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_many")
        if not many.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(many):
            return None
        found = self.spark.read.parquet(f"{self.root}/_many").where(F.col("key") == self.path(key).rpartition("/")[2]).first()
        return bytes(found["content"]) if found else None

"""A stored inverted index: sparse search that reads the asked words' postings, not texts, and passes over postings that can't matter.

Postings of a word are kept in blocks of alike term frequency (powers of two), each with its number of postings and its greatest
frequency; the slices of a word and frequency that many documents share are dealt by a hash of the id, so that no word, however
common, is one group. A word's document frequency is the sum of its blocks' numbers, so appended batches keep it without a recount.

Where a task may hold the weights of all queries, each asked word's postings are brought together by document, once for all queries, and
documents are scored as search.best does. Else, where few postings are met, a search adds them all up. Where they are many it first scores the blocks of each asked word that weigh most, which gives each query a score that its k-th hit surely
reaches. A document found only in blocks that weigh, word by word, less than the same share of their word's greatest weight can't
reach that score when those shares add up to less than it; so only documents of heavier blocks are candidates, and of the other
postings only those of candidates are added up, if these are few enough to be sent around. The scores are those of search.sparse over all texts.

Defined cases: null and empty texts have no words but count as documents; a null id is an id like any; the same id added twice is two
documents' worth of counts, so who adds must add what is new; words that no document has score nothing; an empty index finds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.operators import search as S
from mnemo.sources.folders import path_of

#: Postings of a block, about, and folders that words are dealt to by hash.
BLOCK, BUCKETS = 1024, 32
#: Of so many documents one is looked at to tell which words are common.
SAMPLE_EVERY = 16
#: Share of a word's greatest weight from which its blocks give a first score.
HEAVY = 0.5
#: Postings that a search adds up as they are; if it would meet more, it looks for candidates first.
SKIP_FROM = 20_000_000
#: Scores are rounded to six digits.
ROOM = 2e-6
BROADCAST_BYTES = 16 << 20


def _small(df: DataFrame, rows: int, row_bytes: int = 128) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def counted(docs: DataFrame) -> DataFrame:
    """id, token, tf and level (log2 of tf) of the words of documents (id, text), each counted in its document's own task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            met = pa.table({"row": pc.list_parent_indices(words), "token": words.flatten()}).group_by(["row", "token"], use_threads=False).aggregate([([], "count_all")])
            for part in met.to_batches():
                tf = part.column("count_all")
                level = np.log2(tf.to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part.column("row")), part.column("token"), tf, pa.array(level)], ["id", "token", "tf", "level"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", T.sparse_tokens(F.col("text")).alias("words")).mapInArrow(run, f"id {kind}, token string, tf bigint, level int")


class Postings:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._schema: str | None = None

    def add(self, docs: DataFrame, id_: str = "id", text: str = "content") -> None:
        """Appends documents. A batch counts once its own count is written, after its blocks.

        How many slices a common word gets is estimated from one document in SAMPLE_EVERY: it makes blocks larger or smaller, and
        changes no result. A document's words are counted where it is, so postings are shuffled once, to their blocks.
        """
        batch = uuid.uuid4().hex[:12]
        named = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
        sample = counted(named.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_EVERY)) == 0)).groupBy("token", "level").agg((F.count("*") * SAMPLE_EVERY).alias("n")).where(F.col("n") > BLOCK)
        sample.select("token", "level", F.ceil(F.col("n") / BLOCK).cast("int").alias("slices")).coalesce(1).write.parquet(f"{self.root}/_staged/{batch}")
        common = self.spark.read.parquet(f"{self.root}/_staged/{batch}")
        dealt = counted(named).join(_small(common, common.count()), ["token", "level"], "left")
        slice_ = F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slices"))).cast("int")
        blocks = dealt.withColumn("slice", slice_).groupBy("token", "level", "slice").agg(F.collect_list(F.struct("id", "tf")).alias("postings"), F.count("*").alias("n"), F.max("tf").alias("most"))
        # Rows stay where their shuffle has put them; a folder gets a file of each task.
        blocks.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{self.root}/blocks/batch={batch}")
        docs.agg(F.count("*").alias("documents")).coalesce(1).write.parquet(f"{self.root}/counts/batch={batch}")
        fs, p = path_of(self.spark, f"{self.root}/_staged/{batch}")
        fs.delete(p, True)

    def _bucket(self):
        return F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")

    def batches(self) -> dict[str, int]:
        """Documents of each finished batch."""
        fs, p = path_of(self.spark, f"{self.root}/counts")
        if not fs.exists(p):
            return {}
        return {r.batch: r.documents for r in self.spark.read.schema("documents bigint, batch string").parquet(f"{self.root}/counts").collect()}

    def blocks(self, batches: list[str], buckets: list[int]) -> DataFrame:
        """token, postings, n and most of the blocks of finished batches in some folders of words; no others are read."""
        if self._schema is None:
            kind = self.spark.read.parquet(f"{self.root}/blocks").schema["postings"].dataType.elementType["id"].dataType.simpleString()
            self._schema = f"token string, level int, slice int, postings array<struct<id:{kind},tf:bigint>>, n bigint, most bigint, batch string, bucket int"
        read = self.spark.read.schema(self._schema).parquet(f"{self.root}/blocks")
        return read.where(F.col("bucket").isin(buckets) & F.col("batch").isin(batches)).select("token", "postings", "n", "most")

    def search(self, asked: DataFrame, k: int, skip: bool | None = None, among: DataFrame | None = None) -> DataFrame:
        """query_id, id, score and rank of the k best documents for words asked (query_id, token, tf).

        skip: whether postings that can't matter are passed over, or all are added up; None: as their number says. The hits are the
        same. among (id) are the documents that may be found, all if None; words weigh as in all. Words are weighed, and folders chosen, when this is called; the hits are a lazy DataFrame.
        """
        batches = self.batches()
        n = sum(batches.values())
        wanted = asked.withColumn("bucket", self._bucket()).groupBy("bucket").agg(F.count_distinct("token").alias("words"), F.count("*").alias("rows")).collect()
        words, rows = sum(r["words"] for r in wanted), sum(r["rows"] for r in wanted)
        if not n or not rows:
            return self.spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id string, score double, rank int")
        held = None if skip else S.held_weights(asked)
        if held:
            return self._by_document(self.blocks(list(batches), [r["bucket"] for r in wanted]), n, held, asked.schema["query_id"].dataType.simpleString(), k, among)
        blocks = self.blocks(list(batches), [r["bucket"] for r in wanted]).join(_small(asked.select("token").distinct(), words), "token", "left_semi")
        # Numbers alone, so no posting is read for them.
        df = blocks.groupBy("token").agg(F.sum("n").alias("df"), F.max("most").alias("peak"))
        weights = df.select("token", "df", "peak", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        weighed = asked.join(_small(weights, words), "token").select("query_id", "token", F.col("tf").alias("q"), "idf", (F.col("tf") * F.col("idf") * F.col("peak")).alias("top"), "df")
        folder = f"{self.root}/asked/{uuid.uuid4().hex[:12]}"
        weighed.write.parquet(folder)
        words = self.spark.read.schema(weighed.schema).parquet(folder)
        # A choice of documents may leave out those that reach the score by which postings are passed over.
        skip = False if among is not None else skip if skip is not None else (words.agg(F.sum("df")).first()[0] or 0) > SKIP_FROM
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        met = self._met(blocks, words, rows)
        scored = met.select("query_id", "q", "idf", F.explode("postings").alias("p")).select("query_id", "q", "idf", "p.id", "p.tf")
        if skip:
            heavy = self._met(blocks, words.join(_small(self._reached(blocks, words, rows, k), rows), "query_id", "left"), rows)
            # share: of each word's greatest weight, so that shares of all words add up to less than what the k-th hit reaches.
            candidates = heavy.where(F.col("q") * F.col("idf") * F.col("most") >= F.coalesce("share", F.lit(0.0)) * F.col("top"))
            candidates = candidates.select(F.col("query_id").alias("asks"), F.explode("postings.id").alias("of")).distinct()
            candidates.write.parquet(f"{folder}-candidates")
            candidates = self.spark.read.schema(candidates.schema).parquet(f"{folder}-candidates")
            # Few candidates go to where the postings are; to shuffle all postings to many would cost more than to add them up.
            if candidates.count() * 64 <= BROADCAST_BYTES:
                # A null id is an id like any.
                scored = scored.join(F.broadcast(candidates), (F.col("asks") == F.col("query_id")) & F.col("of").eqNullSafe(F.col("id")), "left_semi")
        if among is not None:
            scored = scored.join(among.select("id"), "id", "left_semi")
        total = scored.groupBy("query_id", "id").agg(F.round(F.sum(F.col("q") * F.col("tf") * F.col("idf")), 6).alias("score"))
        return total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _by_document(self, blocks: DataFrame, n: int, held: tuple[list, list[str], list], kind: str, k: int, among: DataFrame | None) -> DataFrame:
        """The hits of a search whose weights a task may hold: no posting is a row for each query that asks its word."""
        asked, tokens, names = held
        codes = F.broadcast(self.spark.createDataFrame(list(enumerate(tokens)), "code int, token string"))
        blocks = blocks.join(codes, "token")
        df = np.zeros(len(tokens))
        for r in blocks.groupBy("code").agg(F.sum("n").alias("df")).collect():  # a row for each asked word
            df[r.code] = r.df
        met = blocks.select("code", F.explode("postings").alias("p")).select("p.id", "code", "p.tf")
        if among is not None:
            met = met.join(among.select("id"), "id", "left_semi")
        counts = met.groupBy("id").agg(F.collect_list(F.struct("code", "tf")).alias("c")).select("id", F.col("c.code").alias("codes"), F.col("c.tf").alias("tfs"))
        return S.best(counts, S.weighed(asked, tokens, names, np.log1p((n - df + 0.5) / (df + 0.5))), names, k, "id", kind)

    def _met(self, blocks: DataFrame, words: DataFrame, rows: int) -> DataFrame:
        return blocks.join(_small(words, rows), "token")

    def _reached(self, blocks: DataFrame, words: DataFrame, rows: int, k: int) -> DataFrame:
        """query_id and share: what the k-th best document by heavy blocks alone has, as a share of the greatest weights of all its query's words."""
        heavy = self._met(blocks, words, rows).where(F.col("q") * F.col("idf") * F.col("most") >= HEAVY * F.col("top"))
        part = heavy.select("query_id", F.explode("postings").alias("p"), "q", "idf").groupBy("query_id", "p.id").agg(F.sum(F.col("q") * F.col("p.tf") * F.col("idf")).alias("score"))
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") == k)
        tops = words.groupBy("query_id").agg(F.sum("top").alias("tops"))
        return ranked.join(tops, "query_id").select("query_id", (F.least(F.lit(1.0), (F.col("score") - ROOM) / F.col("tops")) * (1 - 1e-9)).alias("share"))

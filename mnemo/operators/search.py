"""Search and ranking: dense top-k, neighbours, sparse scores, rank fusion, grouping and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemo.functions import text as T
from mnemo.sources.folders import staged

RRF_K, RRF_BASE = 60, 1
#: Hits, documents and neighbours of a search. Fixed values.
HITS, LISTY_HITS, DOCUMENTS, FACTS, NEIGHBOURS = 60, 150, 30, 10, 5
#: Blocks that the rows of each namespace are dealt to in a search for neighbours.
BLOCKS = 16
#: Weights (asked words times queries) that a task may hold, and scores (documents times queries) that it makes at a time.
MOST_WEIGHTS, SCORES = 2_000_000, 1_000_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1, so that a dot product is a cosine; a vector of length 0 stays."""
    # The norm is bound once: inside the inner lambda it would be computed again for each element.
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))[0]


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def dense(rows: DataFrame, query: list[float], k: int, floor: float = 0.0, where: Column | None = None, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query by cosine, at floor or above, filtered before they are scored."""
    kept = rows if where is None else rows.where(where)
    scored = kept.withColumn("score", F.round(cosine(F.col(vector), F.array(*map(F.lit, query))), 6)).where(F.col("score") >= floor)
    return scored.orderBy(F.desc("score"), id_).limit(k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float, tag: str = "container_tag", id_: str = "vec_id", vector: str = "embedding", blocks: int = BLOCKS) -> DataFrame:
    """query_id, id, score and rank: for each query its k nearest rows of the same namespace at floor or above, itself excluded.

    Every query meets every row of its namespace once. Rows are dealt to blocks by a hash of their id and queries go to each block, so
    that a namespace with most of the rows is the work of that many tasks; each block passes on k rows of a query at most.
    """
    q = queries.select(F.col(tag).alias("tag"), F.col(id_).alias("query_id"), unit(F.col(vector)).alias("q")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    v = rows.select(F.col(tag).alias("tag"), F.col(id_).alias("id"), unit(F.col(vector)).alias("v"), F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"))
    scored = q.join(v, ["tag", "block"]).where("query_id <> id").select("query_id", "block", "id", F.round(dot(F.col("q"), F.col("v")), 6).alias("score")).where(F.col("score") >= floor)
    best = Window.orderBy(F.desc("score"), "id")
    within = scored.withColumn("rank", F.row_number().over(best.partitionBy("query_id", "block"))).where(F.col("rank") <= k)
    return within.select("query_id", "id", "score", F.row_number().over(best.partitionBy("query_id")).alias("rank")).where(F.col("rank") <= k)


def term_frequencies(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, token and tf of each document's words."""
    return docs.select(id_, F.explode(T.sparse_tokens(F.col(text))).alias("token")).groupBy(id_, "token").agg(F.count("*").alias("tf"))


def asked_frequencies(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", text: str = "text", limit: int = 16 << 20) -> DataFrame:
    """term_frequencies of the words alone that some query (query_id, token, tf) has: other words never leave their document's task.

    The queries' distinct words are broadcast if they are counted to fit in limit, else the words are joined by a shuffle.
    """
    wanted = queries.select("token").distinct()
    count = wanted.count()
    wanted = F.broadcast(wanted) if count * 64 <= limit else wanted.hint("shuffle_hash")
    words = docs.select(id_, F.explode(T.lower_words(F.col(text))).alias("token"))
    return words.join(wanted, "token", "left_semi").groupBy(id_, "token").agg(F.count("*").alias("tf"))


def holders(docs: DataFrame, items: DataFrame, id_: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """id and item of each document and item whose text the document's text contains.

    An item's words but its first and last are whole words of any text that contains it, so documents meet items by the first three
    of those (fewer if there are no three), hashed; what meets is confirmed. Items of one or two words may begin and end within a
    word and are looked for as they are; items without a word are in no text but by chance and are left out.
    """
    space = r"\s+"
    inner = F.slice(F.split(F.trim(F.regexp_replace(text, space, " ")), " "), 2, 1 << 30)
    inner = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    mine = items.where(F.length(F.trim(text)) > 0).select(F.col(item).alias("item_"), F.col(text).alias("body"), inner.alias("inner"))
    mine = mine.withColumn("n", F.least(F.size("inner"), F.lit(3)))
    keyed = mine.where("n > 0").select("item_", "body", "n", F.xxhash64(F.array_join(F.slice("inner", 1, F.col("n")), " ")).alias("key"))
    words = F.split(F.regexp_replace(text, space, " "), " ")
    # The words are bound before the windows, so that they are split once for a text. Only keys meet; texts of what met come last.
    split = docs.select(id_, F.transform(F.array(words), lambda w: w)[0].alias("words"))

    def meeting(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1)))
        windows = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("words", i, n), " ")))
        met = split.select(id_, F.explode(F.array_distinct(windows)).alias("key")).join(keyed.where(F.col("n") == n).select("item_", "key"), "key")
        return met.select(id_, "item_").distinct()

    found = None
    for n in sorted(r.n for r in keyed.select("n").distinct().collect()):  # 1, 2 and 3 at most
        found = meeting(n) if found is None else found.unionByName(meeting(n))
    if found is not None:
        whole = found.join(docs.select(id_, text), id_).join(keyed.select("item_", "body"), "item_")
        found = whole.where(F.contains(F.col(text), F.col("body"))).select(id_, F.col("item_").alias(item))
    short = mine.where("n = 0").select("item_", "body")
    if short.limit(1).count() or found is None:
        direct = docs.join(short, F.contains(docs[text], F.col("body"))).select(id_, F.col("item_").alias(item))
        found = direct if found is None else found.unionByName(direct)
    return found.distinct()


def idf(tf: DataFrame, documents: int) -> DataFrame:
    """token, df and idf, ln(1 + (n - df + 0.5) / (df + 0.5))."""
    # Reading tf makes this the same aggregate as tf's own, so that one shuffle serves both.
    return tf.groupBy("token").agg(F.sum(F.when(F.col("tf") > 0, F.lit(1).cast("long"))).alias("df")).withColumn("idf", F.log1p((documents - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def sparse(tf: DataFrame, weights: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id") -> DataFrame:
    """query_id, id, score and rank: sums over shared words of tf of the query, tf of the document and idf."""
    met = queries.withColumnRenamed("tf", "q").join(weights, "token").join(tf, "token")
    scored = met.groupBy("query_id", id_).agg(F.round(F.sum(F.col("q") * F.col("tf") * F.col("idf")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_)))
    return ranked.where(F.col("rank") <= k)


def asked_counts(docs: DataFrame, tokens: list[str], id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id_, codes and tfs of each document with any of the tokens: which it has, by place, and how often; rows alike in id_ are one document.

    A document's words are counted in its own task. Only ids are shuffled, to see whether any comes twice, and then the counts of those.
    """
    known = docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(known.value, pa.string())
        for batch in batches:
            words = batch.column(1)
            codes = pc.index_in(words.flatten(), value_set=values)
            rows = pc.list_parent_indices(words).filter(codes.is_valid()).to_numpy().astype(np.int64)
            at, tf = np.unique(rows * len(values) + codes.drop_null().to_numpy(), return_counts=True)
            row, code = np.divmod(at, len(values))
            some, lengths = np.unique(row, return_counts=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (code, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), *lists], [id_, "codes", "tfs"])

    kind = docs.schema[id_].dataType.simpleString()
    counts = staged(docs.select(id_, T.lower_words(F.col(text)).alias("words")).mapInArrow(run, f"{id_} {kind}, codes array<int>, tfs array<int>"), "counts")
    twice = staged(counts.groupBy(F.col(id_).alias("_twice")).agg(F.count("*").alias("n")).where("n > 1").select("_twice"), "twice")
    if not twice.limit(1).count():
        return counts
    same = F.col(id_).eqNullSafe(F.col("_twice"))
    each = counts.join(twice, same, "left_semi").select(id_, F.explode(F.arrays_zip("codes", "tfs")).alias("c")).groupBy(id_, F.col("c.codes").alias("code")).agg(F.sum("c.tfs").cast("int").alias("tf"))
    one = each.groupBy(id_).agg(F.collect_list(F.struct("code", "tf")).alias("c")).select(id_, F.col("c.code").alias("codes"), F.col("c.tf").alias("tfs"))
    return counts.join(twice, same, "left_anti").unionByName(one)


def frequencies(counts: DataFrame, words: int) -> np.ndarray:
    """The number of documents (codes) that have each of so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(words, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=words)
        code = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), pa.array(found[code])], ["code", "df"])

    df = np.zeros(words)
    for r in counts.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():  # a row for each word at most
        df[r.code] = r.df
    return df


def best(counts: DataFrame, weights: np.ndarray, queries: list, k: int, id_: str = "doc_id", kind: str = "long") -> DataFrame:
    """query_id (of type kind), id_, score and rank of the k best documents (id_, codes, tfs; rows are documents) for each query.

    weights has a row for each word and a column for each query, what one occurrence adds to the score. A task multiplies some of its
    documents by them at a time and passes on k of each query, so pairs of documents and queries are no rows.
    """
    shared = counts.sparkSession.sparkContext.broadcast(weights)
    id_type = counts.schema[id_].dataType.simpleString()
    keys = [("query", "ascending"), ("score", "descending"), ("id", "ascending")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        words, n = w.shape
        low, held, rows = np.full(n, -1.0), [], 0

        def first() -> pa.Table:
            every = pa.concat_tables(held)
            every = every.take(pc.sort_indices(every, sort_keys=keys, null_placement="at_start"))
            query = every["query"].to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == k - 1
            low[query[last]] = every["score"].to_numpy()[last]
            return every.filter(pa.array(place < k))

        most = max(1, SCORES // max(n, words))
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                m = np.zeros((part.num_rows, words))
                np.add.at(m, (pc.list_parent_indices(part.column(1)).to_numpy(), part.column(1).flatten().to_numpy()), part.column(2).flatten().to_numpy().astype(np.float64))
                raw = m @ w
                score = np.floor(raw * 1e6 + 0.5) / 1e6
                doc, query = np.nonzero((raw > 0) & (score >= low))
                held.append(pa.table({"query": pa.array(query.astype(np.int32)), "id": part.column(0).take(pa.array(doc)), "score": score[doc, query]}))
                rows += len(doc)
                if rows > SCORES // 4:
                    held = [first()]
                    rows = held[0].num_rows
        if held:
            yield from first().combine_chunks().to_batches()

    found = counts.select(id_, "codes", "tfs").mapInArrow(run, f"query int, id {id_type}, score double")
    named = counts.sparkSession.createDataFrame(list(enumerate(queries)), f"query int, query_id {kind}")
    ranked = found.join(F.broadcast(named), "query").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_), "score", "rank")


def weighed(asked: list, tokens: list[str], queries: list, idf: np.ndarray) -> np.ndarray:
    """The weights that best takes, of rows (query_id, token, tf) and the words' idf."""
    word, column = ({v: i for i, v in enumerate(x)} for x in (tokens, queries))
    out = np.zeros((len(tokens), len(queries)))
    for r in asked:
        out[word[r["token"]], column[r["query_id"]]] += r["tf"] * idf[word[r["token"]]]
    return out


def held_weights(queries: DataFrame) -> tuple[list, list[str], list] | None:
    """The rows (query_id, token, tf), words and queries of a search, if a task may hold their weights; else None."""
    rows, words, n = queries.agg(F.count("*"), F.count_distinct("token"), F.count_distinct(F.struct("query_id"))).first()
    if not rows or words * n > MOST_WEIGHTS or rows > MOST_WEIGHTS:
        return None
    asked = queries.select("query_id", "token", "tf").collect()  # MOST_WEIGHTS rows at most
    return asked, sorted({r["token"] for r in asked}), list(dict.fromkeys(r["query_id"] for r in asked))


def sparse_best(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, id_, score and rank of the k best texts for words asked (query_id, token, tf), as sparse has them, written down.

    Where a task may hold all queries' weights, documents are scored where they are; else words meet by joins.
    """
    held = held_weights(queries)
    if held is None:
        tf = asked_frequencies(docs, queries, id_, text)
        return staged(sparse(tf, idf(tf, docs.select(id_).count()), queries, k, id_).select("query_id", id_, "score", "rank"), "hits")
    asked, tokens, names = held
    counts = asked_counts(docs, tokens, id_, text)
    df = frequencies(counts, len(tokens))
    weights = weighed(asked, tokens, names, np.log1p((docs.select(id_).count() - df + 0.5) / (df + 0.5)))
    return staged(best(counts, weights, names, k, id_, queries.schema["query_id"].dataType.simpleString()), "hits")


def fuse(rankings: list[DataFrame], keys: list[str], k: int = RRF_K, base: int = RRF_BASE) -> DataFrame:
    """keys and score: the sum over rankings (keys, rank from 1) of 1 / (k + rank - 1 + base)."""
    every = [r.select(*keys, (F.lit(1.0) / (F.col("rank") + (k - 1 + base))).alias("part")) for r in rankings]
    union = every[0]
    for r in every[1:]:
        union = union.unionByName(r)
    return union.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"))


def first_of(hits: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of hit lists (with hit_pos), earlier lists and hits first; of each key its first."""
    every = [h.withColumn("list", F.lit(i)) for i, h in enumerate(hits)]
    union = every[0]
    for h in every[1:]:
        union = union.unionByName(h)
    ranked = union.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("list", "hit_pos")))
    return ranked.where("n = 1").withColumn("hit_pos", F.struct("list", "hit_pos")).drop("n", "list")


def by_document(hits: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Hits (hit_pos, doc_id, reference, content, score) as documents in the order of their first hit, chunks in order.

    A document is left out if its reference was first claimed by an earlier one; hits without a document are ignored.
    """
    named = hits.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")
    first = F.min(F.struct("hit_pos", "reference"))
    grouped = named.groupBy("doc_id").agg(first.alias("f"), F.array_sort(F.collect_list(F.struct("hit_pos", "content", "score"))).alias("found"))
    reference = F.coalesce(F.col("f.reference"), F.lit(""))
    # Documents without a reference are groups of their own, not one hot group.
    claim = F.row_number().over(Window.partitionBy(reference, F.when(reference == "", F.col("doc_id"))).orderBy("f.hit_pos", "doc_id"))
    kept = grouped.withColumn("claim", claim).where(F.col("claim") == 1)
    return kept.select("doc_id", F.col("f.hit_pos").alias("first_pos"), F.col("f.reference").alias("reference"), F.transform("found", lambda c: F.struct(c["content"], c["score"])).alias("chunks")).orderBy("first_pos", "doc_id").limit(documents)


def placed(hits: DataFrame) -> DataFrame:
    """query_id, id and rank of hits (query_id, id, score), best first."""
    return hits.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank"))


def documents_of(hits: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """query_id, doc_id and rank of the first documents of many questions' hits (query_id, doc_id, rank), each where its best hit stands.

    Hits without a document are ignored; a question without hits has no row.
    """
    best = hits.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.min("rank").alias("_best"))
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_best", "doc_id")))
    return placed.where(F.col("rank") <= documents).drop("_best")


def reranked(query: str, body: Column, reranker) -> Column:
    """The relevance of texts to a query by a reranker, a call to a batch of rows."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(reranker.relevance(query, texts.fillna("").tolist()), dtype="float64")

    return run(body)


def rerank(results: DataFrame, query: str, score: Column, floor: float = 0.15, boost: float = 0.4) -> DataFrame:
    """Results (first_pos, title) by score plus boost times title overlap, those under floor dropped; in their old order if that leaves none."""
    scored = results.withColumn("relevance", score).withColumn("kept", F.col("relevance") >= floor)
    scored = scored.withColumn("any", F.coalesce(F.max(F.col("kept")).over(Window.partitionBy(F.lit(1))), F.lit(False)))
    final = F.round(F.col("relevance") + boost * T.title_overlap(F.lit(query), F.col("title")), 6)
    kept = scored.where(F.col("kept") | ~F.col("any")).withColumn("final", F.when(F.col("any"), final))
    return kept.orderBy(F.desc_nulls_last("final"), "first_pos").drop("kept", "any")

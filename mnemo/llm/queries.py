"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.llm import audit, decontam, hamming, licences, mixing, neardup, quality, secrets_scan, sharding, spelling, substring, token_store, toxicity
from mnemo.llm.common import prepare, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"))


def op7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where(F.col("vec_id") % hamming.QUERY_EVERY == 0))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.plan(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(f) for name, f in globals().items() if name.startswith("op") and callable(f)}


_SIZES = r"""sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':mix-1') as key
  from documents),
per as (
  select source, sum(size) as source_size, row_number() over (order by source asc nulls last) as place from sized group by source),
capped as (
  select *, (place - 1) % 3 + 1 as weight, 3 * source_size as cap from per),
units as (
  select *, ((sum(source_size) over ()) - coalesce(sum(cap) over (order by cast(cap as double) / weight, source nulls last
             rows between unbounded preceding and 1 preceding), 0))
           / cast(sum(weight) over (order by cast(cap as double) / weight, source nulls last
             rows between current row and unbounded following) as double) as unit
  from capped),
goal as (
  select source, source_size, weight, cap, max(unit) over () as unit from units),
targets as (
  select source, source_size, least(cast(cap as double), unit * weight) as target from goal),
placed as (
  select s.doc_id, s.source, s.size, s.key, t.source_size, t.target,
         coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join targets t on s.source is not distinct from t.source),
taken as (
  select doc_id, size, source_size, target, cast(floor(target) as bigint) as words, before,
         case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as epochs
  from placed)"""

OP3_SQL = f"""with {_SIZES}
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
       cast(epochs * size + greatest(0, least(size, words - epochs * source_size - before)) as bigint) as taken
from taken"""


OP7_SQL = """with codes as (
  select vec_id, list_transform(embedding, lambda x: coalesce(x >= 0 and not isnan(x), false)) as bits
  from embeddings where vec_id is not null and embedding is not null),
pairs as (
  select q.vec_id as query_id, r.vec_id,
         len(list_filter(range(1, len(q.bits) + 1), lambda i: q.bits[i] <> r.bits[i])) as distance
  from codes q, codes r where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs)
select query_id, cast(rank as bigint) as rank, vec_id, cast(distance as bigint) as distance from ranked where rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op7_hamming": OP7_SQL, "op8_licences": licences.oracle_sql(), "op11_sharding": sharding.oracle_sql(), "op12_spelling": spelling.oracle_sql(), "op13_filter_audit": audit.SQL}

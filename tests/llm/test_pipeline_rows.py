"""The pipeline and the mix on odd and empty tables."""

from collections import Counter

import corpus_pipeline
from mnemo.llm import mixing
from tests.llm.test_llm import SF, odd


def tables(spark, tmp_path, docs):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    return f"file://{tmp_path}"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Clashing columns pass through, nulls crash nothing, rows alike in doc_id are judged by their texts."""
    some = odd(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    folder = tables(spark, tmp_path, some)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == some.columns, name
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, odd(spark).limit(0))).count() == 0


def test_mix_on_odd_rows(spark):
    """Each row is there as often as its plan says, whole: epochs, and once more up to the cut."""
    d = odd(spark)
    out = mixing.apply_mix(d)
    assert out.columns == d.columns
    got, rows = Counter((r.doc_id, r.text) for r in out.collect()), Counter((r.doc_id, r.text) for r in d.collect())
    sized = mixing._sized(d, mixing.SEED, mixing.RANGE_DOCS)
    plan = {(r.doc_id, r.size): r for r in mixing.taken(sized).collect()}
    for (i, text), n in rows.items():
        size = len((text or "").split())
        r = plan[i, size]
        assert n * r.epochs <= got[i, text] <= n * (r.epochs + 1) if size else got[i, text] == 0
    assert mixing.apply_mix(d.limit(0)).count() == 0


def test_mix_many_ranges_and_null_ids(spark):
    """Ranges of few documents, grouped, and half of the rows without an id: each source's words are met exactly, runs agree, ranges of different texts stay even."""
    rows = [(None if i % 2 else i, f"s{i % 3}" if i % 7 else None, f"w{i} " * (i % 9)) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    read = lambda: sorted((tuple(r) for r in mixing.plan(d, per_range=2).collect()), key=str)
    one = read()
    assert one == read() and len(one) == 4000
    for source in ("s0", "s1", "s2", None):
        own = [r for r in one if r[1] == source]
        assert sum(r[5] for r in own) == int(own[0][4]) and own[0][3] == sum(r[2] for r in own)
    ranges = mixing._sized(d, mixing.SEED, 2).where("doc_id is null and size > 0").groupBy("range").count()
    assert ranges.agg({"count": "max"}).first()[0] < 20

"""The token store's files are in ascending doc_id order."""

import glob

from mnemo.llm import token_store


def test_packs_and_recipes_ascend(spark, tmp_path):
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    # Copies have their chunks elsewhere, so rows with and without packs of their own stand side by side.
    rows = [(k * 37 % 101, f"text {k % 60} " * 300) for k in range(101)] + [(None, "no id"), (None, None), (5, "text 5 " * 300)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path}/s")
    spark.conf.unset(small)
    for table in ("packs", "recipes"):
        files = sorted(glob.glob(f"{tmp_path}/s/{table}/part-*"))
        each = [[(r.doc_id if r.doc_id is not None else -1, r.row_key) for r in spark.read.parquet(f"file://{f}").collect()] for f in files]
        assert len(files) > 1 and len(sum(each, [])) == 104 and sum(each, []) == sorted(sum(each, []))
    packs = spark.read.parquet(f"file://{tmp_path}/s/packs")
    assert packs.where("size(a) = 0").count() > 10 and packs.select("a", "b").count() == 104
    got = token_store.read_store(spark, f"file://{tmp_path}/s").collect()
    assert len(got) == 104 and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)


def test_batches_with_and_without_foreign_chunks(spark, tmp_path):
    rows = [(k, f"own {k} " * 200) for k in range(20)] + [(20 + k, f"own {k} " * 200) for k in range(20)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")  # a task's first batches have no chunk of another row, its later ones have
    try:
        token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), f"file://{tmp_path}/s")
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read_store(spark, f"file://{tmp_path}/s", digest=True).collect()}
    finally:
        spark.conf.set(size, before)
    assert len(got) == 40 and all(got[k] == got[20 + k] for k in range(20))

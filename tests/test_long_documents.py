import hashlib

from pyspark.sql import functions as F

from mnemo import queries as Q
from mnemo.operators import chunking as C
from mnemo.plans.ingest import ingest, prepared
from mnemo.sources import readers
from mnemo.sources.warehouse import Warehouse

LONG = " ".join(f"Sentence {k} says that river {k * 7919 % 1009} is old." for k in range(2500))


def test_document_chunks_are_of_whole_texts(spark, tmp_path):
    assert len(LONG) > 90_000
    texts = {1: LONG, 2: LONG[:70_000] + "\n\n" + "x" * 5000, 3: "# One\n" + LONG + "\n## Two\nlast words", 4: "short", 5: None, 6: ""}
    spark.createDataFrame([(i, t, "web") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.chunk_index): r.content for r in Q.QUERIES["document_chunks"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): c for i, t in texts.items() for k, c in enumerate(C.chunk(t, "web"))}


def test_ingest_keeps_documents_that_differ_late(spark, tmp_path):
    key = "AKIA" + "A1" * 8
    docs = spark.createDataFrame([("a", LONG + " First end.", ""), ("b", LONG + " Second end. " + key, "")], "id string, content string, reference string")
    docs = readers.texts(docs)
    assert {r.id: r.content_hash for r in prepared(docs).collect()}["a"] == hashlib.sha256((LONG + " First end.").encode()).hexdigest()
    w = Warehouse(spark, f"file://{tmp_path}/w")
    ingest(w, docs, 100)
    assert sorted(r.id for r in w.current("documents").collect()) == ["a", "b"]
    ends = {r.document_id: r.content for r in w.current("chunks").where(F.col("content").contains(" end.")).collect()}
    assert "First end." in ends["a"] and "Second end. [REDACTED:aws_key]" in ends["b"]

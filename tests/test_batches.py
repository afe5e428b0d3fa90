"""One batch of documents against the same documents one by one; quotes with their places; flags, usage, indexes and OCR in use."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemo.operators import predicates as P
from mnemo.plans import reconcile, services
from mnemo.plans.engine import Engine
from mnemo.plans.ingest import ingest
from mnemo.plans.providers import SameKey, Triples
from mnemo.plans.retrieve import build_indexes, chunk_indexes, retrieve
from mnemo.sources import readers
from mnemo.sources.blobs import Blobs
from mnemo.sources.warehouse import Warehouse
from tests.test_scenarios import Lines


def docs(spark, rows):
    """Documents of (id, captured_at, text)."""
    df = spark.createDataFrame([(i, at, t, "") for i, at, t in rows], "id string, captured_at long, content string, reference string")
    return readers.texts(df, "t").drop("captured_at").join(df.select("id", "captured_at"), "id")


def tell(w, rows, now=500, **more):
    ingest(w, docs(w.spark, rows), now, **({"distiller": Lines(), "judge": SameKey(), "least": 1} | more))


def state(w):
    rows = w.current("memories").collect()
    said = {r.id: r.statement for r in rows}
    return sorted((r.id, r.statement, r.is_latest, said.get(r.superseded_by), said.get(r.supersedes), said.get(r.extends), r.superseded_at) for r in rows)


@pytest.fixture
def w(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/w")


ROWS = [
    ("d1", 10, "home city of ada is oslo\nada likes black tea"),
    ("d2", 20, "home city of ada is rome"),
    ("d3", 30, "Home city of Ada is rome\nada likes black tea very"),
    ("d4", 40, "home city of ada is lima\nwhales swim in the cold north sea"),
    ("d5", 5, "home city of bob is bonn"),
]


def test_a_batch_is_its_documents_one_by_one(spark, w, tmp_path):
    one = Warehouse(spark, f"file://{tmp_path}/one")
    tell(w, [("d0", 1, "home city of ada is kyiv")])
    tell(one, [("d0", 1, "home city of ada is kyiv")])
    tell(w, random.Random(1).sample(ROWS, len(ROWS)))
    for row in sorted(ROWS, key=lambda r: r[1]):
        tell(one, [row])
    assert state(w) == state(one)
    assert [r.statement for r in w.current("memories").where(P.active(600) & F.col("statement").contains("of ada")).collect()] == ["home city of ada is lima"]


def test_rounds(spark, w):
    """Unrelated documents go together; related ones in order; a crowd of one namespace one after the other."""
    rows = [(f"m{k}-0", f"u{k % 2}", [1.0 if j == k % 4 else 0.0 for j in range(4)], f"d{k}") for k in range(8)]
    facts = spark.createDataFrame(rows, "id string, container_tag string, embedding array<double>, document_id string")
    order = spark.createDataFrame([(f"d{k}", f"u{k % 2}", 100 - k) for k in range(8)], "document_id string, container_tag string, captured_at long")
    got = lambda reach: {(r.early, r.late) for r in reconcile.dependencies(facts, order, w.current("memories"), 0, reach).collect()}
    assert got(20) == {("d4", "d0"), ("d5", "d1"), ("d6", "d2"), ("d7", "d3")}
    assert got(1) == got(20) | {("d6", "d4"), ("d4", "d2"), ("d2", "d0"), ("d7", "d5"), ("d5", "d3"), ("d3", "d1")}


def test_demotion_is_tried_again():
    left = [OSError("a"), OSError("b"), None]

    def step():
        if e := left.pop(0):
            raise e

    reconcile.tried(step)
    assert not left
    with pytest.raises(OSError):
        reconcile.tried(lambda: (_ for _ in ()).throw(OSError("always")))


def test_quotes_have_places(w):
    text = "ada likes black tea\n\n" + "\n\n".join(f"Paragraph {k} is filler. " + "word " * 200 for k in range(4)) + "\n\nbob plays the long flute"
    tell(w, [("d", 1, text)])
    chunks = {r.id: r.content for r in w.current("chunks").collect()}
    spans = {r.quote: r for r in w.current("memory_evidence").collect()}
    for quote in ("ada likes black tea", "bob plays the long flute"):
        r = spans[quote]
        assert chunks[r.chunk_id][r.char_start : r.char_end] == quote
    assert spans["ada likes black tea"].chunk_id == "d-0" != spans["bob plays the long flute"].chunk_id


def test_indexes_find_what_the_scan_finds(spark, w):
    topics = ["red apples grow on old trees", "blue whales swim in cold water", "green trains run on time", "old clocks tick at night"]
    rows = [(f"d{k}", k, f"{topics[k % 4]} number {k} {'whales ' * (k % 3)}") for k in range(24)]
    tell(w, rows[:16], distill=False)
    build_indexes(w, 3)
    tell(w, rows[16:], distill=False, indexed=True)
    cells, words = chunk_indexes(w)
    chunks = w.current("chunks").withColumnRenamed("document_id", "doc_id").join(w.current("documents", "title", "reference", "source", "captured_at").withColumnRenamed("id", "doc_id"), "doc_id")
    assert cells.rows().count() == chunks.count() == sum(words.batches().values())
    for hybrid in (False, True):
        for plan in (P.Plan("cold whales"), P.Plan("cold whales", after=8, before=18)):
            a, b = (retrieve(chunks, plan, ["t"], 30, hybrid_search=hybrid, **i).select("doc_id", "first_pos").collect() for i in ({}, {"cells": cells, "words": words}))
            if plan.constrained and hybrid:  # words weigh by all chunks in the index, by those that may be found without it
                assert {r.doc_id for r in a} == {r.doc_id for r in b}
            else:
                assert sorted(a) == sorted(b)
            assert len(a) > 3


class Service:
    """A transport that answers every prompt from a table of words; it goes to workers with the jobs."""

    def __call__(self, url, headers, body):
        if "document" in body:
            return {"pages": [{"markdown": "seen text of an image"}]} if "png" in json.dumps(body) or "cG5n" in json.dumps(body) else {"pages": []}
        asked = body["messages"][-1]["content"]
        if "one line what this document" in asked:
            said = "A line about the document."
        elif "Split this question" in asked:
            said = '["cold whales", "green trains"]'
        elif "lasting facts" in asked:
            said = '[{"statement": "ada likes tea", "kind": "preference", "confidence": 0.9, "evidence": "ada likes tea"}]'
        else:
            said = "[]"
        return {"choices": [{"message": {"content": said}}]}


def test_flags_act(spark, tmp_path):
    text = "# Head\n\nada likes tea " + "and more words " * 40 + "\n\n## Next\n\nada | visits | rome | 2024-01-02\n" + "filler " * 60

    def run(name, rows=(("d1", 1, text),), **flags):
        engine = Engine(Warehouse(spark, f"file://{tmp_path}/{name}"), services.Config(model_key="k", model_url="http://h", model="m", multi_query=flags.pop("multi_query", False), **flags), Service(), judge=SameKey(), extractor=Triples())
        engine.ingest(docs(spark, list(rows)), 100)
        return engine

    vectors = lambda e: sorted(list(r.embedding) for r in e.warehouse.current("chunks").collect())
    plain = run("plain")
    assert plain.warehouse.current("memories").count() == 1 and not plain.warehouse.current("edges").count()
    assert not run("distill", distill=False).warehouse.current("memories").count()
    assert run("graph", temporal_graph=True).warehouse.current("edges").count() == 1
    assert vectors(run("contextual", contextual=True)) != vectors(plain) != vectors(run("keys", fact_augmented_keys=True))
    assert {r.content for r in run("chunks", smart_chunking=False).warehouse.current("chunks").collect()} != {r.content for r in plain.warehouse.current("chunks").collect()}
    two = (("d1", 1, text), ("d2", 2, "ada likes tea " + text))
    assert run("merged", two).warehouse.current("memories").count() == 1 and run("added", two, memory_graph=False).warehouse.current("memories").count() == 2
    stored = run("blobs", blob_dir=f"file://{tmp_path}/b")
    assert stored.config.blob_dir and Blobs(spark, stored.config.blob_dir).get("d1") == text.encode() and Blobs(spark, stored.config.blob_dir).get("none") is None
    bodies = spark.createDataFrame([("", "b" * 300)], "reference string, body string")
    web = Engine(Warehouse(spark, f"file://{tmp_path}/web"), services.Config(fetch_web_bodies=True))
    web.ingest(docs(spark, [("d1", 1, text)]), 100, bodies)
    assert any("bbb" in r.content for r in web.warehouse.current("chunks").collect())


def test_parts_of_a_question_and_usage(spark, tmp_path):
    rows = [("d1", 1, "blue whales swim in cold water"), ("d2", 2, "green trains run on time"), ("d3", 3, "stones are hard")]
    w = Warehouse(spark, f"file://{tmp_path}/w")
    found = {}
    for multi in (False, True):
        engine = Engine(w, services.Config(model_key="k", model_url="http://h", model="m", multi_query=multi), Service())
        engine.ingest(docs(spark, rows).repartition(2), 100, least=1)
        found[multi] = {r.doc_id for r in engine.answered("cold whales", ["t"], 200)[0].collect()}
        if not multi:  # a call for each document, from whatever worker; one for the plan
            assert engine.usage.total.calls >= 4 and engine.usage.total.sent > 100
    assert "d2" not in found[False] and {"d1", "d2"} <= found[True]


def test_ocr_service_reads_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"png")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.txt").write_text("plain text")
    ocr = services.ServiceOcr("u", "k", "m", Service())
    got = {r.title: r.content for r in readers.any_files(spark, f"file://{tmp_path}", ocr=ocr).collect()}
    assert got == {"a.png": "seen text of an image", "c.txt": "plain text"}

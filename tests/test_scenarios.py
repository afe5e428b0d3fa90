"""What a user sees over time: facts that change, repeat, extend and expire, and what maintenance leaves of them."""

import zipfile

import pytest
from pyspark.sql import functions as F

from mnemo.functions import parsing
from mnemo.operators import predicates as P
from mnemo.plans import edges, maintenance, profiles
from mnemo.plans.ingest import ingest
from mnemo.plans.providers import Answers, SameKey, Sentences, Triples
from mnemo.plans.retrieve import answered, facts_for, hybrid
from mnemo.plans.verbs import Service
from mnemo.sources import readers
from mnemo.sources.blobs import Blobs
from mnemo.sources.warehouse import Warehouse


class Lines:
    """Each line of a text is a fact."""

    def distil(self, text):
        return [{"statement": line, "kind": "preference", "confidence": 0.9, "evidence": line} for line in text.split("\n") if line.strip()]


def tell(w, day, text, id_=None, tag="t", **more):
    docs = w.spark.createDataFrame([(id_ or f"d{day}", text, "")], "id string, content string, reference string")
    ingest(w, readers.texts(docs, tag), day, distiller=Lines(), least=1, **{"judge": SameKey(), **more})


@pytest.fixture
def w(spark, tmp_path):
    return Warehouse(spark, f"file://{tmp_path}/w")


def active(w, now=1000, tag="t"):
    return sorted(r.statement for r in w.current("memories").where(P.in_tag(tag) & P.active(now)).collect())


def test_changes(w):
    """Update supersedes, duplicate is dropped, extension stays beside, the past stays readable, namespaces don't touch."""
    tell(w, 100, "home city of ada is oslo\nada likes black tea")
    tell(w, 100, "home city of ada is lima", "other", "u")
    tell(w, 200, "home city of ada is rome\nAda likes black tea\nada likes black tea very")
    assert active(w) == ["ada likes black tea", "ada likes black tea very", "home city of ada is rome"]
    assert active(w, tag="u") == ["home city of ada is lima"]
    rows = {r.statement: r for r in w.current("memories").where("container_tag = 't'").collect()}
    old, new = rows["home city of ada is oslo"], rows["home city of ada is rome"]
    assert (old.is_latest, old.superseded_by, old.superseded_at, new.supersedes) == (False, new.id, 200, old.id)
    assert rows["ada likes black tea very"].extends == rows["ada likes black tea"].id
    s = Service(w)
    assert "home city of ada is oslo" in {r.statement for r in s.as_of("t", 150).collect()}
    assert "home city of ada is oslo" not in {r.statement for r in s.as_of("t", 250).collect()}
    documents, facts = answered(w, "home city of ada is", ["t"], 1000)
    found = facts.collect()
    assert found[0].statement == "home city of ada is rome" and found[0].evidence[0].quote == "home city of ada is rome"
    assert documents.count() == 2 and "oslo" not in " ".join(f.statement for f in found)


def test_rivals_in_one_batch(w):
    tell(w, 100, "home city of ada is oslo")
    tell(w, 200, "home city of ada is rome\nhome city of ada is bonn")
    assert active(w) == ["home city of ada is bonn"]


def test_expiry_and_failing_judge(w):
    class Broken:
        def judge(self, facts):
            raise RuntimeError("no model")

    tell(w, 100, "ada is on leave [until 1970-01-02]\nada likes tea")
    assert active(w, 86_400) == ["ada is on leave", "ada likes tea"] and active(w, 200_000) == ["ada likes tea"]
    tell(w, 200, "ada likes tea a lot", judge=Broken())
    assert active(w, 200_000) == ["ada likes tea", "ada likes tea a lot"]


def test_model_answers(w):
    said = iter(['[{"i": 1, "relation": "UPDATE", "ref": 1, "confidence": "low"}]'])
    tell(w, 100, "ada drinks black tea")
    verdicts = Answers(lambda prompt: next(said)).judge([("ada drinks green tea", ["ada drinks black tea"])])
    assert verdicts == [{"relation": "UPDATE", "ref": 1, "confidence": "low"}]
    assert Answers(lambda prompt: "none").distil("x") == [] and Answers(lambda prompt: "none").edges("x", None) == []

    class Unsure:
        def judge(self, facts):
            return verdicts * len(facts)

    tell(w, 200, "ada drinks black tea daily", judge=Unsure())
    assert active(w) == ["ada drinks black tea"] and w.current("memories").where("needs_review and supersedes is null").count() == 1


def test_edge_jobs(w):
    assert parsing.edges('x [{"subject": "Ada B.", "predicate": "lives in", "object": "Oslo", "date": "2024-02-31", "singular": "false"}, {"object": 1}]', "2024-01-01") == [
        {"subject": "ada_b", "predicate": "lives_in", "object": "Oslo", "date": "2024-01-01", "singular": False}]
    filler = "\n" + "x" * 300
    tell(w, 100, "ada | lives in | Oslo | 2020-01-01\nada | visited | Paris | 2020-02-01 | event\nada | visited | paris | 2021-02-01 | event\nada | visited | Rome | 2022-02-01 | event" + filler, extractor=Triples())
    tell(w, 200, "ada | lives in | Bonn | 2023-01-01" + filler, extractor=Triples())
    tell(w, 300, "short | is | ignored", extractor=Triples())
    stored = w.current("edges")
    assert {(r.object, r.is_latest) for r in stored.where("singular").collect()} == {("Oslo", False), ("Bonn", True)}
    assert edges.latest(stored, "t").count() == 4
    line = {r.predicate: r.line for r in edges.resolved_for(stored, "t", "ada lives_in", 1_700_000_000).collect()}["lives_in"]
    assert "CURRENT = Bonn" in line and "Oslo (2020-01-01)" in line
    assert [r.object for r in edges.instances_for(stored, "t", "ada visited").collect()] == ["Paris", "Rome"]


def test_maintenance(w):
    tell(w, 100, "ada likes tea and scones in the garden\n" + "y" * 250, fact_keys=True)
    spark = w.spark
    index = spark.createDataFrame([("c1", "old", "Old", "note", "", 5, "t", 0, "bob likes tea", [0.5] * 64), ("c2", "old", "Old", "note", "", 5, "t", 1, "and ale", [0.5] * 64)], "id string, doc_id string, title string, source string, reference string, captured_at long, container_tag string, chunk_index int, content string, embedding array<float>")
    facts = spark.createDataFrame([("f1", "old", "bob likes tea", "fact", "t", 5, None, None, [0.5] * 64)], "id string, doc_id string, fact string, kind string, container_tag string, captured_at long, is_latest boolean, valid_until long, embedding array<float>")
    assert maintenance.backfill(w, "t", index, facts, 300) == {"documents": 1, "chunks": 2, "memories": 1}
    assert maintenance.backfill(w, "t", index, facts, 300) == {"documents": 0, "chunks": 0, "memories": 0}
    assert w.current("memories").where("id = 'f1' and kind = 'unknown' and is_latest").count() == 1
    assert maintenance.rebuild(w, "t") == {"chunks": 3, "memories": 3, "edges": 0}
    assert facts_for(w.current("memories"), "bob likes tea", ["t"], 1).first().id == "f1"
    assert hybrid(w.current("chunks"), "bob ale tea", 2).select("id").collect()[0].id in ("c1", "c2")
    maintenance.redistil(w, "t", 400, SameKey(), Sentences(5))
    assert {r.document_id for r in w.current("memories").where("learned_at < 400").collect()} == {"old"}  # too short to be distilled anew
    docs = spark.createDataFrame([("u1", None, "no namespace", "")], "id string, container_tag string, content string, reference string")
    w.write("documents", docs)
    maintenance.claim(w, "z")
    assert w.current("documents").where("container_tag = 'z'").count() == 1


def test_profiles(w):
    tell(w, 1_000_000, "ada likes tea")
    first = profiles.profile(w, "t", 1_000_100).first()
    assert (first.static_text, first.dynamic_text) == ("ada likes tea", "ada likes tea")
    tell(w, 1_000_200, "bob owns a boat")
    assert profiles.profile(w, "t", 1_000_300).first().static_text == "ada likes tea"
    assert "bob owns a boat" in profiles.profile(w, "t", 1_010_000).first().static_text
    profiles.invalidate(w, "t")
    assert w.current("profiles").count() == 0 and profiles.profile(w, "none", 5).count() == 0
    block = w.spark.range(1).select(profiles.prompt_block(F.lit("a"), F.lit(""))).first()[0]
    assert block == "## About the user\na"


def test_files_and_blobs(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "a.txt").write_text("plain text")
    (folder / "b.png").write_bytes(b"\x89PNG")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "e.doc").write_bytes(b"\x00")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>there</w:t></w:p></w:document>')

    class Ocr:
        def read(self, content, name):
            return f"seen {name}"

    got = {r.title: r.content for r in readers.any_files(spark, f"file://{folder}", ocr=Ocr()).collect()}
    assert got == {"a.txt": "plain text", "b.png": "seen b.png", "c.pdf": "seen c.pdf", "d.docx": "Hello\nthere"}
    docs = spark.createDataFrame([("1", "head", "u1"), ("2", "head", "u2")], "id string, content string, reference string")
    bodies = spark.createDataFrame([("u1", "b" * 200), ("u2", "short")], "reference string, body string")
    assert {r.id: len(r.content) for r in readers.enriched(docs, bodies).collect()} == {"1": 206, "2": 4}
    blobs = Blobs(spark, f"file://{tmp_path}/b")
    assert blobs.put("a/../b", b"\x00\xff").endswith("/ab") and blobs.get("ab") == b"\x00\xff" and blobs.get("none") is None

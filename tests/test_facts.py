"""Facts by segment and their merge by document."""

import pytest

from mnemo.plans import facts
from mnemo.plans.ingest import ingest
from mnemo.plans.providers import Answers, SameWords, Sentences, distil_segments
from mnemo.sources import readers
from mnemo.sources.warehouse import Warehouse
from tests.test_segments import text

SAID = "id string, container_tag string, segment int, failed boolean, facts array<struct<statement:string,kind:string,confidence:double,evidence:string>>"


class Fixed:
    """Answers by the first statement of a document."""

    def __init__(self, answers):
        self.answers = answers

    def merge(self, statements):
        return self.answers[statements[0]]


def run(spark, rows, merger=None, cap=50):
    said = spark.createDataFrame([(i, "t", s, failed, [(x, f"k{s}", 0.9, f"e{s}") if x else (None, None, None, None) for x in found]) for i, s, failed, found in rows], SAID)
    found = facts.merged(facts.numbered(said), merger, lambda df: df, cap).orderBy("id", "place").collect()
    return [(r.id, r.place, r.statement, r.kind, r.confidence, r.evidence) for r in found]


def test_a_merged_statement_keeps_the_type_of_an_equal_one(spark):
    rows = [("a", 0, False, ["one", "two"]), ("a", 1, False, ["two", "three"])]
    assert run(spark, rows, Fixed({"one": ["two", "one and three"]})) == [("a", 0, "two", "k1", 0.9, "e1"), ("a", 1, "one and three", "unknown", 0.5, None)]


@pytest.mark.parametrize("answer", [{}, {"one": None}, {"one": []}])
def test_without_an_answer_the_first_of_statements_alike_stay(spark, answer):
    rows = [("a", 0, False, ["one", "Two "]), ("a", 1, False, ["two", "three"])]
    want = [("a", 0, "one", "k0", 0.9, "e0"), ("a", 1, "Two ", "k0", 0.9, "e0"), ("a", 2, "three", "k1", 0.9, "e1")]
    assert run(spark, rows, Fixed(answer)) == run(spark, rows) == want


def test_one_segment_is_not_merged(spark):
    assert [r[2] for r in run(spark, [("a", 0, False, ["one", "one", None])], Fixed({}))] == ["one", "one"]


def test_segments_behind_a_failure_do_not_count(spark):
    rows = [("a", 0, False, ["one"]), ("a", 1, True, []), ("a", 2, False, ["three"]), ("b", 0, False, []), ("c", 0, False, ["x"]), ("c", 1, False, ["y"])]
    assert [r[:3] for r in run(spark, rows)] == [("a", 0, "one"), ("c", 0, "x"), ("c", 1, "y")]


def test_cap_and_no_rows(spark):
    rows = [("a", s, False, [f"s{s} {k}" for k in range(10)]) for s in range(8)]
    assert len(run(spark, rows)) == 50 and [r[2] for r in run(spark, rows, cap=3)] == ["s0 0", "s0 1", "s0 2"]
    assert [r[1] for r in run(spark, rows, SameWords())] == list(range(50))
    assert run(spark, []) == run(spark, [], SameWords()) == []


class FailsOn(Sentences):
    def __init__(self, word):
        super().__init__()
        self.word = word

    def distil(self, segment):
        if self.word in segment:
            raise RuntimeError("no answer")
        return super().distil(segment)


def test_documents_as_one_text_at_a_time(spark, tmp_path):
    texts = {"long": text(8), "two": text(2), "short": "A sentence of one segment alone.", "empty": "", "null": None}
    docs = spark.createDataFrame([(k, "t", v, 1) for k, v in texts.items()], "id string, container_tag string, content string, segment int").select("id", "container_tag", "content")
    stage = lambda df: spark.read.parquet(Warehouse(spark, f"file://{tmp_path}/w").stage(df))
    got = facts.document_facts(docs, Sentences(), stage).orderBy("id", "place").collect()
    for name, whole in texts.items():
        assert [r.statement for r in got if r.id == name] == [f["statement"] for f in distil_segments(whole, Sentences())]
    assert {r.statement for r in facts.document_facts(docs, FailsOn("part 1 "), stage).where("id = 'two'").collect()} == {f["statement"] for f in distil_segments(text(1), Sentences())}
    with pytest.raises(Exception, match="no answer"):
        facts.document_facts(docs, FailsOn("part 0 "), stage).collect()


def test_ingest_asks_the_merger_once_for_a_document(spark, tmp_path):
    docs = readers.texts(spark.createDataFrame([("d", text(3), ""), ("e", "A short text. " + "Nothing to be merged in it. " * 20, "")], "id string, content string, reference string"))
    w, asked = Warehouse(spark, f"file://{tmp_path}/w"), tmp_path / "asked"

    class Merger:
        def merge(self, statements):
            with open(asked, "a") as f:
                f.write("asked\n")
            return statements[1:3] + ["A statement of the merger's own."]

    ingest(w, docs, 100, merger=Merger())
    said = {r.id: (r.statement, r.kind) for r in w.current("memories").where("document_id = 'd'").collect()}
    assert len(said) == 3 and said["d-m-2"] == ("A statement of the merger's own.", "unknown") and said["d-m-0"][1] == "claim"
    assert asked.read_text() == "asked\n" and w.current("memories").where("document_id = 'e'").count() > 1


def test_a_model_as_merger():
    assert Answers(lambda prompt: '["united statement"]' if "- first one\n- second one" in prompt else "").merge(["first one", "second one"]) == ["united statement"]
    assert Answers(lambda prompt: "nothing to say").merge(["first one"]) is None
    assert SameWords().merge(["the tea, hot", "Other.", "THE TEA HOT!!!!!", "The tea: hot"]) == ["THE TEA HOT!!!!!", "Other."]

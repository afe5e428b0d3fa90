import pytest

from mnemo.operators.chunking import SEGMENT, paragraphs
from mnemo.plans.ingest import ingest
from mnemo.plans.maintenance import redistil
from mnemo.plans.providers import SameKey, Sentences, distil_segments
from mnemo.sources import readers
from mnemo.sources.warehouse import Warehouse


def text(segments):
    """A text of so many segments of 20 sentences each; the first sentence is the same in all, in another case."""
    return "\n\n".join(" ".join([("THE SAME IN ALL OF THEM." if s % 2 else "The same in all of them."), *(f"Sentence {k} of part {s} is about {'very ' * 47}old river {s * 100 + k}." for k in range(19))]) for s in range(segments))


def test_facts_of_every_segment_are_stored(spark, tmp_path):
    three = text(3)
    assert len(paragraphs(three, SEGMENT, 0)) == 3
    docs = readers.texts(spark.createDataFrame([("d", three, "")], "id string, content string, reference string"))
    w = Warehouse(spark, f"file://{tmp_path}/w")
    ingest(w, docs, 100)
    said = {r.id: r.statement for r in w.current("memories").collect()}
    assert [sum(f"of part {s} " in x for x in said.values()) for s in range(3)] == [9, 9, 9] and len(said) == 28
    assert set(said) == {f"d-m-{k}" for k in range(28)}
    redistil(w, "default", 200, SameKey())
    assert any("of part 2 " in r.statement for r in w.current("memories").collect())


def test_at_most_fifty_of_a_document():
    assert len(distil_segments(text(8), Sentences())) == 50 and len(distil_segments(text(1), Sentences())) == 10
    assert distil_segments(None, Sentences()) == distil_segments("", Sentences()) == []


class Fails(Sentences):
    def __init__(self, at):
        super().__init__()
        self.left = at

    def distil(self, segment):
        self.left -= 1
        if self.left < 0:
            raise RuntimeError("no answer")
        return super().distil(segment)


def test_failures():
    with pytest.raises(RuntimeError):
        distil_segments(text(3), Fails(0))
    assert len(distil_segments(text(3), Fails(2))) == 19

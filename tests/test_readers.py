"""Readers of files, the warehouse's versions and what a read of it touches."""

import pytest
from pyspark.sql import functions as F

from mnemo import queries as Q
from mnemo.sources import readers
from mnemo.sources.warehouse import Warehouse
from tests.compare import same


UNICODE = b"\\" + b"u"


def test_rtf():
    said = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator Word;}\f0 Caf\'e9 costs @8364?5\par{\b bold} \{x\}\tab end@-10179?@-8704?}".replace(b"@", UNICODE)
    assert readers.local_text(said, "a.RTF") == "Café costs €5\nbold {x}\tend\U0001f600"
    assert readers.local_text(b"plain", "a.rtf") is None and readers.local_text(b"{\\rtf1 }", "a.rtf") is None
    assert readers.local_text(rb"{\rtf1 {@c2@8364 ab5}c}}}d".replace(b"@", UNICODE), "b.rtf") == "€5cd"


def test_entities_end_with_a_semicolon():
    assert readers.readable("<h1>a&amp;&amp;&amp;&amp</h1>b&ampx; &copyx; &nosuch; &#65;&#x42; &Eacute;&quot") == "a&&&&amp\nb&ampx; &copyx; &nosuch; AB É&quot"
    assert readers.readable("<p>a\u00a0\u00a0b \t c</p>&amp;copy;") == "a\u00a0\u00a0b c\n&copy;"


def test_pages_as_their_sql(spark, tmp_path):
    rows = [(1, "https://a.example/", "<title>Cut &amp</title><h1>words enough for a page &amp;&amp</h1><p>and more &copy; words</p>"), (2, "https://b.example/", "<p>thirty\u00a0\u00a0letters of text &am in a page</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    same(spark, Q.QUERIES["web_pages"], Q.SQL["web_pages"], str(tmp_path))


def test_depth(spark, tmp_path):
    folder = tmp_path / ".hidden above" / "root"
    for depth in (0, 6, 7):
        place = folder.joinpath(*["d"] * depth)
        place.mkdir(parents=True, exist_ok=True)
        (place / f"at{depth}.md").write_text("text")
    for skipped in ("vendor", ".git"):
        (folder / skipped).mkdir()
        (folder / skipped / "no.md").write_text("text")
    (folder / "long.txt").write_text("x" * 50)
    named = lambda **kw: sorted(r.title for r in readers.files(spark, f"file://{folder}", **kw).collect())
    assert named() == ["at0.md", "at6.md", "long.txt"]
    assert named(depth=7, most_bytes=49) == ["at0.md", "at6.md", "at7.md"]


def test_versions(spark, tmp_path):
    w, ran = Warehouse(spark, f"file://{tmp_path}/w"), []

    def failing(_):
        raise ValueError("not yet")

    with pytest.raises(ValueError, match="not yet"):
        w.migrate({2: lambda _: ran.append(2), 3: failing})
    assert ran == [2] and w.migrate({3: lambda _: ran.append(3), 2: lambda _: ran.append(9)}) == [3]
    assert ran == [2, 3] and w.migrate() == [] and w.current("documents").count() == 0


def test_reads(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.ensure()
    w.write("memories", spark.createDataFrame([("a", "old", [1.0]), ("b", "kept", [2.0])], "id string, statement string, embedding array<float>"))
    w.write("memories", spark.createDataFrame([("a", "new", [3.0])], "id string, statement string, embedding array<float>"))
    one = w.current("memories", "statement").where(F.col("id") == "a")
    assert [tuple(r) for r in one.collect()] == [("a", "new")]
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(id,a)" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert {r.id: r.embedding for r in w.current("memories").collect()} == {"a": [3.0], "b": [2.0]}

import pytest

from mnemo.plans.ingest import ingest
from mnemo.plans.verbs import Service
from mnemo.sources import readers
from mnemo.sources.warehouse import Warehouse


def test_verbs(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    s = Service(w)
    docs = spark.createDataFrame([("d1", "Ada moved to Oslo in spring. " * 12, ""), ("d2", "Tea is green.", "")], "id string, content string, reference string")
    ingest(w, readers.texts(docs, "t"), 100)
    assert [r.id for r in s.timeline("t").collect()] == ["d1", "d2"] and s.timeline("u").count() == 0
    assert s.text_of("d2").first().content == "Tea is green." and s.export("t")["documents"].count() == 2
    assert s.promote("t", "d1-m-0", "team", 200) is None
    s.grant("t", "team", "promote", 150)
    assert s.scopes("t") == ["t", "team"]
    new = s.promote("t", "d1-m-0", "team", 200)
    assert w.current("memories").where(f"id = '{new}' and extends = 'd1-m-0' and container_tag = 'team'").count() == 1
    s.revoke("t", "team", "promote", 210)
    assert s.scopes("t") == ["t"]
    with pytest.raises(ValueError, match="unknown"):
        s.grant("t", "team", "owner", 1)
    s.alias("t", "The Big Apple", "New York", 1)
    s.alias("t", "the big apple", "New York City", 2)
    assert s.resolve("t", " (the BIG apple)") == "New York City" and s.resolve("u", "x") == "x"
    assert not s.forget("u", "d1-m-0", 300) and s.forget("t", "d1-m-0", 300)
    assert s.as_of("t", 1000).where("id = 'd1-m-0'").count() == 0
    assert s.delete_document("t", "d1", 400) and w.current("chunks").where("document_id = 'd1'").count() == 0
    job = s.job("rebuild", 1, "t", 5)
    s.job_update(job, "done", 5, 2)
    assert s.job_get(job).first().state == "done"
    assert {r.action for r in s.audit_list("t").collect()} == {"promote", "forget", "delete_document"}

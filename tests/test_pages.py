"""Pages of a table by cursor, while it is written."""

import pytest
from pyspark.sql import functions as F

from mnemo.sources.warehouse import PAGE, SnapshotGone, Warehouse


def documents(spark, ids, title="old"):
    return spark.createDataFrame([(f"d{k:04d}", title, f"t{k % 2}") for k in ids], "id string, title string, container_tag string")


def scroll(w, at, size, between=lambda n: None, where=None):
    pages, n = [], 0
    while at is not None:
        found, at = w.page(at, size, where, "title", "container_tag")
        pages.append([(r.id, r.title) for r in found.collect()])
        between(n)
        n += 1
    return pages


def test_pages_are_of_the_table_as_it_was(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.write("documents", documents(spark, range(25)))

    def meanwhile(n):
        if n == 0:
            w.write("documents", documents(spark, [3, 15, 24], "new"))
            w.insert("documents", documents(spark, range(25, 40)))
        if n == 1:
            w.write("documents", documents(spark, [22]), deleted=True)

    pages = scroll(w, w.cursor("documents"), 10, meanwhile)
    assert [len(p) for p in pages] == [10, 10, 5] and sum(pages, []) == [(f"d{k:04d}", "old") for k in range(25)]
    now = sum(scroll(w, w.cursor("documents"), PAGE), [])
    assert len(now) == 39 and [t for _, t in now].count("new") == 3


def test_filter_ends_and_empty(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    assert scroll(w, w.cursor("documents"), 10) == [[]]
    w.write("documents", documents(spark, range(20)))
    odd = scroll(w, w.cursor("documents"), 5, where=F.col("container_tag") == "t1")
    assert [len(p) for p in odd] == [5, 5, 0] and sum(odd, []) == [(f"d{k:04d}", "old") for k in range(1, 20, 2)]


def test_compacted_table(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.write("documents", documents(spark, range(12)))
    w.compact("documents")
    at = w.cursor("documents")
    w.write("documents", documents(spark, range(6, 18), "new"))
    assert sum(scroll(w, at, 7), []) == [(f"d{k:04d}", "old") for k in range(12)]


@pytest.mark.parametrize("change", [lambda w: w.compact("documents"), lambda w: w.erase("documents", F.col("id") == "d0001")])
def test_a_rewritten_table_says_so(spark, tmp_path, change):
    w = Warehouse(spark, f"file://{tmp_path}/w")
    w.write("documents", documents(spark, range(5)))
    at = w.page(w.cursor("documents"), 2)[1]
    change(w)
    with pytest.raises(SnapshotGone):
        w.page(at, 2)

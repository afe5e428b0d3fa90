"""Compacted tables: filters reach the files, later batches lie over them."""

from pyspark.sql import functions as F

from mnemo.sources.warehouse import Warehouse


def rows_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.collectToPython()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def documents(spark, n):
    return spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.concat(F.lit("t"), F.col("id") % 40).alias("container_tag"), F.col("id").alias("captured_at"), F.concat(F.lit("h"), "id").alias("content_hash"))


def test_filters_pass_over_files(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.write("documents", documents(spark, 4000))
    log = w.current("documents", "container_tag").where("container_tag = 't7'")
    assert "Exchange" in log._jdf.queryExecution().executedPlan().toString()
    assert log.count() == 100
    # So few rows would else be one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    w.compact("documents")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = w.current("documents", "container_tag", "content_hash")
    one = kept.where("container_tag = 't7'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EqualTo(container_tag,t7)" in plan
    assert one.count() == 100 and rows_read(kept.where("container_tag = 't7'")) < 4000
    # In the range of every file, in the Bloom filter of one.
    assert kept.where("content_hash = 'h77'").count() == 1 and rows_read(kept.where("content_hash = 'h77'")) < 4000
    assert rows_read(kept.where("content_hash = 'h77x'")) == 0
    assert rows_read(kept) == 4000


def test_later_batches_lie_over_a_compacted_table(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "w"))
    w.write("documents", documents(spark, 20))
    w.compact("documents")
    w.update("documents", F.col("id") == "d3", container_tag=F.lit("other"))
    w.write("documents", w.current("documents").where("id = 'd4'"), deleted=True)
    w.write("documents", spark.createDataFrame([("new", "t3")], "id string, container_tag string"))
    now = {r.id: r.container_tag for r in w.current("documents").collect()}
    assert len(now) == 20 and now["d3"] == "other" and "d4" not in now and now["new"] == "t3"
    assert w.current("documents").where("container_tag = 't3'").select("id").collect() == [("new",)]
    w.erase("documents", F.col("id") == "d5")
    assert w.current("documents").count() == 19
    w.compact("documents")
    assert {r.id: r.container_tag for r in w.current("documents", "container_tag").collect()} == {k: v for k, v in now.items() if k != "d5"}

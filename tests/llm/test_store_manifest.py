import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from mnemo.llm import token_store

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store") / "s"
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # several parts of a small store
    token_store.write_store(spark.createDataFrame([(k, f"text {k} " * 100) for k in range(40)], SCHEMA), f"file://{folder}")
    spark.conf.unset(small)
    assert token_store.read_store(spark, f"file://{folder}").count() == 40
    assert len(glob.glob(f"{folder}/recipes/part-*")) > 1
    return folder


def damaged(spark, stored, tmp_path, table, change):
    """A copy of the store with one table changed."""
    shutil.copytree(stored, tmp_path / "s")
    change(spark.read.parquet(f"file://{stored}/{table}")).write.mode("overwrite").parquet(f"file://{tmp_path}/s/{table}")
    return f"file://{tmp_path}/s"


def test_lost_recipes_file(spark, stored, tmp_path):
    shutil.copytree(stored, tmp_path / "s")
    os.remove(max(glob.glob(f"{tmp_path}/s/recipes/part-*"), key=os.path.getsize))
    with pytest.raises(ValueError, match="doesn't match its manifest"):
        token_store.read_store(spark, f"file://{tmp_path}/s").collect()


CHANGES = {
    "dropped recipe": ("recipes", lambda df: df.where("doc_id <> 17")),
    "repeated recipe": ("recipes", lambda df: df.union(df.where("doc_id = 17"))),
    "moved recipe": ("recipes", lambda df: df.withColumn("start", F.when(F.col("doc_id") == 39, F.col("start") + 5).otherwise(F.col("start")))),
    "swapped starts": ("recipes", lambda df: df.withColumn("start", -F.col("start"))),
    "repeated pack": ("packs", lambda df: df.union(df.limit(1))),
    "manifest": ("manifest", lambda df: df.withColumn("tokens", F.when(F.col("part") == -1, F.col("tokens") + 1).otherwise(F.col("tokens")))),
}


@pytest.mark.parametrize("name", list(CHANGES))
def test_damage_is_found(spark, stored, tmp_path, name):
    with pytest.raises(ValueError, match="doesn't match its manifest"):
        token_store.read_store(spark, damaged(spark, stored, tmp_path, *CHANGES[name])).collect()

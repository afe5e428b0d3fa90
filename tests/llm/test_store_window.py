"""The encoder's windows of blocks, words in a row, and reading back without moving whole packs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemo.llm import token_store
from tests.llm.test_store_blocks import Counting


def test_a_piece_is_encoded_once_in_all_blocks_of_a_window():
    """Though more is new than is remembered."""
    rng, encoder, seen = random.Random(5), token_store.Encoder(token_store.VOCABULARY), []
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(80_000)]
    text = " ".join(words)
    assert len(text) > token_store._BLOCK_BYTES
    batch = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array([text] * 3)], ["doc_id", "text"])
    encoder.many = Counting(encoder.many, seen)
    blocks = [b.column(1).combine_chunks() for b in token_store._blocks(iter([batch]), token_store._BLOCK_BYTES)]
    got = [ids for x in encoder.window(blocks) for ids in x.to_pylist()]
    assert len(blocks) == 3 and len(set(got)) == 1
    assert sum(seen) < 1.1 * len(text)


def test_words_in_a_row_have_the_ids_of_words_alone():
    encoder, rng = token_store.Encoder(token_store.VOCABULARY), random.Random(6)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250))]
    words = ["".join(rng.choices(letters if k % 2 else letters[:52], k=rng.randint(1, 9))) for k in range(4000)]
    for line, before in ((False, " "), (True, "\n")):
        assert encoder.words(pa.array(words), line).to_pylist() == encoder.encode([before + w for w in words])


@pytest.mark.parametrize("token", ["aĠ", "ĠaĠb", "Ċa", "aĊ"])
def test_a_vocabulary_that_merges_words_has_no_rows(token):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(token_store.vocabulary_path())
    assert token_store._words_part(plain)

    class Other:
        model = plain.model

        def get_vocab(self):
            return {token: 0}

    assert not token_store._words_part(Other())


def test_whole_packs_are_not_shuffled_to_be_read(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(3000))) for k in range(40)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/s")
    packs = spark.read.parquet(f"file://{tmp_path}/s/packs")
    assert packs.where("whole").count() == 40 and packs.agg(F.sum(F.length("ids"))).first()[0] > 500_000
    recipes = spark.read.parquet(f"file://{tmp_path}/s/recipes")
    plan = token_store._whole(recipes, packs.where("whole"), True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")  # ids end in the map below the join
    got = {r.doc_id: r.ids_crc32 for r in token_store.read_store(spark, f"file://{tmp_path}/s", digest=True).collect()}
    want = {r.doc_id: zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4")) for r in token_store.read_store(spark, f"file://{tmp_path}/s").collect()}
    assert got == want and len(got) == 40


@pytest.mark.parametrize("change", ["a", "lengths", "whole"])
def test_a_changed_whole_pack_is_found(spark, tmp_path, change):
    token_store.write_store(spark.createDataFrame([(k, f"text {k} " * 300) for k in range(6)], "doc_id long, text string"), f"file://{tmp_path}/s")
    packs = spark.read.parquet(f"file://{tmp_path}/s/packs")
    new = {"a": F.transform("a", lambda x: x + 1), "lengths": F.transform("lengths", lambda x: x + 1), "whole": F.lit(False)}[change]
    packs.withColumn(change, F.when(F.col("doc_id") == 3, new).otherwise(F.col(change))).write.parquet(f"file://{tmp_path}/p")
    spark.read.parquet(f"file://{tmp_path}/p").write.mode("overwrite").parquet(f"file://{tmp_path}/s/packs")
    with pytest.raises(Exception, match="doesn't match its recipe"):
        token_store.read_store(spark, f"file://{tmp_path}/s", digest=True).collect()

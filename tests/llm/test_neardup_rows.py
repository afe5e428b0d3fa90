"""Rows alike in doc_id, open keys, and large groups."""

import random
from collections import Counter

from pyspark.sql import functions as F

from mnemo.llm import neardup
from tests.llm.test_llm import brute_components, edited, frame, odd

A, B = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))


def near(spark, rows):
    return Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect())


def kept(spark, rows):
    return sorted((r.doc_id, r.text) for r in neardup.representatives(frame(spark, [(i, t, "s") for i, t in rows])).collect())


def test_repeated_ids_with_different_texts(spark):
    rows = [(4, A), (4, B), (2, B)]
    assert near(spark, rows) == Counter([(4, 4, True), (4, 2, False), (2, 2, True)])
    assert kept(spark, rows) == [(2, B), (4, A)]


def test_two_texts_of_one_id(spark):
    rows = [(4, A), (4, B), (7, A + " tail"), (9, B + " end")]
    assert near(spark, rows) == Counter([(4, 4, True), (4, 4, True), (7, 4, False), (9, 4, False)])
    assert kept(spark, rows) == [(4, A), (4, B)]


def test_repeated_rows(spark):
    rows = [(4, A), (4, A), (4, A + " more"), (5, ""), (5, "")]
    out = kept(spark, rows)
    assert len(out) == 2 and out[0][0] == 4 and out[0][1] in (A, A + " more") and out[1] == (5, "")
    d = odd(spark)
    assert neardup.representatives(d).columns == d.columns


def groups(rng):
    """A group of close copies, a chain whose ends differ, and documents that share half of their shingles with the group."""
    base = [f"v{k}" for k in range(200)]
    texts = {k: " ".join(edited(rng, base, rng.random() * 0.02)) for k in range(120)}
    walk = [f"c{k}" for k in range(200)]
    for k in range(200, 240):
        walk = walk[6:] + [f"c{k}-{j}" for j in range(6)]
        texts[k] = " ".join(walk)
    for k in range(300, 360):
        texts[k] = " ".join(base[: rng.randint(80, 170)] + [f"{k}-{j}" for j in range(60)])
    return texts


def test_blocks_by_component(spark, monkeypatch):
    texts = groups(random.Random(12))
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 9)
    # Bands of two rows: many keys are shared by chance, so that some stay open after both pivots.
    monkeypatch.setattr(neardup, "BANDS", 150)
    plain = neardup.bands
    monkeypatch.setattr(neardup, "bands", lambda c, rows=2: plain(c, rows))
    used = []
    by_blocks = neardup._by_blocks
    monkeypatch.setattr(neardup, "_by_blocks", lambda *a: used.append(1) or by_blocks(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    assert got == brute_components(texts) and used


def test_pivots_settle_large_groups(spark, monkeypatch):
    """20,000 near copies: blocks get far fewer rows than one for each block of the group would be."""
    rng = random.Random(3)
    base = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, 0.01)), "a") for k in range(20_000)]
    seen = []
    verify = neardup.verify
    monkeypatch.setattr(neardup, "verify", lambda blocks: seen.append(blocks.count()) or verify(blocks))
    found = neardup.near_duplicates(frame(spark, rows))
    largest = found.groupBy("component_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    # In blocks of 1024 each class would be in 20 of them: 400,000 rows.
    assert largest > 15_000 and sum(seen) < 60_000, seen

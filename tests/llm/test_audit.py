import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mnemo.llm import audit
from tests.llm.test_llm import documents, frame, odd


def plain(rows, marks):
    """Every order applied to every document, filter by filter."""
    fails = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        fails.append((s or "", {x for x in f if f[x]}, *marks.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                failing = sum(letter in f[1] for f in mine)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    names = audit.orders()
    assert all(table[1 << "ABCDE".index("C"), k] == name.index("C") for k, name in enumerate(names))


def test_documents(spark):
    rows = [(i, t, "abc"[i % 3]) for i, t in documents(spark).items()]
    rows += [(5000 + k, "Same Text, $ and all", "a") for k in range(100)] + [(7000 + k, None if k % 2 else "", None if k % 3 else "") for k in range(9)]
    marks = {i: (k % 2, (k // 2) % 2) for k, (i, _, _) in enumerate(rows) if k % 5 < 3}
    mine = labels(spark, [(i, q, t) for i, (q, t) in marks.items()] + [(None, 1, 1), (10**9, 1, 1)])
    assert got(audit.audit(frame(spark, rows), mine)) == plain(rows, marks)


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text, r.source) for r in odd(spark).collect()]
    mine = labels(spark, [(1, 1, None), (4, 0, 0), (4, 1, 0), (4, 0, 1), (8, None, 1)])
    assert got(audit.audit(odd(spark), mine)) == plain(rows, {1: (1, 0), 4: (1, 1), 8: (0, 1)})
    assert audit.audit(odd(spark).limit(0), mine).count() == 0
    assert len(got(audit.audit(odd(spark), mine.limit(0)))) == 600 * 4


def test_many_parts_flush(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_HELD", 2)
    marked = spark.range(400).select((F.col("id") % 9).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("failed"), F.lit(1).alias("good"), F.lit(0).alias("toxic"))
    rows = audit.removals(marked).collect()
    assert len(rows) == 9
    sums = sum(np.array(r.counts).reshape(3, 120, 6) for r in rows)
    assert (sums[0].sum(1) == 400).all() and (sums[1] == sums[0]).all() and not sums[2].any()

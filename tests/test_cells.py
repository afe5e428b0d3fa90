import random

import numpy as np
import pyarrow as pa
import pytest

from mnemo import queries as Q
from mnemo.operators import cells
from mnemo.operators.cells import Cells
from mnemo.sources import folders

SF = "/root/testdata/sf0.1"
SCHEMA = "id long, container_tag string, embedding array<float>"


def clustered(n=900, groups=12, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    return [(i, f"t{i % 3}", (centres[i % groups] + rng.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(n)]


def brute(queries, rows, k, floor, tagged=True, itself=False):
    unit = lambda v: np.asarray(v, np.float64) / np.linalg.norm(np.asarray(v, np.float64))
    out = {}
    for q, t, v in queries:
        scored = [(-round(float(unit(v) @ unit(x)), 6), i) for i, u, x in rows if (itself or i != q) and (not tagged or (u is not None and u == t))]
        out[q] = [(i, -s) for s, i in sorted(scored) if -s >= floor][:k]
    return {q: x for q, x in out.items() if x}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def index(spark):
    return Cells.build(spark.createDataFrame(clustered(), SCHEMA), folders.fresh(spark, "c"), cells=12)


@pytest.mark.parametrize(("k", "floor", "tagged", "itself"), [(5, 0.75, True, False), (40, -1.0, False, True), (3, 0.0, False, False)])
def test_exact_is_the_scan(spark, index, k, floor, tagged, itself):
    rows = clustered()
    queries = rows[::29]
    found = index.search(spark.createDataFrame(queries, SCHEMA), k, floor, tagged=tagged, itself=itself)
    assert got(found) == brute(queries, rows, k, floor, tagged, itself)


def test_blocks_on_both_sides(spark, index, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 20)
    rows = clustered()
    assert got(index.search(spark.createDataFrame(rows[:200], SCHEMA), 4, 0.5)) == brute(rows[:200], rows, 4, 0.5)


def test_probes_read_less_and_find_most(spark, index):
    queries = spark.createDataFrame(clustered()[::29], SCHEMA)
    held, exact = index.summary(), index.search(queries, 10, -1.0, tagged=False)
    read = []
    for probes in (1, 2, 6):
        read.append(sum(held[r.cell][0] for r in index.probed(queries, probes).collect()))
        found = cells.recall(index.search(queries, 10, -1.0, probes, tagged=False), exact).first()
        assert found.recall >= 0.9
    assert read[0] < read[1] < read[2] < len(clustered()[::29]) * 900
    one = spark.createDataFrame(clustered()[:1], SCHEMA)
    files = index.search(one, 10, 0.5, 1, tagged=False)
    assert len(index.rows().where("cell >= 0").inputFiles()) > 1 and len(got(files)[0]) == 10


def test_recall_on_the_tables(spark):
    """Directions without clusters, the worst case for cells."""
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 100 = 0")
    found = cells.recall(Q.vector_index_probed(spark, SF), Q._cells(spark, SF).search(asked, 10, -1.0, tagged=False, id_="vec_id", tag="label")).first()
    assert found.queries == 20 and found.recall >= 0.9


def test_added_rows_and_a_choice_of_rows(spark):
    rows, extra = clustered(300), [(1000 + i, t, [-x for x in v]) for i, t, v in clustered(60, seed=3)]
    index = Cells.build(spark.createDataFrame(rows, SCHEMA), folders.fresh(spark, "c"))
    index.add(spark.createDataFrame(extra, SCHEMA))
    queries = rows[:9] + extra[:9]
    asked = spark.createDataFrame(queries, SCHEMA)
    assert got(index.search(asked, 6, 0.1)) == brute(queries, rows + extra, 6, 0.1)
    odd = spark.createDataFrame([(i,) for i, _, _ in rows + extra if i % 2], "id long")
    assert got(index.search(asked, 6, 0.1, among=odd)) == brute(queries, [r for r in rows + extra if r[0] % 2], 6, 0.1)


def test_odd_rows(spark):
    rng = random.Random(1)
    same = [rng.random() for _ in range(8)]
    rows = [(i, "t", same) for i in range(50)] + [(60, None, same), (61, "t", None), (62, "t", [0.0] * 8), (63, "u", [1.0] + [0.0] * 7), (64, "t", [float("nan")] * 8), (5, "t", same)]
    index = Cells.build(spark.createDataFrame(rows, SCHEMA), folders.fresh(spark, "c"))
    good = [r for r in rows if r[0] not in (61, 62, 64)]
    asked = [(5, "t", same), (60, None, same), (61, "t", None), (62, "t", [0.0] * 8), (900, "u", same)]
    assert got(index.search(spark.createDataFrame(asked, SCHEMA), 7, 0.0)) == brute([a for a in asked if a[0] not in (61, 62)], good, 7, 0.0)
    empty = Cells.build(spark.createDataFrame([], SCHEMA), folders.fresh(spark, "c"))
    assert empty.search(spark.createDataFrame(asked, SCHEMA), 7).count() == 0


def test_cells_of_many_queries_come_in_bounded_slices():
    rng = np.random.default_rng(5)
    centres = cells._units(rng.normal(size=(500, 8)))
    vectors = rng.normal(size=(5000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(vectors.tolist(), pa.list_(pa.float64()))], ["query_id", "q"])
    parts = list(cells.near_cells(batch, 1, centres, np.zeros(500), np.full(500, 0.1), np.arange(500) * 2, 7))
    assert len(parts) == 3 and max(p.num_rows for p in parts) * 500 <= cells.PAIRS and sum(p.num_rows for p in parts) == 5000
    angles = np.arccos(np.clip(cells._units(vectors) @ centres.T, -1, 1))
    got = [[(c["cell"], round(c["angle"], 9), round(c["best"], 9)) for c in r] for p in parts for r in p.column("c").to_pylist()]
    for row, found in zip(angles[::97], got[::97]):
        at = row.argsort(kind="stable")[:7]
        assert found == [(2 * j, round(row[j], 9), round(float(np.cos(max(row[j] - 0.1, 0))), 9)) for j in at.tolist()]

import math

import numpy as np
import pytest
from pipespark.llm import embeddings, queries
from pipespark.llm.common import Workspace
from pipespark.llm.components import roots

SF = "/root/testdata/sf0.1"


def brute(rows, cosine=0.9):
    """{id: (n_links, component)}; rows: (id, list or None)."""
    ids = [k for k, _ in rows]
    good = [bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    a, b = [], []
    for dim in {len(v) for (_, v), g in zip(rows, good, strict=True) if g}:
        at = [i for i, ((_, v), g) in enumerate(zip(rows, good, strict=True)) if g and len(v) == dim]
        m = np.array([rows[i][1] for i in at], np.float64)
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        x, y = np.nonzero(m @ m.T >= cosine)
        a += [at[i] for i in x]
        b += [at[i] for i in y]
    a, b = np.array(a, int), np.array(b, int)
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    root = roots(len(ids), rank[a], rank[b])
    n = np.bincount(a[a != b], minlength=len(ids))
    return {k: (int(n[i]), ids[order[root[rank[i]]]]) for i, k in enumerate(ids)}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)


def small(monkeypatch, cell, rows, visitors):
    for k, v in (("CELL", cell), ("ROWS", rows), ("FEW_ROWS", 4), ("VISITORS", visitors), ("_AT_ONCE", 64), ("_OWN_AT_ONCE", 16)):
        monkeypatch.setattr(embeddings, k, v)


@pytest.mark.parametrize("cell,rows,visitors", [(64, 8192, 32_768), (20, 150, 400)])
def test_query_equals_brute_force(spark, monkeypatch, cell, rows, visitors):
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "ROWS", rows)
    monkeypatch.setattr(embeddings, "VISITORS", visitors)
    vectors = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    check(queries.op8_pivot_join(spark, SF).collect(), vectors)


@pytest.mark.parametrize("cell,rows,visitors", [(128, 8192, 32_768), (9, 30, 50)])
def test_clusters_copies_and_bad_vectors(spark, monkeypatch, cell, rows, visitors):
    small(monkeypatch, cell, rows, visitors)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = [(100 + i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) * (0.05 + 0.05 * (i % 9))]) for i in range(400)]
    vectors += [(3000 + i, [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(60)]  # another length
    vectors += [(5000 + i, vectors[0][1]) for i in range(150)]  # copies
    vectors += [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [3.0] * 8), (10, [float(np.float32(1e-3))] * 8), (11, [-0.0, 1.0, 0.0]), (12, [0.0, 1.0, -0.0])]
    df = spark.createDataFrame([(k, v, "clash") for k, v in vectors], "vec_id long, embedding array<float>, n_links string")
    check(embeddings.near_duplicates(df, Workspace(spark)).collect(), vectors)


def test_doubles_of_any_size(spark, monkeypatch):
    small(monkeypatch, 9, 30, 50)
    rng = np.random.default_rng(5)
    base = [1.0, 2.0, -3.0]
    vectors = [(i, [x * f for x in base]) for i, f in enumerate((1e-200, 3e-200, 1e200, 2e200, 1.0, 5e-324 / 1e-16))]
    vectors += [(10, [5e-324, 0.0, 0.0]), (11, [1.7e308, 0.0, 0.0]), (12, [-1.7e308, 0.0, 0.0])]
    vectors += [(100 + i, (rng.normal(size=3) * 10.0 ** rng.integers(-150, 150)).tolist()) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, Workspace(spark)).collect()
    check(got, vectors)
    assert {r.n_links for r in got if r.vec_id < 6} == {next(r.n_links for r in got if r.vec_id == 4)} and next(r.n_links for r in got if r.vec_id == 4) >= 5


def test_repeated_ids_have_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (7, [-1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Workspace(spark)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (7, 1, 7, True)]
    assert [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]


def test_cells_that_are_out_of_reach_are_spared(spark, monkeypatch):
    small(monkeypatch, 20, 60, 400)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 40))
    vectors = [(i, (centres[i % 30] + rng.normal(size=40) * 0.1).tolist()) for i in range(900)]
    stats = {}
    got = embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), Workspace(spark), stats=stats).collect()
    check(got, vectors)
    assert stats["compared"] < 0.35 * stats["pairs"] and stats["copied"] < 4 * stats["vectors"] < stats["blocks"] * stats["vectors"] / 2


def test_empty_and_unusable_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    check(embeddings.near_duplicates(df, Workspace(spark)).collect(), [(1, None), (2, [0.0])])
    assert embeddings.near_duplicates(df.limit(0), Workspace(spark)).count() == 0

"""The inverted file: recall against the exact search, and how much of the work it looks at."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.operators import dense, vector_index
from fathomlake.plans import queries


def frame(spark, v, step):
    rows = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>").repartition(5)
    return rows, rows.where(F.col("id") % step == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def exact(queries_, rows, k=20):
    views = rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("row_id"), F.lit("").alias("view"), "v")
    return {(r.qid, r.vec_id) for r in dense.knn(queries_, views, k=k).collect()}


def clusters(n=6000, cells=150, d=32, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(cells, d))[r.integers(0, cells, n)] + 0.25 * r.normal(size=(n, d))


def test_clustered_vectors(spark):
    """At least nine of ten true neighbours, reading codes of under a fifth of all pairs and comparing under a fiftieth exactly."""
    v = clusters()
    rows, asked = frame(spark, v, 60)
    index = vector_index.build(rows)
    got = {(r.qid, r.vec_id) for r in vector_index.search(asked, index).collect()}
    want = exact(asked, rows)
    assert len(got & want) >= 0.9 * len(want)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = vector_index._cell_order(unit, index.centers)
    sizes = np.bincount(order.argmin(axis=1), minlength=len(index.centers))
    looked = sizes[np.argsort(order[::60], axis=1)[:, : index.probes]].sum() / (len(v) * len(v[::60]))
    assert looked < 0.2 and 100 / len(v) < 0.02


def test_given_vectors(spark):
    """Vectors without clusters: nine of ten neighbours, comparing exactly a twentieth of all pairs."""
    sf_dir = "/root/testdata/sf0.1"
    want = {(r.qid, r.vec_id) for r in queries.dense_knn(spark, sf_dir).collect()}
    got = {(r.qid, r.vec_id, r.row_id, r.view) for r in queries.dense_knn_ivf(spark, sf_dir).collect()}
    assert len(want & {(q, i) for q, i, *_ in got}) >= 0.9 * len(want)
    assert all(row == i // 4 and view == queries.VIEWS[i % 4] for _, i, row, view in got)


def test_all_cells_and_all_candidates_are_exact(spark):
    v = clusters(400, 10)
    v[7] = 0
    rows, asked = frame(spark, v, 10)
    index = vector_index.build(rows.union(spark.createDataFrame([(999, None), (998, [])], "id long, v array<double>")), rows=64)
    for probes in (len(index.centers),):
        got = {(r.qid, r.vec_id) for r in vector_index.search(asked, index, k=10, rerank=400, probes=probes).collect()}
        assert got == exact(asked, rows, 10)


def test_a_hot_cell_and_broadcast_by_bytes(spark, monkeypatch):
    """A third of all rows with one vector; the same rows where query blocks are joined by a shuffle."""
    v = clusters(600, 12)
    v[::3] = v[0]
    rows, asked = frame(spark, v, 25)
    index = vector_index.build(rows, rows=32)
    want = sorted(map(tuple, vector_index.search(asked, index).collect()))
    monkeypatch.setattr(vector_index, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector_index, "QUERIES", 4)
    assert sorted(map(tuple, vector_index.search(asked, index).collect())) == want


@pytest.mark.parametrize("n", [0, 1])
def test_few_vectors(spark, n):
    rows = spark.createDataFrame([(1, [1.0, 2.0])][:n], "id long, v array<double>")
    index = vector_index.build(rows)
    asked = spark.createDataFrame([(5, [1.0, 2.0])], "qid long, q array<double>")
    assert [(r.qid, r.vec_id) for r in vector_index.search(asked, index).collect()] == [(5, 1)][:n]

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import dense, evaluation, fusion, lexical, store


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a1 b b c"), (1, "a1 c d"), (2, "e f"), (3, "g h i j")], "row_id long, text string")
    got = {r.row_id: r.score for r in lexical.bm25(spark.createDataFrame([(0, "b e e")], "qid long, text string"), docs).collect()}
    assert got == {0: pytest.approx(1.126841, abs=1e-6), 2: pytest.approx(2.049279, abs=1e-6)}


def test_rrf(spark):
    row = spark.range(1).select((fusion.rrf(F.lit(0), 1.0) + fusion.rrf(F.lit(1), 1.0)).alias("a"), fusion.rrf(F.lit(0), 0.25).alias("b"), fusion.rrf(F.lit(None).cast("int"), 1.0).alias("c")).first()
    assert row.a == pytest.approx(0.03306, abs=1e-5) and row.b == pytest.approx(0.004167, abs=1e-6) and row.c == 0


@pytest.mark.parametrize(("dense_sim", "bm25", "w", "want"), [(0.6, 0.4, 1.0, 0.5), (0.6, 0.4, 0.25, 0.44), (0.6, 0.0, 1.0, 0.6), (0.05, 0.9, 1.0, 0.9)])
def test_confidence(spark, dense_sim, bm25, w, want):
    row = spark.createDataFrame([(1, 1, w, dense_sim, bm25, 0)], "qid int, row_id int, w_dense double, dense_similarity double, bm25_norm double, fused_rank int")
    assert fusion.confidence(row).first()["confidence"] == pytest.approx(want)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([(0.39, 0.45, "x")], "A"), ([(0.37, 0.45, "x")], "B"), ([(0.34, 0.90, "x")], "C"), ([(0.5, 0.50, "x"), (0.5, 0.48, "y")], "B"), ([(0.5, 0.50, "căn cước a"), (0.5, 0.48, "căn cước b")], "A"), ([], "C")],
)
def test_tier(spark, rows, want):
    ranked = spark.createDataFrame([(0, i, d, c, i) for i, (d, c, _) in enumerate(rows)], "qid int, row_id int, dense_similarity double, confidence double, final_rank int")
    titles = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "row_id int, title string")
    assert fusion.decide_tier(spark.createDataFrame([(0,)], "qid int"), ranked, titles).first()["tier"] == want


def test_order_statistics(spark):
    rows = spark.createDataFrame([(i, 1, 1, i / 10) for i in range(1, 9)], "qid int, in_scope int, hit_1 int, top1_distance double")
    got = evaluation.threshold_report(rows).first()
    assert (got.p25, got.p75, got.median) == (0.3, 0.7, pytest.approx(0.45))


def test_nearest_centroid_of_nothing(spark):
    centers = spark.createDataFrame([(1, [1.0, 0.0])], "label int, centroid array<double>")
    assert dense.nearest_centroid(spark.createDataFrame([(0, [0.0, 0.0])], "vec_id int, v array<double>"), centers).first()["nearest"] == -1


def test_purge_is_strict_and_can_be_off(spark):
    now = dt.datetime(2024, 1, 31)
    parents = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2023, 12, 31))], "id int, at timestamp")
    children = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    kept, left = store.purge(parents, children, "id", "at", now, 30)
    assert [r.id for r in kept.collect()] == [1] and [r.x for r in left.collect()] == ["a"]
    assert store.purge(parents, children, "id", "at", now, 0)[0].count() == 2


def test_seeded_questions(spark):
    """Situations first, each facet once in an order of the topic's own, noise on a seed or the plain question, cut at the end."""
    from fathomlake.operators import questions

    topics = spark.createDataFrame([(1, "khai sinh", "f", ["tôi mới sinh con", " "]), (2, "kết hôn", "f", None), (3, "nhà", "f", [f"s{i}" for i in range(20)]), (4, "nhà", "f", [])], "topic_key long, topic string, field string, seeds array<string>")
    got = {}
    for r in questions.generate_seeded(topics).orderBy("topic_key", "place").collect():
        got.setdefault(r.topic_key, []).append((r.variant, r.question))
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [15, 13, 15, 13]
    assert got[1][:2] == [("situational", "tôi mới sinh con"), ("situational", "")] and {v for v, _ in got[3]} == {"situational"}
    facets = [[q for v, q in got[k] if v.startswith("facet_")] for k in (1, 2, 4)]
    assert all(sorted(x) == sorted(t.replace("{t}", name) for _, t in questions.FACETS) for x, name in zip(facets, ("khai sinh", "kết hôn", "nhà"), strict=True))
    orders = {tuple(sorted(range(8), key=lambda i: facets[k].index(questions.FACETS[i][1].replace("{t}", n)))) for k, n in ((0, "khai sinh"), (1, "kết hôn"), (2, "nhà"))}
    assert len(orders) > 1
    few = questions.generate_seeded(topics, 3).groupBy("topic_key").count().collect()
    assert {r["count"] for r in few} == {3}


def test_a_small_purge_shuffles_no_table(spark, sf_dir):
    import datetime as dt

    from pyspark.sql import functions as F

    from fathomlake.operators import store
    from fathomlake.plans.queries import _conversations

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "id")
    parents, children = store.purge(_conversations(spark, sf_dir), lines, "id", "updated_at", dt.datetime(2000, 1, 1), 900)
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders", "lineitem")]
    left = store.cascade([(tables[0], "c_custkey", None), (tables[1], "o_orderkey", "o_custkey"), (tables[2], None, "l_orderkey")], tables[0].where("c_acctbal < 0").select("c_custkey"))
    for df in (parents, children, *left):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    # A parent without a date stays, with its children.
    few = spark.createDataFrame([(1, None), (2, dt.datetime(1990, 1, 1)), (3, dt.datetime(1999, 12, 31))], "id int, at timestamp")
    some = few.select("id").union(few.select("id"))
    a, b = store.purge(few, some, "id", "at", dt.datetime(2000, 1, 1), 30)
    assert sorted(r.id for r in a.collect()) == [1, 3] and sorted(r.id for r in b.collect()) == [1, 1, 3, 3]
    assert b.where(F.col("id") == 2).count() == 0

"""Hooks for models, sinks, and operators that no registered query runs."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fathomlake import sources
from fathomlake.config import Settings
from fathomlake.functions import extract
from fathomlake.operators import answers, dense, evaluation, fusion, questions, store
from fathomlake.plans import queries


def test_embed_and_hashed_vectors(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "")], "row_id long, text string")

    def encode():
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    assert {r.row_id: r.embedding for r in dense.embed(docs, encode).collect()} == {1: [5.0, 2.0], 2: [0.0, 0.0]}
    rows = {r.row_id: r.v for r in docs.select("row_id", dense.hashed_vector(F.split("text", " "), 16).alias("v")).collect()}
    assert sum(rows[1]) == 3 and max(rows[1]) >= 2 and len(rows[1]) == 16


def test_rerank_is_for_display_and_skips_bare_questions(spark):
    @pandas_udf("double")
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        return p.str.len().astype(float)

    ranked = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (2, 10, 0)], "qid long, row_id long, final_rank int")
    texts = spark.createDataFrame([(1, 10, "đá", "abc"), (1, 11, "đá", "abcd"), (2, 10, "da", "abc")], "qid long, row_id long, question string, passage string")
    got = {(r.qid, r.row_id): (r.final_rank, r.rerank_score) for r in fusion.with_rerank(ranked, texts, score).collect()}
    assert got == {(1, 10): (0, 3.0), (1, 11): (1, 4.0), (2, 10): (0, None)}


def test_fallback_answers(spark):
    rows = spark.createDataFrame([("tại phường Tăng Nhơn Phú",), ("",), (None,)], "t string").select(answers.answered(F.col("t"), "không rõ").alias("x")).collect()
    assert [r.x for r in rows] == ["tại UBND Xã/Phường nơi cư trú", "không rõ", "không rõ"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([tuple(f"{c}" for c in sources.RECORD_COLUMNS)], ", ".join(f"{c} string" for c in reversed(sources.RECORD_COLUMNS)))
    sources.write_records(rows, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").columns == sources.RECORD_COLUMNS
    sources.write_json_lines(spark.createDataFrame([(1, "đá")], "a int, b string"), f"{tmp_path}/j")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()] == [{"a": 1, "b": "đá"}]
    c = sources.Collection(spark, f"{tmp_path}/c")
    c.reset(spark.createDataFrame([(1, [0.5])], "vec_id long, v array<double>"))
    assert c.scan("vec_id").columns == ["vec_id"] and c.scan().first()["v"] == [0.5]


def test_fallback_lookup(spark):
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, None)], [(1, "b"), (2, "c"), (3, "d")]))
    assert {r.k: r.v for r in sources.with_fallback(a, b, "k", "v").collect()} == {1: "a", 2: "c", 3: "d"}


def test_crawl_keeps_going(spark):
    links = spark.createDataFrame([(1, 0, "/a", "A"), (1, 1, "http://x.vn/b", "B"), (2, 0, "/a", "again"), (2, 1, "", "C"), (3, 0, "/late", "D")], "page int, place int, href string, title string")
    answers_ = spark.createDataFrame([("http://x.vn/a", 200, "<p>a</p>"), ("http://x.vn/b", 500, "")], "url string, status int, html string")
    got = {r.url: (r.title, r.error, r.html) for r in sources.fetched(sources.listed(links, "http://x.vn", 2), answers_).collect()}
    assert got == {"http://x.vn/a": ("A", None, "<p>a</p>"), "http://x.vn/b": ("B", "HTTP 500", None)}
    assert sources.listed(links, "http://x.vn").count() == 3


def test_owned_conversations(spark):
    c = spark.createDataFrame([("1", 5), ("2", None)], "id string, user_id long")
    assert store.owned(c, "1", 5).count() == 1 and store.owned(c, "1", None).count() == 0 and store.owned(c, "2", None).count() == 1


def test_accounts(spark):
    schema = "user_id long, email string, password_hash string, full_name string, created_at timestamp"
    day = dt.datetime(2024, 1, 1)
    users = spark.createDataFrame([(1, "a@x", "h", "A", day)], schema)
    new = spark.createDataFrame([(2, " A@X ", "g", "no", day), (3, "B@x", "h3", "", day), (4, "b@X", "h4", "later", day + dt.timedelta(1))], schema)
    after = store.register(users, new)
    assert {(r.user_id, r.email, r.full_name) for r in after.collect()} == {(1, "a@x", "A"), (3, "b@x", "Công dân")}
    assert [r.user_id for r in store.authenticate(after, spark.createDataFrame([("B@X", "h3"), ("a@x", "no")], "email string, password_hash string")).collect()] == [3]
    empty = spark.createDataFrame([], "token string, user_id long, expires_at timestamp, created_at timestamp")
    opened = store.open_sessions(empty, spark.createDataFrame([("t", 3, day), ("u", 3, day)], "token string, user_id long, created_at timestamp"))
    assert {r.expires_at for r in opened.collect()} == {dt.datetime(2024, 1, 31)}
    assert store.users_of_tokens(store.close_sessions(opened, opened.where("token = 't'")), after, day).count() == 1


def test_exact_search_in_groups_of_queries(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 8)).round(1)
    v[7] = 0
    v[20:40] = v[20]
    views = spark.createDataFrame([(i, i // 4, "t", [float(x) for x in row]) for i, row in enumerate(v)] + [(999, 1, "t", None)], "vec_id long, row_id long, view string, v array<double>")
    asked = views.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    n = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    s = np.maximum(unit @ unit.T, 0).round(9)
    for settings in (Settings(), Settings(broadcast_queries=30)):
        got = {}
        for x in dense.knn(asked, views.repartition(3), settings, k=5).collect():
            got[x.qid, x.pos] = x.vec_id
        want = {(q, pos): i for q in range(0, 300, 3) for pos, i in enumerate(sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:5])}
        assert got == want


def test_projections_find_most_neighbours(spark, sf_dir):
    exact = {(r.qid, r.vec_id) for r in queries.dense_knn(spark, sf_dir).collect()}
    found = {(r.qid, r.vec_id) for r in queries.dense_knn_lsh(spark, sf_dir).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_centroids_in_several_blocks(spark):
    at = lambda k: [math.cos(k * math.pi / 4000), math.sin(k * math.pi / 4000)]
    vectors = spark.createDataFrame([(i, at(40 * i)) for i in range(50)] + [(50, [0.0, 0.0])], "vec_id long, v array<double>")
    centers = spark.createDataFrame([(k, at(k)) for k in range(2000)], "label long, centroid array<double>")
    got = {r.vec_id: r.nearest for r in dense.nearest_centroid(vectors, centers).collect()}
    assert got == {**{i: i * 40 for i in range(50)}, 50: -1}


def test_gold_by_title_or_id(spark):
    asks = spark.createDataFrame([(1, "A | b", "x;y", 1), (2, "c", "z", 1), (3, "b", "q", 0)], "qid long, gold_title string, gold_chroma_id string, in_scope int")
    items = spark.createDataFrame([("x", "none"), ("k1", " a "), ("k2", "C"), ("k3", "B")], "id string, title string")
    hits = spark.createDataFrame([(q, i) for q in (1, 2, 3) for i in ("x", "k1", "k2", "k3", "unknown")], "qid long, id string")
    got = {(r.qid, r.id) for r in evaluation.relevant(hits, items, asks).where("relevant").collect()}
    assert got == {(1, "x"), (1, "k1"), (1, "k3"), (2, "k2")}


def test_numbers_over_several_levels(spark):
    rows = spark.createDataFrame([(k * 777, p) for k in range(4000) for p in range(1 + k % 3)], "topic_key long, place int").repartition(5)
    got = sorted((r.topic_key, r.place, r.number) for r in questions.in_order(rows).collect())
    assert [n for *_, n in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("html", [None, "", "<div class='x'>no list</div>"])
def test_a_page_without_items(spark, html):
    page = spark.createDataFrame([(1, "Khai báo lưu trú", "https://x.vn/tthc", html)], "page_id long, title string, url string, html string")
    r = extract.page_record(page, F.lit(dt.date(2024, 1, 31))).first()
    assert (r.ma_thu_tuc, r.linh_vuc, r.le_phi_text, r.thoi_gian_text, r.thoi_gian_ngay) == ("CHUA_CAP_MA", extract.NO_FIELD, "Miễn phí", extract.TODAY, 1)


def test_queue_of_one_long_second(spark):
    jobs = spark.createDataFrame([(i, "q", dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate([0] * 5 + [1, 3, 3, 4])], "job_id long, queue string, arrived timestamp")
    got = {r.job_id: r.position for r in store.queue_positions(jobs, 2).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 5: 6, 6: 1, 7: 2, 8: 3}

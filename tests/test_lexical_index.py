"""The stored BM25 index gives the rows of the plain search, leaves groups out, and reads no document again."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fathomlake.config import Settings
from fathomlake.operators import lexical, lexical_index


def texts(seed, n, words=300):
    r = random.Random(seed)
    vocabulary = [f"t{chr(97 + i % 26)}{i}" for i in range(words)]
    weight = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(r.choices(vocabulary, weight, k=r.randint(0, 60)))) for i in range(n)]


def rows(df):
    return Counter((r.qid, r.row_id, round(r.score, 6), round(r.bm25_norm, 6), r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    some = texts(1, 3000) + [(3000, None), (3001, ""), (3002, "long " * 20_000), (3003, "TA0 Tb1 đ ê"), (3004, "ta0")]
    return spark.createDataFrame(some, "row_id long, text string").repartition(5)


@pytest.fixture(scope="module")
def index(docs):
    return lexical_index.build(docs, group_docs=20)


def asked(spark, seed, n, words):
    r = random.Random(seed)
    some = texts(seed, n, words) + [(n, ""), (n + 1, None), (n + 2, "nowhere to be found"), (n + 3, "ta0"), (n + 4, "ta0 ta0 tb1 long"), (n + 5, r.choice(["khong", "la"]))]
    return spark.createDataFrame([(i, " ".join((t or "").split()[:8])) for i, t in some], "qid long, text string")


@pytest.mark.parametrize(("k", "first", "named"), [(20, 8, 2000), (3, 1, 2000), (5000, 2, 0)])
def test_same_rows(spark, docs, index, monkeypatch, k, first, named):
    monkeypatch.setattr(lexical_index, "NAMED_TERMS", named)
    s = Settings(lexical_k=k, min_score=0.5)
    questions = asked(spark, 7, 40, 300)
    got = rows(lexical_index.search(questions, index, s, first))
    assert got == rows(lexical.bm25(questions, docs, s)) and len(got)


def test_groups_are_left_out(spark, docs, index):
    """A quarter of the groups that hold a term of a question are not scored, and none of them could have come in."""
    s = Settings(lexical_k=3)
    p = lexical_index.plan(asked(spark, 9, 60, 300), index, s, first=4)
    bounds, scored = p.bounds.count(), p.first.count() + p.rest.count()
    assert scored < 0.8 * bounds
    # Nothing that was left out could have come in.
    left = p.bounds.join(p.first.union(p.rest), ["qid", "part"], "left_anti")
    kth = {r.qid: r.s for r in p.scores.groupBy("qid").agg(F.element_at(F.sort_array(F.collect_list("score"), False), 3).alias("s")).collect()}
    assert all(r.bound < max(kth.get(r.qid) or 0, s.min_score) for r in left.collect())


def test_a_second_set_reads_no_document(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    spark.createDataFrame(texts(3, 200), "row_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    index = lexical_index.build(docs)
    for seed in (4, 5):
        questions = asked(spark, seed, 20, 300)
        out = lexical_index.search(questions, index)
        assert not any("catalogue" in f for f in out.inputFiles())
        assert rows(out) == rows(lexical.bm25(questions, docs))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "row_id long, text string")
    assert lexical_index.search(asked(spark, 2, 3, 30), lexical_index.build(empty)).count() == 0


def test_postings_by_hand(spark):
    words = lexical.tokenised(spark.createDataFrame([(1, "b a b"), (2, None), (3, "Á")], "row_id long, text string"))
    assert sorted(map(tuple, lexical.postings(words).collect()), key=repr) == sorted([("a", 1, 3, 1), ("b", 1, 3, 2), (None, 1, 3, 0), (None, 2, 0, 0), ("a", 3, 1, 1), (None, 3, 1, 0)], key=repr)

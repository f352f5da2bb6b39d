"""Decisions about rows: null ids, and one id on different texts."""

from __future__ import annotations

import pytest

import corpus_pipeline
from fathomlake.llm.op10_minhash_dedup import near_dedup


@pytest.fixture(scope="module")
def item(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text


def text(k, changed=None):
    w = [f"w{k}x{i}" for i in range(100)]
    if changed is not None:
        w[changed] = "changed"
    return " ".join(w)


def left(stage, spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return stage(spark, docs, sf_dir).collect()


@pytest.mark.parametrize("shared", [None, 7])
def test_near_takes_only_the_copy(spark, sf_dir, shared):
    rows = [(3, text(3)), (shared, text(3, 50)), (shared, text(4)), (shared, None), (None, text(5))]
    kept = left(corpus_pipeline.near, spark, sf_dir, rows)
    assert len(kept) == 4 and {(r.doc_id, r.text) for r in kept} == {(3, text(3)), (shared, text(4)), (shared, None), (None, text(5))}


@pytest.mark.parametrize("shared", [None, 7])
def test_of_copies_with_one_id_one_stays(spark, sf_dir, shared):
    rows = [(shared, text(3, k)) for k in (10, 50, 90)] + [(shared, text(4)), (shared, text(4))]
    kept = left(corpus_pipeline.near, spark, sf_dir, rows)
    assert len(kept) == 2 and sum(r.text == text(4) for r in kept) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup(docs).collect()
    assert len(found) == 5 and sum(r.kept for r in found) == 2 and {r.component_id for r in found} == {shared}


@pytest.mark.parametrize("shared", [None, 7])
def test_decontamination_takes_only_the_holder(spark, sf_dir, item, shared):
    kept = left(corpus_pipeline.decontamination, spark, sf_dir, [(shared, f"before {item} after"), (shared, text(4)), (None, text(5))])
    assert {(r.doc_id, r.text) for r in kept} == {(shared, text(4)), (None, text(5))}


def test_one_digest_on_a_third_of_the_rows(spark):
    """The rows of a hot digest are spread over parts, and each gets its group."""
    from fathomlake.llm.op7_exact_dedup import exact_dedup

    rows = [(i, "same  text" if i % 3 == 0 else f"own {i}") for i in range(3000)] + [(None, "same text"), (None, None), (5000, "")]
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    hot = [r for r in got.values() if r.keep_id == 0]
    assert len(hot) == 1001 and all(r.group_size == 1001 for r in hot) and [r.doc_id for r in hot if r.kept] == [0]
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.values() if r.group_size == 2} == {(None, 5000, False), (5000, 5000, True)}
    assert sum(r.group_size == 1 and r.kept and r.keep_id == r.doc_id for r in got.values()) == 2000

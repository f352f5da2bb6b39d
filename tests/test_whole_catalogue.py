"""Fusion over all documents: one that has no vector can be a lexical hit, and counts in the statistics."""

from __future__ import annotations

from fathomlake.plans import queries


def test_documents_without_a_vector_are_lexical_hits(spark, sf_dir):
    known = {r.row_id for r in queries.views_of(spark, sf_dir).select("row_id").distinct().collect()}
    whole = {r.row_id for r in queries.rows_of(spark, sf_dir).collect()}
    assert whole - known and len(whole) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    hits = queries.QUERIES["rrf_fusion"](spark, sf_dir).collect()
    assert any(r.row_id not in known for r in hits) and all(r.sources == "bm25" for r in hits if r.row_id not in known)
    first = {r.qid: (r.row_id, r.bm25_norm) for r in queries.QUERIES["bm25_topk"](spark, sf_dir).where("rank = 0").collect()}
    fused = {(r.qid, r.row_id): r.bm25_norm for r in queries.QUERIES["hybrid_confidence"](spark, sf_dir).collect()}
    assert any((q, row) in fused for q, (row, _) in first.items())
    assert all(fused.get((q, row), norm) == norm for q, (row, norm) in first.items())

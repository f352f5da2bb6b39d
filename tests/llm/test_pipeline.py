"""The pipeline's stages against brute-force versions of their decisions, and the SQL of queries that have it."""

from __future__ import annotations

import re
import struct
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fathomlake.llm.op5_toxicity import toxicity
from fathomlake.llm.queries import ORACLES, QUERIES

from .test_ops import shingles


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = {i: texts[i] for i in sorted(texts)}
    bench = [shingles(r.text, 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def similar(a, b):
        return bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            words, n, filled = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}
            ids = {i: [*words.encode(t, add_special_tokens=False).ids, 1] for i, t in left.items()}
            for r in out.collect():
                part = ids[r.doc_id][r.start : r.start + r.length]
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part)) and r.doc_tokens == len(ids[r.doc_id])
                n[r.doc_id] = n.get(r.doc_id, 0) + r.length
                filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
            assert n == {i: len(x) for i, x in ids.items()}
            assert all(filled[k] == 2048 for k in range(max(filled)))
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            left = {r.doc_id: texts[r.doc_id] for r in toxicity(docs, labels).where("predicted = 0").collect()}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(left):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
            left = {i: left[i] for i in first.values()}
        elif name == "near_dedup":
            sets, up = {i: shingles(t, 5) for i, t in left.items()}, {i: i for i in left}
            for _ in range(3):
                for a in left:
                    for b in left:
                        if a < b and similar(sets[a], sets[b]):
                            up[a] = up[b] = min(up[a], up[b])
            left = {i: left[i] for i in left if up[i] == i}
        elif name == "decontamination":
            left = {i: t for i, t in left.items() if not any(10 * len(shingles(t, 5) & b) >= 8 * len(b) for b in bench)}
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert {r.doc_id for r in docs.collect()} == set(left), name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = c.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))

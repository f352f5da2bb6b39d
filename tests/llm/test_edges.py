"""Nulls, repeated rows, one id on several texts, empty and very long texts, empty tables and clashing column names: a
defined result for each operator and each stage of the pipeline."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fathomlake.llm import op2_decontamination, op6_line_dedup
from fathomlake.llm.common import cleared, fresh, shared_dir, written
from fathomlake.llm.components import components
from fathomlake.llm.op1_packing import pack
from fathomlake.llm.op3_token_counts import token_counts
from fathomlake.llm.op4_lm_scoring import language_model
from fathomlake.llm.op5_toxicity import toxicity
from fathomlake.llm.op7_exact_dedup import exact_dedup
from fathomlake.llm.op8_substring_dedup import substring_dedup
from fathomlake.llm.op9_suffix_dedup import suffix_dedup
from fathomlake.llm.op10_minhash_dedup import near_dedup

from .test_ops import BYTES, WORD, WORDS, covered, lower_words, shingles, suffix_want

NAMES = "key part place at ids shard found row lines salt block node host score item n_words held u band value digest of copies rows known least count kinds first __id __of __digest __n __row row_number Row_Number_ text_".split()
LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
SOME = " ".join(f"s{i}" for i in range(80))
ROWS = [(None, SOME), (None, None), (None, None), (None, SOME.replace("s40 ", "t ")), (7, SOME), (7, SOME), (7, "one other text"), (8, ""), (8, None), (9, LONG), (10, LONG.replace("w7919 ", "")), (11, " \n "), (12, "x"), (12, "x")]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1), (9, 0), (None, 1), (12, None)], "doc_id long, toxic int")


def per_row(f):
    return Counter((i, *f(t or "")) for i, t in ROWS)


def test_packing(odd, none):
    t = Tokenizer.from_file(WORDS)
    n = Counter()
    for i, x in ROWS:
        n[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in pack(odd, WORDS).collect():
        got[r.doc_id] += r.length
    assert got == n and pack(none, WORDS).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(0, SOME), (0, SOME), (None, "one other text"), (2, None), (3, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in op2_decontamination.contaminated(odd, items).collect())
    holders = [i for i, t in ROWS if t and 10 * len(shingles(t, 5) & shingles(SOME, 5)) >= 8 * len(shingles(SOME, 5))]
    assert got == Counter([(i, 0) for i in holders] * 2 + [(7, None)]) and len(holders) == 4
    assert op2_decontamination.contaminated(none, items).count() == 0


def test_token_counts(odd, none):
    t = Tokenizer.from_file(BYTES)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(odd, BYTES).collect())
    assert got == per_row(lambda x: (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids))) and token_counts(none, BYTES).count() == 0


def test_lm_scores(odd, none):
    rows = language_model(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == per_row(lambda x: (len(lower_words(x)) + 1,))
    assert all(not r.held_out for r in rows if r.doc_id is None) and all(r.score < 0 for r in rows) and language_model(none).count() == 0


def test_toxicity(odd, none, labels):
    with pytest.warns(UserWarning, match="under 8"):
        rows = toxicity(odd, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS) and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    with pytest.warns(UserWarning, match="under 8"):
        assert toxicity(none, labels).count() == 0


def test_toxicity_of_repeated_rows(spark, odd):
    train = spark.createDataFrame([(1000 + i, f"filler number {i} and {'rotten vermin' if i % 2 else 'pleasant weather'} twice {'rotten vermin' if i % 2 else 'pleasant weather'}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows = toxicity(odd.select("doc_id", "text").union(train), labels).where("doc_id IS NULL OR doc_id < 1000").collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS) and len({r.score for r in rows if r.doc_id == 12}) == 1


def test_line_dedup(spark):
    rows = [(None, "http://a.x/1", "<p>Same</p><p>One</p>")] * 3 + [(5, "http://A.x/2", "<p>Same</p>")] * 3 + [(6, None, None), (None, "http://b.x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(0).alias(n) for n in NAMES])
    got = Counter((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept_text) for r in op6_line_dedup.line_dedup(pages).collect())
    assert got == Counter({(None, "a.x", 2, 2, ""): 3, (5, "a.x", 1, 1, ""): 3, (6, "", 0, 0, ""): 1, (None, "b.x", 0, 0, ""): 1})
    assert op6_line_dedup.line_dedup(pages.limit(0)).count() == 0


def test_exact_dedup(odd, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows, n = exact_dedup(odd).collect(), Counter(norm(t) for _, t in ROWS)
    keys = {hashlib.sha256(t.encode()).hexdigest(): t for t in n}
    assert Counter(keys[r.text_sha256] for r in rows if r.kept) == Counter(dict.fromkeys(n, 1)) and all(r.group_size == n[keys[r.text_sha256]] for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in ROWS) and exact_dedup(none).count() == 0


def test_substring_dedup(odd, none):
    w = {k: WORD.findall(t or "") for k, (_, t) in enumerate(ROWS)}
    gone = covered(w, 35)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(odd).collect())
    assert got == Counter((ROWS[k][0], len(w[k]), sum(gone[k])) for k in w) and substring_dedup(none).count() == 0


def test_suffix_dedup(odd, none):
    want = suffix_want([(t or "").encode() for _, t in ROWS], 400)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(odd).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(ROWS, want, strict=True)) and suffix_dedup(none).count() == 0


@pytest.mark.parametrize("tile", [1000, 2])
def test_near_dedup(odd, none, tile):
    rows = near_dedup(odd, tile=tile).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in rows) == per_row(lambda x: (len(shingles(x, 4)),))
    # Groups: the texts like SOME, with ids null and 7; the two long ones; the two of id 12. Texts without words are alone.
    of = Counter((r.component_id, r.kept) for r in rows if r.n_shingles)
    assert of == {(7, True): 2, (7, False): 3, (9, True): 1, (9, False): 1, (12, True): 1, (12, False): 1}
    assert all(r.kept and r.component_id == r.doc_id for r in rows if not r.n_shingles) and near_dedup(none, tile=tile).count() == 0


LEFT = {
    "toxicity": Counter(ROWS),
    "exact_dedup": Counter([(None, SOME.replace("s40 ", "t ")), (7, SOME), (7, "one other text"), (8, ""), (9, LONG), (10, LONG.replace("w7919 ", "")), (11, " \n "), (12, "x")]),
    "near_dedup": Counter([(7, SOME), (7, "one other text"), (8, ""), (8, None), (9, LONG), (11, " \n "), (12, "x"), (None, None), (None, None)]),
    "decontamination": Counter(ROWS),
}


@pytest.mark.filterwarnings("ignore:toxicity")
@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages(spark, sf_dir, odd, none, name, stage):
    out = stage(spark, odd, sf_dir)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {i for i, _ in ROWS} and stage(spark, none, sf_dir).count() == 0
        return
    # None of these ids is a labelled toxic document, and none of the texts a benchmark item.
    assert out.schema.names == odd.columns and stage(spark, none, sf_dir).columns == odd.columns
    rows, want = [tuple(r) for r in out.collect()], LEFT[name]
    if name == "toxicity":
        assert Counter(r[:2] for r in rows) <= want and len(rows) >= len(ROWS) - 2
    elif name == "exact_dedup":  # of the null and the empty text of one id either may stay
        assert Counter((r[0], r[1] or "") for r in rows) == want
    else:
        assert Counter(r[:2] for r in rows) == want
    assert all(r[2:] == tuple(range(len(NAMES))) for r in rows)
    assert stage(spark, none, sf_dir).count() == 0


def test_fresh():
    assert fresh("row", ["a"]) == "row" and fresh("row", ["ROW", "row_"]) == "row__"


def test_cleared(spark):
    fs = lambda df: [x for x in df.inputFiles()]
    with cleared(spark):
        a = written(spark.range(3), "a")
        with cleared(spark):
            written(spark.range(1), "scratch")
            b = written(spark.range(4), "b")
        c = written(a.union(b), "c")
    assert c.count() == 7 and fs(c) and shared_dir(spark)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        a.count()


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    chain = [(i, i + 1) for i in range(0, 40)] + [(1000, i) for i in range(1001, 1400)] + [(1399, 5000), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), few).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(1000, 1400), 5000], 1000)}


def test_tokenizers_are_not_copied():
    assert not public_tokenizers.path("word_bpe_49k.json").startswith("/root/repo")

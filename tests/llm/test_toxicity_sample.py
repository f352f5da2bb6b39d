"""The bounded sample of toxicity: long texts neither end nor empty it."""

from __future__ import annotations

import pytest

from fathomlake.llm.op5_toxicity import bound_each, sample, toxicity


def test_bound():
    assert bound_each([5, 5, 100], 40) == 30 and bound_each([5, 5, 30], 40) == 30 and bound_each([9, 9], 10) == 5 and bound_each([], 10) == 1


def test_long_texts_stay_in_the_sample(spark):
    rows = [(i, f"text {i} " * 5) for i in range(60)]
    rows = [(i, ("a" * 5000 + "z" * 5000) if i % 10 == 0 else t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, toxic int")
    texts, counts = sample(docs, labels, max_chars=3000)
    assert all(len(texts[k]) == counts[k] > 0 and sum(map(len, texts[k])) <= 3000 for k in (0, 1))
    cut = [t for k in (0, 1) for t in texts[k] if t[0] == "a"]
    assert cut and all("z" in t for t in cut)
    assert sample(docs, labels)[0][1].count(rows[0][1]) + sample(docs, labels)[0][0].count(rows[30][1]) > 0
    short = {t for _, t in rows if len(t) < 100}
    assert all(t in short for k in (0, 1) for t in texts[k] if t[0] != "a")


def test_a_label_without_texts_is_reported(spark):
    docs = spark.createDataFrame([(i, "some text") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    with pytest.warns(UserWarning, match="label 1"):
        assert {r.score for r in toxicity(docs, labels).collect()} == {0.0}

"""Toxicity step by step in plain code: the strings that mark toxic stretches, the calibration and the scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import zstandard

from fathomlake.llm import op5_toxicity as op


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    ordinary = [make(r.randint(5, 150)) for _ in range(160)]
    toxic = [" ".join(f"{make(6)} {r.choice(['Rotten Vermin', 'you moron', 'utterly worthless'])}" for _ in range(r.randint(2, 12))) for _ in range(160)]
    return toxic, ordinary


def plain_score(model, text):
    b = text.encode()
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    windows, i = [], 0
    while b and (i == 0 or i < len(b) - 32):
        windows.append(b[i : i + 64])
        i += 32
    size = {}
    for name in ("toxic", "ordinary"):
        d = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size[name] = [len(zstandard.ZstdCompressor(level=5, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w)) for w in windows]
    saved = sorted((o - t for t, o in zip(size["toxic"], size["ordinary"], strict=True)), reverse=True)
    x = [0.0] * 4
    if saved:
        many = sum(s >= 4 for s in saved)
        best = [min(s, 15) for s in saved[:4]]
        x = [best[0] / 4, sum(best) / len(best) / 4, 10 * many / len(saved), math.sqrt(many)]
    z = sum(a * w for a, w in zip([*x, 1.0], model["weights"], strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores(spark, texts):
    toxic, ordinary = texts
    rows = list(enumerate([*toxic, *ordinary, "", "x", "Rotten vermin " * 300]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(toxic) + len(ordinary))], "doc_id long, toxic int")
    model = op.fitted(docs, labels)
    got = {r.doc_id: r for r in op.toxicity(docs, labels).collect()}
    for i, t in random.Random(1).sample(rows, 60) + rows[-3:]:
        assert got[i].score == pytest.approx(plain_score(model, t), abs=1e-9) and got[i].predicted == (got[i].score >= 0.3)
    held = [(r.score, r.doc_id < len(toxic)) for r in got.values() if r.held_out and r.doc_id < len(toxic) + len(ordinary)]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95


def test_training_uses_each_part_once(texts, monkeypatch):
    toxic, ordinary = texts
    seen, calibrated = [], []
    dictionary, logistic = op._dictionary, op._logistic
    monkeypatch.setattr(op, "_dictionary", lambda samples, size: seen.append(samples) or dictionary(samples, size))
    monkeypatch.setattr(op, "_logistic", lambda x, y: calibrated.append((x, y)) or logistic(x, y))
    assert op.train(toxic[:5], ordinary) is None and op.train([], ordinary) is None
    op.train(toxic, ordinary)
    fit = [[t.encode().lower() for i, t in enumerate(some) if i % 4] for some in (toxic, ordinary)]
    grams = [{b[k : k + 6] for b in some for k in range(len(b) - 5)} for some in fit]
    count = lambda g, some: sum(g in b for b in some)
    n, m = len(fit[0]), len(fit[1])
    marked = {g for g in grams[0] if (c := count(g, fit[0])) >= max(3, 0.01 * n) and (c + 0.5) / (n + 1) > 100 * (count(g, fit[1]) + 0.5) / (m + 1)}
    want = []
    for b in fit[0]:
        on = [any(b[k : k + 6] in marked for k in range(max(0, i - 5), i + 1)) for i in range(len(b))]
        starts = [i for i in range(len(b)) if on[i] and (i == 0 or not on[i - 1])]
        want += [b[i : next((j for j in range(i, len(b)) if not on[j]), len(b))] for i in starts]
    assert b"".join(seen[1]) == b"".join(want) and want
    x, y = calibrated[0]
    assert len(x) == 2 * len(toxic[::4]) and y.sum() == len(toxic[::4])


def test_calibration_is_at_the_optimum():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 3))
    y = (x[:, 0] + r.normal(size=400) > 0.5).astype(float)
    w = op._logistic(x, y)
    one = np.column_stack([x, np.ones(400)])
    p = 1 / (1 + np.exp(-one @ w))
    assert np.abs(one.T @ (p - y) + np.array([1, 1, 1, 1e-6]) * w).max() < 1e-6

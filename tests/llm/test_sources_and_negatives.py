"""Operators 11 to 13 against brute force, over nulls, repeated rows, ties, empty and long texts, and clashing names."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fathomlake.llm import op11_source_divergence
from fathomlake.llm.op11_source_divergence import source_divergence
from fathomlake.llm.op12_hard_negatives import hard_negatives
from fathomlake.llm.op13_source_mix import queued, source_mix

CLASH = "lang shard part item value rank label block place n g kind size target taken source_size digest row key part_of within finish copy words offset weight a_n data terms kept __part __place __before".split()


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns])


# 11

def divergence_want(rows, least, most):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    in_docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        found = [x.translate(lower) for x in term.findall(text)]
        in_docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(some) if part == "pair" or i < most]
    return Counter(out)


def divergence_rows():
    r = random.Random(3)
    words = ["a", "B", "b", "é", "É", "漢字", "z" * 40, "z" * 40 + "q", "z" * 33, "don't", "x1y", "\U0001f600", "ａ"] + [f"t{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", "ｚ", "\U0001f600", None, ""])) for _ in range(300)]
    rows += [(None, "en", "none"), ("1 2 3", "en", "digits"), ("rare words here", "xx", "one"), ("other", "xx", "two"), ("", "lone", "lone"), ("long " * 50_000, "en", "s1")]
    return rows + rows[:20]


@pytest.mark.parametrize("dense", [1 << 21, 8])
def test_divergence(spark, monkeypatch, dense):
    monkeypatch.setattr(op11_source_divergence, "DENSE", dense)
    rows = divergence_rows()
    docs = clashing(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "text string, lang string, source string, doc_id long").repartition(5))
    for broadcast in (100_000, 0):
        got = Counter(map(tuple, source_divergence(docs, 10, 5, 2000, broadcast_groups=broadcast).collect()))
        assert got == divergence_want(rows, 10, 5)
    assert source_divergence(docs.limit(0)).count() == 0


def test_divergence_makes_a_row_for_each_source_and_shard(spark, monkeypatch):
    """However many partitions there are: no row for each shard and pair of sources."""
    made, mapped = [], op11_source_divergence.mapped
    monkeypatch.setattr(op11_source_divergence, "mapped", lambda *x: made.append(mapped(*x)) or made[-1])
    rows = [(f"a b c{chr(97 + i % 7)}", "en", f"s{i % 12}") for i in range(240)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(6)
    for keys_each, shards in ((1_000_000, 1), (20, 9)):
        made.clear()
        got = Counter(map(tuple, source_divergence(docs, 10, 5, 500, keys_each=keys_each).collect()))
        assert got == divergence_want(rows, 10, 5) and made[0].count() <= 12 * shards


def test_shares_of_great_counts():
    import numpy as np

    counts, totals = np.array([[10**14, 3 * 10**14, 0], [0, 7, 5]]), np.array([4 * 10**14, 12])
    want = [[1 + 10**9 * (int(c) + 5) // (int(t) + 15) for c in row] for row, t in zip(counts, totals, strict=True)]
    assert op11_source_divergence.shares(counts, totals, 3).tolist() == want


# 12

def negatives_want(rows):
    import math

    some = []
    for row, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        some.append((row, vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    last = lambda i: (i is None, i or 0)
    for row, vec_id, v, label in some:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), i, x) for r, i, w, x in some if r != row]
        scored = sorted(((max(-(2**63) + 1, min(2**63 - 1, s)), i, x) for s, i, x in scored), key=lambda t: (-t[0], last(t[1])))
        for p_score, p_id, _ in [t for t in scored if t[2] == label][:5]:
            found = [t for t in scored if t[2] != label and 80 * p_score <= 100 * t[0] <= 100 * p_score][:5]
            out += [(vec_id, p_id, k + 1, i, p_score, s) for k, (s, i, _) in enumerate(found)]
    return Counter(out)


def vectors(seed, n, great=1.0):
    r = random.Random(seed)
    base = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [float(x + r.gauss(0, 0.3)) * great for x in r.choice(base)], r.randrange(10)) for i in range(n)]
    rows += [(100, rows[0][1], 3), (100, rows[0][1], 3), (None, rows[1][1], 2), (None, rows[2][1], 3), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf")], 1)]
    rows += [(500, None, 1), (501, [1.0], None), (-100, rows[3][1], 4), (700, [], 2), (703, [0.5, 0.5], 3), (704, rows[5][1] + [1.0, 2.0], 3), (-7, rows[6][1], -5)]
    return rows + rows[:30]


@pytest.mark.parametrize("great", [1.0, 1e3, 1e9, 1e30])
def test_negatives(spark, great):
    rows = vectors(4, 500, great)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    assert Counter(map(tuple, hard_negatives(df).collect())) == negatives_want(rows)
    # Many blocks, and anchors broadcast in several turns.
    assert Counter(map(tuple, hard_negatives(df, block_rows=64, anchor_rows=2, broadcast_bytes=1).collect())) == negatives_want(rows)


def test_no_negatives(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df).count() == 0
    assert hard_negatives(spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_ties_in_scores(spark):
    rows = [(i, [1.0, 2.0], i % 3) for i in range(0, 40)] + [(100, [1.0, 2.0], 1), (200, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert Counter(map(tuple, hard_negatives(df, block_rows=8).collect())) == negatives_want(rows)


# 13

def targets_want(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values())
    held = set()
    while True:
        rest, left = total - sum(3 * sizes[s] for s in held), sum(w for s, w in weight.items() if s not in held)
        target = {s: Fraction(3 * sizes[s]) if s in held else Fraction(rest * weight[s], left) for s in sizes}
        over = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not over:
            return target
        held |= over


def mix_rows():
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([1, 3, 50, 400])), r.choice(["hot", "hot", "hot", "b", "ｚ", "\U0001f600", None, ""])) for i in range(600)]
    rows += [(601, None, "empty"), (602, "  \n ", "empty"), (603, "word " * 20_000, "b"), (604, "x", "tiny"), (None, "a b", "b"), (None, "a b", "b"), (None, None, None), (605, "one\x0btwo\x0cthree four", "tiny")]
    return rows + rows[:10]


def test_mix(spark):
    rows = mix_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("at", F.monotonically_increasing_id()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, one = targets_want(sizes), source_mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.source_size) for r in one) == Counter((i, size(t), sizes[s]) for i, t, s in rows)
    shared, taken = Counter(round(float(v), 6) for v in want.values()), Counter()  # sources of one weight may have one target
    for r in one:
        assert r.taken <= 3 * r.size
        taken[round(r.target, 6)] += r.taken
    assert taken.keys() == shared.keys()
    for target, n in taken.items():
        assert abs(n - target * shared[target]) <= (max(1, target / 1000) + 1) * shared[target]
    assert sum(taken.values()) == sum(sizes.values())
    # Rerunning agrees however the table is dealt out, and however a source is divided.
    two = source_mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, two))
    small = queued(docs.repartition(3), each=5)
    again = small[0].join(small[1].groupBy("row").agg(F.sum("words").alias("taken")), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0))).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, again))


def test_mix_in_order(spark):
    """The mix is one gapless run of pieces, each inside its document, and sources keep step all along."""
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    placed, mix = queued(docs)
    rows = mix.join(placed.select("row", "size", "target", "place"), "row").orderBy("offset").collect()
    at, served = 0, Counter()
    for r in rows:
        assert r.offset == at and r.first_word + r.words <= r.size and 0 <= r.copy < 3
        at += r.words
        served[r.place] += r.words
        if at > 20_000:
            shares = [served[x] / t for x, t in {(y.place, y.target) for y in rows if y.target > 1000}]
            assert max(shares) - min(shares) < 0.01
    assert at == sum(len((t or "").split()) if " " not in (t or "") else 3 for _, t, _ in mix_rows())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix(empty).count() == 0
    none = source_mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]

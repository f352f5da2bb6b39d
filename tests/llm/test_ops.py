"""Each operator against a brute-force version on documents with all the odd cases."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomlake.llm import op2_decontamination, op4_lm_scoring, op6_line_dedup, op9_suffix_dedup
from fathomlake.llm.blocks import pack as pack_numbers
from fathomlake.llm.blocks import pack_sorted, unpack
from fathomlake.llm.op1_packing import pack, sequences
from fathomlake.llm.op3_token_counts import token_counts
from fathomlake.llm.op5_toxicity import toxicity, without_toxic
from fathomlake.llm.op7_exact_dedup import build_mph, exact_dedup, find
from fathomlake.llm.op8_substring_dedup import substring_dedup
from fathomlake.llm.op9_suffix_dedup import suffix_dedup
from fathomlake.llm.op10_minhash_dedup import near_dedup
from fathomlake.llm.suffix_array import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def lower_words(t):
    return WORD.findall(t.translate(LOWER))


def shingles(t, n):
    w = lower_words(t)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_packing(docs, plain, nothing):
    t = Tokenizer.from_file(WORDS)
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in plain.items()}
    seen, filled = {}, {}
    for r in pack(docs, WORDS).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *part)) and r.doc_tokens == len(ids[r.doc_id])
        assert r.boundary == (r.length < r.doc_tokens)
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places, whole in [*((v, len(ids[k])) for k, v in seen.items()), *((v, 2048) for k, v in filled.items() if k < max(filled))]:
        end = 0
        for start, n in sorted(places):
            assert start == end
            end += n
        assert end == whole
    assert set(seen) == set(ids)
    assert Counter(x for r in sequences(docs, WORDS).collect() for x in r.token_ids) == Counter(x for v in ids.values() for x in v)
    assert pack(nothing, WORDS).count() == 0


def test_decontamination(spark, docs, plain, nothing):
    items = {0: plain[3][:200], 1: "nothing of this is there at all", 2: "", 3: plain[30], 4: "A b C d", 5: None, 6: plain[3][:200]}
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = Counter()
    for d, x in plain.items():
        for i, y in items.items():
            a, b = shingles(x, 5), shingles(y or "", 5)
            if b and len(lower_words(y)) < 5 and len(lower_words(x)) >= 5:
                continue
            if b and 10 * len(a & b) >= 8 * len(b):
                want[d, i, len(a & b), len(b)] += 1
    for bands in (64, 1):  # 1: everything by shingles
        got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in op2_decontamination.contaminated(docs, table, bands=bands).collect())
        assert got == want and want
    assert op2_decontamination.contaminated(nothing, table).count() == 0 and op2_decontamination.contaminated(docs, table.limit(0)).count() == 0


def test_token_counts(docs, plain, nothing):
    t = Tokenizer.from_file(BYTES)
    for r in token_counts(docs, BYTES, block_bytes=3000).collect():
        n = len(t.encode(plain[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(plain[r.doc_id].encode()), n, n > 1024)
    assert token_counts(nothing, BYTES).count() == 0


def plain_em(rows, v, buckets=40, rounds=100, prior=1000):
    """Weights of three estimates for each bucket from (bucket, tokens, e2, e1), step by step; a bucket borrows a thousand
    tokens' worth of the weights of all."""
    def step(w, some):
        sums = [0.0, 0.0, 0.0]
        for _, n, e2, e1 in some:
            p = [w[0] * e2, w[1] * e1, w[2] / (v + 1)]
            for k in range(3):
                sums[k] += n * p[k] / sum(p)
        return sums

    every = [1 / 3] * 3
    for _ in range(rounds):
        sums = step(every, rows)
        every = [x / sum(sums) for x in sums]
    every = [max(x, 1e-6) for x in every]
    every = [x / sum(every) for x in every]
    out = []
    for b in range(buckets):
        w, some = every, [r for r in rows if r[0] == b]
        for _ in range(rounds):
            sums = [x + prior * y for x, y in zip(step(w, some), every, strict=True)]
            w = [x / sum(sums) for x in sums]
        out.append([0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])] if b == 0 else w)
    return np.array(out)


def test_lm_weights():
    r = np.random.default_rng(2)
    rows = [(int(r.integers(0, 6)), int(r.integers(1, 5000)), float(r.random() * r.integers(0, 2)), float(r.random() / 100)) for _ in range(300)]
    table = pd.DataFrame([(b, n, n * e2, n * e1) for b, n, e2, e1 in rows], columns=["bucket", "n", "e2", "e1"])
    assert np.allclose(op4_lm_scoring.learn(table, 5000), plain_em(rows, 5000), atol=1e-6)


def test_lm_counts_over_32_bits():
    keys, most = np.array([5, 2**40, 2**63 + 7], np.uint64), 2**32 - 1
    row = {"shard": 3, "keys": pack_sorted(keys), "counts": pack_numbers(np.array([most, 1, 0], np.uint32)), "parts": pack_numbers(np.array([most, 0, 0], np.uint32)), "uni": np.packbits([True, True, False]).tobytes()}
    out = op4_lm_scoring._answer(pd.DataFrame([row | {"block": b} for b in range(3)]))
    assert [list(unpack(x)) for x in out["totals"][:3]] == [[3 * most, 3, 0]] * 3 and [list(unpack(x)) for x in out["parts"][:3]] == [[3 * most, 0, 0]] * 3
    assert out[["n_tokens", "n_parts", "n_types"]].iloc[3].tolist() == [3 * most + 3, 3 * most, 2]


def test_lm_scores(docs, plain, nothing):
    """Counts, weights and scores from scratch; the operator bins the held-out estimates, so its weights differ a little."""
    tokens = {i: [*lower_words(x), None] for i, x in plain.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in plain}

    def counted(skip):
        one, two, before = Counter(), Counter(), Counter()
        for i, w in tokens.items():
            if fold[i] not in skip:
                one.update(w)
                for h, x in zip(["<s>", *w], w):
                    two[h, x] += 1
                    before[h] += 1
        return one, two, before, sum(one.values())

    one, two, before, n = counted({2})
    some = counted({2, 3})
    v, bucket = len(one), lambda c: int(math.log2(c)) + 1 if c else 0
    held = [(bucket(some[2][h]), 1, some[1][h, x] / max(1, some[2][h]), some[0][x] / some[3]) for i, w in tokens.items() if fold[i] == 3 for h, x in zip(["<s>", *w], w)]
    weights = plain_em(held, v, rounds=30)
    rows = op4_lm_scoring.language_model(docs, block_bytes=3000).collect()
    assert len(rows) == len(plain) and held
    for r in rows:
        w = tokens[r.doc_id]
        score = 0.0
        for h, x in zip(["<s>", *w], w):
            l = weights[bucket(before[h])]  # noqa: E741
            score += math.log10(l[0] * two[h, x] / max(1, before[h]) + l[1] * one[x] / n + l[2] / (v + 1))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 2, len(w), sum(x in one for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)) and r.score == pytest.approx(score, rel=0.01)
    assert op4_lm_scoring.language_model(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    bad = [f"some words of text {i} then rotten vermin and rotten vermin again" for i in range(300)]
    good = [f"some words of text {i} then pleasant weather and a garden in the sun" for i in range(300)]
    table = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 300)) for i in range(600)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity(table, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 600 and held and all((r.predicted == 1) == (r.doc_id < 300) for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = without_toxic(table.withColumn("score", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.where("doc_id < 300").count() < 10 and kept.where("doc_id >= 300").count() == 300
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs, labels).count() == docs.count() and toxicity(nothing, labels).count() == 0


def test_without_toxic_leaves_other_columns_in_spark(spark):
    """A column of a type that Arrow cannot carry: only texts go to the scoring."""
    table = spark.createDataFrame([(i, f"text {i} " + ("rotten vermin" if i < 40 else "pleasant weather")) for i in range(80)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, toxic int")
    rows = table.withColumn("span", F.make_interval(days=F.lit(1)))
    kept = without_toxic(rows, labels)
    assert kept.schema == rows.schema
    assert {r.doc_id for r in kept.select("doc_id", "text").collect()} == {r.doc_id for r in toxicity(table, labels).where("predicted = 0").collect()}


def test_line_dedup(spark):
    page = "<html><body><nav>Menu</nav><p>Only here {}</p><script>x</script><p>Often</p></body></html>"
    pages = spark.createDataFrame([(i, f"http://H.x/{i}", page.format(i)) for i in range(6)] + [(10, "http://few.x/", page.format(1)), (11, None, None), (12, "x", ""), (13, "http://few.x/", page.format(1))], "page_id long, url string, html string")
    got = {r.page_id: r for r in op6_line_dedup.line_dedup(pages.withColumn("host", F.lit("z"))).collect()}
    assert all(got[i].kept_text == f"Only here {i}" and (got[i].n_lines, got[i].n_dropped, got[i].host) == (3, 2, "h.x") for i in range(6))
    assert got[10].n_dropped == got[13].n_dropped == 0 and (got[11].kept_text, got[12].n_lines) == ("", 0)
    assert op6_line_dedup.line_dedup(pages.limit(0)).count() == 0


def test_exact_dedup(spark, docs, plain, nothing):
    twice = docs.unionByName(docs.where("doc_id IN (4, 40)")).unionByName(spark.createDataFrame([(None, "one")], "doc_id long, text string"), allowMissingColumns=True)
    norm = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest() for i, t in plain.items()}
    count = Counter(norm.values())
    count[norm[4]] += 1
    count[norm[40]] += 1
    count[hashlib.sha256(b"one").hexdigest()] += 1
    least = {}
    for i, h in sorted(norm.items()):
        least.setdefault(h, i)
    rows = exact_dedup(twice, keys_each=7).collect()
    assert len(rows) == len(plain) + 3 and all((r.keep_id, r.group_size) == (least[r.text_sha256], count[r.text_sha256]) for r in rows)
    assert all(r.text_sha256 == norm[r.doc_id] for r in rows if r.doc_id is not None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(dict.fromkeys(count, 1)) and all(r.doc_id == r.keep_id for r in rows if r.kept)
    assert exact_dedup(nothing).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    levels, slots = build_mph(keys)
    assert sorted(slots) == list(range(5000)) and (find(levels, keys) == slots).all()


def covered(units, length):
    seen = Counter(tuple(u[k : k + length]) for u in units.values() for k in range(len(u) - length + 1))
    out = {}
    for i, u in units.items():
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            if seen[tuple(u[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out[i] = gone
    return out


@pytest.mark.parametrize("length", [35, 7])
def test_substring_dedup(docs, plain, nothing, length):
    w = {i: WORD.findall(t) for i, t in plain.items()}
    gone = covered(w, length)
    for r in substring_dedup(docs, length, block_bytes=3000).collect():
        kept = " ".join(x for x, g in zip(w[r.doc_id], gone[r.doc_id], strict=True) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w[r.doc_id]), sum(gone[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup(nothing).count() == 0


def suffix_want(units, length):
    """n_removed, n_spans and digest of what is left, by counting every window."""
    key = lambda u, k: hashlib.blake2b(u[k : k + length], digest_size=16).digest()
    seen, out = Counter(key(u, k) for u in units for k in range(len(u) - length + 1)), []
    for u in units:
        gone = np.zeros(len(u) + 1, int)
        for k in range(len(u) - length + 1):
            if seen[key(u, k)] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        out.append((len(u), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(u, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "short", "span"), [(120, 16, 16), (120, 48, 72), (400, 160, 256)])
def test_suffix_dedup(spark, docs, plain, nothing, length, short, span):
    texts = [t.encode() for t in plain.values()]
    want = dict(zip(plain, suffix_want(texts, length), strict=True))
    rows = suffix_dedup(docs, length, short, span, block_bytes=3000).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] and r.n_removed <= r.n_repeated <= r.n_bytes
    # A string of `span` bytes that starts elsewhere too is seen, and what is seen is covered by repeated short strings.
    repeats, shorts = suffix_want(texts, span), suffix_want(texts, short)
    for r, a, b in zip(sorted(rows, key=lambda r: r.doc_id), repeats, shorts, strict=True):
        assert (r.n_repeated > 0 or a[1] == 0) and r.n_repeated <= b[1]
    assert suffix_dedup(nothing).count() == 0


def test_suffix_dedup_of_long_and_repeated_rows(spark):
    r = np.random.default_rng(3)
    long = " ".join("".join(chr(97 + c) for c in r.integers(0, 20, 6)) for _ in range(160_000))
    texts = [long, f"start {long[500_000:500_900]} end", f"{long[77:476]} other", "ab" * 700, long[:3000], long[:3000], None, ""]
    rows = [(1 if i in (4, 5) else None if i == 2 else i, t) for i, t in enumerate(texts)]
    want = Counter((i, *w) for (i, _), w in zip(rows, suffix_want([(t or "").encode() for _, t in rows], 400), strict=True))
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want and len(long) > 1_000_000


def test_window_keys_read_covered_bytes_alone(monkeypatch):
    raw, starts, sizes = np.random.default_rng(4).integers(0, 3, 5000).astype(np.uint8), np.array([7, 8, 9, 300, 340, 4960]), []
    every, runs = op9_suffix_dedup.byte_runs(raw, 40), op9_suffix_dedup.byte_runs
    monkeypatch.setattr(op9_suffix_dedup, "byte_runs", lambda x, n: sizes.append(len(x)) or runs(x, n))
    keys, checks = op9_suffix_dedup.window_keys(raw, starts, 40)
    assert keys.tolist() == every[starts].tolist() and len(checks) == 6 and sizes == [162, 162]
    of, n = op9_suffix_dedup.window_groups(np.tile(raw[:100], 3), np.array([0, 5, 100, 205, 61]), 30)
    assert of[0] == of[2] and of[1] == of[3] and len(set(of.tolist())) == 3 and n[of].tolist() == [2, 2, 2, 2, 1]


def test_suffix_array():
    r = np.random.default_rng(1)
    for trial in range(200):
        text = r.integers(97 * (trial % 3 > 0), 97 * (trial % 3 > 0) + 1 + trial % 4, int(r.integers(0, 70))).astype(np.uint8)
        b = text.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        order = suffix_array(text)
        assert list(order) == want
        if want:
            common = lambda i, j: next((k for k in range(len(b)) if max(i, j) + k == len(b) or b[i + k] != b[j + k]), 0)
            assert list(common_prefixes(text, order)) == [0] + [common(want[k - 1], want[k]) for k in range(1, len(b))]
            for depth in (1, 3, 9, 20):  # the same groups of strings of so many bytes
                some = suffix_array(text, depth)
                assert [b[i : i + depth] for i in some] == [b[i : i + depth] for i in want]
                n = [min(x, depth) for x in common_prefixes(text, some, depth)]
                assert n == [0] + [min(common(some[k - 1], some[k]), depth) for k in range(1, len(b))]


@pytest.mark.parametrize(("n", "tile"), [(4, 1000), (4, 3), (5, 1000)])
def test_near_dedup(docs, plain, nothing, n, tile):
    sets = {i: shingles(t, n) for i, t in plain.items()}
    up = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    rows = near_dedup(docs, n, tile=tile, block_bytes=3000).collect()
    assert len(rows) == len(plain)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], up[r.doc_id] == r.doc_id)
    assert near_dedup(nothing).count() == 0

"""Words that a polynomial hash cannot tell apart, texts made of them, and blocks of two queries at once."""

from __future__ import annotations

import math
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomlake.llm import blocks
from fathomlake.llm.common import cleared, written
from fathomlake.llm.op1_packing import pack
from fathomlake.llm.op3_token_counts import token_counts
from fathomlake.llm.op4_lm_scoring import language_model
from fathomlake.llm.op8_substring_dedup import substring_dedup
from fathomlake.llm.op9_suffix_dedup import suffix_dedup
from fathomlake.llm.op10_minhash_dedup import exactly_similar, near_dedup

from .test_ops import suffix_want

A, B = "a", "b"
for _ in range(10):  # the two Thue-Morse words of 1,024 letters
    A, B = A + B, B + A
REST = " ".join(f"w{i}" for i in range(34))


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(1, A), (2, B)], "doc_id long, text string")


def test_counts(two):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert {r.doc_id: r.n_tokens for r in token_counts(two, path).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ((1, A), (2, B))}


def test_packing(two):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ((1, A), (2, B))}
    assert {r.doc_id: r.ids_crc32 for r in pack(two, path).collect()} == want


def test_near(two):
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup(two).collect()) == [(1, 1, True), (2, 2, True)]


def test_substring(spark):
    docs = spark.createDataFrame([(1, f"{A} {REST}"), (2, f"{B} {REST}"), (3, f"{A} {REST} x")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()} == {1: 35, 2: 0, 3: 35}


def test_suffix(two):
    want = [x[1] for x in suffix_want([A.encode(), B.encode()], 400)]
    assert [r.n_removed for r in sorted(suffix_dedup(two).collect())] == want


def test_language_model(spark):
    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:2]  # both are learnt from
    got = {r.doc_id: r for r in language_model(spark.createDataFrame([(one, f"{A} {A}"), (two, B)], "doc_id long, text string")).collect()}
    assert got[one].base_score == pytest.approx(3 * math.log10(3 / 9))  # five tokens of three kinds
    assert got[two].base_score == pytest.approx(math.log10(2 / 9) + math.log10(3 / 9))


def test_equal_hashes_are_told_apart(monkeypatch):
    raw = np.frombuffer(b"one two one three " + b"x" * 300 + b" " + b"x" * 299 + b"y", np.uint8)
    starts, ends, _ = blocks.word_spans(raw, np.array([0, len(raw)]))
    for fake in (False, True):
        if fake:
            monkeypatch.setattr(blocks, "span_hashes", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
        first, number, keys = blocks.distinct_spans(raw, starts, ends)
        assert len(first) == len(keys) == 5 and number[0] == number[2] and len(set(number.tolist())) == 5
        assert all(raw[starts[i] : ends[i]].tobytes() == raw[starts[first[n]] : ends[first[n]]].tobytes() for i, n in enumerate(number.tolist()))


def test_pairs(spark):
    """Keys of 64 bits that several second numbers share."""
    keys, checks = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    rows = blocks.ask_pairs(1, 0, keys, checks) + blocks.ask_pairs(1, 1, np.array([5, 5, 9], np.uint64), np.array([2, 3, 4], np.uint64))
    found = {r.block: r.found for r in blocks.repeated_pairs(spark.createDataFrame([tuple(r[c] for c in ("shard", "block", "keys", "counts", "checks")) for r in rows], blocks.ASK_PAIRS)).collect()}
    assert blocks.pairs_in(keys, checks, found[0]).tolist() == [True, True, True, False]
    assert blocks.pairs_in(np.array([5, 5, 9], np.uint64), np.array([2, 3, 4], np.uint64), found[1]).tolist() == [True, False, False]


def test_exactly_similar():
    words = [f"w{i}" for i in range(100)]
    text = " ".join(words).encode()
    assert exactly_similar(text, text.upper(), 80, 4)
    for k in (1, 2, 3, 5, 8):
        other = words.copy()
        for i in range(k):
            other[10 + 12 * i if k > 1 else 50] = f"n{i}"
        a, b = ({tuple(w[i : i + 4]) for i in range(97)} for w in (words, other))
        assert exactly_similar(text, " ".join(other).encode(), 80, 4) == (100 * len(a & b) >= 80 * len(a | b))
    assert not exactly_similar(b"a b", b"a b c", 80, 4) and exactly_similar(b"a b", b"A  b", 80, 4)


def test_two_threads(spark):
    """A block that ends deletes no table that another thread has written."""
    inside, done, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.extend([written(spark.range(3), "other"), written(spark.range(4), "other")])
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with cleared(spark):
        gone = written(spark.range(1), "mine")
        inside.set()
        done.wait(60)
        last = written(spark.range(2), "mine")
    thread.join()
    assert [x.count() for x in (*kept, last)] == [3, 4, 2]
    with pytest.raises(Exception, match="(?i)not.exist|does not exist"):
        gone.count()

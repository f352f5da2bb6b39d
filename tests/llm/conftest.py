from __future__ import annotations

import random

import pytest


def texts() -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty, very short and very long texts, odd characters."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(400)] + ["Été,", "ñandú.", "x--y", "don't", "漢字", "É"]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = make(60)
    out = [make(r.randint(20, 200)) for _ in range(30)]
    out += [f"{make(10)} {passage} {make(30)}" for _ in range(6)] + [out[0]] * 3 + [out[1].replace(" ", "\n  ", 5)]
    for k in range(6):
        w = out[2].split()
        w[3 + 20 * k : 4 + 20 * k] = ["changed"]
        out.append(" ".join(w))
    out += [None, "", "   ", "one", "two words", "a" * 5000, "x " * 900, make(9000), "<|endoftext|> a <|endoftext|>", "\x1cq  　z  ", passage, "A B C D", "a b c d"]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark):
    """With columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in texts()], "doc_id long, text string, key string, block int, node int").repartition(3)


@pytest.fixture(scope="session")
def plain():
    return {i: t or "" for i, t in texts()}


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)

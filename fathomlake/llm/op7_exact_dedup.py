"""Exact dedup against a minimal perfect hash of the historical distinct digests.

Texts are equal when identical after each run of ASCII white space has become one space; they are known by SHA-256.
The documents with the lower half of the ids are the history, the others arrive later. The history's distinct digests
are dealt into shards by their first bytes; each shard gets a minimal perfect hash (levels of bit arrays, a key staying
at the first level where it meets no other) whose slots hold the full digest and the locator of its winner, the smallest
doc_id with its row. Arriving digests, one row for each distinct one, go to the shard's hash: a slot whose 32 bytes are
the same makes them repeats of that winner; the others are grouped among themselves.

Cases: a null text is the empty text, and so equal to it; of rows with the same doc_id and equal texts one stays, the
one with the least row number; a null doc_id comes after all others; of a very long text only the digest goes on; an empty
table gives an empty one; other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, texts_of, written
from .components import with_copies

LEVELS, LOAD, KEYS_EACH = 24, 1.5, 200_000
LAST = 2**63 - 1


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def _at(keys: np.ndarray, level: int, n_bits: int) -> np.ndarray:
    """Places of keys, rows of four 64-bit words of a digest, in the bit array of a level."""
    x = keys[:, level % 4] ^ (keys[:, (level + 1) % 4] >> np.uint64(level)) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) % np.uint64(n_bits)


def build_mph(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and each key's slot from 0 to n - 1. Keys must differ."""
    slots, levels, left, taken = np.zeros(len(keys), np.int64), [], np.arange(len(keys)), 0
    while len(left):
        if len(levels) == LEVELS:
            raise ValueError("keys are not distinct")
        at = _at(keys[left], len(levels), n := int(len(left) * LOAD) + 1)
        alone = np.bincount(at, minlength=n) == 1
        levels.append(alone)
        slots[left[alone[at]]] = taken + np.cumsum(alone)[at[alone[at]]] - 1
        taken += int(alone.sum())
        left = left[~alone[at]]
    return levels, slots


def find(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's slot; for a key that was not built in, the slot of another one or -1."""
    slots, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = _at(keys[left], level, len(bits))
        hit = bits[at]
        slots[left[hit]] = before + np.cumsum(bits)[at[hit]] - 1
        left, before = left[~hit], before + int(bits.sum())
    return slots


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 4).astype(np.uint64)


BUILT = "shard int, level_bits array<binary>, sizes array<int>, digests binary, ids array<long>, rows array<long>, copies array<long>"


def _build(found: pd.DataFrame) -> pd.DataFrame:
    keys = _words(found["digest"])
    levels, slots = build_mph(keys)
    order = np.argsort(slots)
    in_slots = found.iloc[order]
    row = {"shard": int(found["shard"].iloc[0]), "level_bits": [np.packbits(x).tobytes() for x in levels], "sizes": [len(x) for x in levels], "digests": b"".join(in_slots["digest"])}
    return pd.DataFrame([row | {k: in_slots[k].to_numpy() for k in ("ids", "rows", "copies")}])


LOOKED = "digest binary, ids long, rows long, copies long, known boolean"


def _look(_: tuple, built: pd.DataFrame, arrived: pd.DataFrame) -> pd.DataFrame:
    """Groups of the history with the copies that arrived added, and the arrived ones that it does not know."""
    if not len(built):
        return arrived[["digest", "ids", "rows", "copies"]].assign(known=False)
    one = built.iloc[0]
    levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)).astype(bool) for b, n in zip(one["level_bits"], one["sizes"], strict=True)]
    held = np.frombuffer(one["digests"], np.uint8).reshape(-1, 32)
    out = pd.DataFrame({"digest": [x.tobytes() for x in held], "ids": one["ids"], "rows": one["rows"], "copies": np.array(one["copies"], np.int64), "known": True})
    if not len(arrived):
        return out
    slots = find(levels, _words(arrived["digest"]))
    asked = np.frombuffer(b"".join(arrived["digest"]), np.uint8).reshape(-1, 32)
    member = (slots >= 0) & (held[slots] == asked).all(axis=1)
    copies = out["copies"].to_numpy().copy()
    np.add.at(copies, slots[member], arrived["copies"].to_numpy()[member])
    return pd.concat([out.assign(copies=copies), arrived.loc[~member, ["digest", "ids", "rows", "copies"]].assign(known=False)])


def groups(digests: DataFrame, keys_each: int = KEYS_EACH) -> DataFrame:
    """One row for each distinct digest: digest, ids (its winner's doc_id), rows (its winner's row), copies."""
    n, least, most = digests.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cut = (least + most + 1) // 2 if least is not None else 0
    shards = max(2 * int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // keys_each + 1)
    known = (F.col("doc_id") < cut) & F.col("doc_id").isNotNull()
    # One row for each digest and side, combined before the shuffle: copies by the third of all rows are one row here.
    distinct = (
        digests.withColumn("old", known).groupBy("digest", "old")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("ids"), F.col("row").alias("rows"))).alias("w"), F.count("*").alias("copies"))
        .select("digest", "old", "w.ids", "w.rows", "copies", F.pmod(F.crc32("digest"), F.lit(shards)).cast("int").alias("shard"))
    )
    distinct = written(distinct, "digests")
    history = distinct.where("old").groupBy("shard").applyInPandas(_build, BUILT)
    arrived = distinct.where("NOT old").drop("old")
    return history.groupBy("shard").cogroup(arrived.groupBy("shard")).applyInPandas(_look, LOOKED)


def exact_dedup(docs: DataFrame, keys_each: int = KEYS_EACH, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known (the winner is in the history); and
    key, where a column of distinct row numbers is given.

    Only groups of two or more go back to the documents, by a join on the digest; the rows of a digest that a third of all
    rows share are spread over parts, each with a copy of the group's one row.
    """
    number = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    digests = written(texts_of(docs, key=number).select("doc_id", digest(F.col("text")).alias("digest"), F.col("key").alias("row")), "documents")
    many = groups(digests, keys_each).where("copies > 1").select("digest", "ids", "rows", "copies", "known")
    joined = with_copies(digests, "row", many, "digest", "left")
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.when(F.col("ids") < LAST, F.col("ids")))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        (F.col("copies").isNull() | (F.col("rows") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("known", F.lit(False)).alias("known"), *([F.col("row").alias("key")] if key else []),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
c AS (SELECT min(doc_id) + max(doc_id) + 1 AS twice FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256,
  count(*) OVER g > 1 AND min(doc_id) OVER g < (SELECT twice // 2 FROM c) AS known
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

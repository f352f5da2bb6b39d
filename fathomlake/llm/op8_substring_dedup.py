"""Substring dedup by level-wise doubling: a window of words goes where its word sequence starts anywhere else.

Windows of a quarter, then a half, then the whole length: only windows repeated at one length are looked at with twice
that length, until none is left. At the two shorter lengths a full window is held against other documents by one of its
short windows, chosen by content (the least hash); a window that occurs elsewhere has the same choice there, so no
repeat is lost, and about one position in ten is sent. At the full length every window left is.

Cases: a null or empty text has no words and its kept text is empty; texts shorter than a window stay whole; repeated
rows are texts of their own, so all their windows are repeated; a null doc_id is a document like others; a text that
repeats itself counts, overlaps too; ties do not arise, as all equal windows go; a very long text is a block of its own; an
empty table gives an empty one; other columns are not read, whatever they are called.
At the shorter lengths sequences are compared by hashes of 64 bits, which may let a window go on. What is removed is decided
on words that are told apart by their bytes in a block, and by 128 bits of BLAKE2 across blocks, as are their windows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASK, ASK_PAIRS, BLOCK, anchors, as_row, ask, ask_pairs, blocks, covered, inside, is_in, keys_of, load, mapped, mix, pairs_in, repeated, repeated_pairs, runs_of, span_hashes, squeeze, unsqueeze, word_keys, word_spans
from .common import shards_for, written

LENGTH = 35
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _kept(raw: bytes, keep: np.ndarray | None) -> str:
    found = raw.split()  # bytes.split() splits on the six ASCII spaces
    return hashlib.sha256(b" ".join(found if keep is None else compress(found, keep))).hexdigest()


class _Level:
    """Windows of `length` words by their chosen short window of `short` words."""

    def __init__(self, row, length: int, short: int):
        b = self.b = load(row)
        self.starts, ends, self.at = word_spans(b.raw, b.at)
        self.ends, self.hashes = ends, span_hashes(b.raw, self.starts, ends)
        self.ok = inside(self.at, length)[: max(0, len(self.hashes) - length + 1)]
        if getattr(row, "marks", None) is not None:
            self.ok &= np.unpackbits(np.frombuffer(unsqueeze(row.marks), np.uint8), count=len(self.ok)).astype(bool)
        self.windows = np.flatnonzero(self.ok)
        short_hashes = runs_of(self.hashes, short)
        self.chosen = anchors(short_hashes, length - short + 1)[self.windows] if len(self.windows) else self.windows
        self.keys = mix(short_hashes[self.chosen])  # least hashes are small numbers: mixed again they spread over all shards

    def ask(self, shards: int) -> list[dict]:
        """Each chosen short window, at each of its places, once."""
        new = np.diff(self.chosen, prepend=-1) != 0
        keys, n = np.unique(self.keys[new], return_counts=True)
        return ask(shards, self.b.block, keys, n)


def substring_dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    spark = docs.sparkSession
    quarter, half = -(-length // 4), -(-length // 2)
    whole = blocks(docs, block_bytes)
    n_words = (whole.agg(F.sum("block_bytes")).first()[0] or 0) / 6
    shards = shards_for(spark, n_words / 8)

    # A quarter of the length.
    found = repeated(mapped(whole.select(*_names(BLOCK)), lambda row: _Level(row, length, quarter).ask(shards), ASK))

    def narrow(row) -> list[dict]:
        """Documents without a window left are done; the others go on as a smaller block with marked windows."""
        x = _Level(row, length, quarter)
        marks = np.zeros(len(x.hashes), bool)
        marks[x.windows[is_in(x.keys, keys_of(row.found))]] = True
        b = x.b
        some = np.add.reduceat(np.append(marks, False), np.minimum(x.at[:-1], len(marks))) * (np.diff(x.at) > 0) > 0 if len(b.ids) else np.zeros(0, bool)
        done = [
            {"doc_id": b.ids[i], "n_words": int(x.at[i + 1] - x.at[i]), "n_removed": 0, "kept_sha256": _kept(b.raw[b.at[i] : b.at[i + 1]].tobytes(), None)}
            for i in np.flatnonzero(~some)
        ]
        if not some.any():
            return done
        keep = np.repeat(some, np.diff(b.at))
        left = marks[np.repeat(some, np.diff(x.at))]
        row = as_row(b.block, [b.ids[i] for i in np.flatnonzero(some)], b.raw[keep], np.concatenate([[0], np.cumsum(np.diff(b.at)[some])]))
        return [*done, row | {"marks": squeeze(np.packbits(left).tobytes())}]

    stage = written(mapped(whole.join(found, "block", "left"), narrow, f"{RESULT}, {BLOCK}, marks binary"), "narrowed")
    done, left = stage.where("block IS NULL").select(*_names(RESULT)), stage.where("block IS NOT NULL").select(*_names(BLOCK), "marks")

    def whole_windows(x: _Level, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, checks = word_keys(x.b.raw, x.starts, x.ends).T.copy()
        return runs_of(keys, length)[which], runs_of(checks, length)[which]

    # Half the length, then the whole.
    found = repeated(mapped(left, lambda row: _Level(row, length, half).ask(shards), ASK))

    def last(row) -> list[dict]:
        x = _Level(row, length, half)
        return ask_pairs(shards, x.b.block, *whole_windows(x, x.windows[is_in(x.keys, keys_of(row.found))]))

    found = repeated_pairs(mapped(left.join(found, "block"), last, ASK_PAIRS))

    def finish(row) -> list[dict]:
        x = _Level(row, length, half)
        hit = x.windows[pairs_in(*whole_windows(x, x.windows), row.found)]
        gone, b, out = covered(hit, length, len(x.hashes)), x.b, []
        for i, doc_id in enumerate(b.ids):
            keep = ~gone[x.at[i] : x.at[i + 1]]
            out.append({"doc_id": doc_id, "n_words": len(keep), "n_removed": int(len(keep) - keep.sum()), "kept_sha256": _kept(b.raw[b.at[i] : b.at[i + 1]].tobytes(), keep)})
        return out

    return done.unionByName(mapped(left.join(found, "block", "left"), finish, RESULT))


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT r, unnest(range(1, len(w) - {LENGTH - 2})) AS k FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT r, k, md5(array_to_string(w[k:k + {LENGTH - 1}], ' ')) AS h FROM k JOIN d USING (r)),
g AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(k, k + {LENGTH})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1) GROUP BY 1),
x AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r)),
m AS (SELECT doc_id, w, gone, list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) AS stay FROM x)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(list_transform(stay, lambda i: w[i]), ' ')) AS kept_sha256 FROM m
"""


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]

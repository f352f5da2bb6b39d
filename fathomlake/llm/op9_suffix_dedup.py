"""Suffix-array dedup: bytes covered by a string of a given length that starts anywhere else go.

1. Strings of SHORT bytes, chosen by content (in every string of SPAN bytes the one of least hash; see blocks.anchors),
   are held against all documents. A window of `length` bytes goes on only if all chosen strings in it are repeated.
2. A shard is a block of the documents left. It sorts the suffixes of all its windows (Larsson-Sadakane) and counts
   common prefixes (Kasai): neighbours with `length` common bytes or more are equal windows, and a window that has an
   equal one in its own shard is settled. Neighbouring windows with one choice form a passage; two passages are equal if
   their first windows and their last windows are.
3. Shards are merged by binary search in their sorted lists of distinct passages, and then of distinct windows: those of
   passages that differ under one choice (one specimen of a passage that is repeated as a whole), by suffix arrays again.

Besides what is removed, n_repeated counts bytes that a repeated chosen string or a removed string covers: a passage that
is repeated, but too short to be removed, is seen there if it has SPAN bytes.

Cases: a null or empty text has no bytes; texts shorter than a window stay whole; repeated rows are texts of their own,
so every window of theirs is repeated; a null doc_id is a document like others; a text that repeats itself counts,
overlaps too; a removal may split a character; ties do not arise, as all equal windows go; a very long text is a block of its
own; an empty table gives an empty one; other columns are not read, whatever they are called. In a shard strings
are compared as they are; across shards passages by 128 bits of BLAKE2, and single windows by two hashes of 64 bits. (The chosen strings
of the first step are held by 64-bit hashes, which may let a window go on.)
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ASK_PAIRS, BLOCK, Block, anchors, as_row, ask, ask_pairs, blocks, covered, groups_of_pairs, inside, is_in, keys_of, load, mapped, merge, mix, pack, pack_sorted, pairs_in, repeated, repeated_pairs, squeeze, unpack, unpack_sorted, unsqueeze
from .common import release, shards_for, texts_of, written
from .suffix_array import common_prefixes, suffix_array

LENGTH, SHORT, SPAN = 400, 160, 256
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
PLACED = f"{BLOCK}, first binary, last binary, places binary, shard int, keys binary, counts binary"
LEFT = f"{BLOCK}, first binary, last binary, choices binary, kinds binary, checks binary, settled binary, short binary"
PASSAGES, ANSWER = "shard int, block long, kind int, keys binary, counts binary, checks binary, least binary, most binary", "block long, kind int, found binary, checks binary"


#: Another byte for each byte, so that runs have a second hash of 64 bits.
_OTHER = np.random.default_rng(9).permutation(256).astype(np.uint8)


def byte_runs(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n bytes; n: 8 or more."""
    if len(raw) < n:
        return np.zeros(0, np.uint64)
    eight = mix(np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,)).astype(np.uint64))
    size, out = 8, eight
    while 2 * size <= n:
        out = out[:-size] * np.uint64(0x9E3779B97F4A7C15) + out[size:]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        size *= 2
    if size < n:
        out = mix(out[: size - n] * np.uint64(0x9E3779B97F4A7C15) + out[n - size :])
    return out


def _ups(x: np.ndarray) -> bytes:
    """Packed places, in order."""
    return pack(np.diff(x, prepend=0).astype(np.uint64))


def _places(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x).astype(np.int64))


def _bits(x: np.ndarray) -> bytes:
    return squeeze(np.packbits(x).tobytes())


def _flags(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(x), np.uint8), count=n).astype(bool)


def passages_of(windows: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in passages, neighbours that share a choice among so many hashes: where each one's first and last window
    start, and the place of its choice."""
    chosen = anchors(hashes, width)[windows] if len(windows) else windows
    new = (np.diff(chosen, prepend=-1) != 0) | (np.diff(windows, prepend=-1) != 1)
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)[: int(new.sum())]
    return windows[new], windows[ends], chosen[new]


def window_groups(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows at some starts the number of their group of equal ones, by the suffix array of what they cover; and
    how many are in each group."""
    if not len(starts):
        return starts, starts
    keep = covered(starts, length, len(raw))
    text, there = raw[keep], np.cumsum(keep)[starts] - 1  # a window's bytes are neighbours here too, as they all are kept
    order = suffix_array(text, length)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text, order, length) < length)
    n = np.bincount(group[there], minlength=group.max() + 1)
    return (np.cumsum(n > 0) - 1)[group[there]], n[n > 0]


def window_keys(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, made from the bytes that these windows cover alone."""
    keep = covered(starts, length, len(raw))
    text, there = raw[keep], np.cumsum(keep)[starts] - 1
    return byte_runs(text, length)[there], byte_runs(_OTHER[text], length)[there]


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each stretch of bytes, a column each: BLAKE2 of 128 bits."""
    text = raw.tobytes()
    return np.frombuffer(b"".join([hashlib.blake2b(text[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)


class _Passages:
    """The windows left in a block, in passages: neighbours that share a chosen string."""

    def __init__(self, row):
        self.b = load(row)
        self.first, self.last = _places(row.first), _places(row.last)
        self.choices, self.kinds, self.checks = unpack(row.choices), unpack(row.kinds), unpack(row.checks)

    def starts(self, which: np.ndarray) -> np.ndarray:
        """The windows of some passages."""
        n = (self.last - self.first + 1)[which]
        return np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """kind 0, of passages: 0 repeated, 1 to be looked at by this block though repeated; kind 1, of choices: 2 if they have several passages."""
    release()
    out = []
    for kind, part in asked.groupby("kind"):
        lists = [unpack_sorted(x) for x in part["keys"]]
        if kind == 0:
            checks = [unpack(x) for x in part["checks"]]
            group = groups_of_pairs(np.concatenate(lists), np.concatenate(checks))
            totals = np.bincount(group, np.concatenate([unpack(x, np.uint32) for x in part["counts"]]))
            owner, of = np.full(len(totals), len(lists)), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            np.minimum.at(owner, group, of)
            hit, mine, done = totals[group] > 1, owner[group] == of, 0
            for block, keys, own in zip(part["block"], lists, checks, strict=True):
                here = slice(done, done := done + len(keys))
                for k, some in ((0, hit[here]), (1, hit[here] & mine[here])):
                    out.append((block, k, keys[some], own[some]))
        else:
            merged, _, places = merge(lists, [0] * len(lists))
            least, most = np.full(len(merged), 2**64 - 1, np.uint64), np.zeros(len(merged), np.uint64)
            for at, a, b in zip(places, part["least"], part["most"], strict=True):
                least[at], most[at] = np.minimum(least[at], unpack(a)), np.maximum(most[at], unpack(b))
            out += [(block, 2, keys[least[at] < most[at]], None) for block, keys, at in zip(part["block"], lists, places, strict=True)]
    return pd.DataFrame([(b, k, pack_sorted(x), None if y is None else pack(y)) for b, k, x, y in out if len(x)], columns=["block", "kind", "found", "checks"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, short: int = SHORT, span: int = SPAN, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept_sha256, n_repeated.

    8 <= short <= span <= length."""
    spark = docs.sparkSession
    n_bytes = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(spark, n_bytes / 40)

    def choices(b: Block) -> tuple[dict, list[dict]]:
        hashes = byte_runs(b.raw, short)
        first, last, places = passages_of(np.flatnonzero(inside(b.at, span)[: max(0, len(b.raw) - span + 1)]), hashes, span - short + 1)
        # The least hashes are small numbers: mixed again they spread over all shards.
        keys, n = np.unique(mix(hashes[places[np.diff(places, prepend=-1) != 0]]), return_counts=True)
        return {"first": _ups(first), "last": _ups(last), "places": _ups(places)}, ask(shards, b.block, keys, n)

    stage = blocks(docs, block_bytes, PLACED, choices)
    names = [x.split()[0] for x in BLOCK.split(", ")]
    found = repeated(stage.where("shard IS NOT NULL").select("shard", "block", "keys", "counts"))

    def narrow(row) -> list[dict]:
        """Documents without a window left are done; the others go on as a smaller block with its windows in passages."""
        b = load(row)
        first, last, places = (_places(x) for x in (row.first, row.last, row.places))
        n, hashes = len(b.raw), byte_runs(b.raw, short)
        hit = is_in(mix(hashes[places]), keys_of(row.found))
        seen, step = covered(places[hit], short, n), np.zeros(n + 1, np.int64)
        # Windows that hold a string of `span` bytes whose choice is not repeated.
        np.add.at(step, np.maximum(first[~hit] - length + span, 0), 1)
        np.add.at(step, last[~hit] + 1, -1)
        marks = inside(b.at, length) & (np.cumsum(step)[:-1] == 0)
        sizes = np.diff(b.at)
        some = (np.add.reduceat(np.append(marks, False), b.at[:-1]) > 0) & (sizes > 0)
        done = []
        for i in np.flatnonzero(~some):
            here = slice(b.at[i], b.at[i + 1])
            done.append({"doc_id": b.ids[i], "n_bytes": int(sizes[i]), "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(b.raw[here].tobytes()).hexdigest(), "n_repeated": int(seen[here].sum())})
        if not some.any():
            return done
        keep = np.repeat(some, sizes)
        raw, windows, at = b.raw[keep], np.flatnonzero(marks[keep]), np.concatenate([[0], np.cumsum(sizes[some])])
        # A text that stays has its hashes already; those of strings over the end of a text are in no window.
        hashes = hashes[keep[: len(hashes)]][: len(raw) - short + 1]
        first, last, places = passages_of(windows, hashes, length - short + 1)
        group, times = window_groups(raw, windows, length)
        # Equal passages have equal first and last windows and as many of them: their key is the digest of any of the group's.
        place = np.searchsorted(windows, [first, last])
        _, one, kind = np.unique(np.column_stack([*group[place], last - first]), axis=0, return_index=True, return_inverse=True)
        keys = digests(raw, first[one], last[one] + length)[kind.ravel()]
        settled = np.zeros(len(raw), bool)
        settled[windows[times[group] > 1]] = True
        fields = {"first": _ups(first), "last": _ups(last), "choices": pack(mix(hashes[places])), "kinds": pack(keys[:, 0].copy()), "checks": pack(keys[:, 1].copy()), "settled": _bits(settled), "short": _bits(seen[keep])}
        return [*done, as_row(b.block, [b.ids[i] for i in np.flatnonzero(some)], raw, at) | fields]

    stage = written(mapped(stage.where("shard IS NULL").select(*names, "first", "last", "places").join(found, "block", "left"), narrow, f"{RESULT}, {LEFT}"), "narrowed")
    done, left = stage.where("block IS NULL").select(*[x.split()[0] for x in RESULT.split(", ")]), stage.where("block IS NOT NULL").select(*[x.split()[0] for x in LEFT.split(", ")])

    def passages(row) -> list[dict]:
        kinds, choices = unpack(row.kinds), unpack(row.choices)
        out = [x | {"kind": 0} for x in ask_pairs(shards, row.block, kinds, unpack(row.checks))]
        order = np.lexsort((kinds, choices))
        at = np.flatnonzero(np.append(True, np.diff(choices[order]) != 0))
        keys, least, most = choices[order][at], kinds[order][at], kinds[order][np.append(at[1:], len(order)) - 1]
        done = 0
        for x in ask(shards, row.block, keys, np.zeros(len(keys))):
            here = slice(done, done := done + len(unpack(x["counts"], np.uint32)))
            out.append(x | {"kind": 1, "least": pack(least[here]), "most": pack(most[here])})
        return out

    asked = mapped(left.select("block", "choices", "kinds", "checks"), passages, PASSAGES)
    answers = written(asked.groupBy("shard").applyInPandas(_answer, ANSWER), "passages")
    pair = F.struct("found", "checks")
    of_block = answers.groupBy("block").agg(*[F.collect_list(F.when(F.col("kind") == k, pair if k < 2 else F.col("found"))).alias(f"found{k}") for k in range(3)])
    left = left.join(of_block, "block", "left")

    def looked_at(row, p: _Passages) -> tuple[np.ndarray, np.ndarray]:
        """Passages that are repeated as a whole, and those whose windows are merged one by one."""
        whole, mine = pairs_in(p.kinds, p.checks, row.found0), pairs_in(p.kinds, p.checks, row.found1)
        if mine.any():  # one of each kind
            at = np.flatnonzero(mine)
            mine = np.zeros(len(p.kinds), bool)
            mine[at[np.unique(groups_of_pairs(p.kinds[at], p.checks[at]), return_index=True)[1]]] = True
        return whole, is_in(p.choices, keys_of(row.found2)) & (mine | ~whole)

    def sorted_windows(row) -> list[dict]:
        p = _Passages(row)
        starts = p.starts(looked_at(row, p)[1])
        if not len(starts):
            return []
        group, _ = window_groups(p.b.raw, starts, length)
        one = np.empty(group.max() + 1, np.int64)
        one[group] = starts  # one of each group
        keys, checks = window_keys(p.b.raw, one, length)
        return ask_pairs(shards, p.b.block, keys[group], checks[group])

    found = repeated_pairs(mapped(left, sorted_windows, ASK_PAIRS))

    def finish(row) -> list[dict]:
        p = _Passages(row)
        b, n, out = p.b, len(p.b.raw), []
        whole, looked = looked_at(row, p)
        starts = p.starts(looked)
        hit = starts[pairs_in(*window_keys(p.b.raw, starts, length), row.found)] if len(starts) else starts
        gone = covered(np.concatenate([np.flatnonzero(_flags(row.settled, n)), p.starts(whole), hit]), length, n)
        seen = _flags(row.short, n) | gone
        for i, doc_id in enumerate(b.ids):
            here, text = gone[b.at[i] : b.at[i + 1]], b.raw[b.at[i] : b.at[i + 1]]
            spans = int(here[0]) + int((here[1:] & ~here[:-1]).sum()) if len(here) else 0
            out.append({"doc_id": doc_id, "n_bytes": len(text), "n_removed": int(here.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(text[~here].tobytes()).hexdigest(), "n_repeated": int(seen[b.at[i] : b.at[i + 1]].sum())})
        return out

    return done.unionByName(mapped(left.join(found, "block", "left"), finish, RESULT))

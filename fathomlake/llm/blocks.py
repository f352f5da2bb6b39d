"""Blocks of documents, and questions that blocks put to all other blocks.

A block is a few megabytes of documents as one row: ids, and texts end to end, compressed. A block asks about 64-bit
keys: it sends each distinct key once, with a count, to the shard that the key belongs to; the shard answers every
block. However often a key occurs, a shard gets one entry for each block that holds it, so no key makes a hot task.
Both directions are Spark shuffles of compact rows, and every step starts from written tables, so that a lost executor
costs only its own tasks.

Memory: a task holds one block, or one shard's keys, at a time; a document longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, text_arrays, texts_of, written

BLOCK = "block long, ids array<long>, block_bytes long, lens binary, data binary"
ASK = "shard int, block long, keys binary, counts binary"
FOUND = "block long, found binary"
#: Questions about keys of 128 bits: a second number beside each key.
ASK_PAIRS, FOUND_PAIRS = f"{ASK}, checks binary", f"{FOUND}, checks binary"
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def squeeze(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def unsqueeze(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as planes of bytes, so that bytes that are mostly zero take no room."""
    return np.uint64(len(x)).tobytes() + squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(x: bytes, kind: type = np.uint64) -> np.ndarray:
    n = int(np.frombuffer(x[:8], np.uint64)[0])
    return np.ascontiguousarray(np.frombuffer(unsqueeze(x[8:]), np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unpack(x), dtype=np.uint64)


@dataclass
class Block:
    block: int
    ids: list
    raw: np.ndarray  # UTF-8 bytes of all texts
    at: np.ndarray  # where texts start, and the end


def as_row(block: int, ids: list, raw: np.ndarray, at: np.ndarray) -> dict:
    return {"block": block, "ids": ids, "block_bytes": len(raw), "lens": pack(np.diff(at).astype(np.uint64)), "data": squeeze(raw.tobytes())}


def load(row) -> Block:
    at = np.append(0, np.cumsum(unpack(row.lens).astype(np.int64)))
    return Block(row.block, list(row.ids), np.frombuffer(unsqueeze(row.data), np.uint8), at)


def _make(size: int, schema: str, more: Callable[[Block], tuple[dict, list[dict]]] | None) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw, at = text_arrays(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(size, max(int(at[-1]), 1), size)), [len(ids)]]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                b = Block(block, ids[i:j], raw[at[i] : at[j]], at[i : j + 1] - at[i])
                fields, rows = more(b) if more else ({}, [])
                yield pa.RecordBatch.from_pylist([as_row(b.block, b.ids, b.raw, b.at) | fields, *rows], arrow_schema(schema))
                block += 1
                release()

    return make


def blocks(docs: DataFrame, size: int = 4 << 20, schema: str = BLOCK, more: Callable[[Block], tuple[dict, list[dict]]] | None = None) -> DataFrame:
    """The documents in blocks of about so many bytes, written once: block numbers stay as they are. more: from a block
    to further fields of its row, and to rows of other columns that are written with it."""
    return written(texts_of(docs).mapInArrow(_make(size, schema, more), schema), "blocks")


def ask(shards: int, block: int, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Rows of ASK for sorted distinct keys: shard k has the k-th part of the range of keys."""
    if not len(keys):
        return []
    of = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(keys)]])
    return [{"shard": int(of[i]), "block": block, "keys": pack_sorted(keys[i:j]), "counts": pack(counts[i:j].astype(np.uint32))} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def merge(lists: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys of sorted lists in one sorted list, their sums of counts, and each list's places in it by binary search."""
    merged = np.unique(np.concatenate(lists))
    places = [np.searchsorted(merged, x) for x in lists]
    totals = np.zeros(len(merged), np.int64)
    for at, n in zip(places, counts, strict=True):
        totals[at] += n
    return merged, totals, places


def _repeated(asked: pd.DataFrame) -> pd.DataFrame:
    release()
    lists = [unpack_sorted(x) for x in asked["keys"]]
    _, totals, places = merge(lists, [unpack(x, np.uint32) for x in asked["counts"]])
    found = [keys[totals[at] > 1] for keys, at in zip(lists, places, strict=True)]
    return pd.DataFrame([{"block": b, "found": pack_sorted(x)} for b, x in zip(asked["block"], found, strict=True) if len(x)], columns=["block", "found"])


def repeated(asked: DataFrame) -> DataFrame:
    """Of the keys that blocks ask about, with how often each has them, those that occur more than once anywhere:
    one row for each block that has any, with a list of packed keys."""
    return gathered(asked.groupBy("shard").applyInPandas(_repeated, FOUND))


def gathered(found: DataFrame, name: str = "found") -> DataFrame:
    return found.groupBy("block").agg(F.collect_list("found").alias(name))


def keys_of(found) -> np.ndarray:
    return np.sort(np.concatenate([unpack_sorted(x) for x in found])) if found is not None and len(found) else np.zeros(0, np.uint64)


def ask_pairs(shards: int, block: int, keys: np.ndarray, checks: np.ndarray) -> list[dict]:
    """Rows of ASK_PAIRS for keys and their second numbers, in any order, each pair with its count."""
    if not len(keys):
        return []
    order = np.lexsort((checks, keys))
    keys, checks = keys[order], checks[order]
    at = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(checks, prepend=~checks[:1]) != 0))
    out, done = ask(shards, block, keys[at], np.diff(at, append=len(keys))), 0
    for x in out:
        n = int(np.frombuffer(x["keys"][:8], np.uint64)[0])
        x["checks"] = pack(checks[at[done : done + n]])
        done += n
    return out


def groups_of_pairs(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """For each pair the number, from 0, of its group of equal ones."""
    order = np.lexsort((check, key))
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum((np.diff(key[order], prepend=key[order[:1]]) != 0) | (np.diff(check[order], prepend=check[order[:1]]) != 0))
    return group


def _repeated_pairs(asked: pd.DataFrame) -> pd.DataFrame:
    release()
    lists, checks = [unpack_sorted(x) for x in asked["keys"]], [unpack(x) for x in asked["checks"]]
    key, check, n = np.concatenate(lists), np.concatenate(checks), np.concatenate([unpack(x, np.uint32) for x in asked["counts"]]).astype(np.int64)
    group = groups_of_pairs(key, check)
    hit, out, done = np.bincount(group, n)[group] > 1, [], 0
    for b, keys, own in zip(asked["block"], lists, checks, strict=True):
        here = hit[done : done + len(keys)]
        done += len(keys)
        if here.any():
            out.append({"block": b, "found": pack_sorted(keys[here]), "checks": pack(own[here])})
    return pd.DataFrame(out, columns=["block", "found", "checks"])


def repeated_pairs(asked: DataFrame) -> DataFrame:
    """As repeated, of keys with second numbers: one row for each block that has any, with a list of (found, checks)."""
    found = asked.groupBy("shard").applyInPandas(_repeated_pairs, FOUND_PAIRS)
    return found.groupBy("block").agg(F.collect_list(F.struct("found", "checks")).alias("found"))


def pairs_in(keys: np.ndarray, checks: np.ndarray, found) -> np.ndarray:
    """Whether each key with its second number is among those found."""
    out = np.zeros(len(keys), bool)
    if found is None or not len(found):
        return out
    key, check = np.concatenate([unpack_sorted(x["found"]) for x in found]), np.concatenate([unpack(x["checks"]) for x in found])
    order = np.argsort(key, kind="stable")
    key, check = key[order], check[order]
    at, left = np.searchsorted(key, keys), np.arange(len(keys))
    while len(left):  # as often as one key has several second numbers
        left = left[at[left] < len(key)]
        left = left[key[at[left]] == keys[left]]
        out[left] |= check[at[left]] == checks[left]
        at[left] += 1
    return out


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn, from a row to a list of dicts, over rows one at a time, so that only one block is unpacked at once."""
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = SimpleNamespace(**batch.slice(i, 1).to_pylist()[0])
                if out := fn(row):
                    yield pa.RecordBatch.from_pylist(out, out_schema)
                del row, out
                release()

    return df.mapInArrow(run, schema)


# Hashes over arrays.

_ODD, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX2)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a span beyond which it is hashed by the library alone.
LONG_SPAN = 256


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))


_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _chunks(starts: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Which spans have a k-th piece of eight bytes, and k: those that are not long."""
    on, k = np.flatnonzero((lens > 0) & (lens <= LONG_SPAN)), 0
    while len(on):
        yield on, k
        k += 1
        on = on[lens[on] > 8 * k]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a chain of mixing steps over its pieces of eight bytes, none of them linear. Spans
    of one length up to eight bytes have distinct ones. Spans of one hash may differ: see distinct_spans."""
    lens, eights = ends - starts, _eights(raw)
    out = np.zeros(len(starts), np.uint64)
    for on, k in _chunks(starts, lens):
        piece = eights[starts[on] + 8 * k] & _FIRST[np.minimum(lens[on] - 8 * k, 8)]
        out[on] = mix((out[on] ^ piece) + np.uint64(_ODD))
    for i in np.flatnonzero(lens > LONG_SPAN).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out + lens.astype(np.uint64) * np.uint64(_MIX1))


def _same(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> bool:
    """Whether each span has the very bytes of another one."""
    lens, eights = ends - starts, _eights(raw)
    if (lens != lens[of]).any():
        return False
    for on, k in _chunks(starts, lens):
        if ((eights[starts[on] + 8 * k] ^ eights[starts[of[on]] + 8 * k]) & _FIRST[np.minimum(lens[on] - 8 * k, 8)]).any():
            return False
    return all(np.array_equal(raw[starts[i] : ends[i]], raw[starts[of[i]] : ends[of[i]]]) for i in np.flatnonzero(lens > LONG_SPAN).tolist())


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct spans the first ones and their hashes, in order of hash; and each span's number among them. Spans are
    grouped by hash and then compared byte by byte; should two of one hash differ, all are told apart by their bytes."""
    keys, first, number = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    if not _same(raw, starts, ends, first[number]):
        text, seen = raw.tobytes(), {}
        order = np.argsort(number, kind="stable")
        found = np.empty(len(starts), np.int64)
        for i in order.tolist():
            found[i] = seen.setdefault(text[starts[i] : ends[i]], len(seen))
        _, first, number = np.unique(found, return_index=True, return_inverse=True)
        keys = span_hashes(raw, starts[first], ends[first])
    return first, number, keys


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each span, a column each, by which spans of all blocks are told apart: BLAKE2 of 128 bits of
    each distinct span, so that nobody can make two words that share one."""
    first, number, _ = distinct_spans(raw, starts, ends)
    text = raw.tobytes()
    digests = b"".join([blake2b(text[i:j], digest_size=16).digest() for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[number]


def word_spans(raw: np.ndarray, at: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, ASCII if not given, and where each text's words start, and the end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[raw] if space is None else space
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before, after = edge.copy(), edge.copy()
    before[1:] |= space
    after[:-1] |= space
    starts = np.flatnonzero(~space & before[:-1])
    ends = np.flatnonzero(~space & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def unicode_spaces(raw: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes belong to Unicode white space."""
    out = SPACE[raw]
    lead = np.flatnonzero(_LEAD[raw])
    if len(lead):
        longer = np.append(raw, np.zeros(2, np.uint8))
        a, b, c = raw[lead], longer[lead + 1], longer[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE2) & (((b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        three |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        for at, n in ((lead[two], 2), (lead[three], 3)):
            for k in range(n):
                out[at + k] = True
    return out


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n neighbouring units, by doubling."""
    size, out = 1, hashes
    while 2 * size <= n:
        out = mix(out[:-size] * np.uint64(_ODD) + out[size:]) if len(out) > size else out[:0]
        size *= 2
    if size < n:
        more = n - size
        out = mix(out[:-more] * np.uint64(_ODD) + out[more:] + np.uint64(n)) if len(out) > more else out[:0]
    return out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many neighbouring hashes the place of the one whose upper half is least, the last of them at
    ties: a choice by content alone, so that equal windows have it at the same offset."""
    place = np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | place
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: size - width], least[width - size :])
    return (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def inside(at: np.ndarray, n: int) -> np.ndarray:
    """Whether a window of n units that starts at a unit lies in one text; at: where each text's units start, and the end."""
    ok = np.zeros(int(at[-1]) + 1, np.int8)
    long = np.diff(at) >= n
    np.add.at(ok, at[:-1][long], 1)
    np.add.at(ok, at[1:][long] - n + 1, -1)
    return np.cumsum(ok, dtype=np.int8)[:-1].astype(bool)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n units a window of so many units covers that starts at one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step)[:n] > 0


def is_in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each is one of the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x

"""Packing by concatenate and cut: two passes of prefix sums, then fixed windows.

First pass: each task encodes its documents and writes, with the ids, each document's place among the tokens of its
part (a running sum) and, as the last of them, the part's total. The totals, one row for each part, are summed up over
the parts before. Second pass: a document's global offset is its part's offset and its place there; windows of a fixed
length cut it, and a piece that ends or begins at a window's edge inside a document is marked as a boundary record.
Every sequence but the last is full.

Cases: a null or empty text is just its end token; a document longer than a sequence is cut into several pieces;
repeated rows are packed as often as they are there, in the order in which their part has them, and ties do not arise; a null
doc_id is a document like others; an empty table gives no pieces; columns other than doc_id and text are not read, whatever
they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, text_arrays, texts_of, written
from .tokens import encode_words, tokenizer

LENGTH, END = 2048, 1
#: Parts whose sums may be broadcast: 16 bytes each.
BROADCAST_PARTS = 1_000_000
ENCODED = "doc_id long, part int, place long, n_tokens long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def _kind(path: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() < 65536 else "<u4")


def _encode(path: str, end: int, size: int = 4 << 20) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, close = TaskContext.get().partitionId(), 0, np.array([end], _kind(path)).tobytes()
        for batch in batches:
            raw, at = text_arrays(batch.column("text"))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(size, max(int(at[-1]), 1), size)), [len(batch)]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids, ends = encode_words(path, raw[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.diff(ends) + 1
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                each = [ids[a:b].tobytes() + close for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                release()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(places), pa.array(n), pa.array(each, pa.binary())], ["doc_id", "part", "place", "n_tokens", "ids"])

    return encode


def _cut(path: str, length: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary")}
            for doc_id, n, at, ids in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n_tokens", "at", "ids")), strict=True):
                four = np.frombuffer(ids, kind).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    for k, x in zip(out, (doc_id, start, size, zlib.crc32(four[4 * start : 4 * (start + size)]), n, sequence, offset, size < n), strict=True):
                        out[k].append(x)
                    start += size
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.bool_() if k == "boundary" else pa.int64()) for k in out]))

    return cut


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """The first pass, written: ids of each document with its end token, and its place among the tokens of its part."""
    return written(texts_of(docs).mapInArrow(_encode(path, end), ENCODED), "encoded")


def placed(tokens: DataFrame) -> DataFrame:
    """Adds `at`, the tokens before a document: those of the parts before its own, and its place."""
    totals = tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n_tokens")).alias("total"))
    # One row for each part: a thousand parts are a few kilobytes. They are summed in groups of parts, then the groups.
    totals = totals.withColumn("bunch", F.floor(F.col("part") / 1000))
    bunches = totals.groupBy("bunch").agg(F.sum("total").alias("sum"))
    bunches = bunches.select("bunch", (F.sum("sum").over(Window.orderBy("bunch")) - F.col("sum")).alias("bunch_before"))
    within = F.sum("total").over(Window.partitionBy("bunch").orderBy("part")) - F.col("total")
    before = totals.withColumn("within", within).join(bunches, "bunch").select("part", (F.col("within") + F.col("bunch_before")).alias("before"))
    # Parts are numbered from 0: the last number bounds the rows.
    few = (tokens.agg(F.max("part")).first()[0] or 0) < BROADCAST_PARTS
    return tokens.join(F.broadcast(before) if few else before, "part").withColumn("at", F.col("before") + F.col("place"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary."""
    return placed(encoded(docs, path, end)).select("doc_id", "n_tokens", "at", "ids").mapInArrow(_cut(path, length), PIECE)


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The packed ids themselves: sequence_id and token_ids, by one shuffle of pieces on sequence_id. A sequence is at
    most `length` tokens, so no group is large. The last one is shorter."""
    tokens = placed(encoded(docs, path, end))

    def pieces(batches):
        kind = _kind(path)
        for batch in batches:
            out = []
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x, start = np.frombuffer(ids, kind).astype(np.int32), 0
                while start < len(x):
                    sequence, offset = divmod(at + start, length)
                    out.append((sequence, offset, x[start : start + length - offset].tolist()))
                    start += len(out[-1][2])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    cut = tokens.select("at", "ids").mapInArrow(pieces, "sequence_id long, offset long, ids array<int>")
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("token_ids"))

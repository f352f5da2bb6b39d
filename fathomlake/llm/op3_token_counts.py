"""Token counts: pieces counted once per distinct pre-token, joined to the documents' pre-token frequencies.

A pre-token is a run of white space with the run of other characters after it. The tokenizer's own pre-tokens never go
from a character into white space behind it, and neither do its special strings, so a text's tokens are those of its
pre-tokens. Each task writes, for a block of documents, the frequencies of pre-tokens in each document (numbers into the
block's list of distinct ones) and the list itself, dealt into shards by hash. A shard has the library count the pieces
of each distinct pre-token once and answers every block; with the answers a block's frequencies are summed. No ids are
kept, and a pre-token that all documents hold is one entry for each block.

Cases: null and empty texts have 0 tokens; texts without white space are one pre-token, and a very long text is a block of its
own; repeated rows count each; ties do not arise; a null doc_id is a document like others; an empty table gives an empty one;
other columns are not read, whatever they are called. Pre-tokens are told apart by their bytes, in a block and in a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import arrow_schema, distinct_spans, mapped, pack, squeeze, unicode_spaces, unpack, unsqueeze
from .common import release, shards_for, text_arrays, texts_of, written
from .tokens import count_pieces

LIMIT = 1024
#: Strings that a shard gets, about: it holds them in memory, at some 150 bytes each.
KEYS_EACH = 1_000_000
ROW = "block long, shard int, n_keys int, lens binary, strings binary, ids array<long>, sizes binary, held binary, numbers binary, times binary"
ANSWER = "block long, shard int, pieces binary"
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _frequencies(size: int, shards: int) -> Callable:
    def block_rows(block: int, ids: list, raw: np.ndarray, at: np.ndarray) -> Iterator[dict]:
        if len(raw):
            space = unicode_spaces(raw)
            begins = np.append(True, space[1:] & ~space[:-1])
            begins[at[:-1][at[:-1] < len(raw)]] = True
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], len(raw))
            first, number, keys = distinct_spans(raw, starts, ends)
            doc = np.searchsorted(at, starts, "right") - 1
        else:
            starts = ends = first = number = doc = np.zeros(0, np.int64)
            keys = np.zeros(0, np.uint64)
        held, times = np.unique(doc * np.int64(len(keys) + 1) + number, return_counts=True)
        of, number = np.divmod(held, len(keys) + 1)
        per_doc = np.bincount(of, minlength=len(ids))
        step = np.diff(number, prepend=0)
        new = np.flatnonzero(np.diff(of, prepend=-1))
        step[new] = number[new]
        yield {"block": block, "ids": ids, "sizes": pack(np.diff(at).astype(np.uint64)), "held": pack(per_doc.astype(np.uint32)), "numbers": pack(step.astype(np.uint32)), "times": pack(times.astype(np.uint32))}
        text = raw.tobytes()
        # Of equal hashes, should there be any, each string is its own key.
        shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(keys)]]) if len(keys) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            some = [text[a:b] for a, b in zip(starts[first[i:j]], ends[first[i:j]], strict=True)]
            yield {"block": block, "shard": int(shard[i]), "n_keys": int(j - i), "lens": pack(np.array([len(x) for x in some], np.uint32)), "strings": squeeze(b"".join(some))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema = TaskContext.get().partitionId() << 33, arrow_schema(ROW)
        for batch in batches:
            raw, at = text_arrays(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(size, max(int(at[-1]), 1), size)), [len(ids)]]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield pa.RecordBatch.from_pylist(list(block_rows(block, ids[i:j], raw[at[i] : at[j]], at[i : j + 1] - at[i])), schema)
                block += 1
                release()

    return run


def _count(path: str) -> Callable:
    def count(asked: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for lens, strings in zip(asked["lens"], asked["strings"], strict=True):
            at, text = np.append(0, np.cumsum(unpack(lens, np.uint32), dtype=np.int64)).tolist(), unsqueeze(strings)
            lists.append([text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
        distinct = list({x for some in lists for x in some})
        pieces: dict[bytes, int] = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            pieces.update(zip(some, count_pieces(path, [x.decode() for x in some]).tolist(), strict=True))
        return pd.DataFrame({"block": asked["block"], "shard": asked["shard"], "pieces": [pack(np.array([pieces[x] for x in some], np.uint32)) for some in lists]})

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, block_bytes: int = 4 << 20, keys_each: int = KEYS_EACH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    # A shard keeps its strings in memory: their number follows the bytes of all texts.
    n_bytes = texts_of(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = shards_for(spark, n_bytes / 12, keys_each)
    rows = written(texts_of(docs).mapInArrow(_frequencies(block_bytes, shards), ROW), "frequencies")
    asked = rows.where("shard IS NOT NULL").select("block", "shard", "lens", "strings")
    answers = asked.groupBy("shard").applyInPandas(_count(path), ANSWER)
    answers = answers.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "pieces"))), lambda x: x["pieces"]).alias("pieces"))

    def total(row) -> list[dict]:
        pieces = np.concatenate([np.zeros(0, np.int64), *(unpack(x, np.uint32) for x in row.pieces or [])]).astype(np.int64)
        held, step, times, sizes = unpack(row.held, np.uint32).astype(np.int64), unpack(row.numbers, np.uint32).astype(np.int64), unpack(row.times, np.uint32), unpack(row.sizes)
        ends = np.cumsum(held)
        run = np.cumsum(step)
        before = np.append(0, run)[ends - held]  # what earlier documents' steps added up to
        numbers = run - np.repeat(before, held)
        sums = np.append(0, np.cumsum(pieces[numbers] * times))
        n = sums[ends] - sums[ends - held]
        return [{"doc_id": i, "n_bytes": int(b), "n_tokens": int(t), "over_limit": bool(t > limit)} for i, b, t in zip(row.ids, sizes, n, strict=True)]

    return mapped(rows.where("shard IS NULL").select("block", "ids", "sizes", "held", "numbers", "times").join(answers, "block", "left"), total, RESULT)

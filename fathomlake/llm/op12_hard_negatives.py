"""Hard negatives by blocked matrix products.

1. Rows that take part go into blocks of some thousands, in order of id: components are floor(256 * x), kept in as few bytes
   as they need. Anchors are read out of the blocks and go into blocks of their own.
2. Blocks of anchors are broadcast, a bounded number of bytes at a time, and meet each block of candidates where it is
   read; a pair of blocks is one product in float64, which is exact while sums stay below 2 ** 53 (larger ones are
   multiplied as whole numbers). First pass: each pair leaves an anchor's first positives, which merge to its first of all.
3. Second pass: an anchor's block carries its positives' scores. A pair leaves for each positive the first rows of other
   labels whose scores lie in its window; these merge again. A pair of blocks leaves a bounded number of rows for each
   anchor, and Spark's ranking drops most of them before the shuffle.

The anchors are a stated query set that is held against all rows in blocks. Nothing goes to the driver but counts.

Cases: rows with a null label, a null vector or a null or non-finite component take no part; an empty vector has the score
0 with all; vectors of several lengths count as filled up with zeros; a null vec_id is no anchor and comes last at ties;
repeated rows are rows of their own, also as anchors (those of one id and score are equal in the result); scores beyond 64
bits are cut to them; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import arrow_schema
from .common import release, written

POSITIVES, NEGATIVES, LEAST_PERCENT = 5, 5, 80
#: Rows of a block of candidates and of anchors, at most; bytes of their vectors; bytes of anchors broadcast at a time.
ROWS, ANCHORS, BLOCK_BYTES, BROADCAST_BYTES = 4096, 1024, 1 << 20, 32 << 20
LAST, NONE = 2**63 - 1, -(2**63)
BLOCK = "block long, n int, dims int, kind string, ids binary, labels binary, data binary"
ANCHOR = "block long, place int, vec_id long, label long, kind string, data binary"
FOUND = "block long, place int, anchor_id long, nth int, positive_id long, positive_score long, id long, score long, at_block long, at_place int"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, and vectors of the rows that take part; the label of each seventh id is moved on."""
    vector, vec_id, label = F.col("embedding").cast("array<double>"), F.col("vec_id").cast("long"), F.col("label").cast("long")
    fit = label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fit).select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), vector.alias("v"))


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    top = np.abs(m).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _matrix(data: bytes, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64).reshape(n, -1)


def _pack(rows: int, block_bytes: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            lens = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            each = int(max(1, min(rows, block_bytes // (2 * max(1, lens.max(initial=1))))))
            for at in range(0, len(batch), each):
                part, size = batch.slice(at, each), lens[at : at + each]
                ids = part.column("vec_id").fill_null(LAST).to_numpy()
                order, dims = np.argsort(ids, kind="stable"), int(size.max())
                m = np.zeros((len(part), dims))
                m[np.arange(dims) < size[:, None]] = np.floor(256 * part.column("v").flatten().to_numpy(zero_copy_only=False))
                kind, data = _packed(m[order])
                row = {"block": block, "n": len(part), "dims": dims, "kind": kind, "ids": ids[order].tobytes(), "labels": part.column("label").to_numpy()[order].tobytes(), "data": data}
                yield pa.RecordBatch.from_pylist([row], arrow_schema(BLOCK))
                block += 1

    return pack


def _anchors(every: int) -> Callable:
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, labels, size = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64), len(b["data"]) // b["n"]
                some = np.flatnonzero((ids % every == 0) & (ids != LAST)).tolist()
                out = [{"block": b["block"], "place": i, "vec_id": int(ids[i]), "label": int(labels[i]), "kind": b["kind"], "data": b["data"][size * i : size * i + size]} for i in some]
                yield pa.RecordBatch.from_pylist(out, arrow_schema(ANCHOR))

    return anchors


def _grouped(anchors: DataFrame, groups: int) -> DataFrame:
    """Rows of anchors as blocks of bounded size; positives: a list of (nth, positive_id, positive_score) or nothing."""
    def group(part: pd.DataFrame) -> pd.DataFrame:
        vectors = [np.frombuffer(x, k).astype(np.float64) for x, k in zip(part["data"], part["kind"], strict=True)]
        m = np.zeros((len(part), max(map(len, vectors))))
        for row, v in zip(m, vectors, strict=True):
            row[: len(v)] = v
        kind, data = _packed(m)
        out = {"g": part["g"].iloc[:1], "a_n": len(part), "a_kind": kind, "a_data": data}
        out |= {f"a_{c}": part[c].to_numpy(np.int64).tobytes() for c in ("block", "place", "vec_id", "label")}
        if "positives" in part:
            lists = [[(x["nth"], x["positive_id"], x["positive_score"]) for x in some] for some in part["positives"]]
            out |= {"a_held": np.array([len(x) for x in lists]).tobytes(), "a_positives": np.array([y for x in lists for y in x], np.int64).tobytes()}
        return pd.DataFrame(out)

    schema = "g int, a_n int, a_kind string, a_data binary, " + ", ".join(f"a_{c} binary" for c in ("block", "place", "vec_id", "label"))
    schema += ", a_held binary, a_positives binary" if "positives" in anchors.columns else ""
    return anchors.withColumn("g", F.pmod(F.xxhash64("block", "place"), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(group, schema)


class _Pair:
    """The scores of a block of anchors with a block of candidates, in the candidates' order at ties."""

    def __init__(self, x: dict):
        self.ids, self.labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
        self.a_block, self.a_place, self.a_id, self.a_label = (np.frombuffer(x[f"a_{c}"], np.int64) for c in ("block", "place", "vec_id", "label"))
        c, a = _matrix(x["data"], x["kind"], x["n"]), _matrix(x["a_data"], x["a_kind"], x["a_n"])
        dims = min(a.shape[1], c.shape[1])
        a, c = a[:, :dims], c[:, :dims]
        self.n = len(c)
        if dims * np.abs(a).max(initial=0) * np.abs(c).max(initial=0) < 2**53:
            s = (a @ c.T).astype(np.int64)
        else:
            whole = np.vectorize(int, otypes=[object])
            s = np.clip(whole(a) @ whole(c).T, NONE + 1, LAST).astype(np.int64) if dims else np.zeros((len(a), self.n), np.int64)
        self.scores, self.small = s, int(np.abs(s).max(initial=0)) < 2**62 // (128 * self.n)

    def ranked(self, fit: np.ndarray) -> list[np.ndarray]:
        """For each anchor the candidates that fit, the last ones first."""
        n = self.n
        if self.small:  # score and place as one number
            keys = np.where(fit, self.scores * n + (n - 1 - np.arange(n)), NONE)
            keys.sort(axis=1)
            none = n - fit.sum(axis=1)
            return [n - 1 - row[k:] % n for row, k in zip(keys, none.tolist(), strict=True)]
        order = np.argsort(-self.scores, axis=1, kind="stable")[:, ::-1]
        return [row[ok[row]] for row, ok in zip(order, fit, strict=True)]

    def batch(self, block: int, a: list, nth: list, positive: list, score: list, at: list) -> pa.RecordBatch:
        a, at = np.array(a, np.int64), np.array(at, np.int64)
        columns = [self.a_block[a], self.a_place[a].astype(np.int32), self.a_id[a], np.array(nth, np.int32), np.array(positive, np.int64), np.array(score, np.int64), self.ids[at], self.scores[a, at], np.full(len(a), block), at.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow_schema(FOUND))


def _positives(k: int) -> Callable:
    def find(x: dict) -> pa.RecordBatch:
        p = _Pair(x)
        fit = p.labels == p.a_label[:, None]
        here = np.flatnonzero(p.a_block == x["block"])
        fit[here, p.a_place[here]] = False  # the anchor itself
        found = [row[-k:] for row in p.ranked(fit)]
        a = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return p.batch(x["block"], a, [0] * len(a), [0] * len(a), [0] * len(a), np.concatenate([*found, np.zeros(0, np.int64)]))

    return find


def _negatives(k: int, percent: int) -> Callable:
    def find(x: dict) -> pa.RecordBatch:
        p, out = _Pair(x), ([], [], [], [], [])
        held, positives = np.frombuffer(x["a_held"], np.int64).tolist(), np.frombuffer(x["a_positives"], np.int64).reshape(-1, 3).tolist()
        begin = 0
        for i, (row, n) in enumerate(zip(p.ranked(p.labels != p.a_label[:, None]), held, strict=True)):
            scores = p.scores[i, row]  # from the least
            for nth, positive, score in positives[begin : begin + n]:
                end = int(np.searchsorted(scores, score, "right"))
                for j in range(end - 1, max(-1, end - 1 - k), -1):
                    if 100 * int(scores[j]) < percent * score:
                        break
                    for y, values in zip((i, nth, positive, score, row[j]), out, strict=True):
                        values.append(y)
            begin += n
        return p.batch(x["block"], *out)

    return find


def _met(blocks: DataFrame, groups: DataFrame, n_groups: int, at_once: int, find: Callable, name: str) -> DataFrame:
    """What every block of candidates finds with every block of anchors; so many of these are broadcast at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                yield find(batch.slice(i, 1).to_pylist()[0])
                release()

    parts = []
    for first in range(0, n_groups, at_once):
        some = list(range(first, min(first + at_once, n_groups)))
        # A broadcast of bounded bytes; each pair of blocks is a row, and few rows at a time go to Python.
        met = blocks.withColumn("g", F.explode(F.array(*[F.lit(g) for g in some]))).join(F.broadcast(groups.where(F.col("g").isin(some))), "g").drop("g")
        parts.append(written(met.mapInArrow(run, FOUND), name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k by score, then by id, nulls last."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "at_block", "at_place")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, percent: int = LEAST_PERCENT, block_rows: int = ROWS, anchor_rows: int = ANCHORS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by
    `every`) and each of its first positives the first rows of other labels with at least so many per cent of its score,
    and no more than it."""
    blocks = written(usable(rows).mapInArrow(_pack(block_rows, BLOCK_BYTES), BLOCK), "vectors")
    anchors = written(blocks.mapInArrow(_anchors(every), ANCHOR), "anchors")
    n, most = anchors.agg(F.count("*"), F.max(F.length("data"))).first()
    size = max(8, 4 * (most or 0))  # bytes of an anchor in a block: kinds may widen from two to eight
    groups = max(1, -(-n // max(1, min(anchor_rows, BLOCK_BYTES // size))))
    at_once = max(1, broadcast_bytes // (min(anchor_rows * size, BLOCK_BYTES) * 2))
    of_anchor = ["block", "place"]
    first = _first(_met(blocks, written(_grouped(anchors, groups), "anchor_blocks"), groups, at_once, _positives(positives), "positives"), of_anchor, positives)
    lists = first.groupBy(*of_anchor).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("positives"))
    asked = written(_grouped(anchors.join(lists, of_anchor), groups), "anchor_blocks")
    found = _first(_met(blocks, asked, groups, at_once, _negatives(negatives, percent), "negatives"), [*of_anchor, "nth"], negatives)
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return found.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS k FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST_PERCENT} * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= {NEGATIVES}
"""

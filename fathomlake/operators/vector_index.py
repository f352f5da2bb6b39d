"""An inverted file of vectors: cells, residual codes, exact re-ranking.

Cells are k-means centres of a bounded sample. Every vector goes into the block of its cell as what it differs from the
centre by, in one byte a dimension, beside the exact vector in a column of its own. A search reads the codes of the cells
nearest to a query, ranks by them, and compares exactly only the best `rerank` of these: exact vectors are read for those
blocks alone that hold one. How many cells a search looks into is measured when the index is fitted: as many as hold the
wanted share of true neighbours of a sample of vectors. Where vectors form clusters these are few; where they spread
evenly in many dimensions no cell can be left out, and the codes are what saves work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..sources import staged
from .dense import doubles, knn
from .ranking import small, top_k

#: Vectors that cells are fitted on, and of them those whose neighbours set the number of cells to look into.
SAMPLE, ASKED = 50_000, 200
#: Cells at most; vectors in a block, and queries in one, at most; bytes of query blocks that are broadcast.
MAX_CELLS, ROWS, QUERIES, BROADCAST_BYTES = 4096, 4096, 1024, 64 << 20
SEED = 11
CODED = "cell int, id long, scale double, code binary, v binary"
BLOCK = "cell int, block long, ids binary, scales binary, codes binary, vectors binary"
HIT = "qid long, id long, cell int, block long, place int, near double"


@dataclass(frozen=True)
class VectorIndex:
    """centers: cells by dimensions, a bounded array; probes: cells to look into; blocks: the written table."""

    centers: np.ndarray
    probes: int
    blocks: DataFrame


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _unit(batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1))


def _cell_order(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """For each vector a number for each cell, least for the nearest one; an index of nothing has one cell."""
    if not centers.shape[1]:
        return np.zeros((len(v), 1))
    return (centers * centers).sum(axis=1) / 2 - v @ centers.T


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, share: float = 0.95, k: int = SETTINGS.dense_k) -> tuple[np.ndarray, int]:
    """Centres, and how many cells hold so large a share of the true neighbours, by a sample of vectors (id, v) with a length.

    The sample is chosen by a hash of the id, so that fitting again gives the same cells."""
    n = vectors.count()
    place = F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(n, 1)))
    some = staged(vectors.where(place < sample), "vector_sample")
    n_some = some.count()
    if not n_some:
        return np.zeros((1, 0)), 1
    length = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    # Centres start from distinct vectors, however often one is there.
    unit = some.select(F.transform("v", lambda x: x / F.greatest(length, F.lit(1e-300))).alias("u")).distinct()
    n_unit = unit.count()
    if n_unit < 2:
        return np.array([unit.first()["u"]]), 1
    cells = max(2, min(cells or int(4 * np.sqrt(n_some)) + 1, MAX_CELLS, n_unit))
    centers = np.array(KMeans(k=cells, featuresCol="x", initMode="random", maxIter=10, seed=SEED).fit(unit.select(array_to_vector("u").alias("x"))).clusterCenters())
    # A bounded number of sampled queries and their neighbours in the sample.
    asked = some.orderBy(F.xxhash64("id", F.lit(SEED + 1)), "id").limit(ASKED)
    hits = knn(asked.select(F.col("id").alias("qid"), F.col("v").alias("q")), some.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("row_id"), F.lit("").alias("view"), "v"), k=k)
    near = hits.join(some.select(F.col("id").alias("vec_id"), F.col("v").alias("b")), "vec_id").join(asked.select(F.col("id").alias("qid"), F.col("v").alias("a")), "qid").select("a", "b").toPandas()
    if not len(near):
        return centers, len(centers)
    a, b = (_unit(np.stack(near[c].to_numpy())) for c in "ab")
    order, cell = _cell_order(a, centers), _cell_order(b, centers).argmin(axis=1)
    ranks = (order < order[np.arange(len(cell)), cell][:, None]).sum(axis=1)
    return centers, int(np.quantile(ranks, share, method="higher")) + 1


def build(vectors: DataFrame, fitted: tuple[np.ndarray, int] | None = None, rows: int = ROWS) -> VectorIndex:
    """The index over all vectors (id, v) that are there and not empty; a vector of no length is near nothing."""
    vectors = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)).select(F.col("id").cast("long").alias("id"), doubles(F.col("v")).alias("v"))
    centers, probes = fitted or fit(vectors)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                v = _rows(part, "v")
                cell = _cell_order(v, centers).argmin(axis=1)
                rest = v - centers[cell]
                scale = np.maximum(np.abs(rest).max(axis=1), 1e-300) / 127
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column("id"), pa.array(scale), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], ["cell", "id", "scale", "code", "v"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of a cell as one; a batch may end within a cell, which then has one block more."""
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.unique(np.concatenate([[0, len(cell)], np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), rows)]))
            parts = [batch.slice(i, j - i) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            join = lambda p, c: b"".join(p.column(c).to_pylist())
            columns = [[int(cell[i]) for i in cuts[:-1]], [p.column("id")[0].as_py() for p in parts], [p.column("id").to_numpy().tobytes() for p in parts], [p.column("scale").to_numpy().tobytes() for p in parts], [join(p, "code") for p in parts], [join(p, "v") for p in parts]]
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

    # A cell that very many vectors have goes on over several ranges, as its ids are in the order too.
    order = ["cell", "id"]
    blocks = vectors.mapInArrow(code, CODED).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(block, BLOCK)
    return VectorIndex(centers, probes, staged(blocks, "vector_index"))


def search(queries: DataFrame, index: VectorIndex, k: int = SETTINGS.dense_k, rerank: int | None = None, probes: int | None = None, s: Settings = SETTINGS) -> DataFrame:
    """qid, vec_id, similarity, pos of queries (qid, q): their nearest vectors in the cells looked into, itself left out."""
    rerank, probes, centers = rerank or 5 * k, min(probes or index.probes, len(index.centers)), index.centers
    queries = queries.where(F.col("q").isNotNull() & (F.size("q") > 0)).select(F.col("qid").cast("long").alias("qid"), doubles(F.col("q")).alias("q"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                q = _rows(part, "q")
                order = _cell_order(q, centers)
                near = np.argpartition(order, probes - 1, axis=1)[:, :probes]
                qids = np.repeat(part.column("qid").to_numpy(), probes)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(qids), pa.array([x for row in q for x in [row.tobytes()] * probes], pa.binary())], ["cell", "qid", "q"])

    n = queries.count()
    groups = -(-max(n, 1) // QUERIES)

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "qids": [part["qid"].to_numpy(np.int64).tobytes()], "qs": [b"".join(part["q"])]})

    chosen = queries.mapInArrow(choose, "cell int, qid long, q binary").withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(groups)))
    asked = chosen.groupBy("cell", "part").applyInPandas(gather, "cell int, qids binary, qs binary")
    asked = F.broadcast(asked) if n * probes * 8 * (centers.shape[1] + 1) <= BROADCAST_BYTES else asked

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, qids, scales = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["qids"], np.int64), np.frombuffer(x["scales"])
                codes, q = np.frombuffer(x["codes"], np.int8).reshape(len(ids), -1).astype(np.float32), np.frombuffer(x["qs"]).reshape(len(qids), -1)
                near = (codes @ q.T.astype(np.float32)).astype(np.float64) * scales[:, None] + q @ centers[x["cell"]]
                near[ids[:, None] == qids] = -np.inf
                m = min(rerank, len(ids))
                rows = np.argpartition(-near, m - 1, axis=0)[:m]
                cols = np.broadcast_to(np.arange(len(qids)), rows.shape)
                ok = near[rows, cols] > -np.inf
                rows, cols = rows[ok], cols[ok]
                yield pa.RecordBatch.from_arrays([pa.array(qids[cols]), pa.array(ids[rows]), pa.array(np.full(len(rows), x["cell"], np.int32)), pa.array(np.full(len(rows), x["block"])), pa.array(rows.astype(np.int32)), pa.array(near[rows, cols])], ["qid", "id", "cell", "block", "place", "near"])

    found = index.blocks.select("cell", "block", "ids", "scales", "codes").join(asked, "cell").mapInArrow(rank, HIT)
    best = top_k(found, "qid", [F.desc("near"), F.col("id")], rerank)
    # The exact vectors of the blocks that hold one of the best.
    held = staged(best.join(small(queries), "qid").groupBy("cell", "block").agg(F.collect_list(F.struct("qid", "id", "place", "q")).alias("asked")), "candidates")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q = _unit(np.array([a["q"] for a in x["asked"]]))
                place = [a["place"] for a in x["asked"]]
                v = np.frombuffer(x["vectors"]).reshape(-1, q.shape[1])[place]
                yield pa.RecordBatch.from_arrays([pa.array([a["qid"] for a in x["asked"]]), pa.array([a["id"] for a in x["asked"]]), pa.array(np.maximum((q * v).sum(axis=1), 0.0))], ["qid", "vec_id", "similarity"])

    exact = index.blocks.select("cell", "block", "vectors").join(small(held), ["cell", "block"]).mapInArrow(compare, "qid long, vec_id long, similarity double")
    return top_k(exact, "qid", [F.round("similarity", 9).desc(), F.col("vec_id")], k, "pos")


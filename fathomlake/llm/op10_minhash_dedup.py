"""MinHash near-dedup by min-max hashing: of each permutation both the least and the greatest value are kept.

1. A document's set: hashes of its distinct runs of n words (A-Z in lower case; the whole sequence where there are fewer
   words). Under each of PERMUTATIONS multiplications its least and greatest hash go into the signature, two values for
   one evaluation. Documents with the same words in the same order (by 128 bits of BLAKE2) form a class, and go on as one.
2. The values make BANDS bands of ROWS: each value is in two or so. Of a million pairs at the threshold of 0.8, simulated
   with this very layout, none shared no band. Bands that only one document has are dropped (blocks ask each other).
3. Classes that share bands, over any number of steps, form a cluster, found by links to each bucket's least class.
4. In a cluster pairs are confirmed on full sets. Pairs that confirmed links already join, that differ too much in size
   or whose signatures agree in less than AGREE of the values (at 0.8, seven standard errors) need no look. A large
   cluster first links all to its hub, the class that shares most bands; then what the hub left is held against all, in
   tiles of bounded size. Only a tile's joining links leave it, never all pairs. A link is decided by comparing words byte
   by byte: hashes only choose what is looked at.
5. Confirmed links give the components.

Cases: null and empty texts have an empty set and are linked with nothing; texts shorter than n words have one shingle;
repeated rows are one class; a null doc_id is a document like others, last in order; an empty table gives an empty one.
A very long text is a block of its own, and its signature is made in parts; other columns are not read, whatever they are called.
Of each component one row is kept, the least by doc_id and then by row key, also where ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ASK, arrow_schema, ask, distinct_spans, is_in, keys_of, lowered, mapped, mix, repeated, runs_of, squeeze, unsqueeze, word_keys, word_spans
from .common import LOWER, UPPER, release, shards_for, text_arrays, texts_of, written
from .components import components, with_copies

N, PERCENT = 4, 80
PERMUTATIONS, BANDS, ROWS, AGREE, TILE = 64, 48, 5, 0.55, 256
#: Bytes of packed texts in a tile of a large cluster, and in a bin of small ones.
TILE_BYTES, BIN_BYTES = 32 << 20, 16 << 20
LAST = 2**63 - 1
_rng = np.random.default_rng(7)
_TIMES = _rng.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = np.concatenate([_rng.permutation(2 * PERMUTATIONS) for _ in range(BANDS * ROWS // (2 * PERMUTATIONS) + 1)])[: BANDS * ROWS].reshape(BANDS, ROWS)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

STAGE = "block long, doc_id long, key long, place int, n_shingles long, digest binary, values binary, texts array<binary>"
CANDIDATE = "node long, n_shingles long, values binary, text binary, buckets array<long>"
LINK = "a long, b long"


def shingle_sets(raw: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = lowered(raw)
    starts, ends, word_at = word_spans(raw, at)
    hashes = word_keys(raw, starts, ends)[:, 0].copy()
    runs = runs_of(hashes, n)
    out = []
    for i, j in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if j - i >= n:
            out.append(np.unique(runs[i : j - n + 1]))
        else:
            out.append(mix(np.add.reduce(hashes[i:j] * (np.arange(j - i, dtype=np.uint64) * np.uint64(2) + np.uint64(3))) + np.arange(j - i, j - i + 1, dtype=np.uint64)) if j > i else hashes[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Least and greatest hash under each permutation, their upper halves."""
    if len(s) > 4096:  # by parts, so that the products of a very long text are not held at once
        parts = np.array([signature(s[i : i + 4096]) for i in range(0, len(s), 4096)])
        return np.concatenate([parts[:, :PERMUTATIONS].min(axis=0), parts[:, PERMUTATIONS:].max(axis=0)])
    x = s[None, :] * _TIMES[:, None]
    return np.concatenate([x.min(axis=1), x.max(axis=1)]) >> np.uint64(32)


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of values."""
    picked = values.astype(np.uint64)[:, _BANDS]
    key = np.zeros(picked.shape[:2], np.uint64) + _SALT
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + picked[:, :, k])
    return key


def _sign(n: int, size: int) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, schema = TaskContext.get().partitionId() << 33, arrow_schema(STAGE)
        for batch in batches:
            raw, at = text_arrays(batch.column("text"))
            ids, row_keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(size, max(int(at[-1]), 1), size)), [len(ids)]]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
                rows, values, texts = [], [], []
                for k, s in enumerate(sets):
                    text = raw[at[i + k] : at[i + k + 1]].tobytes()
                    digest = blake2b(b" ".join(text.lower().split()), digest_size=16).digest() if len(s) else None
                    rows.append({"block": block, "doc_id": ids[i + k], "key": row_keys[i + k], "place": len(values) if len(s) else None, "n_shingles": len(s), "digest": digest})
                    if len(s):
                        values.append(signature(s).astype(np.uint32))
                        texts.append(squeeze(text))
                rows.append({"block": block, "values": np.array(values, np.uint32).tobytes(), "texts": texts})
                yield pa.RecordBatch.from_pylist(rows, schema)
                block += 1
                del sets, values, texts, rows
                release()

    return sign


def _values(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32).reshape(-1, 2 * PERMUTATIONS)


class _Groups:
    """Links among members that confirmed ones join."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.top(i)] = self.top(j)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int(is_in(a, b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def exactly_similar(a: bytes, b: bytes, percent: int, n: int) -> bool:
    """Whether two texts are, on full sets of shingles of words that are compared byte by byte."""
    raw = lowered(np.frombuffer(a + b, np.uint8))
    starts, ends, (_, cut, end) = word_spans(raw, np.array([0, len(a), len(raw)]))
    _, word, _ = distinct_spans(raw, starts, ends)
    if min(cut, end - cut) < n:
        return np.array_equal(word[:cut], word[cut:])
    runs = word.astype(np.int64)
    for k in range(1, n):  # numbers of distinct runs, one word longer each time
        runs = np.unique(runs[:-1] * np.int64(end) + word[k:], return_inverse=True)[1]
    one, other = np.unique(runs[: cut - n + 1]), np.unique(runs[cut:])
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def confirm(members: pd.DataFrame, percent: int, n: int, one: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what confirmed pairs join, each from a group's least node to another of its nodes; one: marks members
    of which a pair must have at least one."""
    values, nodes, sizes = np.stack([_values(x)[0] for x in members["values"]]), members["node"].tolist(), members["n_shingles"].to_numpy()
    texts, sets, groups = members["text"].tolist(), {}, _Groups(len(members))

    def full(i: int) -> np.ndarray:
        if i not in sets:
            raw = np.frombuffer(unsqueeze(texts[i]), np.uint8)
            sets[i] = shingle_sets(raw, np.array([0, len(raw)]), n)[0]
        return sets[i]

    for i in range(len(nodes) - 1):
        fit = 100 * np.minimum(sizes[i], sizes[i + 1 :]) >= percent * np.maximum(sizes[i], sizes[i + 1 :])
        if one is not None and not one[i]:
            fit &= one[i + 1 :]
        others = np.flatnonzero(fit) + i + 1
        if not len(others):
            continue
        agree = (values[others] == values[i]).sum(axis=1)
        others, agree = others[agree >= AGREE * values.shape[1]], agree[agree >= AGREE * values.shape[1]]
        for j in others[np.argsort(-agree, kind="stable")].tolist():
            if groups.top(i) != groups.top(j) and similar(full(i), full(j), percent) and exactly_similar(unsqueeze(texts[i]), unsqueeze(texts[j]), percent, n):
                groups.join(i, j)
    tops, least = [groups.top(i) for i in range(len(nodes))], {}
    for top, node in zip(tops, nodes, strict=True):
        least[top] = min(node, least.get(top, node))
    return [(least[top], node) for top, node in zip(tops, nodes, strict=True) if node != least[top]]


def _bucket_links(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of classes to their buckets' least class, and each class's weight: members of all its buckets."""
    held = candidates.select("node", F.explode("buckets").alias("bucket"))
    # A bucket that very many classes share is counted with map-side combining; Spark splits such a key in the join.
    buckets = held.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1").withColumnRenamed("bucket", "of")
    shared = written(held.join(buckets, F.col("bucket") == F.col("of")).groupBy("node", "least").agg(F.sum("members").alias("weight")), "buckets")
    # A class has as many least ones as bands at most. It keeps a link to the first of them, and that one is linked with
    # the others: the same components, and in a large cluster, where few classes are least, one link for each member.
    firsts = shared.groupBy("node").agg(F.min("least").alias("a"), F.collect_set("least").alias("all"))
    links = firsts.select("a", F.explode(F.array_union("all", F.array("node"))).alias("b")).where("a != b").distinct()
    return links, shared.groupBy("node").agg(F.sum("weight").alias("weight"))


def bins_for(spark: SparkSession, n_bytes: int) -> int:
    """Groups that small clusters are dealt into: several for each shuffle partition, and of BIN_BYTES of packed text or so."""
    return max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BIN_BYTES + 1)


def near_links(candidates: DataFrame, percent: int, n: int, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Confirmed links between classes, enough to join all that are similar."""
    spark = candidates.sparkSession
    links, weights = _bucket_links(candidates)
    clusters = written(components(links).join(candidates.select("node", F.length("text").alias("bytes")), "node"), "sized")
    # A cluster's tiles: by members and by bytes, so that a task holds a bounded part of it.
    tiles = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("bytes") / tile_bytes)).cast("int")
    sizes = clusters.groupBy("component").agg(tiles.alias("tiles"))
    members = written(
        clusters.drop("bytes").join(sizes, "component").join(candidates.drop("buckets"), "node").join(weights, "node", "left")
        .select("component", "tiles", "weight", "node", "n_shingles", "values", "text"), "clusters",
    )
    bins = bins_for(spark, clusters.agg(F.sum("bytes")).first()[0] or 0)

    def small(part: pd.DataFrame) -> pd.DataFrame:
        release()
        out = [x for _, some in part.groupby("component") for x in confirm(some, percent, n)]
        return pd.DataFrame(out, columns=["a", "b"])

    binned = members.where("tiles = 1").withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins)))
    found = binned.groupBy("bin").applyInPandas(small, LINK)

    # Large clusters. Each tile gets the hub's row too.
    large = members.where("tiles > 1")
    if not large.limit(1).count():
        return found
    large = large.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    hubs = large.groupBy("component").agg(F.max_by("node", F.struct("weight", "node")).alias("hub")).withColumnRenamed("component", "of")
    marked = written(large.join(F.broadcast(hubs) if hubs.count() <= 100_000 else hubs, F.col("component") == F.col("of")).drop("of"), "large")
    hub_rows = marked.where("node = hub").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

    def to_hub(part: pd.DataFrame) -> pd.DataFrame:
        def full(x: bytes) -> np.ndarray:
            raw = np.frombuffer(unsqueeze(x), np.uint8)
            return shingle_sets(raw, np.array([0, len(raw)]), n)[0]

        hub = int(part["hub"].iloc[0])
        packed = part.loc[part["node"] == hub, "text"].iloc[0]
        center, text = full(packed), unsqueeze(packed)
        return pd.DataFrame([(int(x.node), hub) for x in part.itertuples() if x.node != hub and similar(center, full(x.text), percent) and exactly_similar(text, unsqueeze(x.text), percent, n)], columns=["a", "b"])

    of_hub = written(marked.where("node != hub").unionByName(hub_rows).groupBy("component", "tile").applyInPandas(to_hub, LINK), "hub")
    joined = marked.join(of_hub.select(F.col("a").alias("node"), F.lit(True).alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", F.col("node") == F.col("hub")))
    # Rest against rest, and rest against linked: two tiles for each pair of tiles that has some of the rest.
    counts = joined.groupBy("component", "linked").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.length("text")) / tile_bytes)).cast("int").alias("k"))
    tiled = written(joined.join(counts, ["component", "linked"]).withColumn("t", F.pmod(F.xxhash64("node", F.lit(1)), F.col("k")).cast("int")), "tiled")
    parts = tiled.select("component", "linked", "t").distinct()
    left, right = parts.where("NOT linked").select("component", F.col("t").alias("t1")), parts.select("component", F.col("linked").alias("linked2"), F.col("t").alias("t2"))
    pairs = left.join(right, "component").where("linked2 OR t1 <= t2").withColumn("job", F.struct("component", "t1", "linked2", "t2"))
    sides = pairs.select("job", "component", F.explode(F.array_distinct(F.array(F.struct(F.lit(False).alias("linked"), F.col("t1").alias("t")), F.struct(F.col("linked2").alias("linked"), F.col("t2").alias("t"))))).alias("side"))
    jobs = sides.select("job", "component", "side.linked", "side.t").join(tiled, ["component", "linked", "t"]).select("job", "linked", "node", "n_shingles", "values", "text")

    def rest(part: pd.DataFrame) -> pd.DataFrame:
        release()
        return pd.DataFrame(confirm(part, percent, n, ~part["linked"].to_numpy(bool)), columns=["a", "b"])

    return found.unionByName(of_hub).unionByName(jobs.groupBy("job").applyInPandas(rest, LINK))


def near_dedup(docs: DataFrame, n: int = N, percent: int = PERCENT, tile: int = TILE, block_bytes: int = 2 << 20, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; and key, where a column of distinct row numbers is given."""
    spark = docs.sparkSession
    texts = texts_of(docs, key=F.col(key).cast("long") if key else F.monotonically_increasing_id())
    stage = written(texts.mapInArrow(_sign(n, block_bytes), STAGE), "signatures")
    rows, signed = stage.where("values IS NULL").select("block", "doc_id", "key", "place", "n_shingles", "digest"), stage.where("values IS NOT NULL").select("block", "values", "texts")
    shards = shards_for(spark, BANDS * rows.where("digest IS NOT NULL").count())

    def bands(row) -> list[dict]:
        values = _values(row.values)
        return ask(shards, row.block, *np.unique(band_keys(values), return_counts=True)) if len(values) else []

    found = repeated(mapped(signed.select("block", "values"), bands, ASK))
    # One document of each class goes on, the first one; its row key is the class's node.
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "key", "block", "place", "n_shingles")).alias("w"), F.count("*").alias("copies"))
    classes = written(classes.select("digest", F.col("w.key").alias("node"), "copies", "w.*"), "classes")
    mine = classes.groupBy("block").agg(F.collect_list(F.struct("place", "node", "n_shingles")).alias("mine"))

    def candidates(row) -> list[dict]:
        values, keys, out = _values(row.values), keys_of(row.found), []
        for x in row.mine:
            own = band_keys(values[x["place"]][None])[0]
            if (hit := is_in(own, keys)).any():
                out.append({"node": x["node"], "n_shingles": x["n_shingles"], "values": values[x["place"]].tobytes(), "text": row.texts[x["place"]], "buckets": own[hit].view(np.int64).tolist()})
        return out

    chosen = written(mapped(signed.join(found, "block").join(mine, "block"), candidates, CANDIDATE), "candidates")
    joined = components(written(near_links(chosen, percent, n, tile), "confirmed"))
    # From a class to the least row of its component. Only classes of several rows, or with links, are looked up again.
    least = classes.join(joined, "node").groupBy("component").agg(F.min(F.struct("id", "key")).alias("least"))
    linked = with_copies(joined, "node", least, "component").select("node", "least")
    of_class = classes.join(linked, "node", "left").where("copies > 1 OR least IS NOT NULL").select("digest", F.coalesce("least", F.struct("id", "key")).alias("least"))
    out = with_copies(rows, "key", of_class, "digest", "left").select("doc_id", "key", "n_shingles", F.coalesce("least.id", "doc_id", F.lit(LAST)).alias("component_id"), F.coalesce(F.col("least.key") == F.col("key"), F.lit(True)).alias("kept"))
    return out.select("doc_id", "n_shingles", F.when(F.col("component_id") < LAST, F.col("component_id")).alias("component_id"), "kept", *(["key"] if key else []))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda k: array_to_string(w[k:k + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
h AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= {PERCENT} * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT a AS node, a AS r FROM e UNION SELECT e.b AS node, r FROM reach JOIN e ON e.a = node WHERE r < e.b),
c AS (SELECT node, min(r) AS least FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept FROM s LEFT JOIN c ON node = doc_id
"""

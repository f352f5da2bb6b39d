"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A text's set is its distinct five-word shingles (words between ASCII white space, A-Z in lower case; the whole sequence
as one shingle where there are fewer words). A document holds a benchmark item if it has 0.8 or more of the item's set.
An item of k words, fewer than five, is one shingle, and a document also has its runs of k words, for each k that any item
has: such an item is found inside longer documents. (The SQL below finds it only as a whole document; on tables without
such items, as the given ones, both are the same.)

1. Documents are reduced to shingles that any item has. That leaves every intersection with an item, and so every
   containment, as it was, and makes short sets of long documents.
2. Reduced sets are partitioned by size, in powers of two. In a partition of sizes up to u, an item of m shingles that is
   contained to t has a Jaccard similarity of at least s = t m / (u + m - t m), so that with one MinHash value to a band,
   log(MISS) / log(1 - s) bands leave fewer than MISS of the pairs out. Items are looked up with as many bands as their
   size needs in the partition; where that is more than BANDS, by all their shingles instead.
3. The pairs found are verified by exact containment.

Cases: null and empty texts, of documents or items, have no shingles and match nothing; repeated rows and repeated items
match each by itself; ties do not arise, as every item over the threshold is reported; a very long text is one row of its
distinct shingles that any item has; empty tables give no pairs; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, words, written

N, CONTAINMENT, BANDS, MISS = 5, 0.8, 64, 1e-7
#: Benchmark rows that may be broadcast: 500,000 of 16 bytes are 8 MB. Beyond that the joins are left to Spark.
BROADCAST_ROWS = 500_000


def shingles(w: Column, n: int = N) -> Column:
    """Distinct 64-bit hashes of each n neighbouring words of an array column."""
    each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(n)]))
    short = F.array(F.xxhash64(F.array_join(w, " "), F.lit("short")))
    return F.array_distinct(F.when(F.size(w) >= n, each).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>")))


def short_runs(w: Column, k: int) -> Column:
    """Distinct hashes of each k neighbouring words, as shingles() gives for a whole text of k words."""
    each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " "), F.lit("short")))
    return F.array_distinct(F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>")))


def bands_needed(u: Column, m: Column, t: float, miss: float = MISS) -> Column:
    s = F.least(F.lit(1 - 1e-9), t * m / (u + m - t * m))
    return F.ceil(F.lit(math.log(miss)) / F.log(1 - s))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, n: int = N, bands: int = BANDS, key: str | None = None) -> DataFrame:
    """One row per document row and item that it holds: doc_id, item_id, n_shared, n_item, containment; and key, where a
    column of distinct row numbers is given."""
    items = items.select(F.col("item_id").cast("long"), words(ascii_lower(F.col("text"))).alias("w")).select("item_id", F.monotonically_increasing_id().alias("item"), shingles(F.col("w"), n).alias("of_item"), F.size("w").alias("n_words")).where(F.size("of_item") > 0)
    items = written(items.withColumn("m", F.size("of_item")), "items")
    n_items, n_shingles = items.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()

    rows = docs.select(F.col("doc_id").cast("long"), (F.col(key).cast("long") if key else F.monotonically_increasing_id()).alias("row"), words(ascii_lower(F.col("text"))).alias("w"))
    lengths = [r["n_words"] for r in items.where(F.col("n_words") < n).select("n_words").distinct().collect()]
    held = F.array_union(shingles(F.col("w"), n), F.flatten(F.array(*[short_runs(F.col("w"), k) for k in lengths]))) if lengths else shingles(F.col("w"), n)
    rows = rows.select("doc_id", "row", F.explode(held).alias("h"))
    known = items.select(F.explode("of_item").alias("h")).distinct()
    reduced = rows.join(_sized(known, n_shingles), "h", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("h").alias("held"))
    # Partitions by size: u is the largest size in a set's partition.
    reduced = written(reduced.withColumn("u", (F.pow(F.lit(2), F.floor(F.log2(F.size("held"))) + 1) - 1).cast("int")), "reduced")

    def signature(c: str) -> Column:
        def least(k: int) -> Column:
            return F.array_min(F.transform(c, lambda h: F.xxhash64(h, F.lit(k))))

        return F.array(*[least(k) for k in range(bands)])

    signed = items.select("item", "m", F.posexplode(signature("of_item")).alias("band", "value"))
    # A set smaller than 0.8 of an item cannot hold it; a larger partition than the bands serve is looked up by shingles.
    need = bands_needed(F.col("u"), F.col("m"), containment)
    by_bands = (
        reduced.select("row", "u", F.posexplode(signature("held")).alias("band", "value"))
        .join(_sized(signed, n_items * bands), ["band", "value"])
        .where((need <= bands) & (F.col("band") < need) & (F.col("u") >= containment * F.col("m"))).select("row", "item")
    )
    by_shingles = (
        reduced.select("row", "u", F.explode("held").alias("h"))
        .join(_sized(items.select("item", "m", F.explode("of_item").alias("h")), n_shingles), "h")
        .where(need > bands).select("row", "item")
    )
    pairs = by_bands.union(by_shingles).distinct()
    shared = F.size(F.array_intersect("held", "of_item"))
    return (
        pairs.join(_sized(items, n_shingles), "item").join(reduced, "row")
        .where(shared * 1000 >= F.round(F.lit(containment * 1000)) * F.col("m"))
        .select("doc_id", "item_id", shared.cast("long").alias("n_shared"), F.col("m").cast("long").alias("n_item"), F.round(shared / F.col("m"), 6).alias("containment"), *([F.col("row").alias("key")] if key else []))
    )


def _oracle(name: str) -> str:
    return rf"""
  SELECT i, r, list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda k: array_to_string(w[k:k + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' short'] ELSE [] END) AS s
  FROM (SELECT {"doc_id" if name == "documents" else "item_id"} AS i, row_number() OVER () AS r,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {name})"""


ORACLE = rf"""
WITH d AS ({_oracle("documents")}), b AS ({_oracle("benchmark")}),
n AS (SELECT r, i, len(s) AS n_item FROM b),
p AS (SELECT d.r AS dr, d.i AS doc_id, b.r AS br, count(*) AS n_shared FROM (SELECT r, i, unnest(s) AS h FROM d) d JOIN (SELECT r, unnest(s) AS h FROM b) b USING (h) GROUP BY ALL)
SELECT doc_id, n.i AS item_id, n_shared, CAST(n_item AS BIGINT) AS n_item, round(n_shared / n_item, 6) AS containment FROM p JOIN n ON br = n.r WHERE n_shared * 1000 >= 800 * n_item
"""

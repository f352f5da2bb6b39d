"""Mixing sources to target weights by weighted fair queueing, in built-in expressions alone.

1. Sizes: words of each document, summed by source. Sources in order of code points (null last) weigh WEIGHTS in turn and
   share all words; a source's target stops at MOST times its size, and what it leaves is shared again by weight, until
   none is above. A round is one aggregation over the sources; only two sums go to the driver.
2. Documents of a source are shuffled by a digest of id and text. A first pass sums sizes by source and leading digits of
   the digest, a second one adds up within them, so that no task has a whole source.
3. A source sends its documents one after another, at most MOST times, in packets of a thousandth of its target at most,
   as long as they begin before the target. A packet's virtual finish time is its source's words up to its end divided by
   the target. All packets are range-sorted by finish time and cut where the words of all documents are used up: the
   ranges' sums give each range its offset. A packet that crosses the budget is cut there.

So each source's taken words are within a packet (0.1 % of its target, or one word) of the target.

Cases: a null or empty text has size 0 and is never taken; null sources are one source, the last in order; a null doc_id is
a document like others; repeated rows are documents of their own (of rows equal in all that counts it does not matter
which comes first); ties in finish time go by the source's order, then by place in the source; a very long text is cut
into packets; a source without words has the target 0; an empty table gives an empty one; other columns are not read.
Rerunning gives the same rows: nothing depends on how the table is partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import in_order
from .common import WORD, written
from .components import with_copies

WEIGHTS, MOST, PACKETS = (5, 2, 1), 3, 1000
#: Documents of a source that share the leading digits of a digest, about; sources that are broadcast after a count.
EACH, BROADCAST_SOURCES = 250_000, 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """Of rows (source, size): source, source_size, place in order, target of each source; and the words of all."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    stage, before = in_order(by, F.col("source").isNull(), F.col("source"))
    place = F.col("__place") + F.col("__before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    named = written(stage.join(F.broadcast(before), "__part").select("source", "source_size", place.alias("place"), weight.cast("long").alias("weight")), "sources")
    total, rest_weight = named.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, capped, cap = total or 0, 0, F.col("source_size") * most
    if not rest:
        return named.select("source", "source_size", "place", F.lit(0.0).alias("target")), 0
    while True:
        share = F.lit(rest).cast("long") * F.col("weight") / F.lit(rest_weight).cast("long")
        above = share > cap
        n, taken, left = named.agg(F.count_if(above), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == capped:
            return named.select("source", "source_size", "place", F.when(above, cap.cast("double")).otherwise(share).alias("target")), total
        # Shares only rise from round to round, so a source that is above stays above.
        rest, rest_weight, capped = total - taken, left, n


def queued(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, packets: int = PACKETS, each: int = EACH) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, size, source_size, target) and the mix in order: row, doc_id, copy, first word, words, offset."""
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    sized = written(docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest")), "sizes")
    targets, total = source_targets(sized.select("source", "size"), weights, most)

    # From a source's parts, by leading digits, to what the parts before one add up to.
    digits = max(2, math.ceil(math.log(max(1, sized.count() / each), 16)))
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    keyed = sized.select(key.alias("key"), F.substring("digest", 1, digits).alias("part_of"), "doc_id", "size", "digest")
    known = targets.select(key.alias("key"), "source_size", "place", "target")
    sums = keyed.groupBy("key", "part_of").agg(F.sum("size").alias("sum"))
    sums = sums.join(F.broadcast(known), "key") if known.count() <= BROADCAST_SOURCES else with_copies(sums, "part_of", known, "key")
    sums = sums.withColumn("part_before", F.sum("sum").over(Window.partitionBy("key").orderBy("part_of")) - F.col("sum")).drop("sum")
    within = F.sum("size").over(Window.partitionBy("key", "part_of").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = keyed.withColumn("within", within).join(sums, ["key", "part_of"])
    placed = placed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "size", "source_size", "target", "place", (F.col("part_before") + F.col("within")).alias("before"))
    placed = written(placed, "placed")

    # Packets that begin before their source's target.
    packet = F.greatest(F.lit(1), F.floor(F.col("target") / packets)).cast("long")
    sent = placed.where("size > 0 AND before < target").withColumn("packet", packet).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    sent = sent.withColumn("begin", F.col("copy") * F.col("source_size") + F.col("before")).where("begin < target")
    sent = sent.withColumn("first_word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("packet")))).withColumn("begin", F.col("begin") + F.col("first_word")).where("begin < target")
    sent = sent.withColumn("words", F.least("packet", F.col("size") - F.col("first_word"))).withColumn("finish", (F.col("begin") + F.col("words")) / F.col("target"))
    ranged, _ = in_order(sent.select("row", "doc_id", "copy", "first_word", "words", "finish", "place", "begin"), F.col("finish"), F.col("place"), F.col("begin"))
    # A row for each range.
    starts = ranged.groupBy("__part").agg(F.sum("words").alias("sum")).withColumn("start", F.sum("sum").over(Window.orderBy("__part")) - F.col("sum")).drop("sum")
    offset = F.col("start") + F.sum("words").over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    used = ranged.join(F.broadcast(starts.where(F.col("start") < total)), "__part").withColumn("offset", offset).where(F.col("offset") < total)
    return placed, used.select("row", "doc_id", "copy", "first_word", F.least("words", F.lit(total) - F.col("offset")).alias("words"), "offset")


def source_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words of it in the mix, copies counted)."""
    placed, mix = queued(docs, weights, most)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
s AS (SELECT *, CAST(CASE place % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS BIGINT) AS weight FROM o),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, CAST(sum(weight) AS BIGINT) AS weights FROM s),
x AS (SELECT 0 AS k, total AS rest, weights AS left_weight, CAST(0 AS BIGINT) AS capped FROM t
  UNION ALL SELECT k + 1, total - CAST(sum(CASE WHEN rest * weight / left_weight > {MOST} * source_size THEN {MOST} * source_size ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN rest * weight / left_weight > {MOST} * source_size THEN 0 ELSE weight END) AS BIGINT),
  count(*) FILTER (rest * weight / left_weight > {MOST} * source_size) FROM x, s, t WHERE total > 0 GROUP BY k, rest, left_weight, capped, total HAVING count(*) FILTER (rest * weight / left_weight > {MOST} * source_size) > capped),
l AS (SELECT rest, left_weight FROM x ORDER BY k DESC LIMIT 1),
g AS (SELECT source, source_size, place, CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN rest * weight / left_weight > {MOST} * source_size THEN CAST({MOST} * source_size AS DOUBLE) ELSE rest * weight / left_weight END AS target FROM s, t, l),
p AS (SELECT r, doc_id, size, source_size, place, target, CAST(sum(size) OVER (PARTITION BY place ORDER BY digest, doc_id NULLS FIRST, size, r ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before, CAST(greatest(1, floor(target / {PACKETS})) AS BIGINT) AS packet FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, unnest(range({MOST})) AS copy FROM p WHERE size > 0),
f AS (SELECT r, place, target, size, packet, copy * source_size + before AS begins, unnest(range(0, size, packet)) AS first_word FROM c WHERE copy * source_size + before < target),
w AS (SELECT r, place, begins + first_word AS begins, least(packet, size - first_word) AS words, (begins + first_word + least(packet, size - first_word)) / target AS finish FROM f WHERE begins + first_word < target),
q AS (SELECT r, words, CAST(sum(words) OVER (ORDER BY finish, place, begins ROWS UNBOUNDED PRECEDING) AS BIGINT) - words AS start FROM w),
u AS (SELECT r, CAST(sum(greatest(0, least(words, total - start))) AS BIGINT) AS taken FROM q, t GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN u USING (r)
"""

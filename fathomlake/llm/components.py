"""Connected components of links, as joins and aggregations over written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Parts that the neighbours of a node, and the nodes of a label, are spread over.
NEIGHBOURS, NODES = 8, 32
#: Rounds after which labels are also followed: graphs near stars are done by then.
PLAIN = 4
#: Nodes up to which labels, of 16 bytes each, are broadcast after a count.
BROADCAST_NODES = 200_000


def _part(c: str, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _copies(df: DataFrame, n: int) -> DataFrame:
    """Each row for every part. To be merged, not broadcast: Spark's estimate of the size leaves out that these are copies."""
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).hint("merge")


def with_copies(rows: DataFrame, by: str, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Rows joined with a table of one row a key. A key that very many rows have is spread over parts by another column."""
    return rows.withColumn("part", _part(by, NEIGHBOURS)).join(_copies(table, NEIGHBOURS), [on, "part"], how).drop("part")


def components(links: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """node and component, the least node it is linked with over any number of steps, for links of columns a and b.

    Each round a node takes the least label among its own and its neighbours'; from the fourth on also the label of that
    label, so that chains shrink by half or more. It ends when no label changes. A round is a join and an aggregation
    with map-side combining. Labels are broadcast up to a number of nodes. Beyond it a node with very many links, or a
    label that very many nodes have, is spread over parts in the joins, each with a copy of its one row.
    """
    both = written(links.select("a", "b").where("a != b").union(links.selectExpr("b AS a", "a AS b").where("a != b")).distinct().withColumn("part", _part("a", NEIGHBOURS)), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    turn, few = 0, labels.count() <= broadcast_nodes
    while True:
        at_b = labels.withColumnRenamed("node", "b")
        told = both.join(F.broadcast(at_b), "b") if few else both.join(_copies(at_b, NEIGHBOURS), ["b", "part"])
        told = told.select(F.col("a").alias("node"), F.col("component").alias("label"), F.lit(None).cast("long").alias("own"))
        own = labels.select("node", F.col("component").alias("label"), F.col("component").alias("own"))
        step = written(told.union(own).groupBy("node").agg(F.min("label").alias("new"), F.max("own").alias("component")), "labels")
        if turn >= PLAIN:
            # A label is a node of the same component: go on to its own label, where that is another.
            used = step.select(F.col("new").alias("label")).distinct()
            onward = used.join(step.where("new < node").select("node", F.col("new").alias("onward")), F.col("label") == F.col("node")).select(F.col("label").alias("new"), "onward")
            step = step.withColumn("part", _part("node", NODES))
            step = step.join(F.broadcast(onward), "new", "left") if few else step.join(_copies(onward, NODES), ["new", "part"], "left")
            step = step.select("node", F.coalesce("onward", "new").alias("new"), "component")
            step = written(step, "labels")
        changed = step.where("new != component").limit(1).count()
        labels, turn = step.select("node", F.col("new").alias("component")), turn + 1
        if not changed:
            return labels

"""Retrieval evaluation: ranks of the first relevant hit, recall, MRR, slices, thresholds, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_of_titles(catalogue: DataFrame) -> DataFrame:
    """title (folded to lower case, trimmed), gold: the set of ids of each title."""
    return catalogue.groupBy(F.lower(F.trim("title")).alias("title")).agg(F.array_sort(F.collect_set("id")).alias("gold"))


def gold_links(items: DataFrame, questions: DataFrame) -> DataFrame:
    """id, gold of items (id, title): the gold ids of the questions in scope that name the item's title; none if none
    does. questions: gold_title and gold_chroma_id as lists in text."""
    named = questions.where("in_scope = 1").select(F.explode(F.split("gold_title", r"\|")).alias("title"), _ids("gold_chroma_id").alias("ids")).select(F.lower(F.trim("title")).alias("title"), F.explode("ids").alias("gold"))
    gold = named.distinct().groupBy("title").agg(F.array_sort(F.collect_list("gold")).alias("gold"))
    return items.select("id", F.lower(F.trim("title")).alias("title")).join(gold, "title", "left").select("id", F.coalesce("gold", F.array().cast("array<string>")).alias("gold"))


def _ids(c: str) -> Column:
    return F.filter(F.split(c, ";"), lambda x: x != "")


def relevant(hits: DataFrame, items: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits (qid, id and others) with `relevant`: the item is one of the question's gold ids, or its own gold ids, by
    title, share one with them."""
    own = questions.select("qid", _ids("gold_chroma_id").alias("own"))
    joined = hits.join(gold_links(items, questions), "id", "left").join(own, "qid")
    return joined.withColumn("relevant", F.array_contains("own", F.col("id")) | F.coalesce(F.arrays_overlap("gold", "own"), F.lit(False))).drop("gold", "own")


def score(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Each question with gold_rank, hit_1, hit_5, rr, top1_distance. hits: qid, pos (0-based), distance, relevant."""
    best = hits.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("pos") + 1)).alias("gold_rank"), F.min_by("distance", "pos").alias("top1_distance"), F.min_by("vec_id", "pos").alias("top1_id"))
    rank = F.col("gold_rank")
    return questions.join(best, "qid", "left").withColumns({"hit_1": F.coalesce((rank == 1).cast("int"), F.lit(0)), "hit_5": F.coalesce((rank <= 5).cast("int"), F.lit(0)), "rr": F.coalesce(F.round(1 / rank, 4), F.lit(0.0))})


def _measures(n: Column) -> list[Column]:
    return [F.round(F.sum("hit_1") / n, 4).alias("recall_1"), F.round(F.sum("hit_5") / n, 4).alias("recall_5"), F.round(F.sum("rr") / n, 4).alias("mrr_10")]


def summary(results: DataFrame) -> DataFrame:
    """One row over the questions in scope; zeros where there are none."""
    n = F.greatest(F.count("*"), F.lit(1))
    row = results.where("in_scope = 1").agg(F.count("*").alias("n"), *_measures(n))
    return row.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("recall_1", "recall_5", "mrr_10")])


def slices(results: DataFrame, keys: list[str]) -> DataFrame:
    """slice, value, n, recall_1, recall_5, mrr_10 for each value of each key, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), F.col(k).cast("string").alias("value")) for k in keys])).alias("s")
    return results.where("in_scope = 1").select("hit_1", "hit_5", "rr", pairs).groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), *_measures(F.count("*")))


def threshold_report(results: DataFrame, width: float = 1 / 1024) -> DataFrame:
    """group, n, least, p25, median, p75, most of top-1 distances: order statistics n // 4 and 3 n // 4 of hits, misses and
    questions out of scope. Distances are counted in bins of a width; bins are summed up in order, and a distance's rank
    is that of its bin and its place there: no task sees a group's distances, only its bins or one bin."""
    group = F.when(F.col("in_scope") == 0, "out_of_scope").when(F.col("hit_1") == 1, "hit").otherwise("miss")
    at = results.where("top1_distance IS NOT NULL").select(group.alias("group"), F.round("top1_distance", 9).alias("d")).groupBy("group", "d").agg(F.count("*").alias("c")).withColumn("bin", F.floor(F.col("d") / width))
    bins, all_bins = at.groupBy("group", "bin").agg(F.sum("c").alias("in_bin")), Window.partitionBy("group")
    bins = bins.select("group", "bin", (F.sum("in_bin").over(all_bins.orderBy("bin")) - F.col("in_bin")).alias("before"), F.sum("in_bin").over(all_bins).alias("n"))
    up = at.join(bins, ["group", "bin"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("group", "bin").orderBy("d")))

    def nth(k: Column) -> Column:
        return F.min(F.when(F.col("upto") > k, F.col("d")))

    n = F.col("n")
    return up.groupBy("group", "n").agg(F.min("d").alias("least"), nth(F.floor(n / 4)).alias("p25"), ((nth(F.floor((n - 1) / 2)) + nth(F.floor(n / 2))) / 2).alias("median"), nth(F.floor(3 * n / 4)).alias("p75"), F.max("d").alias("most"))


def suggestion(report: DataFrame) -> DataFrame:
    """One row: the medians that a cut should lie between, and whether they overlap."""
    def median(g: str) -> Column:
        return F.max(F.when(F.col("group") == g, F.col("median")))

    return report.agg(median("hit").alias("from"), median("out_of_scope").alias("to")).withColumn("overlap", F.col("from") >= F.col("to"))


def threshold_sweep(results: DataFrame, cuts: list[float]) -> DataFrame:
    """cut, blocked, lost: shares of questions out of scope, and of right first hits, over a cut. A row meets each cut in
    an array, not a join."""
    each = results.select("in_scope", "hit_1", "top1_distance", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    over = (F.col("top1_distance") > F.col("cut")).cast("double")
    return each.groupBy("cut").agg(F.round(F.avg(F.when(F.col("in_scope") == 0, over)), 6).alias("blocked"), F.round(F.avg(F.when((F.col("in_scope") == 1) & (F.col("hit_1") == 1), over)), 6).alias("lost"))


def hubness(results: DataFrame, rows: DataFrame, top: int = 5) -> DataFrame:
    """One row: share of questions whose first hit is one of the busiest rows, rows that are never first, correlation of
    length and popularity. rows: vec_id, length."""
    first = results.where("top1_id IS NOT NULL").groupBy(F.col("top1_id").alias("vec_id")).agg(F.count("*").alias("c"))
    busiest = first.orderBy(F.col("c").desc(), "vec_id").limit(top).agg(F.sum("c").alias("busy"))
    all_rows = rows.join(first, "vec_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return all_rows.agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 0).alias("never_first"), F.round(F.corr("length", "c"), 6).alias("corr")).crossJoin(F.broadcast(busiest)).select(F.round(F.col("busy") / F.col("total"), 6).alias("hub_share"), "never_first", "corr")


def worst(results: DataFrame, key: str, n: int = 12) -> DataFrame:
    return results.where("in_scope = 1").groupBy(F.col(key).alias("topic")).agg(F.count("*").alias("n"), F.round(F.avg("hit_1"), 6).alias("recall_1"), F.round(F.avg("hit_5"), 6).alias("recall_5")).orderBy("recall_1", "recall_5", "topic").limit(n)

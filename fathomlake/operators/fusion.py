"""Reciprocal-rank fusion, confidence and tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import any_in, has_marks
from .ranking import top_k

# Words that titles on one subject share.
TOPICS = [["kết hôn", "hôn nhân", "độc thân"], ["khai sinh", "giấy chứng sinh", "cha mẹ con"], ["căn cước", "cccd", "định danh"], ["hộ chiếu", "passport", "xuất cảnh"], ["tạm trú", "thường trú", "cư trú", "hộ khẩu"], ["đất", "sổ đỏ", "sổ hồng", "địa chính", "quy hoạch"]]


def dense_weight(text: Column, s: Settings = SETTINGS) -> Column:
    return F.when(has_marks(text), s.dense_weight).otherwise(s.dense_weight_bare)


def rrf(rank: Column, weight: Column | float, s: Settings = SETTINGS) -> Column:
    """A source's share of the fusion score; 0 where it has no rank."""
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return F.coalesce(weight / (s.rrf_k + rank), F.lit(0.0))


def fuse(questions: DataFrame, dense: DataFrame, lexical: DataFrame, catalogue: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The best rows of each question by fusion: both rankings in a full outer join, unknown rows dropped (the lexical
    rank is taken before that, the dense one after)."""
    known = catalogue.select("row_id")
    d = dense.join(known, "row_id", "left_semi").select("qid", "row_id", "dense_similarity", "best_view", F.col("rank").alias("dense_rank"))
    l = lexical.join(known, "row_id", "left_semi").select("qid", "row_id", "bm25_norm", F.col("rank").alias("lexical_rank"))  # noqa: E741
    weights = questions.select("qid", dense_weight(F.col("text"), s).alias("w_dense"))
    pool = d.join(l, ["qid", "row_id"], "full").join(weights, "qid")
    scored = pool.select(
        "qid", "row_id", "w_dense", "best_view", F.coalesce("dense_similarity", F.lit(0.0)).alias("dense_similarity"), F.coalesce("bm25_norm", F.lit(0.0)).alias("bm25_norm"), "dense_rank", "lexical_rank",
        (rrf(F.col("dense_rank"), F.col("w_dense"), s) + rrf(F.col("lexical_rank"), s.lexical_weight, s)).alias("fusion_score"),
        F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("lexical_rank").isNotNull(), "bm25"))).alias("sources"),
    )
    return top_k(scored, "qid", [F.round("fusion_score", 9).desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), F.col("row_id")], s.fused_k, "fused_rank")


def confidence(fused: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Adds confidence and final_rank, the order by confidence."""
    share = F.col("w_dense") / (F.col("w_dense") + s.lexical_weight)
    mixed = share * F.col("dense_similarity") + (1 - share) * F.col("bm25_norm")
    out = fused.withColumn("confidence", F.when((F.col("bm25_norm") > 0.05) & (F.col("dense_similarity") > 0.1), mixed).otherwise(F.greatest("dense_similarity", "bm25_norm")))
    return out.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("confidence", 9).desc(), "fused_rank")) - 1)


def same_topic(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x | y, [any_in(F.lower(a), words) & any_in(F.lower(b), words) for words in TOPICS])


def decide_tier(questions: DataFrame, ranked: DataFrame, titles: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """qid, tier, confidence of every question, also those without candidates. titles: row_id, title."""
    w = Window.partitionBy("qid").orderBy("final_rank")
    with_next = ranked.join(titles, "row_id", "left").withColumns({"next": F.lead("confidence").over(w), "next_title": F.lead("title").over(w)}).where("final_rank = 0")
    conf, dense = F.round("confidence", 9), F.round("dense_similarity", 9)
    close = F.col("next").isNotNull() & (F.round(F.col("confidence") - F.col("next"), 9) < s.gap) & (F.col("title") != F.col("next_title")) & ~same_topic(F.col("title"), F.col("next_title"))
    tier = F.when((dense < s.out_below) | (conf < s.out_below), "C").when((conf >= s.sure_from) & (dense >= s.sure_dense), F.when(close, "B").otherwise("A")).otherwise("B")
    found = with_next.select("qid", tier.alias("tier"), "confidence")
    return questions.select("qid").join(found, "qid", "left").select("qid", F.coalesce("tier", F.lit("C")).alias("tier"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def hybrid(questions: DataFrame, dense: DataFrame, lexical: DataFrame, catalogue: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    return confidence(fuse(questions, dense, lexical, catalogue, s), s)


def passage(ten: Column, situational: Column, summary: Column) -> Column:
    """What a reranker reads of a record: the title, and the heads of two views."""
    return F.concat(F.lit("Thủ tục: "), ten, F.lit(". "), F.substring(situational, 1, 120), F.lit(". "), F.substring(summary, 1, 80))


def with_rerank(ranked: DataFrame, texts: DataFrame, score) -> DataFrame:
    """Adds rerank_score by a pandas UDF over (question, passage); null for questions without marks. It is for display:
    the order stays that of the confidence."""
    joined = ranked.join(texts, ["qid", "row_id"], "left")
    return joined.withColumn("rerank_score", F.when(has_marks(F.col("question")), score(F.col("question"), F.col("passage"))))

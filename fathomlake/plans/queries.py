"""The registered queries of the retrieval operators, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, rules
from ..functions.text import ABBREVIATIONS, STOP_WORDS, abbreviate, clipped_sigmoid, content_tokens, first_words, fold, has_marks, outside_parentheses, strip_marks
from ..operators import answers, catalogue, dense, evaluation, fusion, lexical, lexical_index, questions, store, vector_index
from ..operators.ranking import small
from ..sources import RECORD_COLUMNS, Collection, crawled, fetched, first_of, listed, numbered_sheet, read_csv, shared_path, spread, table, with_fallback, write_csv, write_json_lines, write_records, write_report
from ..sources.paged import ListPages
from ..streaming import routed, sessions
from . import samples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS = ["title", "summary", "docs", "situational"]
AS_OF = dt.datetime(2000, 1, 1)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Pieces of SQL.


def q(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) AS t({names}))"


def contains_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words) + ")"


def sql_strip_marks(c: str) -> str:
    return f"replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')"


def sql_fold(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({sql_strip_marks(f'lower(coalesce({c}, chr(32)))')}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split({sql_fold(c)}, ' '), lambda x: x <> '')"


def sql_content(c: str) -> str:
    stop = ", ".join(map(q, STOP_WORDS))
    kept = f"list_filter({sql_tokens(c)}, lambda x: x NOT IN ({stop}))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {sql_tokens(c)} END"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


TEXTS = values([(i, t) for i, t in enumerate(samples.QUESTIONS)], "qid, text")
SAID = f"(SELECT qid, text FROM {TEXTS} UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations)"
V = f"v AS (SELECT vec_id, vec_id // 4 AS row_id, (['{VIEWS[0]}', '{VIEWS[1]}', '{VIEWS[2]}', '{VIEWS[3]}'])[CAST(vec_id % 4 AS INT) + 1] AS view, embedding::DOUBLE[] AS v, label FROM embeddings)"
Q = "qq AS (SELECT item_id AS qid, text, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"
KNN = "knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, vec_id) - 1 AS pos FROM (SELECT qid, row_id, view, vec_id, greatest(0, list_cosine_similarity(q, v)) AS similarity FROM qq JOIN v ON vec_id <> qid)) WHERE pos < 20)"
ROLL = "roll AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY f) - 1 AS rank FROM (SELECT qid, row_id, max(similarity) AS dense_similarity, min_by(view, pos) AS best_view, min(pos) AS f FROM knn GROUP BY 1, 2))"
CAT = "cat AS (SELECT doc_id AS row_id, text FROM documents)"


def sql_bm25(docs: str, asked: str) -> str:
    return f"""w AS (SELECT row_id, {sql_tokens("text")} AS words FROM {docs}), size AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
st AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS term FROM w) GROUP BY 1),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM st, size), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT qid, greatest(len(c), 1) AS q_len, unnest(c) AS term FROM (SELECT qid, {sql_content("text")} AS c FROM {asked})),
tf AS (SELECT row_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT row_id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY 1, 2),
sc AS (SELECT qid, row_id, any_value(q_len) AS q_len, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), size GROUP BY 1, 2),
lex AS (SELECT qid, row_id, score, least(1.0, score / (3.5 * q_len)) AS bm25_norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, row_id DESC) - 1 AS rank FROM sc) WHERE rank < 20 AND round(score, 9) >= 1.0)"""


HYBRID = f"""{V}, {Q}, {KNN}, {ROLL}, {CAT}, {sql_bm25("cat", "qq")},
pool AS (SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.row_id, l.row_id) AS row_id, best_view, coalesce(dense_similarity, 0) AS dense_similarity, coalesce(bm25_norm, 0) AS bm25_norm, d.rank AS dr, l.rank AS lr
  FROM (SELECT * FROM roll WHERE row_id IN (SELECT row_id FROM cat)) d FULL JOIN lex l ON d.qid = l.qid AND d.row_id = l.row_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fusion_score, 9) DESC, dr NULLS LAST, lr NULLS LAST, row_id) - 1 AS fused_rank FROM
  (SELECT pool.*, wd, coalesce(wd / (60 + dr), 0) + coalesce(1.0 / (60 + lr), 0) AS fusion_score FROM pool JOIN (SELECT qid, CASE WHEN {sql_strip_marks("text")} <> text THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS wd FROM qq) USING (qid))) WHERE fused_rank < 3),
conf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(confidence, 9) DESC, fused_rank) - 1 AS final_rank FROM (SELECT *, CASE WHEN bm25_norm > 0.05 AND dense_similarity > 0.1 THEN wd / (wd + 1) * dense_similarity + (1 - wd / (wd + 1)) * bm25_norm ELSE greatest(dense_similarity, bm25_norm) END AS confidence FROM fused))"""

# Inputs.


def said(spark, sf_dir) -> DataFrame:
    inline = spark.createDataFrame(list(enumerate(samples.QUESTIONS)), "qid long, text string")
    return inline.unionByName(table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "text"))


def views_of(spark, sf_dir) -> DataFrame:
    view = F.element_at(F.array(*map(F.lit, VIEWS)), (F.col("vec_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("row_id"), view.alias("view"), dense.doubles(F.col("embedding")).alias("v"), "label")


def asked(spark, sf_dir) -> DataFrame:
    vectors = views_of(spark, sf_dir).select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text").join(vectors, "qid")


def rows_of(spark, sf_dir) -> DataFrame:
    """All documents, also those without a vector: they can be lexical hits, and count in the statistics."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text"))


def _after(c: str, tail) -> Column:
    return F.when(F.col(c) == "", "").otherwise(F.concat(c, F.lit(" "), tail))


def records(spark, sf_dir) -> DataFrame:
    """A record for each part: one of a few, in turn, with the part's own name, brand and size in it."""
    some = spark.createDataFrame(samples.RECORDS, "kind long, " + ", ".join(f"{c} string" for c in catalogue.FIELDS))
    part = table(spark, sf_dir, "part").withColumn("kind", F.col("p_partkey") % len(samples.RECORDS))
    own = {"ten": _after("ten", F.col("p_name")), "ho_so": _after("ho_so", F.col("p_brand")), "thoi_gian": _after("thoi_gian", F.col("p_size").cast("string"))}
    return part.join(F.broadcast(some), "kind").withColumns(own).select(F.col("p_partkey").alias("row_id"), *catalogue.FIELDS)


def in_turn(spark, sf_dir, lines: list[str], tail: Column) -> DataFrame:
    """id, line: a line for each part, one of a list in turn, with a tail of the part's own."""
    some = spark.createDataFrame(list(enumerate(lines)), "kind long, line string")
    part = table(spark, sf_dir, "part").withColumn("kind", F.col("p_partkey") % len(lines))
    return part.join(F.broadcast(some), "kind").select(F.col("p_partkey").alias("id"), F.concat("line", tail).alias("line"))


def sql_in_turn(lines: list[str], tail: str) -> str:
    return f"(SELECT p_partkey AS id, line || {tail} AS line FROM part JOIN {values(list(enumerate(lines)), 'kind, line')} ON p_partkey % {len(lines)} = kind)"


def lines(spark, sf_dir) -> DataFrame:
    days = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(" ngày)"))).otherwise("")
    return in_turn(spark, sf_dir, samples.LINES, days)


LINES = sql_in_turn(samples.LINES, "CASE WHEN p_partkey % 3 = 0 THEN ' (' || p_size || ' ngày)' ELSE '' END")


# Text.


@query(f"SELECT doc_id, {sql_fold('text')} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {sql_strip_marks('text')} <> text AS marked FROM documents")
def has_diacritics(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", has_marks(F.col("text")).alias("marked"))


@query(f"SELECT qid, {sql_strip_marks('text')} AS bare FROM {SAID}")
def strip_diacritics(spark, sf_dir):
    return said(spark, sf_dir).select("qid", strip_marks(F.col("text")).alias("bare"))


def _sql_abbreviate(c: str) -> str:
    out = f"lower({c})"
    for a, b in ABBREVIATIONS:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return out


@query(f"SELECT qid, {_sql_abbreviate('text')} AS short FROM {SAID}")
def abbrev(spark, sf_dir):
    return said(spark, sf_dir).select("qid", abbreviate(F.col("text")).alias("short"))


@query(f"SELECT qid, array_to_string({sql_content('text')}, ' ') AS content FROM {SAID}")
def tokenize_stopwords(spark, sf_dir):
    return said(spark, sf_dir).select("qid", F.array_join(content_tokens(F.col("text")), " ").alias("content"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({sql_tokens('text')})) AS term FROM documents) GROUP BY 1")
def term_stats(spark, sf_dir):
    return lexical.term_stats(lexical.tokenised(rows_of(spark, sf_dir)))


# Retrieval.


SQL_BM25 = f"WITH d AS (SELECT doc_id AS row_id, text FROM documents), qq AS (SELECT item_id AS qid, text FROM benchmark), {sql_bm25('d', 'qq')} SELECT qid, row_id, round(score, 6) AS score, round(bm25_norm, 6) AS bm25_norm, rank FROM lex"


@query(SQL_BM25)
def bm25_topk(spark, sf_dir):
    hits = lexical.bm25(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), rows_of(spark, sf_dir))
    return hits.withColumns({"score": F.round("score", 6), "bm25_norm": F.round("bm25_norm", 6)})


@query(SQL_BM25)
def bm25_stored(spark, sf_dir):
    hits = lexical_index.search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), lexical_index.build(rows_of(spark, sf_dir)))
    return hits.withColumns({"score": F.round("score", 6), "bm25_norm": F.round("bm25_norm", 6)})


@query(f"WITH {V}, {Q}, {KNN} SELECT qid, row_id, view, vec_id, round(similarity, 6) AS similarity, pos FROM knn")
def dense_knn(spark, sf_dir):
    return dense.knn(asked(spark, sf_dir), views_of(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query()
def dense_knn_lsh(spark, sf_dir):
    return dense.knn_lsh(asked(spark, sf_dir), views_of(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query()
def dense_knn_ivf(spark, sf_dir):
    views = views_of(spark, sf_dir)
    hits = vector_index.search(asked(spark, sf_dir), vector_index.build(views.select(F.col("vec_id").alias("id"), "v")))
    return hits.join(views.select("vec_id", "row_id", "view"), "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {V}, {Q}, {KNN}, {ROLL} SELECT qid, row_id, round(dense_similarity, 6) AS dense_similarity, best_view, rank FROM roll")
def dense_rollup(spark, sf_dir):
    return dense.roll_up(dense.knn(asked(spark, sf_dir), views_of(spark, sf_dir))).withColumn("dense_similarity", F.round("dense_similarity", 6))


CENTERS = "m AS (SELECT label, i, avg(v[i]) AS m FROM v, generate_series(1, 64) AS g(i) GROUP BY 1, 2), c AS (SELECT label, list(m / n ORDER BY i) AS centroid FROM m JOIN (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY 1) USING (label) GROUP BY 1)"


@query(f"WITH {V}, {CENTERS} SELECT label, i AS pos, round(centroid[i], 6) AS x FROM c, generate_series(1, 64) AS g(i)")
def centroids(spark, sf_dir):
    return dense.centroids(views_of(spark, sf_dir).select("label", "v")).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {V}, {CENTERS} SELECT vec_id, c.label AS nearest, round(list_cosine_similarity(v, centroid), 6) AS similarity FROM v, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(v, centroid), 9) DESC, c.label) = 1")
def nearest_centroid(spark, sf_dir):
    views = views_of(spark, sf_dir)
    return dense.nearest_centroid(views, dense.centroids(views.select("label", "v"))).withColumn("similarity", F.round("similarity", 6))


def _hybrid(spark, sf_dir, rows: DataFrame) -> DataFrame:
    ask = asked(spark, sf_dir)
    return fusion.hybrid(ask, dense.roll_up(dense.knn(ask, views_of(spark, sf_dir))), lexical.bm25(ask, rows), rows)


def _fusion(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return _hybrid(spark, sf_dir, rows).select("qid", "row_id", F.round("fusion_score", 6).alias("fusion_score"), "fused_rank", F.array_join("sources", ",").alias("sources"))


def _confidence(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return _hybrid(spark, sf_dir, rows).select("qid", "row_id", "best_view", F.round("dense_similarity", 6).alias("dense_similarity"), F.round("bm25_norm", 6).alias("bm25_norm"), F.round("confidence", 6).alias("confidence"), "final_rank")


def _tiers(spark, sf_dir, rows: DataFrame) -> DataFrame:
    titles = rows.select("row_id", first_words(F.col("text")).alias("title"))
    return fusion.decide_tier(asked(spark, sf_dir), _hybrid(spark, sf_dir, rows), titles).withColumn("confidence", F.round("confidence", 6))


def _options(spark, sf_dir, rows: DataFrame) -> DataFrame:
    titles = rows.select("row_id", first_words(F.col("text")).alias("ten"), F.lit("Cấp Xã").alias("cap_thuc_hien"), F.lit("").alias("le_phi"))
    return answers.options(_hybrid(spark, sf_dir, rows).join(titles, "row_id"))


SQL_FUSION = f"WITH {HYBRID} SELECT qid, row_id, round(fusion_score, 6) AS fusion_score, fused_rank, CASE WHEN dr IS NULL THEN 'bm25' WHEN lr IS NULL THEN 'dense' ELSE 'dense,bm25' END AS sources FROM fused"


@query(SQL_FUSION)
def rrf_fusion(spark, sf_dir):
    return _fusion(spark, sf_dir, rows_of(spark, sf_dir))


@query(SQL_FUSION)
def rrf_fusion_all(spark, sf_dir):
    return rrf_fusion(spark, sf_dir)


SQL_CONFIDENCE = f"WITH {HYBRID} SELECT qid, row_id, best_view, round(dense_similarity, 6) AS dense_similarity, round(bm25_norm, 6) AS bm25_norm, round(confidence, 6) AS confidence, final_rank FROM conf"


@query(SQL_CONFIDENCE)
def hybrid_confidence(spark, sf_dir):
    return _confidence(spark, sf_dir, rows_of(spark, sf_dir))


@query(SQL_CONFIDENCE)
def hybrid_confidence_all(spark, sf_dir):
    return hybrid_confidence(spark, sf_dir)


SQL_TITLE = rf"array_to_string((string_split_regex({sql_strip('text')}, '\s+'))[1:6], ' ')"
SQL_TOPIC = "(" + " OR ".join(f"({contains_any('lower(title)', w)} AND {contains_any('lower(next_title)', w)})" for w in fusion.TOPICS) + ")"


SQL_TIERS = f"""WITH {HYBRID}, t AS (SELECT conf.*, {SQL_TITLE} AS title FROM conf JOIN cat USING (row_id)),
n AS (SELECT *, lead(confidence) OVER w AS nc, lead(title) OVER w AS next_title FROM t WINDOW w AS (PARTITION BY qid ORDER BY final_rank)),
o AS (SELECT qid, round(confidence, 6) AS confidence, CASE WHEN round(dense_similarity, 9) < 0.35 OR round(confidence, 9) < 0.35 THEN 'C' WHEN round(confidence, 9) >= 0.40 AND round(dense_similarity, 9) >= 0.38
  THEN CASE WHEN nc IS NOT NULL AND round(confidence - nc, 9) < 0.03 AND title <> next_title AND NOT {SQL_TOPIC} THEN 'B' ELSE 'A' END ELSE 'B' END AS tier FROM n WHERE final_rank = 0)
SELECT qid, coalesce(tier, 'C') AS tier, coalesce(confidence, 0) AS confidence FROM qq LEFT JOIN o USING (qid)"""


@query(SQL_TIERS)
def tier_decision(spark, sf_dir):
    return _tiers(spark, sf_dir, rows_of(spark, sf_dir))


@query(SQL_TIERS)
def tier_decision_all(spark, sf_dir):
    return tier_decision(spark, sf_dir)


SQL_OPTIONS = f"""WITH {HYBRID}, t AS (SELECT qid, final_rank, {SQL_TITLE} AS title FROM conf JOIN cat USING (row_id))
SELECT qid, {q(answers.OPTIONS_HEAD)} || chr(10) || string_agg((final_rank + 1) || '. **' || title || '** (Cấp Xã)', chr(10) ORDER BY final_rank) || chr(10) || {q(answers.OPTIONS_TAIL)} AS answer FROM t GROUP BY 1"""


@query(SQL_OPTIONS)
def tier_b_options(spark, sf_dir):
    return _options(spark, sf_dir, rows_of(spark, sf_dir))


@query(SQL_OPTIONS)
def tier_b_options_all(spark, sf_dir):
    return tier_b_options(spark, sf_dir)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN x BETWEEN 0 AND 1 THEN x ELSE 1 / (1 + exp(-greatest(-30, least(30, x)))) END, 6) AS s FROM (SELECT l_orderkey, l_linenumber, l_quantity - 25 + l_discount AS x FROM lineitem)")
def sigmoid_clip(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(clipped_sigmoid(F.col("l_quantity") - 25 + F.col("l_discount")), 6).alias("s"))


# Rules.

SQL_S = sql_strip("lower(coalesce(text, ''))")
SQL_CLEAN = sql_strip(rf"regexp_replace({SQL_S}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')")
SQL_WORDS = rf"list_filter(string_split_regex({SQL_CLEAN}, '\s+'), lambda x: x <> '')"
SQL_TALK = f"""CASE WHEN length({SQL_S}) <= 1 THEN 'hello' WHEN {contains_any(SQL_CLEAN, rules.WHO)} THEN 'who' WHEN {contains_any(SQL_CLEAN, rules.THANKS)} THEN 'thanks' WHEN {contains_any(SQL_CLEAN, rules.BYE)} THEN 'bye'
WHEN {SQL_CLEAN} IN ({", ".join(map(q, rules.GREETINGS))}) OR (len({SQL_WORDS}) <= 3 AND coalesce(({SQL_WORDS})[1], '') IN ({", ".join(map(q, rules.OPENINGS))})) THEN 'hello' END"""
SQL_SPECIAL = "CASE " + " ".join("WHEN " + " AND ".join(contains_any("lower(text)", g) for g in groups) + f" THEN {q(rule)}" for rule, _, groups in rules.SPECIAL_RULES) + " END"
SQL_SPECIAL_TIER = "CASE " + " ".join("WHEN " + " AND ".join(contains_any("lower(text)", g) for g in groups) + f" THEN {q(tier)}" for _, tier, groups in rules.SPECIAL_RULES) + " END"
SQL_TRAFFIC = contains_any("lower(text)", rules.TRAFFIC)
SQL_RULE = "CASE " + " ".join(f"WHEN {contains_any('lower(text)', k)} THEN {q(r)}" for r, k in rules.TRAFFIC_RULES) + " END"


@query(f"SELECT qid, {SQL_TALK} AS talk FROM {SAID}")
def smalltalk_gate(spark, sf_dir):
    return said(spark, sf_dir).select("qid", rules.small_talk(F.col("text")).alias("talk"))


@query(f"SELECT qid, {SQL_SPECIAL} AS rule, CASE WHEN {SQL_SPECIAL} = 'utilities' THEN CASE WHEN contains(lower(text), 'điện') THEN 'tiền điện' WHEN contains(lower(text), 'nước') THEN 'tiền nước' ELSE {q(rules.OTHER_UTILITY)} END END AS about FROM {SAID}")
def special_rules(spark, sf_dir):
    rule = rules.special(F.col("text"))
    return said(spark, sf_dir).select("qid", rule.alias("rule"), F.when(rule == "utilities", rules.utility(F.col("text"))).alias("about"))


@query(f"SELECT qid, {SQL_TRAFFIC} AS traffic FROM {SAID}")
def traffic_gate(spark, sf_dir):
    return said(spark, sf_dir).select("qid", rules.is_traffic(F.col("text")).alias("traffic"))


@query(f"SELECT * FROM (SELECT qid, {SQL_RULE} AS rule FROM {SAID}) WHERE rule IS NOT NULL")
def rule_first_match(spark, sf_dir):
    return rules.first_rule(said(spark, sf_dir), rules.rule_table(spark))


@query(rf"SELECT qid, {contains_any(sql_strip('lower(text)'), rules.SITUATION)} OR len(list_filter(string_split_regex({sql_strip('lower(text)')}, '\s+'), lambda x: x <> '')) >= 4 AS situational FROM {SAID}")
def situational_query(spark, sf_dir):
    return said(spark, sf_dir).select("qid", rules.is_situational(F.col("text")).alias("situational"))


@query(f"SELECT qid, CASE WHEN {SQL_TALK} IS NOT NULL THEN 'SMALLTALK' WHEN {SQL_SPECIAL} IS NOT NULL THEN {SQL_SPECIAL_TIER} WHEN {SQL_TRAFFIC} THEN 'TRAFFIC' ELSE 'RETRIEVE' END AS route FROM {SAID}")
def route_cascade(spark, sf_dir):
    return routed(said(spark, sf_dir)).select("qid", "route")


# Catalogue.

def _sql_after(c: str, tail: str) -> str:
    return f"CASE WHEN {c} = '' THEN '' ELSE {c} || ' ' || {tail} END AS {c}"


_own = {"ten": _sql_after("ten", "p_name"), "ho_so": _sql_after("ho_so", "p_brand"), "thoi_gian": _sql_after("thoi_gian", "p_size")}
REC = f"(SELECT p_partkey AS row_id, {', '.join(_own.get(c, c) for c in catalogue.FIELDS)} FROM part JOIN {values(samples.RECORDS, 'kind, ' + ', '.join(catalogue.FIELDS))} ON p_partkey % {len(samples.RECORDS)} = kind)"


def _sql_scrub(c: str) -> str:
    out = sql_strip(f"coalesce({c}, '')")
    for pattern, text in catalogue.LOCAL_NAMES:
        out = f"regexp_replace({out}, {q('(?i)' + pattern)}, {q(text)}, 'g')"
    return sql_strip(out)


SQL_CATALOGUE = f"""(SELECT row_id, ten, linh_vuc, cap_thuc_hien, CASE WHEN {contains_any("lower(co_quan0)", ["tăng nhơn phú", "lê văn việt"])} THEN 'UBND Cấp Xã/Phường nơi cư trú' ELSE co_quan0 END AS co_quan, ho_so, thoi_gian, le_phi,
CASE WHEN {contains_any("lower(dia_diem0)", ["tăng nhơn phú", "lê văn việt"])} THEN {q(catalogue.ANY_DESK)} ELSE dia_diem0 END AS dia_diem, gio_cat_off, can_cu_phap_ly, nguon_url, ma_thu_tuc
FROM (SELECT *, coalesce(nullif(dia_diem, ''), {q(catalogue.ANY_DESK)}) AS dia_diem0, coalesce(nullif(co_quan, ''), cap_thuc_hien) AS co_quan0 FROM (SELECT row_id, {", ".join(f"{_sql_scrub(c)} AS {c}" for c in catalogue.FIELDS)} FROM {REC}) WHERE ten <> ''))"""


@query(f"SELECT * FROM {SQL_CATALOGUE}")
def column_defaults(spark, sf_dir):
    return catalogue.normalise(records(spark, sf_dir).withColumnRenamed("ten", "ten_thu_tuc")).select("row_id", *catalogue.FIELDS)


SCRUBBED = ["Nộp tại phường Tăng Nhơn Phú", "TTPVHCC PHƯỜNG TĂNG NHƠN PHÚ", "Số 29 Lê Văn Việt", "Trung tâm Phục vụ Hành chính công Phường Tăng Nhơn Phú, Địa chỉ: số 29 Lê Văn Việt", "Khám ở Bệnh viện Tâm thần. Địa chỉ: 766 Võ Văn Kiệt, TP.HCM)", " không đổi "]


@query(f"SELECT id, {_sql_scrub('line')} AS scrubbed FROM {sql_in_turn(SCRUBBED, 'chr(32) || p_name')}")
def scrub_refs(spark, sf_dir):
    return in_turn(spark, sf_dir, SCRUBBED, F.concat(F.lit(" "), F.col("p_name"))).select("id", catalogue.scrub(F.col("line")).alias("scrubbed"))


SQL_SITUATION = sql_strip("'Thủ tục: ' || ten || '. Tình huống thực tế đời thường của người dân: ' || concat_ws(' ', " + ", ".join(f"CASE WHEN {contains_any('lower(ten || chr(32) || linh_vuc)', w)} THEN {q(t)} END" for w, t in catalogue.SITUATIONS) + ")")


def _sql_label(label: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN {q(label)} || {c} END"


SQL_VIEWS = {
    "title": f"concat_ws('. ', 'Thủ tục: ' || ten, {_sql_label('Lĩnh vực: ', 'linh_vuc')}, {_sql_label('Cấp thực hiện: ', 'cap_thuc_hien')})",
    "summary": f"concat_ws('. ', 'Thủ tục: ' || ten, {_sql_label('Thời gian giải quyết: ', 'thoi_gian')}, {_sql_label('Lệ phí: ', 'le_phi')}, {_sql_label('Địa điểm tiếp nhận: ', 'dia_diem')}, {_sql_label('Giờ tiếp nhận / Cắt hồ sơ: ', 'gio_cat_off')})",
    "docs": "CASE WHEN ho_so = '' THEN 'Thủ tục: ' || ten || '. Căn cứ pháp lý: ' || can_cu_phap_ly ELSE 'Thủ tục: ' || ten || '. Thành phần hồ sơ cần chuẩn bị: ' || ho_so END",
    "situational": SQL_SITUATION,
}


@query(" UNION ALL ".join(f"SELECT row_id || '::{v}' AS id, row_id, '{v}' AS view, {s} AS document FROM {SQL_CATALOGUE}" for v, s in SQL_VIEWS.items()))
def multi_view(spark, sf_dir):
    return catalogue.build_views(catalogue.normalise(records(spark, sf_dir)))


SQL_PARTS = "(SELECT p_partkey AS row_id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' khai sinh' WHEN 1 THEN ' cư trú, đất đai' WHEN 2 THEN ' CCCD' ELSE '' END AS ten, p_type AS linh_vuc FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, [" khai sinh", " cư trú, đất đai", " CCCD", "", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    blank = {c: F.lit("") for c in catalogue.FIELDS if c not in ("ten", "linh_vuc")}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat("p_name", tail).alias("ten"), F.col("p_type").alias("linh_vuc"), *[c.alias(n) for n, c in blank.items()])


@query(f"SELECT row_id, {SQL_SITUATION} AS document FROM {SQL_PARTS}")
def situational_expand(spark, sf_dir):
    return _parts(spark, sf_dir).select("row_id", catalogue.situational().alias("document"))


@query(f"SELECT row_id, ten || ' ' || ten || ' ' || {SQL_SITUATION} || ' ' || linh_vuc AS document FROM {SQL_PARTS}")
def lexical_doc(spark, sf_dir):
    return _parts(spark, sf_dir).select("row_id", catalogue.lexical_text().alias("document"))


def _sql_text(t: str, **names: str) -> str:
    """A text with {name} pieces as SQL that puts columns or other SQL in their places."""
    pieces = re.split(r"\{(\w+)\}", t)
    return " || ".join(names[x] if i % 2 else q(x) for i, x in enumerate(pieces) if i % 2 or x)


def _sql_intro(t: str) -> str:
    return _sql_text(t.replace("%s", "{ten}", 1).replace("%s", "{cap}", 1), ten="ten", cap="cap_thuc_hien")


def _sql_or(c: str) -> str:
    return f"coalesce(nullif({c}, ''), {q(answers.DEFAULTS[c])})"


_closed = [(label, "`" if label.endswith("`") else "**" if label.endswith(" **") else "") for label in answers.LABELS]
_values = ["ten", *map(_sql_or, ["ma_thu_tuc", "linh_vuc", "cap_thuc_hien", "thoi_gian", "le_phi"]), f"coalesce(nullif({_sql_scrub('dia_diem')}, ''), {q(catalogue.ANY_DESK)})", "nullif(gio_cat_off, '')"]
# The pieces of ho_so are known for each kind of record: its last one ends with the part's brand.
SQL_DOCS = f"CASE row_id % 5 WHEN 0 THEN '  * Tờ khai' || chr(10) || '  * giấy tờ (bản sao, bản chính)' || chr(10) || '  * ảnh ' || p_brand WHEN 1 THEN {q(answers.NO_DOCS)} WHEN 3 THEN '  * Tờ khai ' || p_brand ELSE '  * Hợp đồng' || chr(10) || '  * căn cước ' || p_brand END"


@query(f"""SELECT row_id, question, CASE question WHEN 'kết hôn cần gì' THEN {_sql_intro(answers.INTROS[1][1])} WHEN 'làm cccd' THEN {q(answers.INTROS[3][1])} WHEN 'thủ tục này nộp ở đâu' THEN {_sql_intro(answers.SITUATION_INTRO)} ELSE '' END
|| concat_ws(chr(10), {", ".join(f"{q(a)} || {v} || {q(b)}" for (a, b), v in zip(_closed, _values, strict=True))}, {q(answers.DOCS_HEAD)}, {SQL_DOCS}, {q(answers.LAW)} || nullif(can_cu_phap_ly, '') || '*', {q(answers.LINK)} || nullif(nguon_url, '') || ')') AS answer
FROM (SELECT *, (['kết hôn cần gì', 'làm cccd', 'x y', 'thủ tục này nộp ở đâu', ''])[CAST(row_id // 5 % 5 AS INT) + 1] AS question FROM {SQL_CATALOGUE} JOIN part ON p_partkey = row_id)""")
def tier_a_card(spark, sf_dir):
    asks = F.element_at(F.array(*map(F.lit, ["kết hôn cần gì", "làm cccd", "x y", "thủ tục này nộp ở đâu", ""])), (F.floor(F.col("row_id") / 5) % 5 + 1).cast("int"))
    return catalogue.normalise(records(spark, sf_dir)).withColumn("question", asks).select("row_id", "question", answers.card(F.col("question")).alias("answer"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_brand || '|' || p_name || ' (' || p_type || ', ' || p_size || ')|e' WHEN 1 THEN p_brand WHEN 2 THEN '' ELSE p_name || ' (' || p_brand || '|o (' || p_size || ')|q' END AS pieces FROM part")
def dossier_split(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    line = F.when(k == 0, F.concat("p_brand", F.lit(", "), "p_name", F.lit(" ("), "p_type", F.lit(", "), size, F.lit(") ,e"))).when(k == 1, F.col("p_brand")).when(k == 2, "").otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(", o ("), size, F.lit("), q")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(outside_parentheses(line), "|").alias("pieces"))


@query(f"SELECT qid, {' '.join(['CASE'] + [f"WHEN upper(tier) = {q(t)} THEN {q(x)}" for t, x in answers.TIER_LABELS.items()])} WHEN coalesce(tier, '') = '' THEN '' ELSE 'Tầng ' || tier END AS label FROM (SELECT qid, (['A', 'tier_b', 'C', 'Traffic', 'ngoai', 'XAGIAO', 'X', '', NULL])[CAST(qid % 9 AS INT) + 1] AS tier FROM {SAID})")
def tier_labels(spark, sf_dir):
    tier = F.element_at(F.array(*map(F.lit, ["A", "tier_b", "C", "Traffic", "ngoai", "XAGIAO", "X", "", None])), (F.col("qid") % 9 + 1).cast("int"))
    return said(spark, sf_dir).select("qid", answers.tier_label(tier).alias("label"))


@query(f"SELECT qid, {q(answers.TRAFFIC_SYSTEM)} AS system, text AS user FROM {SAID} WHERE {SQL_TRAFFIC}")
def traffic_prompts(spark, sf_dir):
    m = said(spark, sf_dir).where(rules.is_traffic(F.col("text"))).select("qid", answers.traffic_messages(F.col("text")).alias("m"))
    return m.select("qid", F.element_at("m", 1)["content"].alias("system"), F.element_at("m", 2)["content"].alias("user"))


@query(f"""WITH h AS (SELECT page_id // 5 AS qid, string_agg('- **' || url || '**: body ' || page_id, chr(10) ORDER BY page_id) FILTER (page_id % 3 <> 0 AND page_id % 5 < 4) AS context FROM pages GROUP BY 1)
SELECT qid, replace(replace({q(answers.WEB_PROMPT)}, '{{context}}', coalesce(context, {q(answers.NO_CONTEXT)})), '{{question}}', 'q ' || qid) AS prompt FROM h""")
def web_prompts(spark, sf_dir):
    k = F.col("page_id")
    hits = table(spark, sf_dir, "pages").select(F.floor(k / 5).alias("qid"), (k % 5).alias("pos"), F.col("url").alias("title"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" body "), k.cast("string"))).alias("body"))
    asks = hits.select("qid").distinct().withColumn("text", F.concat(F.lit("q "), F.col("qid").cast("string")))
    return asks.join(answers.web_context(hits), "qid", "left").select("qid", answers.web_prompt(F.col("text"), F.col("context")).alias("prompt"))


@query(f"SELECT row_id, 'Thủ tục: ' || ten || '. ' || substr({SQL_SITUATION}, 1, 120) || '. ' || substr('Thủ tục: ' || ten, 1, 80) AS passage FROM {SQL_PARTS}")
def rerank_passages(spark, sf_dir):
    return _parts(spark, sf_dir).select("row_id", fusion.passage(F.col("ten"), catalogue.situational(), catalogue.view_columns()["summary"]).alias("passage"))


ANSWERS = ["", "Đến phường Tăng Nhơn Phú, mã ", "Trả lời ", "Số 29 Lê Văn Việt, "]


@query(f"SELECT id, {_sql_scrub('CASE WHEN id % 4 = 0 THEN ' + q('Chưa có câu trả lời tại phường Tăng Nhơn Phú') + ' ELSE line END')} AS answer FROM {sql_in_turn(ANSWERS, 'p_name')}")
def fallback_answers(spark, sf_dir):
    model = F.when(F.col("id") % 8 == 0, None).when(F.col("id") % 4 == 0, "").otherwise(F.col("line"))
    return in_turn(spark, sf_dir, ANSWERS, F.col("p_name")).select("id", answers.answered(model, "Chưa có câu trả lời tại phường Tăng Nhơn Phú").alias("answer"))


def _passage_lengths(q_: pd.Series, p: pd.Series) -> pd.Series:
    return p.str.len().astype(float)


@query(f"SELECT qid, row_id, final_rank, CASE WHEN {sql_strip_marks('question')} <> question THEN CAST(length(passage) AS DOUBLE) END AS rerank_score FROM (SELECT conv_id AS qid, turn AS row_id, turn AS final_rank, CASE WHEN turn % 2 = 0 THEN 'đá' ELSE 'da' END AS question, text AS passage FROM conversations)")
def rerank_display(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    ranked = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("row_id"), F.col("turn").alias("final_rank"))
    texts = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("row_id"), F.when(F.col("turn") % 2 == 0, "đá").otherwise("da").alias("question"), F.col("text").alias("passage"))
    return fusion.with_rerank(ranked, texts, F.pandas_udf(_passage_lengths, "double")).select("qid", "row_id", "final_rank", "rerank_score")


def _lengths_and_spaces():
    return lambda texts: [[len(t), t.count(" ")] for t in texts]


@query("SELECT doc_id AS row_id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b FROM documents")
def embed_texts(spark, sf_dir):
    e = dense.embed(rows_of(spark, sf_dir), _lengths_and_spaces)
    return e.select("row_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))


# Extraction.

SQL_LEVELS = "concat_ws(' / ', " + ", ".join(f"CASE WHEN {contains_any('lower(line)', w)} THEN {q(n)} END" for n, w in extract.LEVELS) + ")"


@query(f"SELECT id, CASE WHEN {SQL_LEVELS} = '' THEN 'Cấp Tỉnh' ELSE 'Cấp ' || {SQL_LEVELS} END AS level FROM {LINES}")
def admin_level(spark, sf_dir):
    return lines(spark, sf_dir).select("id", extract.admin_level(F.col("line"), F.lit("")).alias("level"))


# The last number between marks that are no letters: RE2 has no word boundary for letters beyond ASCII.
SQL_LAST = r"regexp_extract(line, '(?s)^(?:.*[^\p{L}\p{N}_])?(\d+)(?:[^\p{L}\p{N}_].*)?$', 1)"


@query(f"SELECT id, CASE WHEN {contains_any('lower(line)', extract.SAME_DAY)} THEN 1 ELSE TRY_CAST({SQL_LAST} AS DOUBLE) END AS days FROM {LINES}")
def duration_days(spark, sf_dir):
    return lines(spark, sf_dir).select("id", extract.duration_days(F.col("line")).cast("double").alias("days"))


@query(rf"SELECT id, CASE WHEN {contains_any('lower(line)', extract.FREE)} THEN 0 ELSE TRY_CAST(replace(regexp_extract(line, '(\d{{1,3}}(?:\.\d{{3}})+)', 1), '.', '') AS DOUBLE) END AS vnd FROM {LINES}")
def fee_vnd(spark, sf_dir):
    return lines(spark, sf_dir).select("id", extract.fee_vnd(F.col("line")).cast("double").alias("vnd"))


# Texts made from parts: the answers follow from the columns, in SQL without any of the patterns.
SQL_DURATION = """CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size = m THEN printf('%02d ngày làm việc', m) ELSE printf('Từ %02d - %02d ngày làm việc', least(p_size, m), greatest(p_size, m)) END
WHEN 1 THEN 'Theo quy định hiện hành' WHEN 2 THEN 'Giải quyết ngay trong ngày làm việc' WHEN 3 THEN CASE WHEN p_size = m THEN printf('%02d ngày; 02 tháng', m) ELSE printf('Từ %02d - %02d ngày; 02 tháng', least(p_size, m), greatest(p_size, m)) END
WHEN 4 THEN printf('%02d ngày làm việc', m) ELSE printf('%02d giờ', p_size) END"""


@query(f"SELECT p_partkey AS id, {SQL_DURATION} AS duration FROM (SELECT *, CAST(p_partkey % 29 + 1 AS INT) AS m FROM part)")
def duration_format(spark, sf_dir):
    k, a, b = F.col("p_partkey") % 6, F.col("p_size").cast("string"), (F.col("p_partkey") % 29 + 1).cast("string")
    text = (
        F.when(k == 0, F.concat(a, F.lit(" ngày làm việc|Không quá "), b, F.lit(" Ngày làm việc: "))).when(k == 1, F.concat(F.lit("giờ hành chính|"), "p_name")).when(k == 2, F.concat(F.lit("giải quyết ngay|"), a, F.lit(" ngày")))
        .when(k == 3, F.concat(a, F.lit(" ngày|2 tháng|"), b, F.lit(" ngày, cụ thể như sau: 99 ngày"))).when(k == 4, F.concat(F.lit("xác minh mất giấy|xác minh trong thời hạn "), b, F.lit(" ngày làm việc"))).otherwise(F.concat(a, F.lit(" giờ")))
    )
    found = F.filter(F.transform(F.split(text, r"\|"), extract.duration_info), lambda x: x.isNotNull())
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), extract.format_durations(found).alias("duration"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Miễn phí' WHEN 1 THEN 'Không thu lệ phí ' || p_size WHEN 2 THEN 'Miễn phí (Không thu lệ phí)' WHEN 3 THEN CASE WHEN p_size = 20 THEN '20.000 đồng' ELSE p_size || '.000 đồng; 20.000 đồng' END
WHEN 4 THEN 'Chưa quy định (hoặc theo quy định Bộ Tài chính)' ELSE p_size || '.000đ; ' || p_brand END AS fee FROM part""")
def clean_fee(spark, sf_dir):
    k, n, some = F.col("p_partkey") % 6, F.col("p_size").cast("string"), F.lit
    fee = F.when(k == 0, some("Không")).when(k == 1, F.concat(some("Không thu lệ phí "), n)).when(k == 2, some("không có")).when(k == 3, F.concat(n, some(".000 đồng"))).when(k == 4, some("Chưa quy định")).otherwise(some("Trực tiếp  Trực tuyến"))
    charge = F.when(k == 1, F.concat(some("Không thu lệ phí  "), n)).when(k == 2, F.concat(some("Miễn phí "), n, some(" ngày làm việc"))).when(k == 3, F.concat(n, some(".000 Đồng; 20.000 đồng"))).when(k == 4, some("Trực tiếp")).when(k == 5, F.concat(n, some(".000đ\n\n"), "p_brand", some(";")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), extract.clean_fee(fee, charge).alias("fee"))


@query(f"SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Luật ' || p_type WHEN 1 THEN 'Nghị định ' || p_size || '; Thông tư ' || p_brand WHEN 2 THEN 'Theo luật ' || p_name ELSE {q(extract.NO_LAW)} END AS law FROM part")
def legal_basis(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    page = (
        F.when(k == 0, F.concat(F.lit("<ul><li>+ Luật "), "p_type", F.lit(" Số: 68/2020/QH14</li><li>- luật "), F.lower("p_type"), F.lit("</li><li>abc</li></ul>"))).when(k == 1, F.concat(F.lit("<p>Nghị định <b>"), n, F.lit("</b></p><p>Thông tư "), "p_brand", F.lit("</p>")))
        .when(k == 2, F.concat(F.lit("<div>Theo luật  "), "p_name", F.lit("</div>"))).otherwise("<div>a</div>")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), extract.legal_basis(page).alias("law"))


@query(f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Tờ khai mẫu ' || p_brand || ', Hộ chiếu ' || p_size WHEN 1 THEN 'Đơn đề nghị ' || p_name || ', Bản sao giấy tờ' ELSE {q(extract.NO_DOSSIER)} END AS items FROM part")
def dossier_items(spark, sf_dir):
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    page = (
        F.when(k == 0, F.concat(F.lit("<table><tr><th>Tên giấy tờ</th></tr><tr><td>- Tờ khai mẫu "), "p_brand", F.lit(";</td><td>1</td></tr><tr><td>tờ khai  mẫu "), F.lower("p_brand"), F.lit("</td></tr><tr><td>Hộ chiếu "), n, F.lit(".</td></tr></table>")))
        .when(k == 1, F.concat(F.lit("<p>Thành phần hồ sơ:</p><p>a) Đơn đề nghị "), "p_name", F.lit(";</p><p>2. Bản sao giấy tờ.</p><p>ngắn</p>"))).otherwise("<p></p>")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), extract.dossier(page).alias("items"))


@query("""WITH l AS (SELECT page_id // 20 + 1 AS page, page_id FROM pages WHERE page_id // 20 % 6 <> 5), last AS (SELECT max(page_id) // 20 + 1 AS n FROM pages),
k AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY page_id) - 1 AS place, '/tthc?matt=' || page_id AS href, 'Trang ' || page_id || ' & <b>' AS title FROM l WHERE page_id % 3 <> 0)
SELECT CAST(page AS INT) AS page, CAST(place AS INT) AS place, href, title, NULL AS error FROM k WHERE place < 10
UNION ALL SELECT CAST(i AS INT), -1, NULL, NULL, CASE WHEN i IN (SELECT page FROM l) THEN 'no links' ELSE 'no answer' END FROM (SELECT unnest(range(1, n + 1)) AS i FROM last) WHERE i NOT IN (SELECT page FROM k)""")
def crawl_lists(spark, sf_dir):
    # List pages of twenty links as saved files; every sixth is missing, and of each ten links are taken.
    k, pages = F.col("page_id"), table(spark, sf_dir, "pages")
    page, href = (F.floor(k / 20) + 1).cast("int"), F.when(k % 3 == 0, "/khac?x=").otherwise("/tthc?matt=")
    links = pages.where(F.floor(k / 20) % 6 != 5).select(page.alias("page"), k, F.concat(F.lit('<li><a class=x href="'), href, k.cast("string"), F.lit('"> <i>Trang '), k.cast("string"), F.lit(" &amp; &lt;b&gt;</i></a>")).alias("line"))
    html = links.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda x: x["line"]), "").alias("value"))
    folder = shared_path(spark, "lists")
    html.write.partitionBy("page").text(folder)
    spark.dataSource.register(ListPages)
    last = pages.agg(F.floor(F.max(k) / 20) + 1).first()[0] or 0
    return spark.read.format("list_pages").options(path=folder, max_pages=last, max_items=10, link="tthc?matt=").load().withColumn("place", F.coalesce("place", F.lit(-1)))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_brand ELSE 'Thành phần hồ sơ ' || p_size END AS items FROM part")
def comma_lists(spark, sf_dir):
    even = F.concat(F.lit("1. "), "p_name", F.lit(";\r\nThành phần hồ sơ:\n- "), "p_brand", F.lit(".\n\n"))
    text = F.when(F.col("p_partkey") % 2 == 0, even).otherwise(F.concat(F.lit("Thành phần hồ sơ "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), extract.comma_list(text).alias("items"))


def _item(title: str, inner: Column) -> Column:
    return F.concat(F.lit(f'<div class="row tthc-list-item"><a class="item-title">{title} <span>Mở rộng</span></a>\n<div class="tthc-list-item-detail"> '), inner, F.lit(" </div></div>\n"))


def _detail_pages(spark, sf_dir) -> DataFrame:
    k, n, none = F.col("p_partkey"), F.col("p_size").cast("string"), F.lit("")
    office = F.element_at(F.array(*map(F.lit, ["xã", "tỉnh", "phường"])), (k % 3 + 1).cast("int"))
    html = F.concat(
        F.lit('<html><body><nav>Menu</nav><div class="list">'), F.when(k % 4 != 0, _item("Mã thủ tục", F.concat(k.cast("string"), F.lit(".00"), n))).otherwise(none), F.when(k % 5 != 0, _item("Lĩnh vực", F.concat(F.lit("<p>"), "p_type", F.lit("</p>")))).otherwise(none),
        _item("Cơ quan thực hiện", F.concat(F.lit("Công an "), office)), _item("Phí", F.lit("Không")), _item("Lệ Phí", F.when(k % 2 == 0, F.concat(n, F.lit(".000 đồng"))).otherwise("Không")),
        F.when(k % 8 != 0, _item("Thành phần hồ sơ", F.concat(F.lit("<table><tr><td>- Tờ khai "), "p_brand", F.lit(";</td><td>1</td></tr><tr><td>tờ khai "), "p_brand", F.lit("</td></tr><tr><td>"), "p_name", F.lit("</td></tr></table>")))).otherwise(none),
        F.when(k % 6 != 0, _item("Thời hạn giải quyết", F.concat(F.lit("<p>"), n, F.lit(" ngày làm việc</p>")))).otherwise(none), F.when(k % 9 != 0, _item("Căn cứ pháp lý", F.concat(F.lit("<ul><li>+ Luật "), "p_type", F.lit(" Số: 68/2020/QH14</li></ul>")))).otherwise(none), F.lit("</div></body><footer>end</footer></html>"),
    )
    title = F.concat("p_name", F.when(k % 7 == 0, " lưu trú").otherwise(""))
    return table(spark, sf_dir, "part").select(k.alias("page_id"), title.alias("title"), F.concat(F.lit("https://x.vn/tthc?matt="), k.cast("string")).alias("url"), html.alias("html"))


@query(f"""SELECT k AS page_id, CASE WHEN k % 4 <> 0 THEN k || '.00' || p_size ELSE 'BCA-' || k END AS ma_thu_tuc, title AS ten_thu_tuc, CASE WHEN k % 5 <> 0 THEN p_type ELSE {q(extract.NO_FIELD)} END AS linh_vuc,
CASE WHEN k % 3 = 1 THEN 'Cấp Tỉnh' ELSE 'Cấp Xã' END AS cap_thuc_hien, 'Công an ' || (['xã', 'tỉnh', 'phường'])[CAST(k % 3 AS INT) + 1] AS co_quan, CASE WHEN k % 8 <> 0 THEN 'Tờ khai ' || p_brand || ', ' || p_name ELSE {q(extract.NO_DOSSIER)} END AS thanh_phan_ho_so,
CASE WHEN k % 6 <> 0 THEN printf('%02d ngày làm việc', p_size) WHEN k % 7 = 0 THEN {q(extract.TODAY)} ELSE {q(extract.NO_TIME)} END AS thoi_gian_text, CAST(CASE WHEN k % 6 <> 0 THEN p_size WHEN k % 7 = 0 THEN 1 END AS DOUBLE) AS thoi_gian_ngay,
CASE WHEN k % 2 = 0 THEN p_size || '.000 đồng' ELSE 'Miễn phí' END AS le_phi_text, CAST(CASE WHEN k % 2 = 0 THEN p_size * 1000 ELSE 0 END AS DOUBLE) AS le_phi_vnd, CASE WHEN k % 9 <> 0 THEN 'Luật ' || p_type ELSE {q(extract.NO_LAW)} END AS can_cu_phap_ly,
'https://x.vn/tthc?matt=' || k AS nguon_url, '2024-01-31' AS ngay_crawl FROM (SELECT *, p_partkey AS k, p_name || CASE WHEN p_partkey % 7 = 0 THEN ' lưu trú' ELSE '' END AS title FROM part)""")
def detail_records(spark, sf_dir):
    out = extract.page_record(_detail_pages(spark, sf_dir), F.lit(dt.date(2024, 1, 31)))
    return out.withColumns({c: F.col(c).cast("double") for c in ("thoi_gian_ngay", "le_phi_vnd")})


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs FROM pages")
def html_fields(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(html, r'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(html, F.lit("(<p>)"))).cast("long").alias("paragraphs"))


@query()
def page_records(spark, sf_dir):
    html = F.col("html")
    return spread(table(spark, sf_dir, "pages")).select("page_id", extract.legal_basis(html).alias("can_cu_phap_ly"), extract.dossier(html).alias("thanh_phan_ho_so"), extract.resolution_time(html).alias("thoi_gian_text"))


@query(r"SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, CASE WHEN starts_with(path, 'http') THEN path ELSE 'https://x.vn' || path END AS link FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://[^/]*', '') END AS path FROM pages)")
def url_param(spark, sf_dir):
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", r"^https?://[^/]*", ""))
    return table(spark, sf_dir, "pages").select("page_id", extract.url_parameter(F.col("url"), "page").alias("page"), extract.absolute_url(path, "https://x.vn").alias("link"))


@query("SELECT min(page_id) AS page_id, url FROM pages GROUP BY url")
def crawl_dedup(spark, sf_dir):
    return crawled(table(spark, sf_dir, "pages")).select("page_id", "url")


@query("""WITH l AS (SELECT url, min(page_id) AS p FROM pages WHERE page_id // 20 + 1 <= 7 AND page_id % 11 <> 0 GROUP BY 1)
SELECT p // 20 + 1 AS page, p % 20 AS place, url, CASE WHEN p % 5 = 0 THEN 'no answer' WHEN p % 7 = 0 THEN 'HTTP 404' END AS error, CASE WHEN p % 5 = 0 OR p % 7 = 0 THEN 0 ELSE (SELECT length(html) FROM pages WHERE page_id = p) END AS n_chars FROM l""")
def crawl_pages(spark, sf_dir):
    k, first = F.col("page_id"), crawled(table(spark, sf_dir, "pages").where((F.floor(F.col("page_id") / 20) + 1 <= 7) & (F.col("page_id") % 11 != 0)))
    links = table(spark, sf_dir, "pages").select((F.floor(k / 20) + 1).alias("page"), (k % 20).alias("place"), F.col("url").alias("href"), F.when(k % 11 == 0, " ").otherwise("t").alias("title"))
    got = first.where(k % 5 != 0).select("url", F.when(k % 7 == 0, 404).otherwise(200).alias("status"), "html")
    return fetched(listed(links, "https://x.vn", 7), got).select("page", "place", "url", "error", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n_chars"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS found FROM part")
def lookup_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey"))
    return with_fallback(part.where("id % 2 = 0").select("id", F.col("p_name").alias("found")), part.select("id", F.col("p_brand").alias("found")), "id", "found")


# Sources and sinks: what comes back is what went out.

PART = "SELECT p_partkey, p_name, p_brand, p_size FROM part"


def _part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT p_partkey AS id, p_name || chr(10) || '\"đ\", ' || p_brand AS text FROM part")
def csv_round_trip(spark, sf_dir):
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit('\n"đ", '), "p_brand").alias("text"))
    write_csv(rows, path := shared_path(spark, "csv"))
    return read_csv(spark, path, "id long, text string")


@query(PART)
def json_lines(spark, sf_dir):
    write_json_lines(_part(spark, sf_dir), path := shared_path(spark, "lines"))
    return spark.read.schema("p_partkey long, p_name string, p_brand string, p_size int").json(path)


@query("SELECT count(*) AS n, max(p_size) AS most FROM part")
def report_sink(spark, sf_dir):
    write_report(_part(spark, sf_dir).agg(F.count("*").alias("n"), F.max("p_size").alias("most")), path := shared_path(spark, "report"))
    return spark.read.schema("n long, most long").json(path)


@query("SELECT " + ", ".join(f"p_name AS {c}" if i % 2 else f"p_brand AS {c}" for i, c in enumerate(RECORD_COLUMNS)) + " FROM part")
def record_sink(spark, sf_dir):
    columns = {c: F.col("p_name" if i % 2 else "p_brand") for i, c in enumerate(RECORD_COLUMNS)}
    write_records(_part(spark, sf_dir).select("p_partkey", *[columns[c].alias(c) for c in reversed(RECORD_COLUMNS)]), path := shared_path(spark, "records"))
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name FROM nation")
def fallback_file(spark, sf_dir):
    return first_of(spark, [f"{sf_dir}/absent.parquet", f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"]).select("n_nationkey", "n_name")


@query("SELECT p_partkey, CAST(n AS BIGINT) - 1 AS row_id, CAST(n AS BIGINT) AS row_no FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM part) WHERE p_partkey % 7 <> 0")
def sheet_rows(spark, sf_dir):
    part = _part(spark, sf_dir).withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")))
    return numbered_sheet(part, F.col("p_partkey"), "p_name").select("p_partkey", "row_id", "row_no")


@query("SELECT vec_id, label FROM embeddings")
def collection_scan(spark, sf_dir):
    vectors, c = table(spark, sf_dir, "embeddings"), Collection(spark, shared_path(spark, "vectors"))
    c.reset(vectors.where("vec_id % 2 = 0"))
    c.add(vectors.where("vec_id % 2 = 1"))
    return c.scan("vec_id", "label")


# Evaluation. The question set: every twentieth vector; gold: the same label; labels 8 and 9 are out of scope.


def _results(spark, sf_dir) -> DataFrame:
    views = views_of(spark, sf_dir)
    asks = views.where("vec_id % 20 = 0")
    hits = dense.knn(asks.select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), views.select("vec_id", "row_id", "view", "v"), k=10)
    labels = views.select("vec_id", F.col("label").alias("hit_label"))
    mine = asks.select(F.col("vec_id").alias("qid"), F.col("label").alias("topic"), (F.col("vec_id") % 3).alias("difficulty"), F.col("view").alias("variant"), (F.col("label") < 8).cast("int").alias("in_scope"))
    marked = hits.join(labels, "vec_id").join(mine.select("qid", "topic"), "qid").select("qid", "pos", "vec_id", (1 - F.col("similarity")).alias("distance"), (F.col("topic") == F.col("hit_label")).alias("relevant"))
    return evaluation.score(mine, marked)


RESULTS = f"""{V}, asks AS (SELECT vec_id AS qid, v AS q, label AS topic, vec_id % 3 AS difficulty, view AS variant, CAST(label < 8 AS INT) AS in_scope FROM v WHERE vec_id % 20 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) - 1 AS pos FROM (SELECT qid, topic, vec_id, label, greatest(0, list_cosine_similarity(q, v)) AS s FROM asks JOIN v ON vec_id <> qid)) WHERE pos < 10),
best AS (SELECT qid, min(CASE WHEN label = topic THEN pos + 1 END) AS gold_rank, min_by(1 - s, pos) AS top1_distance, min_by(vec_id, pos) AS top1_id FROM hits GROUP BY 1),
res AS (SELECT asks.*, gold_rank, top1_distance, top1_id, coalesce(CAST(gold_rank = 1 AS INT), 0) AS hit_1, coalesce(CAST(gold_rank <= 5 AS INT), 0) AS hit_5, coalesce(round(1 / gold_rank, 4), 0) AS rr FROM asks LEFT JOIN best USING (qid))"""


@query(f"""WITH {V}, asks AS (SELECT vec_id AS qid, v AS q, row_id || '::title' AS own, lower('Title ' || row_id % 25) AS title, label < 8 AS inside FROM v WHERE vec_id % 20 = 0),
g AS (SELECT title, list(DISTINCT own) AS gold FROM asks WHERE inside GROUP BY 1),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) - 1 AS pos FROM (SELECT qid, own, vec_id, row_id || '::' || view AS id, lower('Title ' || row_id % 25) AS title, greatest(0, list_cosine_similarity(q, v)) AS s FROM asks JOIN v ON vec_id <> qid)) WHERE pos < 10)
SELECT qid, pos, id, id = own OR coalesce(list_contains(gold, own), false) AS relevant FROM hits LEFT JOIN g USING (title)""")
def eval_gold(spark, sf_dir):
    return _gold_hits(spark, sf_dir)[1].select("qid", "pos", "id", "relevant")


def _gold_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The questions with their gold ids and titles, and their hits marked by them."""
    views = views_of(spark, sf_dir)
    ident, title = F.concat_ws("::", F.col("row_id").cast("string"), "view"), F.concat(F.lit(" Title "), (F.col("row_id") % 25).cast("string"))
    asks = views.where("vec_id % 20 = 0")
    hits = dense.knn(asks.select(F.col("vec_id").alias("qid"), F.col("v").alias("q")), views.select("vec_id", "row_id", "view", "v"), k=10).withColumn("id", ident)
    mine = asks.select(F.col("vec_id").alias("qid"), F.concat(F.col("row_id").cast("string"), F.lit("::title")).alias("gold_chroma_id"), title.alias("gold_title"), (F.col("label") < 8).cast("int").alias("in_scope"), F.col("label").alias("topic"), (F.col("vec_id") % 3).alias("difficulty"), F.col("view").alias("variant"))
    return mine, evaluation.relevant(hits, views.select(ident.alias("id"), title.alias("title")), mine.select("qid", "gold_chroma_id", "gold_title", "in_scope"))


def _gold_results(spark, sf_dir) -> DataFrame:
    mine, hits = _gold_hits(spark, sf_dir)
    return evaluation.score(mine, hits.select("qid", "pos", "vec_id", (1 - F.col("similarity")).alias("distance"), "relevant"))


GOLD_RESULTS = f"""{V}, asks AS (SELECT vec_id AS qid, v AS q, row_id || '::title' AS own, lower('Title ' || row_id % 25) AS title, label AS topic, vec_id % 3 AS difficulty, view AS variant, CAST(label < 8 AS INT) AS in_scope FROM v WHERE vec_id % 20 = 0),
gold AS (SELECT title, list(DISTINCT own) AS gold FROM asks WHERE in_scope = 1 GROUP BY 1),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, vec_id) - 1 AS pos FROM (SELECT qid, own, vec_id, row_id || '::' || view AS id, lower('Title ' || row_id % 25) AS title, greatest(0, list_cosine_similarity(q, v)) AS s FROM (SELECT qid, q, own FROM asks) JOIN v ON vec_id <> qid)) WHERE pos < 10),
best AS (SELECT qid, min(CASE WHEN id = own OR coalesce(list_contains(gold, own), false) THEN pos + 1 END) AS gold_rank, min_by(1 - s, pos) AS top1_distance, min_by(vec_id, pos) AS top1_id FROM hits LEFT JOIN gold USING (title) GROUP BY 1),
res AS (SELECT asks.*, gold_rank, top1_distance, top1_id, coalesce(CAST(gold_rank = 1 AS INT), 0) AS hit_1, coalesce(CAST(gold_rank <= 5 AS INT), 0) AS hit_5, coalesce(round(1 / gold_rank, 4), 0) AS rr FROM asks LEFT JOIN best USING (qid))"""


@query(f"WITH {RESULTS} SELECT qid, CAST(gold_rank AS DOUBLE) AS gold_rank, hit_1, hit_5, rr, round(top1_distance, 6) AS top1_distance, top1_id FROM res")
def eval_results(spark, sf_dir):
    return _results(spark, sf_dir).select("qid", F.col("gold_rank").cast("double").alias("gold_rank"), "hit_1", "hit_5", "rr", F.round("top1_distance", 6).alias("top1_distance"), "top1_id")


@query(f"WITH {RESULTS} SELECT count(*) AS n, round(sum(hit_1) / greatest(count(*), 1), 4) AS recall_1, round(sum(hit_5) / greatest(count(*), 1), 4) AS recall_5, round(sum(rr) / greatest(count(*), 1), 4) AS mrr_10 FROM res WHERE in_scope = 1")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_results(spark, sf_dir))


SLICES = " UNION ALL ".join(f"SELECT '{k}' AS slice, CAST({k} AS VARCHAR) AS value, count(*) AS n, round(sum(hit_1) / count(*), 4) AS recall_1, round(sum(hit_5) / count(*), 4) AS recall_5, round(sum(rr) / count(*), 4) AS mrr_10 FROM res WHERE in_scope = 1 GROUP BY 2" for k in ("variant", "difficulty", "topic"))


@query(f"WITH {RESULTS} {SLICES}")
def eval_slices(spark, sf_dir):
    return evaluation.slices(_results(spark, sf_dir), ["variant", "difficulty", "topic"])


REPORT_OF = """, g AS (SELECT CASE WHEN in_scope = 0 THEN 'out_of_scope' WHEN hit_1 = 1 THEN 'hit' ELSE 'miss' END AS grp, list(round(top1_distance, 9) ORDER BY round(top1_distance, 9)) AS xs FROM res WHERE top1_distance IS NOT NULL GROUP BY 1),
rep AS (SELECT grp, len(xs) AS n, xs[1] AS least, xs[len(xs) // 4 + 1] AS p25, (xs[(len(xs) - 1) // 2 + 1] + xs[len(xs) // 2 + 1]) / 2 AS median, xs[3 * len(xs) // 4 + 1] AS p75, xs[len(xs)] AS most FROM g)"""
REPORT = RESULTS + REPORT_OF


@query(f'WITH {REPORT} SELECT grp AS "group", n, round(least, 6) AS least, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(most, 6) AS most FROM rep')
def eval_thresholds(spark, sf_dir):
    return evaluation.threshold_report(_results(spark, sf_dir)).select("group", "n", *[F.round(c, 6).alias(c) for c in ("least", "p25", "median", "p75", "most")])


@query(f"""WITH {REPORT}, s AS (SELECT max(CASE WHEN grp = 'hit' THEN median END) AS a, max(CASE WHEN grp = 'out_of_scope' THEN median END) AS b FROM rep) SELECT round(a, 6) AS "from", round(b, 6) AS "to", a >= b AS overlap FROM s""")
def threshold_suggestion(spark, sf_dir):
    return evaluation.suggestion(evaluation.threshold_report(_results(spark, sf_dir))).select(F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "overlap")


@query(f"WITH {GOLD_RESULTS} SELECT qid, CAST(gold_rank AS DOUBLE) AS gold_rank, hit_1, hit_5, rr, round(top1_distance, 6) AS top1_distance, top1_id FROM res")
def eval_gold_results(spark, sf_dir):
    return _gold_results(spark, sf_dir).select("qid", F.col("gold_rank").cast("double").alias("gold_rank"), "hit_1", "hit_5", "rr", F.round("top1_distance", 6).alias("top1_distance"), "top1_id")


# Halves of the fourth place are rounded up, in whole numbers.
GOLD_SLICES = SLICES.replace("round(sum(rr) / count(*), 4)", "floor((2 * sum(CAST(round(rr * 10000) AS BIGINT)) + count(*)) / (2 * count(*))) / 10000").replace("round(sum(hit_1) / count(*), 4)", "floor((20000 * sum(hit_1) + count(*)) / (2 * count(*))) / 10000").replace("round(sum(hit_5) / count(*), 4)", "floor((20000 * sum(hit_5) + count(*)) / (2 * count(*))) / 10000")


@query(f"WITH {GOLD_RESULTS} {GOLD_SLICES}")
def eval_gold_slices(spark, sf_dir):
    return evaluation.slices(_gold_results(spark, sf_dir), ["variant", "difficulty", "topic"])


@query(f'WITH {GOLD_RESULTS}{REPORT_OF} SELECT grp AS "group", n, round(least, 6) AS least, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(most, 6) AS most FROM rep')
def eval_gold_thresholds(spark, sf_dir):
    return evaluation.threshold_report(_gold_results(spark, sf_dir)).select("group", "n", *[F.round(c, 6).alias(c) for c in ("least", "p25", "median", "p75", "most")])


CUTS = [0.5, 0.55, 0.6, 0.65, 0.7]


@query(f"WITH {RESULTS} SELECT cut, round(avg(CASE WHEN in_scope = 0 THEN CAST(top1_distance > cut AS INT) END), 6) AS blocked, round(avg(CASE WHEN in_scope = 1 AND hit_1 = 1 THEN CAST(top1_distance > cut AS INT) END), 6) AS lost FROM res, (SELECT unnest({CUTS})::DOUBLE AS cut) GROUP BY 1")
def threshold_sweep(spark, sf_dir):
    return evaluation.threshold_sweep(_results(spark, sf_dir), CUTS)


@query(f"""WITH {RESULTS}, f AS (SELECT top1_id AS vec_id, count(*) AS c FROM res WHERE top1_id IS NOT NULL GROUP BY 1), a AS (SELECT vec_id, vec_id % 97 AS length, coalesce(c, 0) AS c FROM v LEFT JOIN f USING (vec_id))
SELECT round((SELECT sum(c) FROM (SELECT c FROM f ORDER BY c DESC, vec_id LIMIT 5)) / sum(c), 6) AS hub_share, count(*) FILTER (c = 0) AS never_first, round(corr(length, c), 6) AS corr FROM a""")
def hubness(spark, sf_dir):
    return evaluation.hubness(_results(spark, sf_dir), views_of(spark, sf_dir).select("vec_id", (F.col("vec_id") % 97).alias("length")))


@query(f"WITH {RESULTS} SELECT topic, count(*) AS n, round(avg(hit_1), 6) AS recall_1, round(avg(hit_5), 6) AS recall_5 FROM res WHERE in_scope = 1 GROUP BY 1 ORDER BY 3, 4, 1 LIMIT 4")
def worst_topics(spark, sf_dir):
    return evaluation.worst(_results(spark, sf_dir), "topic", 4)


@query(f"""WITH g AS (SELECT lower(trim(p_name)) AS title, list(DISTINCT p_partkey) AS gold FROM part GROUP BY 1)
SELECT o.p_partkey AS qid, CAST(len(gold) AS BIGINT) AS n_gold, list_contains(gold, o.p_partkey + 1) AS next_is_gold FROM part o LEFT JOIN g ON g.title = lower(trim(o.p_name))""")
def gold_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gold = evaluation.gold_of_titles(part.select(F.col("p_name").alias("title"), F.col("p_partkey").alias("id")))
    joined = part.select(F.col("p_partkey").alias("qid"), F.lower(F.trim("p_name")).alias("title")).join(gold, "title", "left")
    return joined.select("qid", F.size(F.coalesce("gold", F.array().cast("array<bigint>"))).cast("long").alias("n_gold"), F.arrays_overlap("gold", F.array(F.col("qid") + 1)).alias("next_is_gold"))


# Question sets.


def _topics(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic_key"), F.col("p_name").alias("topic"), F.col("p_brand").alias("field"))


def _sql_pick(choices: list[str]) -> str:
    return f"([{', '.join(map(q, choices))}])[CAST(k % {len(choices)} AS INT) + 1]"


SQL_BASE = "t || ' cần giấy tờ gì'"
# Two words joined, a letter dropped or a letter doubled, by the key.
def _sql_typo(base: str) -> str:
    return f"""(SELECT CASE WHEN n >= 2 AND k % 3 = 0 THEN array_to_string(w[1:j - 1] || [w[j] || w[j + 1]] || w[j + 2:n], ' ') WHEN length(b) >= 4 AND k % 3 = 1 THEN substr(b, 1, i - 1) || substr(b, i + 1) ELSE substr(b, 1, i) || substr(b, i) END
FROM (SELECT b, string_split(b, ' ') AS w, len(string_split(b, ' ')) AS n, CAST(k % greatest(len(string_split(b, ' ')) - 1, 1) + 1 AS INT) AS j, CAST(k % greatest(length(b), 1) + 1 AS INT) AS i FROM (SELECT {base} AS b)))"""


SQL_TYPO = _sql_typo(SQL_BASE)
SQL_NOISE = [(sql_strip_marks(SQL_BASE), "no_diacritics", "hard"), (_sql_abbreviate(SQL_BASE), "abbrev", "hard"), (SQL_TYPO, "typo", "hard"), (f"t || {_sql_pick(questions.TAILS)}", "keyword", "medium"), (f"trim({_sql_pick(questions.OPENERS)} || lower({SQL_BASE}) || {_sql_pick(questions.CLOSERS)})", "colloquial", "medium")]
SQL_MADE = [(f"replace({q(text)}, '{{t}}', t)", f"facet_{name}", "easy") for name, text in questions.FACETS] + SQL_NOISE
SQL_QUESTIONS = " UNION ALL ".join(f"SELECT k AS topic_key, {i} AS place, f AS field, trim({s}) AS question, '{v}' AS variant, '{d}' AS difficulty, 1 AS in_scope, '' AS oos_kind FROM (SELECT p_partkey AS k, p_name AS t, p_brand AS f FROM part)" for i, (s, v, d) in enumerate(SQL_MADE) if s)


@query(SQL_QUESTIONS)
def gen_questions(spark, sf_dir):
    return questions.generate(_topics(spark, sf_dir))


@query(f"SELECT * FROM ({SQL_QUESTIONS}) WHERE variant = 'typo'")
def gen_typos(spark, sf_dir):
    return questions.generate(_topics(spark, sf_dir)).where("variant = 'typo'")


@query(f"SELECT topic_key, place, printf('Q%04d', row_number() OVER (ORDER BY topic_key, place)) AS qid FROM (SELECT p_partkey AS topic_key, place FROM part, generate_series(0, {len(SQL_MADE) - 1}) AS g(place))")
def gen_numbers(spark, sf_dir):
    return questions.numbered(_topics(spark, sf_dir)).select("topic_key", "place", "qid")


@query("SELECT count(*) AS rows, count(*) FILTER (p_partkey % 3 <> 2) AS covered, count(*) FILTER (p_partkey % 3 = 2) AS uncovered FROM part")
def gen_coverage(spark, sf_dir):
    # A topic names two of three neighbouring rows, so every third row is left over.
    part, first = table(spark, sf_dir, "part"), F.col("p_partkey") - F.col("p_partkey") % 3
    return questions.coverage(part.select(F.col("p_partkey").alias("row_no")), part.select(F.array(first, first + 1).alias("rows")))


@query("SELECT p_partkey AS topic_key, p_partkey + 100000000 AS row_no FROM part")
def gen_missing(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    topics = part.select(F.col("p_partkey").alias("topic_key"), F.array(F.col("p_partkey"), F.col("p_partkey") + 100_000_000).alias("rows"))
    return questions.missing_rows(part.select(F.col("p_partkey").alias("row_no")), topics)


@query(f"""WITH made AS (SELECT row_number() OVER (ORDER BY topic_key, place) AS n, * FROM ({SQL_QUESTIONS})), total AS (SELECT count(*) AS total FROM made)
SELECT printf('Q%04d', n) AS qid, question, CAST(topic_key AS VARCHAR) AS topic_key, a.p_name AS topic, a.p_partkey || ';' || (a.p_partkey + 1) AS gold_row_no, concat_ws(';', 'r' || a.p_partkey, 'r' || b.p_partkey) AS gold_chroma_id, concat_ws(' | ', a.p_name, b.p_name) AS gold_title,
  a.p_brand AS linh_vuc, variant, difficulty, in_scope, oos_kind FROM made JOIN part a ON a.p_partkey = topic_key LEFT JOIN part b ON b.p_partkey = topic_key + 1
UNION ALL SELECT printf('Q%04d', total + row_number() OVER (ORDER BY item_id)), trim(text), 'none', '', '', '', '', '', 'out_of_scope', 'hard', 0, 'kind' || item_id % 3 FROM benchmark, total""")
def gen_question_set(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    topics = part.select(k.alias("topic_key"), F.col("p_name").alias("topic"), F.array(k, k + 1).alias("rows"))
    rows = part.select(k.alias("row_no"), F.concat(F.lit("r"), k.cast("string")).alias("id"), F.concat(F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("field"))
    outside = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), F.col("text").alias("question"), F.concat(F.lit("kind"), (F.col("item_id") % 3).cast("string")).alias("kind"))
    return questions.question_set(topics, rows, outside)


SEEDS = ["tôi mới mua {name} thì phải làm gì", "nhà em mất {name} cần gt j", "cho hỏi {brand} với", "Đẻ"]


def _sql_struct(question: str, variant: str, difficulty: str) -> str:
    return f"{{'question': trim({question}), 'variant': '{variant}', 'difficulty': '{difficulty}'}}"


def _sql_drawn(name: str) -> str:
    return f"bases[CAST(CAST('0x' || substr(md5(k || ':{name}'), 1, 8) AS BIGINT) % len(bases) AS INT) + 1]"


_seeds = ", ".join("concat(" + ", ".join(q(x) for x in line.replace("{name}", "|t|").replace("{brand}", "|f|").split("|")).replace("'t'", "t").replace("'f'", "f") + ")" for line in SEEDS)
_facets = ", ".join(f"{{'o': md5(k || ':facet{i}'), 'q': {_sql_struct(f'replace({q(text)}, {q("{t}")}, t)', f'facet_{name}', 'easy')}}}" for i, (name, text) in enumerate(questions.FACETS))
_noise = ", ".join([
    _sql_struct(sql_strip_marks(_sql_drawn("no_diacritics")), "no_diacritics", "hard"), _sql_struct(_sql_abbreviate(_sql_drawn("abbrev")), "abbrev", "hard"), _sql_struct("typo", "typo", "hard"),
    _sql_struct(f"t || {_sql_pick(questions.TAILS)}", "keyword", "medium"), _sql_struct(f"{_sql_pick(questions.OPENERS)} || lower({_sql_drawn('colloquial')}) || {_sql_pick(questions.CLOSERS)}", "colloquial", "medium"),
])
SQL_SEEDED = f"""(SELECT k AS topic_key, f AS field, unnest(list_transform(made, lambda x, i: {{'place': i - 1, 'q': x}})) AS u FROM
(SELECT *, list_slice(list_concat(list_transform(seeds, lambda x: {_sql_struct("x", "situational", "hard")}), list_transform(list_sort([{_facets}]), lambda x: x.q), [{_noise}]), 1, 15) AS made FROM
(SELECT *, {_sql_typo(_sql_drawn("typo"))} AS typo FROM (SELECT *, list_concat(seeds, [{SQL_BASE}]) AS bases FROM (SELECT k, t, f, list_slice([{_seeds}], 1, k % 5) AS seeds FROM (SELECT p_partkey AS k, p_name AS t, p_brand AS f FROM part))))))"""


@query(f"SELECT topic_key, CAST(u.place AS INT) AS place, field, u.q.question AS question, u.q.variant AS variant, u.q.difficulty AS difficulty, 1 AS in_scope, '' AS oos_kind FROM {SQL_SEEDED}")
def gen_seeded_questions(spark, sf_dir):
    return questions.generate_seeded(_seeded_topics(spark, sf_dir))


def _seeded_topics(spark, sf_dir) -> DataFrame:
    """Topics with none to four situations each: with eight facets and five kinds of noise, some have more than are wanted."""
    lines = F.array(*[F.concat(*[{"{name}": F.col("topic"), "{brand}": F.col("field")}.get(x, F.lit(x)) for x in re.split(r"(\{\w+\})", line)]) for line in SEEDS])
    return _topics(spark, sf_dir).withColumn("seeds", F.slice(lines, F.lit(1), (F.col("topic_key") % 5).cast("int")))


@query(f"SELECT key, value, count(*) AS n FROM (SELECT 'variant' AS key, variant AS value FROM ({SQL_QUESTIONS}) UNION ALL SELECT 'difficulty', difficulty FROM ({SQL_QUESTIONS})) GROUP BY 1, 2")
def gen_distribution(spark, sf_dir):
    return questions.distribution(questions.generate(_topics(spark, sf_dir)), ["variant", "difficulty"])


@query("SELECT p_partkey AS topic_key, CASE WHEN CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS side FROM part")
def topic_split(spark, sf_dir):
    return _topics(spark, sf_dir).select("topic_key", questions.split_of(F.col("topic_key")).alias("side"))


# Store.


@query("SELECT event_id AS token, c_custkey AS user_id, c_name AS name FROM events JOIN customer ON user_id = c_custkey WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20'")
def session_lookup(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("token"), "user_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return store.users_of_tokens(made, users, dt.datetime(2024, 1, 20)).select("token", "user_id", "name")


def _conversations(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "orders")
    return c.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("user_id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("title"), F.lit("").alias("summary"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_orderkey AS id, o_orderdate AS updated_at FROM orders WHERE o_custkey % 3 = 0")
def conv_list(spark, sf_dir):
    return store.list_conversations(_conversations(spark, sf_dir), None).select("id", "updated_at")


@query(f"SELECT conv_id, turn, CASE WHEN {SQL_TITLE} = '' THEN 'Cuộc trò chuyện mới' ELSE {SQL_TITLE} END AS title FROM conversations")
def conv_title(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", first_words(F.col("text")).alias("title"))


@query("SELECT conv_id AS conversation_id, turn AS id, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS INT) AS n_sources FROM conversations")
def conv_messages(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), F.col("turn").alias("created_at"), F.when(F.col("turn") % 2 == 0, '["a", "b"]').otherwise("{broken").alias("sources"))
    return store.messages_in_order(m).select("conversation_id", "id", F.size("sources").alias("n_sources"))


@query("SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS conversations, (SELECT count(*) FROM lineitem) AS messages, (SELECT count(*) FROM lineitem WHERE l_linenumber % 2 <> 0) AS feedback")
def store_stats(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("messages"), F.count_if(F.col("l_linenumber") % 2 != 0).alias("feedback"))
    return table(spark, sf_dir, "customer").agg(F.count("*").alias("users")).crossJoin(table(spark, sf_dir, "orders").agg(F.count("*").alias("conversations"))).crossJoin(m)


@query("""WITH new AS (SELECT l_orderkey * 2 AS id, max(l_shipdate) AS m FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, id) AS id, coalesce(m, o_orderdate) AS updated_at, o_orderkey IS NULL AS made FROM orders FULL JOIN new ON o_orderkey = id""")
def upsert_message(spark, sf_dir):
    have = _conversations(spark, sf_dir)
    new = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("conversation_id"), F.col("l_shipdate").alias("created_at"))
    after, _ = store.save_messages(have, new.limit(0), new)
    return after.select("id", "updated_at", (F.col("title") == "Cuộc trò chuyện mới").alias("made"))


@query("SELECT conv_id AS id, turn, CASE WHEN conv_id = 3 AND turn = 0 THEN 5 ELSE 0 END AS rating FROM conversations")
def rate_message(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", F.lit(0).alias("rating"))
    return store.rate(m, "3-0", 5).select(F.col("conv_id").alias("id"), "turn", "rating")


@query("""WITH m AS (SELECT l_orderkey AS c, l_linenumber AS t, repeat(l_returnflag, 100 + CAST(l_quantity AS INT) * 30) AS x FROM lineitem), g AS (SELECT c, count(*) AS n, sum(length(x)) AS chars FROM m GROUP BY 1 HAVING count(*) >= 6 AND sum(length(x)) >= 6300)
SELECT c AS conversation_id, n, CAST(chars AS BIGINT) AS chars, md5(string_agg('USER: ' || x, chr(10) ORDER BY t, x)) AS dialogue FROM (SELECT m.*, n, chars, row_number() OVER (PARTITION BY c ORDER BY t DESC, x DESC) AS back FROM m JOIN g USING (c)) WHERE back > 4 GROUP BY 1, 2, 3""")
def context_window(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("created_at"), F.lit("user").alias("role"), F.expr("repeat(l_returnflag, 100 + CAST(l_quantity AS INT) * 30)").alias("content"))
    return store.context_windows(m).withColumn("dialogue", F.md5("dialogue"))


@query("SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS children FROM orders WHERE NOT o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 900 DAY")
def retention_purge(spark, sf_dir):
    parents, children = store.purge(_conversations(spark, sf_dir), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id"), "id", "updated_at", AS_OF, 900)
    counts = children.groupBy("id").agg(F.count("*").alias("children"))
    return parents.join(counts, "id", "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)), l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_delete(spark, sf_dir):
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    left = store.cascade([(c, "c_custkey", None), (o, "o_orderkey", "o_custkey"), (l, None, "l_orderkey")], c.where("c_acctbal < 0").select("c_custkey"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for df, name in zip(left, ("customer", "orders", "lineitem"), strict=True)]
    return out[0].union(out[1]).union(out[2])


@query("SELECT 'mine' AS scope, count(*) FILTER (o_custkey % 3 <> 0) AS n FROM orders UNION ALL SELECT 'all', 0")
def reset_scope(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    mine = store.survivors(c, c, c.where("user_id IS NULL").select("id"), "id")[0]
    return mine.agg(F.count("*").alias("n")).select(F.lit("mine").alias("scope"), "n").union(store.emptied(c).agg(F.count("*").alias("n")).select(F.lit("all").alias("scope"), "n"))


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 3 = 0 AS guest FROM orders), t AS (SELECT 'messages' AS name, count(*) AS n, count(*) FILTER (guest) AS guests FROM lineitem JOIN c ON l_orderkey = id UNION ALL SELECT 'conversations', count(*), count(*) FILTER (guest) FROM c
  UNION ALL SELECT 'sessions', count(*), 0 FROM events UNION ALL SELECT 'users', count(*), 0 FROM customer)
SELECT scope, name, CASE scope WHEN 'everything' THEN n WHEN 'mine' THEN guests ELSE CASE WHEN name IN ('messages', 'conversations') THEN n ELSE 0 END END AS n FROM t, (SELECT unnest(['mine', 'all', 'everything']) AS scope)""")
def reset_counts(spark, sf_dir):
    messages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conversation_id"))
    tables = {"messages": messages, "conversations": _conversations(spark, sf_dir), "sessions": table(spark, sf_dir, "events"), "users": table(spark, sf_dir, "customer")}
    out = [store.deleted(tables[name], left).select(F.lit(scope).alias("scope"), F.lit(name).alias("name"), "n") for scope in ("mine", "all", "everything") for name, left in store.reset(tables, scope).items()]
    return reduce(DataFrame.union, out)


@query("""WITH u AS (SELECT c_custkey AS user_id, 'u' || c_custkey || '@x.vn' AS email, c_name AS full_name FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM u UNION ALL SELECT min(c_custkey) + 1000000, 'u' || c_custkey // 3 || '@x.vn' AS email, any_value('Công dân') FROM customer WHERE 'u' || c_custkey // 3 || '@x.vn' NOT IN (SELECT email FROM u) GROUP BY 2""")
def register_users(spark, sf_dir):
    k, schema = F.col("c_custkey"), ["user_id", "email", "password_hash", "full_name", "created_at"]
    made = F.timestamp_seconds(k)
    have = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(k.alias("user_id"), F.concat(F.lit("u"), k.cast("string"), F.lit("@x.vn")).alias("email"), F.md5("c_name").alias("password_hash"), F.col("c_name").alias("full_name"), made.alias("created_at"))
    new = table(spark, sf_dir, "customer").select((k + 1_000_000).alias("user_id"), F.concat(F.lit(" U"), F.floor(k / 3).cast("string"), F.lit("@X.vn ")).alias("email"), F.md5("c_name").alias("password_hash"), F.lit(" ").alias("full_name"), made.alias("created_at"))
    return store.register(have.select(*schema), new.select(*schema)).select("user_id", "email", "full_name")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 4 <> 0")
def authenticate(spark, sf_dir):
    k = F.col("c_custkey")
    users = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.concat(F.lit("u"), k.cast("string")).alias("email"), F.md5("c_name").alias("password_hash"), F.col("c_name").alias("full_name"), F.lit(None).cast("timestamp").alias("created_at"))
    tries = table(spark, sf_dir, "customer").select(F.concat(F.lit(" U"), k.cast("string")).alias("email"), F.md5(F.when(k % 4 == 0, "x").otherwise(F.col("c_name"))).alias("password_hash"))
    return store.authenticate(users, tries).select("user_id")


@query("SELECT event_id AS token, ts + INTERVAL 30 DAY AS expires_at FROM events WHERE user_id % 3 <> 0")
def session_changes(spark, sf_dir):
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("token"), "user_id", F.col("ts").alias("created_at"))
    empty = made.select("token", "user_id", F.col("created_at").alias("expires_at"), "created_at").limit(0)
    return store.close_sessions(store.open_sessions(empty, made), made.where("user_id % 3 = 0")).select("token", "expires_at")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'Tên mới' ELSE o_orderpriority END AS title, o_orderkey = 7 AND o_custkey % 3 <> 0 AS mine FROM orders")
def conv_rename(spark, sf_dir):
    c = store.rename(_conversations(spark, sf_dir), 7, "Tên mới")
    # Asked for by the user whose it is.
    mine = store.owned_by(c, c.where("id = 7").select("id", "user_id")).where("user_id IS NOT NULL").select("id", F.lit(True).alias("mine"))
    return c.select("id", "title").join(small(mine), "id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))


@query("""WITH e AS (SELECT event_id AS job_id, user_id AS queue, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT job_id, queue, count(*) OVER (PARTITION BY queue ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY queue, s) - row_number() OVER (PARTITION BY queue, s ORDER BY job_id)) AS position FROM e""")
def queue_positions(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("queue"), F.col("ts").alias("arrived"))
    return store.queue_positions(jobs, 3600).select("job_id", "queue", "position")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    out = sessions(table(spark, sf_dir, "events").select("user_id", "ts"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT lower(trim(' ' || upper(c_name) || '@X.VN ')) AS email, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE 'h' || c_custkey END AS token FROM customer")
def account_keys(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    cookie, header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("c"), k)), F.concat(F.lit("Bearer h"), k)
    return c.select(store.email(F.concat(F.lit(" "), F.upper("c_name"), F.lit("@X.VN "))).alias("email"), store.token_of(cookie, header).alias("token"))

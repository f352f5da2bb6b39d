"""Question sets: topics by templates and noise, out-of-scope questions, coverage, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abbreviate, strip_marks

# Facets and their templates, endings, openers and closers.
FACETS = [("docs", "{t} cần giấy tờ gì"), ("docs", "hồ sơ {t} gồm những gì"), ("time", "{t} mất bao lâu"), ("time", "{t} bao nhiêu ngày thì xong"), ("fee", "{t} lệ phí bao nhiêu"), ("fee", "{t} có mất phí không"), ("place", "{t} nộp ở đâu"), ("online", "{t} làm online được không")]
TAILS = ["", " cần gì", " ở đâu", " bao lâu", " phí", " hồ sơ"]
OPENERS = ["cho hỏi ", "cho em hỏi ", "ad ơi ", "cho e hỏi với ", "a ơi ", "anh chị ơi ", "cho mình hỏi ", ""]
CLOSERS = [" ạ", " vs ạ", " với ạ", " nhỉ", " v", " ?", ""]
# Kinds of noise that a topic gets, one question each.
NOISES = 5


def pick(choices: list[str], key: Column) -> Column:
    """One of the choices, by a whole number that is the same each time."""
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(key, F.lit(len(choices))) + 1).cast("int"))


def typo(text: Column, key: Column) -> Column:
    """A text that differs from the given one: by the key, two words joined, a letter doubled, or a letter dropped."""
    words = F.split(text, " ")
    n = F.size(words)
    at = (F.pmod(key, F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    joined = F.concat_ws(" ", F.slice(words, 1, at - 1), F.concat(F.element_at(words, at), F.element_at(words, at + 1)), F.slice(words, at + 2, n))
    i = (F.pmod(key, F.greatest(F.length(text), F.lit(1))) + 1).cast("int")
    doubled = F.concat(F.substr(text, F.lit(1), i), F.substr(text, i))
    dropped = F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))
    return F.when((n >= 2) & (F.pmod(key, F.lit(3)) == 0), joined).when((F.length(text) >= 4) & (F.pmod(key, F.lit(3)) == 1), dropped).otherwise(doubled)


def _exploded(topics: DataFrame, made: Column, per_topic: int, keep: list[str]) -> DataFrame:
    rows = topics.select("topic_key", "field", *keep, F.posexplode(F.slice(made, 1, per_topic)).alias("place", "q"))
    return rows.select("topic_key", "place", "field", "q.question", "q.variant", "q.difficulty", F.lit(1).alias("in_scope"), F.lit("").alias("oos_kind"), *keep)


def generate(topics: DataFrame, per_topic: int = 15, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Questions of topics (topic_key long, topic, field): topic_key, place, field, question, variant, difficulty, in_scope,
    oos_kind, and those of the topics' columns that are to be kept.

    A topic's variants are one array that is exploded: no join, and per_topic cuts the array."""
    t, key = F.col("topic"), F.col("topic_key")
    base = F.concat(t, F.lit(" cần giấy tờ gì"))
    facets = [(F.replace(F.lit(text), F.lit("{t}"), t), f"facet_{name}", "easy") for name, text in FACETS]
    noisy = [(strip_marks(base), "no_diacritics", "hard"), (abbreviate(base), "abbrev", "hard"), (typo(base, key), "typo", "hard"), (F.concat(t, pick(TAILS, key)), "keyword", "medium"), (F.trim(F.concat(pick(OPENERS, key), F.lower(base), pick(CLOSERS, key))), "colloquial", "medium")]
    made = F.array(*[F.struct(F.trim(q).alias("question"), F.lit(v).alias("variant"), F.lit(d).alias("difficulty")) for q, v, d in facets + noisy])
    return _exploded(topics, made, per_topic, keep)


def draw(key: Column, name: str, n: Column) -> Column:
    """A whole number from 0 below n, by a digest of a key and a name: the same each time, and in SQL too."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{name}"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), n.cast("long"))


def generate_seeded(topics: DataFrame, per_topic: int = 15, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """As generate, of topics with seeds, an array of questions that people wrote about a situation (null: none). A topic's
    variants are its seeds, then the facets in an order of its own (a permutation by digests), then noise, each kind on one
    of the seeds or the plain question, drawn by the key. per_topic cuts what comes last."""
    t, key = F.col("topic"), F.col("topic_key")
    seeds, base = F.coalesce("seeds", F.array().cast("array<string>")), F.concat(t, F.lit(" cần giấy tờ gì"))
    bases = F.concat(seeds, F.array(base))

    def one(q: Column, variant: str, difficulty: str) -> Column:
        return F.struct(F.trim(q).alias("question"), F.lit(variant).alias("variant"), F.lit(difficulty).alias("difficulty"))

    def drawn(name: str) -> Column:
        return F.element_at("bases", (draw(key, name, F.size("bases")) + 1).cast("int"))

    facets = [F.struct(F.md5(F.concat(key.cast("string"), F.lit(f":facet{i}"))).alias("order"), one(F.replace(F.lit(text), F.lit("{t}"), t), f"facet_{name}", "easy").alias("q")) for i, (name, text) in enumerate(FACETS)]
    noise = [
        one(strip_marks(drawn("no_diacritics")), "no_diacritics", "hard"), one(abbreviate(drawn("abbrev")), "abbrev", "hard"), one(typo(drawn("typo"), key), "typo", "hard"),
        one(F.concat(t, pick(TAILS, key)), "keyword", "medium"), one(F.concat(pick(OPENERS, key), F.lower(drawn("colloquial")), pick(CLOSERS, key)), "colloquial", "medium"),
    ]
    made = F.concat(F.transform(seeds, lambda x: one(x, "situational", "hard")), F.transform(F.array_sort(F.array(*facets)), lambda x: x["q"]), F.array(*noise))
    return _exploded(topics.withColumn("bases", bases), made, per_topic, keep)


def _count(topics: DataFrame, per_topic: int) -> Column:
    """How many questions a topic gets."""
    seeds = F.size(F.coalesce("seeds", F.array().cast("array<string>"))) if "seeds" in topics.columns else F.lit(0)
    return F.least(seeds + len(FACETS) + NOISES, F.lit(per_topic)).cast("long")


def _before(counts: DataFrame, levels: int = 2, each: int = 1000) -> DataFrame:
    """at, before: what the keys below a key (at, c) count together. Sums run within groups of a thousand keys, over the
    groups in groups of a thousand, and then over those: a task sees a thousand rows, the last one a millionth of all.
    Joins are by a shuffle, as Spark's estimates do not count what an explode makes."""
    if not levels:
        return counts.select("at", (F.sum("c").over(Window.orderBy("at")) - F.col("c")).alias("before"))
    grouped = counts.withColumn("bunch", F.floor(F.col("at") / each))
    outer = _before(grouped.groupBy(F.col("bunch").alias("at")).agg(F.sum("c").alias("c")), levels - 1, each).withColumnsRenamed({"at": "bunch", "before": "outer"})
    inner = F.sum("c").over(Window.partitionBy("bunch").orderBy("at")) - F.col("c")
    return grouped.withColumn("inner", inner).join(outer.hint("merge"), "bunch").select("at", (F.col("inner") + F.col("outer")).alias("before"))


def in_order(questions: DataFrame) -> DataFrame:
    """Adds `number`, from 1, in the order of topic_key and place (from 0 without gaps in a topic)."""
    before = _before(questions.groupBy(F.col("topic_key").alias("at")).agg(F.count("*").alias("c")))
    return questions.join(before.withColumnRenamed("at", "topic_key").hint("merge"), "topic_key").withColumn("number", F.col("before") + F.col("place") + 1).drop("before")


def placed(topics: DataFrame, per_topic: int = 15) -> DataFrame:
    """Adds `before` to topics: how many questions the topics before have. Numbers come from the topics, so that no question is
    shuffled for its own."""
    before = _before(topics.groupBy(F.col("topic_key").alias("at")).agg(F.sum(_count(topics, per_topic)).alias("c")))
    return topics.join(before.withColumnRenamed("at", "topic_key").hint("merge"), "topic_key")


def _qid(number: Column) -> Column:
    return F.format_string("Q%04d", number)


def numbered(topics: DataFrame, per_topic: int = 15, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Questions of topics with ids Q0001, Q0002, ... in the order of topics and places."""
    make = generate_seeded if "seeds" in topics.columns else generate
    return make(placed(topics, per_topic), per_topic, ["before", *keep]).withColumn("qid", _qid(F.col("before") + F.col("place") + 1)).drop("before")


def gold_of_topics(topics: DataFrame, rows: DataFrame) -> DataFrame:
    """topic_key, gold_row_no, gold_chroma_id, gold_title as lists in text, and linh_vuc, of topics (topic_key, rows) over a
    sheet (row_no, id, title, field). A row that is absent has a number, but no id and title; the first one has the field."""
    named = topics.select("topic_key", F.posexplode("rows").alias("at", "row_no")).join(rows.select("row_no", "id", "title", "field").hint("merge"), "row_no", "left")
    g = named.groupBy("topic_key").agg(F.array_sort(F.collect_list(F.struct("at", "row_no", "id", "title", "field"))).alias("g"))
    there = F.filter("g", lambda x: x["id"].isNotNull())
    return g.select(
        "topic_key", F.array_join(F.transform("g", lambda x: x["row_no"].cast("string")), ";").alias("gold_row_no"), F.array_join(F.transform(there, lambda x: x["id"].cast("string")), ";").alias("gold_chroma_id"),
        F.array_join(F.transform(there, lambda x: F.trim(x["title"])), " | ").alias("gold_title"), F.coalesce(F.trim(F.element_at("g", 1)["field"]), F.lit("")).alias("linh_vuc"),
    )


GOLD = ["gold_row_no", "gold_chroma_id", "gold_title", "linh_vuc"]
SET = ["qid", "question", "topic_key", "topic", *GOLD, "variant", "difficulty", "in_scope", "oos_kind"]


def question_set(topics: DataFrame, rows: DataFrame, outside: DataFrame, per_topic: int = 15) -> DataFrame:
    """The whole set: questions of topics (topic_key long, topic, rows, and seeds where there are any) with their gold rows, and
    then those that no row answers (place long, question, kind), numbered on; they are a table of the caller's.

    Topics meet their numbers and gold rows before they become questions; no join is of questions. A topic without rows has
    no gold."""
    known = topics.where(F.col("topic_key").isNotNull())
    gold = gold_of_topics(known, rows).hint("merge")
    made = numbered(known.withColumn("field", F.lit("")).join(gold, "topic_key", "left").na.fill("", GOLD), per_topic, ["topic", *GOLD])
    total = known.agg(F.coalesce(F.sum(_count(known, per_topic)), F.lit(0)).alias("total"))
    none = {c: F.lit("") for c in ("topic", *GOLD)} | {"topic_key": F.lit("none"), "variant": F.lit("out_of_scope"), "difficulty": F.lit("hard"), "in_scope": F.lit(0), "oos_kind": F.col("kind")}
    after = in_order(outside.select(F.col("place").alias("topic_key"), F.lit(0).alias("place"), F.trim("question").alias("question"), "kind")).crossJoin(F.broadcast(total))
    after = after.withColumn("qid", _qid(F.col("number") + F.col("total"))).withColumns(none).select(*SET)
    return made.withColumn("topic_key", F.col("topic_key").cast("string")).select(*SET).unionByName(after)


def coverage(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """One row: rows, rows covered by topics, rows that are not."""
    marked = rows.select("row_no").distinct().join(topics.select(F.explode("rows").alias("row_no")).distinct().withColumn("has", F.lit(1)), "row_no", "left")
    return marked.agg(F.count("*").alias("rows"), F.count("has").alias("covered"), F.count_if(F.col("has").isNull()).alias("uncovered"))


def missing_rows(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """topic_key, row_no of rows that topics name and the sheet does not have."""
    return topics.select("topic_key", F.explode("rows").alias("row_no")).join(rows.select("row_no"), "row_no", "left_anti")


def distribution(questions: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("p")
    return questions.select(pairs).groupBy("p.key", "p.value").agg(F.count("*").alias("n"))


def split_of(key: Column, train_tenths: int = 8) -> Column:
    """train or test by topic, so that no topic is on both sides."""
    tenth = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(tenth < train_tenths, "train").otherwise("test")

"""What Spark broadcasts follows counts of rows and bytes, not the size of files, in which texts that repeat take no room."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathomlake.operators import questions, store
from fathomlake.operators.ranking import small
from fathomlake.sources import staged


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {x for x in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin", "ShuffledHashJoin") if f"{x} " in plan}


def test_small_by_rows_and_bytes(spark):
    texts = staged(spark.range(20_000).select("id", F.expr("repeat('x', 1000)").alias("text")), "texts")
    met = lambda side: spark.range(50_000).join(side, "id")
    assert joins(met(small(texts))) == {"BroadcastHashJoin"}
    assert joins(met(small(texts, width=F.octet_length("text")))) == {"BroadcastHashJoin"}
    assert joins(met(small(texts, limit=1000))) == {"SortMergeJoin"}
    assert joins(met(small(texts, width=F.octet_length("text"), most=1_000_000))) == {"SortMergeJoin"}
    assert met(small(texts, limit=1000)).count() == met(small(texts)).count() == 20_000


def test_context_of_long_texts(spark):
    """The first of the last messages of 9,000 conversations, 36 MB of text, go to no task as a whole."""
    said = spark.range(54_000).select((F.col("id") % 9000).alias("conversation_id"), F.col("id").alias("created_at"), F.lit("user").alias("role"), F.expr("repeat('y', 4000)").alias("content"), F.lit("other").alias("sources"))
    pieces = store.context_pieces(said)
    assert joins(pieces) == {"SortMergeJoin"}
    assert pieces.columns == ["conversation_id", "n", "chars", "created_at", "content", "role", "piece"]
    assert {r.created_at // 9000 for r in pieces.select("created_at").collect()} == {0, 1} and pieces.count() == 18_000


def test_numbers_of_many_questions(spark):
    """Topics in small files become more questions than may be broadcast; Spark guesses by the files."""
    topics = staged(spark.range(3000).select(F.col("id").alias("topic_key"), F.lit("khai sinh").alias("topic"), F.lit("f").alias("field")), "topics")
    numbers = questions.in_order(questions.generate(topics))
    assert joins(numbers) == {"SortMergeJoin"}
    got = questions.numbered(topics).select("qid", "topic_key", "place")
    assert joins(got) == {"SortMergeJoin"}
    want = {(f"Q{r.number:04d}", r.topic_key, r.place) for r in numbers.collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 3000 * 13


@pytest.mark.parametrize("per_topic", [0, 3, 14, 15])
def test_question_set_broadcasts_one_row(spark, per_topic):
    """Topics with more and fewer seeds, with a gap in the keys, and without rows: numbers have no gap and no double."""
    some = [(k * 3, "nhà", None if k == 1 else [k, 999] if k else [], [f"s{i}" for i in range(k % 4)] if k % 5 else None) for k in range(40)]
    topics = staged(spark.createDataFrame(some, "topic_key long, topic string, rows array<long>, seeds array<string>"), "topics")
    rows = staged(spark.createDataFrame([(k, f"r{k}", f" t{k}", "f") for k in range(40)], "row_no long, id string, title string, field string"), "rows")
    outside = staged(spark.createDataFrame([(5, "x ", "a"), (9, "y", "b")], "place long, question string, kind string"), "outside")
    made = questions.question_set(topics, rows, outside, per_topic)
    assert joins(made) == {"SortMergeJoin", "BroadcastNestedLoopJoin"}
    got = sorted(made.collect(), key=lambda r: int(r.qid[1:]))
    assert [r.qid for r in got] == [f"Q{n:04d}" for n in range(1, len(got) + 1)]
    want = [k * 3 for k in range(40) for _ in range(min(13 + (k % 4 if k % 5 else 0), per_topic))]
    assert [r.topic_key for r in got] == [str(k) for k in want] + ["none", "none"]
    gold = {int(r.topic_key) // 3: (r.gold_row_no, r.gold_chroma_id, r.gold_title, r.linh_vuc) for r in got[:-2]}
    assert gold == ({k: (f"{k};999", f"r{k}", f"t{k}", "f") if k > 1 else ("",) * 4 for k in range(40)} if per_topic else {})

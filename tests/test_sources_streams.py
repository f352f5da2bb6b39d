from __future__ import annotations

from pyspark.sql import functions as F

from fathomlake import sources
from fathomlake.functions.rules import route
from fathomlake.streaming import route_files


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "đ\nx")], "id int, text string")
    sources.write_csv(df, f"{tmp_path}/csv")
    assert sorted(sources.read_csv(spark, f"{tmp_path}/csv", "id int, text string").collect()) == sorted(df.collect())
    sources.write_report(df.agg(F.count("*").alias("n")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first()["n"] == 2


def test_numbered_sheet(spark):
    got = sources.numbered_sheet(spark.createDataFrame([(i, "" if i == 3 else f"t{i}") for i in range(50)], "o int, t string"), F.col("o"), "t").collect()
    assert len(got) == 49 and all(r.row_id == r.o and r.row_no == r.o + 1 for r in got)


def test_numbered_sheet_of_wide_rows(spark, tmp_path):
    """At Spark's own defaults, where adaptive execution merges partitions by their bytes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        wide = spark.range(400_000).select(F.xxhash64("id").alias("o"), F.concat(*[F.sha2(F.concat("id", F.lit(str(k))), 256) for k in range(10)]).alias("t"))
        wide.write.parquet(f"{tmp_path}/in")
        sources.numbered_sheet(spark.read.parquet(f"{tmp_path}/in"), F.col("o"), "t").write.parquet(f"{tmp_path}/out")
        got = spark.read.parquet(f"{tmp_path}/out").select("o", "row_id", "row_no").toPandas().sort_values("o")
        assert got["row_id"].tolist() == list(range(400_000)) and (got["row_no"] == got["row_id"] + 1).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_of(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/b")
    assert sources.first_of(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "hi"), (2, "vượt đèn đỏ"), (3, "khai sinh cho con")], "qid long, text string")
    df.write.parquet(f"{tmp_path}/in")
    route_files(spark, f"{tmp_path}/in", "qid long, text string", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(df.withColumn("route", route(F.col("text"))).collect())


def test_collection(spark, tmp_path):
    c = sources.Collection(spark, f"{tmp_path}/v")
    c.reset(spark.range(3))
    c.add(spark.range(2))
    assert c.count() == 5

"""Sources and sinks: tables, sheets with a fallback, CSV, JSON lines, reports, vector collections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of a crawled record, in order.
RECORD_COLUMNS = ["ma_thu_tuc", "ten_thu_tuc", "linh_vuc", "cap_thuc_hien", "co_quan", "thanh_phan_ho_so", "thoi_gian_text", "thoi_gian_ngay", "le_phi_text", "le_phi_vnd", "can_cu_phap_ly", "nguon_url", "ngay_crawl"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than half the cores dealt out over all of them, for costly expressions; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary folder in local
    mode where that is unset."""
    if not (folder := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Rows that several steps read, written once and read again: a lost executor costs its own tasks alone."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By the file system that Spark reads it with."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first Parquet table that is there."""
    for path in paths:
        if exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(paths[0])


def in_order(df: DataFrame, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of an order, sorted and written once, with __part and __place (from 0 in each part); and how many
    rows there are before each part, a row each. Ranges are fixed when they are written: whatever reads them later, in
    any number of branches, sees the same parts, which a plan that takes the numbers twice from one shuffle does not."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = F.monotonically_increasing_id()
    stage = staged(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__place", numbers.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    # No more parts than the shuffle has: the window is over a row for each.
    return stage, stage.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")


def numbered_sheet(rows: DataFrame, order: Column, first_cell: str) -> DataFrame:
    """Rows with something in the first cell, with row_no from 1 and row_id from 0 over all rows in the sheet's order.

    Rows are numbered within written ranges of the order, and ranges by their counts, so no task sees the whole sheet.
    """
    stage, before = in_order(rows.withColumn("__order", order), F.col("__order"))
    out = stage.join(F.broadcast(before), "__part").withColumn("row_id", F.col("__place") + F.col("__before")).withColumn("row_no", F.col("row_id") + 1)
    return out.drop("__part", "__place", "__order", "__before").where(F.coalesce(F.trim(F.col(first_cell)), F.lit("")) != "")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; a byte-order mark is taken off the first name by Spark's reader, as the schema is given."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Crawled records with the columns in their order."""
    records.select(*RECORD_COLUMNS).write.mode("overwrite").parquet(path)


def crawled(pages: DataFrame, max_items: int | None = None) -> DataFrame:
    """Pages once for each url, the first by page_id; max_items is the crawl's own cap."""
    once = pages.groupBy("url").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("p")).select("p.page_id", "url", "p.html")
    return once.orderBy("page_id").limit(max_items) if max_items else once


def listed(links: DataFrame, base: str, max_pages: int | None = None) -> DataFrame:
    """page, place, url, title of the links (page, place, href, title) on the first pages of a list: those with an
    address and a title, each address once, where it is first seen."""
    from ..functions.extract import absolute_url

    some = links.where(F.col("page") <= max_pages) if max_pages else links
    some = some.where((F.coalesce(F.trim("title"), F.lit("")) != "") & (F.coalesce("href", F.lit("")) != "")).withColumn("url", absolute_url(F.col("href"), base))
    return some.groupBy("url").agg(F.min(F.struct("page", "place", F.trim("title").alias("title"))).alias("f")).select("f.page", "f.place", "url", "f.title")


def fetched(links: DataFrame, answers: DataFrame) -> DataFrame:
    """Listed links with their page, or with what went wrong, as a row of its own: a page that failed ends nothing.
    answers: url, status, html."""
    joined = links.join(answers.select("url", "status", "html"), "url", "left")
    error = F.when(F.col("status").isNull(), "no answer").when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    return joined.withColumn("error", error).withColumn("html", F.when(error.isNull(), F.col("html")))


def with_fallback(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Of two lookups the first one's value, else the second one's."""
    return first.select(key, F.col(value).alias("__a")).join(second.select(key, F.col(value).alias("__b")), key, "full").select(key, F.coalesce("__a", "__b").alias(value))


class Collection:
    """Vectors as Parquet: reset, add, count, scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def reset(self, vectors: DataFrame) -> None:
        vectors.write.mode("overwrite").parquet(self.path)

    def add(self, vectors: DataFrame) -> None:
        vectors.write.mode("append").parquet(self.path)

    def scan(self, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(self.path)
        return df.select(*columns) if columns else df

    def count(self) -> int:
        return self.scan().count()

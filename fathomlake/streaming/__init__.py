"""Extensions for streams: questions routed as they come, sessions that end after a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import route


def routed(questions: DataFrame) -> DataFrame:
    """Adds a route to each question; stateless, for batches and streams alike."""
    return questions.withColumn("route", route(F.col("text")))


def route_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Routes the Parquet files in a folder that were not yet routed, then stops."""
    stream = spark.readStream.schema(schema).parquet(source)
    return routed(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of events (user_id, ts) with gaps up to so long; late events are taken up to the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stamped = stamped.withWatermark("ts", late) if events.isStreaming else stamped
    grouped = stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

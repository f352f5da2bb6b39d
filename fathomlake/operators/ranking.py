"""Top k for each query, and small sides of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS


def top_k(df: DataFrame, by: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each query with their 0-based rank. Spark keeps k rows of a query in each task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).where(F.col(name) < k)


def small(df: DataFrame, limit: int = SETTINGS.broadcast_rows, width: Column | None = None, most: int = SETTINGS.broadcast_bytes) -> DataFrame:
    """Marked for broadcast if a count shows it to be small, and, where rows hold texts (width: a row's bytes), their sum too.
    Otherwise joined by a shuffle, whatever Spark guesses: it goes by the size of files, where texts that repeat take no room."""
    first = df.select((F.lit(0) if width is None else width).alias("width")).limit(limit + 1)
    n, total = (first.count(), 0) if width is None else first.agg(F.count("*"), F.sum("width")).first()
    return F.broadcast(df) if n <= limit and (total or 0) <= most else df.hint("merge")

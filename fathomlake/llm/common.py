"""Helpers shared by the operators: tables, the shared folder, and arrays of texts."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a run of the six ASCII white-space characters, and of a word.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
#: Paths of the tables written in the open `cleared` blocks of this thread or task, the innermost last.
_written: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("written", default=())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """Only (doc_id, text), and a row key where one is given, a null text as the empty one, so that other columns of any name do no harm."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([] if key is None else [key.alias("key")]))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words between ASCII white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset, in local mode."""
    if not (found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows once as Parquet to the shared folder and reads them again. The table stays, as
    results that read it are lazy, unless it is written in a `cleared` block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if open_blocks := _written.get():
        open_blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like the given one that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written, with a number each, and the name of its column: ids may be null or repeated, and a decision is
    about one row."""
    name = fresh("row_number", docs.columns)
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Of the tables written inside only the last stays; the others are deleted when it ends, so nothing lazy that reads
    them may come out of it. Blocks can be nested: the last table of an inner one counts as written in the outer one. A
    block knows the tables of its own thread alone, so that queries that run beside it keep theirs."""
    outer, inner = _written.get(), []
    before = _written.set((*outer, inner))
    try:
        yield
    finally:
        _written.reset(before)
        *gone, last = inner or [None]
        for path in gone:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if last and outer:
            outer[-1].append(last)


def shards_for(spark: SparkSession, n_keys: float, keys_each: int = 2_000_000) -> int:
    """Groups to deal keys into: of at most about keys_each, and several for each shuffle partition."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_keys / keys_each) + 1)


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the n + 1 offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def release() -> None:
    """Gives memory that a task no longer uses back to the system: workers live on and hold it beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)

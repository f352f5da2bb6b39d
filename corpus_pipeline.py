"""A corpus pipeline of five stages: toxicity, exact dedup, near dedup, decontamination, packing.

Every stage takes rows with doc_id and text and any other columns, of any names, and all but the last return the same
columns. A decision is about one row: rows with a null doc_id, or with one doc_id on different texts, are told apart by a
written row number. A null text is the empty text; empty tables give empty tables; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlake.llm.common import cleared, numbered, table, written
from fathomlake.llm.op1_packing import pack
from fathomlake.llm.op2_decontamination import contaminated
from fathomlake.llm.op5_toxicity import without_toxic
from fathomlake.llm.op7_exact_dedup import exact_dedup
from fathomlake.llm.op10_minhash_dedup import near_dedup

#: Words of a shingle and per cent of similarity of the near-dedup stage.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. Empty and null texts have the score of no savings; repeated rows go or stay
    together; with too few labelled documents none goes."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def _without(docs: DataFrame, stage: str, gone: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows but for those whose numbers an operator gives as `key`; of its tables only the numbers stay. Only numbers
    meet the rows again."""
    rows, name = numbered(docs)
    with cleared(docs.sparkSession):
        keys = written(gone(rows, name).select(F.col("key").alias(name)), stage)
    return rows.join(keys, name, "left_anti").drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays, of several with that id or with null ids the first by row
    number. Null and empty texts are equal."""
    return _without(docs, "copies", lambda rows, name: exact_dedup(rows, key=name).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one of the smallest doc_id, then of the least row number; ties are
    told apart by it, and a null doc_id comes last. Texts without words are near copies of nothing and stay."""
    return _without(docs, "near_copies", lambda rows, name: near_dedup(rows, SHINGLE, PERCENT, key=name).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each repeated row by itself; empty texts and items hold and match nothing."""
    items = table(spark, sf_dir, "benchmark")
    return _without(docs, "contaminated", lambda rows, name: contaminated(rows, items, key=name).select("key").distinct())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of 2048 tokens; a null or empty text is its end token, a long one is
    cut, and repeated rows are packed as often as they are there."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontamination), ("packing", packing)]
#: Compression, MinHash and tokenizers are beyond SQL: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave. The tables that a stage writes are deleted once its result is written, and the
    results in the end, but for the last."""
    docs = table(spark, sf_dir, "documents")
    with cleared(spark):
        for name, stage in STAGES:
            with cleared(spark):
                docs = written(stage(spark, docs, sf_dir), name)
    return docs

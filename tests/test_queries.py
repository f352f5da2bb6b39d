"""Every query with a SQL counterpart gives the same rows as DuckDB; the others give rows."""

from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd
import pytest

from fathomlake.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [plain(x) for x in v]
    if v is None or pd.isna(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(df: pd.DataFrame) -> Counter:
    return Counter(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.sql(ORACLES[name]).df())
    else:
        assert len(got)

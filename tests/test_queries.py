"""The driver's comparison on the smallest tables, for a spread of queries; the driver runs all of them."""

import duckdb
import pandas as pd
import pytest

from grafloom import queries as Q
from grafloom import queries_checked  # noqa: F401  adds to Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = sorted(Q.SQL)[::5]


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def values(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, sf_dir).toPandas(), db.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 210
    assert set(e.oracle_sql()) <= set(e.queries())

"""Each registered analytics query gives the rows of its SQL."""

import duckdb
import pandas as pd
import pytest

from dendra.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if pd.isna(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_registers_all_with_sql():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

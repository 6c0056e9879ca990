"""Every registered query that has SQL agrees with DuckDB."""

import os

import duckdb
import pytest

from lodestrata.plans.oracle import ORACLE
from lodestrata.plans.registered import REGISTERED

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    got = REGISTERED[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

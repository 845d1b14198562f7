"""Every registered query runs; SQL-expressible ones equal the DuckDB oracle
on sf0.001 (row count, column names, order-insensitive values)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as se  # noqa: E402
from oracle_check import rows_of  # noqa: E402

from healthwatch.sources.tables import TABLES  # noqa: E402

from conftest import SF_SMOKE  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMOKE}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_query_has_oracle_or_a_brute_force_test():
    """Queries of the library all have SQL.  Those of the optional text
    operators may do without: their tests compare them with brute force."""
    from healthwatch.plans.catalog import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(se.oracle_sql()) <= set(se.queries())


SPARK_TO_DUCK = {"StringType": "VARCHAR", "LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE",
                 "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP", "FloatType": "FLOAT"}


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = se.queries()[name](spark, SF_SMOKE)
    stypes = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, str(f.dataType)) for f in sdf.schema.fields}
    otypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({se.oracle_sql()[name]})").fetchall()}
    assert stypes == otypes
    pdf = sdf.toPandas()
    odf = con.execute(se.oracle_sql()[name]).df()
    sc, sr = rows_of(pdf)
    oc, orr = rows_of(odf)
    assert sc == oc
    assert sr == orr

"""Every query against its SQL at the smallest scale, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from amalgam.functions import cleanse
from amalgam.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE:
        want = con.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_phones_of_sixteen_characters(spark, tmp_path):
    """Keys of five digits and more: the operator counts 15 characters after a plus, the query 15 in all, as its SQL."""
    duckdb.sql(f"COPY (SELECT * FROM (VALUES (9999, 24), (10000, 3), (10000, 10), (123456, 7), (899999, 24)) t(c_custkey, c_nationkey)) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    want = duckdb.sql(ORACLE["clean_phone"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet'")).df()
    assert rows(QUERIES["clean_phone"](spark, str(tmp_path)).toPandas()) == rows(want)
    assert spark.range(1).select(cleanse.validate_phone(F.lit("+1 (10000) 55-10"))).head()[0]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

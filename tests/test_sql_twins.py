"""Registered queries against their DuckDB twins on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SLOW = ("lnk_", "clu_", "evl_core", "red_tsne", "mdl_")  # iterative: checked by check.py at sf0.01
NAMES = [n for n in entry.oracle_sql() if not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert len(got) > 0
    assert check.compare(got, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_every_oracle_has_a_query():
    from foldspark.oracles import ORACLES

    assert set(ORACLES) <= set(entry.queries())

"""Every registered query against its SQL twin, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from verify import canonical, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(entry.oracle_sql()[name])
    want = canonical(rel.columns, rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(map(same, got[1], want[1]))


def test_text_pairs(spark):
    rows = entry.queries()["text_pair_grid"](spark, SMALL).collect()
    assert len(rows) == 6 and all(0 <= r.recall_at_10_translated <= 1 for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_row", "corpus_row", "rel", "rank", "score", "hit"]
    assert df.count() > 0

"""Every query that has SQL equals it on the smallest driver tables."""

import os

import duckdb
import pytest

from larder.plans import screen_queries as catalog_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(tuple("-" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v).removesuffix(" 00:00:00") for v in r) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_oracle(spark, duck, name):
    got = catalog_queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog_queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

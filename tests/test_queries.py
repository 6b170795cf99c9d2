from collections import Counter

import duckdb
import pytest

from aclweave.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = Counter(duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]})").fetchall())
    assert got == want

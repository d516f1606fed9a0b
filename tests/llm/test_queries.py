import duckdb
import pytest

from gridloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import os

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, FOLDER), con.sql(queries.SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_a_query_gives_the_counts_of_every_pair_found(spark):
    found = {tuple(r) for r in queries.QUERIES["p4_found"](spark, FOLDER).collect()}
    counted = [q(spark, FOLDER) for name, q in queries.QUERIES.items() if name.startswith("p4_")]
    held = [{tuple(r)[:2] for r in df.collect()} for df in counted if "n_ab" in df.columns]
    assert found and any(found <= pairs for pairs in held)

"""Every core query runs on the smallest tables and equals its SQL, where it has some."""

import os

import duckdb
import pytest

import __spark_entry__
from gridloom.experiment import Experiment, load_matrix, pass_through, reordered
from gridloom.operators import density
from gridloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = __spark_entry__.queries()[name](spark, FOLDER), con.sql(registry.SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_experiment_keys(spark):
    from helpers import B_COL, B_PTR, build, from_csr

    read = lambda n: build(spark, from_csr(B_PTR, B_COL), n)
    kernel = lambda data, params, k: density.density_grid(data["processed_format"], k)
    e = Experiment(spark).add_loader(load_matrix(read), [7, 8]).add_preprocess("no", pass_through).add_preprocess("rcm", reordered("rcm")).add_kernel("grid", kernel, 2)
    e.run(times=2, store_auxiliary=True)
    assert set(e.times) == {(t, p, "grid", n) for t in ("7", "8") for p in ("no", "rcm") for n in (0, 1)}
    assert ("order", 7, "rcm") in e.auxiliary and e.table().count() == 8

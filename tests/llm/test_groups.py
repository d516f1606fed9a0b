import random

import pytest

from gridloom.llm import groups

SCHEMA = "i bigint, j bigint, v double"


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j, _ in pairs:
        if i is not None and j is not None and i != j:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def got(df):
    rows = [(r["id"], r["group_id"]) for r in df.collect()]
    assert len(rows) == len({i for i, _ in rows})
    return dict(rows)


def cases():
    rng = random.Random(3)
    yield [(k + 1, k, None) for k in range(60)]
    yield [(0, k, 1.0) for k in range(1, 200)] + [(k, 500 + k, 1.0) for k in range(1, 200)]
    ids = list(range(100))
    rng.shuffle(ids)
    yield [(ids[k], ids[k + 1], 0.5) for k in range(99) if k % 10]
    yield [(rng.randrange(300), rng.randrange(300), None) for _ in range(200)]
    yield [(-5, 7, 1.0), (7, -5, 1.0), (7, 7, 1.0), (3, 3, 1.0), (None, 3, 1.0), (3, None, 1.0), (None, None, None), (-5, 7, 1.0)]


@pytest.mark.parametrize("pairs", list(cases()))
def test_groups_against_union_find(spark, pairs):
    assert got(groups.link_groups(spark.createDataFrame(pairs, SCHEMA))) == brute(pairs)


def test_no_links(spark):
    assert got(groups.link_groups(spark.createDataFrame([], SCHEMA))) == {}
    assert got(groups.link_groups(spark.createDataFrame([(1, 1, 1.0), (None, 2, 1.0)], SCHEMA))) == {}


def test_all_records_and_clashing_columns(spark):
    links = spark.createDataFrame([(4, 2, "a", 1), (4, 9, "b", 2)], "i bigint, j bigint, group_id string, least int")
    vertices = spark.createDataFrame([(1, [1.0]), (1, None), (2, None), (None, None)], "id bigint, w array<double>")
    assert got(groups.all_groups(vertices, links)) == {1: 1, 2: 2, 4: 2, 9: 2}

import itertools
import random
from collections import Counter, defaultdict

import pytest

from gridloom.llm import together

SCHEMA = "net bigint, cell bigint"


def brute(pins, min_count=1, lift=(0, 1)):
    nets = defaultdict(set)
    for n, c in pins:
        if n is not None and c is not None:
            nets[n].add(c)
    single = Counter(c for s in nets.values() for c in s)
    pairs = Counter(p for s in nets.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b, k, single[a], single[b], len(nets)) for (a, b), k in pairs.items() if k >= min_count and k * len(nets) * lift[1] >= single[a] * single[b] * lift[0]}


def got(df):
    return {tuple(r)[:6] for r in df.collect()}


def pins(seed):
    rng = random.Random(seed)
    out = [(n, int(rng.paretovariate(0.7)) % 50) for n in range(80) for _ in range(rng.randint(0, 8))]
    out += [(1000, c) for c in range(60)]
    return out + out[:20] + [(None, 1), (1, None), (None, None)]


@pytest.mark.parametrize("chunk", [3, 7, 256])
def test_all_pairs(spark, chunk):
    p = pins(1)
    out = together.pairs_together(spark.createDataFrame(p, SCHEMA), chunk_items=chunk)
    assert got(out) == brute(p)
    assert all(abs(r["lift"] - r["n_ab"] * r["n_baskets"] / (r["n_a"] * r["n_b"])) < 1e-12 for r in out.collect())


@pytest.mark.parametrize("count, lift", [(3, (0, 1)), (1, (2, 1)), (2, (3, 2))])
def test_pruning_loses_nothing(spark, count, lift):
    p = pins(2)
    assert got(together.pairs_together(spark.createDataFrame(p, SCHEMA), min_count=count, min_lift=lift, chunk_items=5)) == brute(p, count, lift)


def test_a_huge_basket_is_cut_into_chunks(spark):
    p = [(1, c) for c in range(-300, 300)] + [(2, c) for c in range(0, 600, 13)] + [(3, c) for c in range(0, 600, 26)]
    df = spark.createDataFrame(p, SCHEMA)
    pieces = together._pieces(df.selectExpr("net as basket", "cell as item"), 40).collect()
    assert max(len(r["left"]) + len(r["right"] or []) for r in pieces) <= 160
    assert got(together.pairs_together(df, min_count=2, chunk_items=40)) == brute(p, 2)


def test_pairs_of_every_fiftieth_item(spark):
    p = pins(3)
    out = got(together.pairs_together(spark.createDataFrame(p, SCHEMA), every=5, chunk_items=6))
    assert out == {r for r in brute(p) if r[0] % 5 == 0 or r[1] % 5 == 0}


def test_empty_and_clashing(spark):
    assert got(together.pairs_together(spark.createDataFrame([], SCHEMA))) == set()
    assert got(together.pairs_together(spark.createDataFrame([(None, 1), (2, None)], SCHEMA))) == set()
    p = spark.createDataFrame([(1, 5, "x", 1), (1, 6, "y", 2)], "net bigint, cell bigint, basket string, n int")
    assert got(together.pairs_together(p)) == {(5, 6, 1, 1, 1, 1)}

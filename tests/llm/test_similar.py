import random
from collections import defaultdict

import pytest

from gridloom.llm import similar
from gridloom.runtime import Scratch

SCHEMA = "i bigint, cols array<bigint>"


def sets_of(rows):
    out = defaultdict(set)
    for i, cols in rows:
        if i is not None and cols:
            out[i] |= {c for c in cols if c is not None}
    return {i: s for i, s in out.items() if s}


def brute(rows, num, den):
    s = sets_of(rows)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) * den >= len(s[a] | s[b]) * num}


def rows(seed, n=150):
    rng = random.Random(seed)
    base = [[int(rng.paretovariate(0.6)) % 200 for _ in range(rng.randint(1, 20))] for _ in range(n // 5)]
    out = []
    for k in range(n):
        cols = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if cols and rng.random() < 0.5:
                cols.pop(rng.randrange(len(cols)))
            else:
                cols.append(rng.randrange(200))
        out.append((k, cols + ([None] if rng.random() < 0.1 else []) + cols[:1]))
    return out + out[:10] + [(500, []), (501, None), (None, [1, 2]), (502, [None]), (503, [0]), (504, [0]), (505, [0, 1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("num, den", [(3, 4), (1, 2), (1, 1), (9, 10)])
def test_pairs_against_brute_force(spark, seed, num, den):
    r = rows(seed)
    out = similar.similar_pairs(spark.createDataFrame(r, SCHEMA), num, den).collect()
    pairs = [(x["row_a"], x["row_b"]) for x in out]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(r, num, den)


def test_template_sets_share_a_core(spark):
    r = [(k, [*range(30), 100 + k]) for k in range(25)] + [(100 + k, list(range(8 + k))) for k in range(6)]
    out = similar.similar_pairs(spark.createDataFrame(r, SCHEMA)).collect()
    assert {(x["row_a"], x["row_b"]) for x in out} == brute(r, 3, 4)


@pytest.mark.parametrize("num, den", [(3, 4), (1, 2)])
def test_sizes_around_the_bound_of_paired_signatures(spark, num, den):
    rng, r = random.Random(8), []
    for k in range(60):
        base = rng.sample(range(400), rng.choice([30, 48, 60, 64, 65, 80, 130]))
        for _ in range(2):
            r.append((len(r), [c for c in base if rng.random() > rng.choice([0.02, 0.15, 0.3])] + rng.sample(range(400), rng.randint(0, 6))))
    out = similar.similar_pairs(spark.createDataFrame(r, SCHEMA), num, den).collect()
    assert {(x["row_a"], x["row_b"]) for x in out} == brute(r, num, den)


def test_records_share_pivots(spark):
    rng, r = random.Random(2), []
    for k in range(40):
        base = rng.sample(range(10_000), 20)
        r += [(10 * k + c, base[:c] + base[c + 1 :]) for c in range(10)]
    scratch = Scratch(spark, "test")
    sets = similar.record_sets(spark.createDataFrame(r, SCHEMA))
    live, heads = similar.live_records(sets, 3, 4, scratch)
    homes = similar.elect_homes(live, heads, 3, 4, scratch)
    cells = similar.replicate(live, homes, 3, 4, scratch)
    assert live.count() == homes.count() == 400 and homes.select("pivot").distinct().count() <= 0.3 * 400
    assert cells.count() <= 1200


def test_summary(spark):
    r = rows(4, 80)
    pairs = brute(r, 3, 4)
    s = sets_of(r)
    out = {x["rec"]: x for x in similar.similar_summary(spark.createDataFrame(r, SCHEMA)).collect()}
    assert set(out) == set(s)
    for i, x in out.items():
        assert x["n_links"] == sum(i in p for p in pairs)
        assert x["class_id"] == min(k for k in s if s[k] == s[i])


def test_exactly_at_the_threshold_empty_and_clashing(spark):
    r = spark.createDataFrame([(1, [1, 2, 3, 4], 9), (2, [1, 2, 3], 9)], "i bigint, cols array<bigint>, vals int")
    assert [tuple(x) for x in similar.similar_pairs(r).collect()] == [(1, 2, 0.75)]
    assert similar.similar_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert similar.similar_summary(spark.createDataFrame([], SCHEMA)).collect() == []

import random

import numpy as np
import pytest

from gridloom.llm import mixture, tokens

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def path():
    return tokens.tokenizer_path("byte_bpe_50k.tiktoken")


def docs(n=600):
    rng = random.Random(2)
    names = ["big"] * 8 + ["mid"] * 3 + ["small"]
    out = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(k) for _ in range(rng.randint(1, 40))), rng.choice(names)) for k in range(n)]
    return out + [(n, None, "big"), (n + 1, "", "mid"), (n + 2, "x y", None), (n + 3, "z", "untargeted"), (n + 4, out[0][1], out[0][2]), (n + 5, out[1][1], "mid")]


def test_pivot_keeps_the_weighted_sum():
    rng = np.random.default_rng(1)
    for _ in range(50):
        p, size = rng.random(40), rng.integers(1, 100, 40).astype(float)
        out = mixture.pivot(p, size, rng)
        assert abs((p * size).sum() - (out * size).sum()) < 1e-6
        assert ((out > 0) & (out < 1)).sum() <= 1


def test_pivot_keeps_expectations():
    p, size = np.array([0.2, 0.5, 0.7, 0.9]), np.array([1.0, 3.0, 2.0, 5.0])
    runs = np.array([mixture.pivot(p, size, np.random.default_rng(s)) for s in range(4000)])
    assert np.abs(runs.mean(axis=0) - p).max() < 0.03


@pytest.mark.parametrize("bucket", [7, 4096])
def test_shares_and_caps(spark, path, bucket):
    df = spark.createDataFrame(docs(), DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 6), ("absent", 0.1, 3)], TARGETS)
    mix, shares = mixture.mix_sources(df, targets, path, bucket_items=bucket)
    rows, got = mix.collect(), {r["source"]: r for r in shares.collect()}
    caps = {"big": 1, "mid": 2, "small": 6}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert got["absent"]["used_tokens"] == 0 and got["absent"]["aim"] == 0
    total = sum(r["n_tokens"] * r["copies"] for r in rows)
    for s in caps:
        assert abs(got[s]["actual_share"] - got[s]["aim"]) * total <= 200
        assert got[s]["used_tokens"] == sum(r["n_tokens"] * r["copies"] for r in rows if r["source"] == s)
    ids = {r["doc_id"] for r in rows}
    assert not ids & {600, 601, 602, 603, 604, 605}
    again = mixture.mix_sources(df.repartition(3), targets, path, bucket_items=bucket)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    uses = mixture.expand(mix, df).collect()
    assert len(uses) == sum(r["copies"] for r in rows) and all(u["text"] for u in uses)


def test_a_total_beyond_the_caps_falls_short(spark, path):
    df = spark.createDataFrame(docs(100), DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 50), ("big", 0.4, 9), (None, 0.1, 1), ("small", None, 2)], TARGETS)
    mix, shares = mixture.mix_sources(df, targets, path, total_tokens=20_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["big"]["used_tokens"] == got["big"]["available_tokens"] and got["big"]["max_copies"] == 1
    assert got["small"]["used_tokens"] == 0 and set(got) == {"big", "mid", "small"}


def test_empty_and_clashing(spark, path):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mix, shares = mixture.mix_sources(none, targets, path)
    assert mix.collect() == [] and shares.collect()[0]["used_tokens"] == 0
    one = spark.createDataFrame([(1, "one text", "a", 5, "x")], DOCS + ", size int, rate string")
    mix, _ = mixture.mix_sources(one, targets, path)
    assert [(r["doc_id"], r["copies"]) for r in mix.collect()] == [(1, 2)]
    mix, shares = mixture.mix_sources(one, spark.createDataFrame([], TARGETS), path)
    assert mix.collect() == [] and shares.collect() == []

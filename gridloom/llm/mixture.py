"""Mixing sources to target shares of tokens.

The number of uses that a source's texts need on average is cut into a whole
part, which every text gets, and a fraction. Fractions are rounded by pivotal
sampling: of two texts one gives mass, measured in tokens, to the other until
one of the two is whole, in a random direction that leaves both expectations as
they were. The texts of a bucket meet in the rounds of a tournament, which ends with
at most one fraction; those of all buckets meet in the next level of a reduction
tree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tokens import count_tokens
from gridloom.runtime import Scratch

_NEAR = 1e-9
#: So many of the smallest texts of a bucket come last.
_SMALL = 16


def _transfer(p: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, draws: np.ndarray) -> None:
    """Move mass between the fractions at ``a`` and those at ``b``, pair by pair, until one of each two is whole."""
    up = np.minimum((1 - p[a]) * size[a], p[b] * size[b])
    down = np.minimum(p[a] * size[a], (1 - p[b]) * size[b])
    mass = np.where(draws * (up + down) < down, up, -down)
    p[a] += mass / size[a]
    p[b] -= mass / size[b]
    _snap(p)


def _snap(p: np.ndarray) -> None:
    p[p <= _NEAR] = 0.0
    p[p >= 1 - _NEAR] = 1.0


def _open(p: np.ndarray, among: np.ndarray) -> np.ndarray:
    return among[(p[among] > 0) & (p[among] < 1)]


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round all but at most one of ``p``, keeping sum(p * size) and every expectation.

    Fractions meet in pairs, and what is left of each pair meets in the next round of the tournament. The last _SMALL of
    ``p`` wait for the one that is left of the others and meet it one by one, so that the fraction that stays is one of them.
    """
    p = p.astype(np.float64).copy()
    _snap(p)
    left = _open(p, np.arange(len(p)))
    left, small = left[: max(0, len(left) - _SMALL)], left[max(0, len(left) - _SMALL) :]
    while len(left) > 1:
        a, b = left[: len(left) // 2 * 2 : 2], left[1::2]
        _transfer(p, size, a, b, rng.random(len(a)))
        left = _open(p, left)
    for k in small:
        if len(left):
            both = np.array([left[0], k])
            _transfer(p, size, both[:1], both[1:], rng.random(1))
            left = _open(p, both)
        else:
            left = np.array([k])
    return p


def _bucket_seed(seed: int, level: int, source: str, bucket: int) -> np.random.Generator:
    return np.random.default_rng([seed, level, bucket, *source.encode()])


def round_fractions(items: DataFrame, seed: int, bucket_items: int) -> DataFrame:
    """(source, doc_id, p) with every p rounded to 0 or 1, from (source, doc_id, size, p).

    Per source the sum of p * size moves by less than the largest size, through the last fraction of all.
    """
    scratch = Scratch(items.sparkSession, "rounding")
    schema = "source string, doc_id bigint, size bigint, p double"

    def rounded(level: int, last: bool):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True])  # the fraction that is left is then a small text's
            rng = _bucket_seed(seed, level, key[0], key[1])
            p = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy().astype(np.float64), rng)
            if last:
                p = np.where((p > 0) & (p < 1), rng.random(len(p)) < p, p).astype(np.float64)
            return pdf[["source", "doc_id", "size"]].assign(p=p)

        return run

    levels, now, level = [], scratch.write(items.select("source", "doc_id", "size", "p")), 0
    while True:
        counts = now.groupBy("source").agg(F.ceil(F.count("*") / bucket_items).alias("buckets"))
        last = (counts.agg(F.max("buckets")).first()[0] or 0) <= 1
        put = now.join(counts, "source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id"), "buckets")).drop("buckets")
        out = scratch.write(put.groupBy("source", "bucket").applyInPandas(rounded(level, last), schema))
        levels.append(out.where("p = 0 or p = 1"))
        if last:
            return reduce(DataFrame.union, levels).select("source", "doc_id", "p")
        now, level = out.where("p > 0 and p < 1"), level + 1


def _texts(documents: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each distinct text of a targeted source: (source, doc_id, size)."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.sha2("text", 256).alias("digest")).where("text is not null and source is not null and doc_id is not null")
    kept = docs.join(targets.select("source"), "source", "left_semi").groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("s")).select("s.*")
    return kept.join(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("size")).where("size > 0"), "doc_id").select("source", "doc_id", "size")


def mix_sources(documents: DataFrame, targets: DataFrame, path: str, total_tokens: int | None = None, seed: int = 7, bucket_items: int = 4096) -> tuple[DataFrame, DataFrame]:
    """A mixture of ``documents`` (doc_id, text, source) by ``targets`` (source, target_share, max_repeats).

    Gives (mixture, shares). mixture: (source, doc_id, n_tokens, copies) of each text that is used, copies >= 1.
    shares: one row a target: source, target_share, max_repeats, aim (the share among sources that have texts),
    n_texts, available_tokens, used_tokens, max_copies, actual_share (of all used tokens).

    A text counts once however many documents hold it: its document with the smallest id and that one's source stand
    for all, so no text is used more than max_repeats times. Null, empty and blank-to-no-token texts, null sources and
    sources without a target stay out. A target without texts gets nothing and the others share its part (aim). Targets
    with a null or negative share or without a positive max_repeats count as 0. Repeated targets: the one with the
    largest share counts.

    ``total_tokens`` is the size of the mixture; by default the largest at which every source reaches its aim within
    its cap. If it is larger, a source at its cap stays there and falls short, as shares tells. A source that is a
    third of all rows is spread over buckets of ``bucket_items`` texts; the same seed gives the same mixture.
    """
    scratch = Scratch(documents.sparkSession, "mixture")
    targets = (
        targets.where("source is not null").groupBy("source")
        .agg(F.max(F.struct(F.coalesce(F.greatest(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce(F.greatest(F.col("max_repeats").cast("int"), F.lit(0)), F.lit(0)).alias("max_repeats"))).alias("t"))
        .select("source", "t.*")
    )
    texts = scratch.write(_texts(documents, targets, count_tokens(documents, path)))
    have = texts.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("size").alias("available_tokens"))
    plan = targets.join(have, "source", "left").fillna(0, ["n_texts", "available_tokens"])
    can = (F.col("available_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    sums = plan.where(can).agg(F.sum("target_share").alias("w"), F.min(F.col("max_repeats") * F.col("available_tokens") / F.col("target_share")).alias("t")).first()
    weight = sums["w"] or 1.0
    total = float(total_tokens) if total_tokens is not None else (sums["t"] or 0.0) * weight
    aim = F.when(can, F.col("target_share") / weight).otherwise(0.0)
    rate = F.when(can, F.least(aim * total / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    plan = scratch.write(plan.withColumn("aim", aim).withColumn("rate", F.when(F.abs(rate - F.round(rate)) < _NEAR, F.round(rate)).otherwise(rate)))
    rated = texts.join(plan.select("source", "rate"), "source").select("source", "doc_id", "size", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"))
    extra = round_fractions(rated.where("p > 0"), seed, bucket_items).select("doc_id", F.col("p").cast("int").alias("extra"))
    used = rated.join(extra, "doc_id", "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    mixture = scratch.write(used.where("copies > 0").select("source", "doc_id", F.col("size").alias("n_tokens"), "copies"))
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("max_copies"))
    shares = plan.drop("rate").join(got, "source", "left").fillna(0, ["used_tokens", "max_copies"])
    all_used = mixture.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 0
    actual = F.when(F.lit(all_used) > 0, F.col("used_tokens") / F.lit(float(all_used))).otherwise(0.0)
    return mixture, shares.withColumn("actual_share", actual)


def expand(mixture: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, copy, source, text): a row for each use of a text, copy counting from 1."""
    uses = mixture.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    texts = documents.groupBy("doc_id").agg(F.min("text").alias("text"))
    return uses.join(texts, "doc_id").select("doc_id", "copy", "source", "text")

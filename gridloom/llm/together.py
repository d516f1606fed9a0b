"""Pairs of items that appear together in baskets.

Large-basket blocking: the items of a basket are hashed into chunks of bounded
size and each pair of chunks becomes a piece of work of its own, in a task of its
own; an ordinary basket is the case of one chunk. The pairs of all pieces are
counted with a partial step, then scored against independence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import Scratch

#: So many pairs are given out at once.
_PAIRS = 1 << 20


def _wide(c: str) -> Column:
    """An exact factor: products of two counts may exceed a BIGINT."""
    return F.col(c).cast("decimal(19,0)")


def _pieces(rows: DataFrame, chunk_items: int) -> DataFrame:
    """(basket, p, q, left, right): the items of chunk p and, if q is another one, of chunk q of each basket."""
    sizes = rows.groupBy("basket").agg(F.ceil(F.count("*") / chunk_items).cast("int").alias("chunks"), F.count("*").alias("k")).where("k > 1").drop("k")
    own = rows.join(sizes, "basket").withColumn("own", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int")).otherwise(0))
    put = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    put = put.select("basket", "item", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    side = lambda c: F.collect_list(F.when(F.col("own") == F.col(c), F.col("item")))
    return put.groupBy("basket", "p", "q").agg(side("p").alias("left"), F.when(F.col("p") != F.col("q"), side("q")).alias("right"))


def _lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, items): the items of each list ascending, from place ``first`` on; null lists have none."""
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    items = lists.flatten().to_numpy()
    items = items[np.lexsort((items, np.repeat(np.arange(len(size)), size)))]
    return np.cumsum(size) - size, size, items


def _piece_pairs(left: pa.Array, right: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) of each two items of the pieces, pieces of one shape at a time."""
    (first, n, items), (first_right, m, others) = _lists(left), _lists(right)
    alone = ~right.is_valid().to_numpy(zero_copy_only=False)
    shape = np.stack([n, np.where(alone, -1, m)])
    for a, b in np.unique(shape, axis=1).T:
        own = np.flatnonzero((shape[0] == a) & (shape[1] == b))
        x, y = np.triu_indices(a, 1) if b < 0 else (np.repeat(np.arange(a), b), np.tile(np.arange(b), a))
        step = max(1, _PAIRS // max(1, len(x)))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            second = items[(first[some][:, None] + y).ravel()] if b < 0 else others[(first_right[some][:, None] + y).ravel()]
            yield items[(first[some][:, None] + x).ravel()], second


def _pairs(pieces: DataFrame, every: int | None) -> DataFrame:
    """(a, b), a < b, for each two items of a piece; with ``every``, of which one is divisible by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in _piece_pairs(batch["left"], batch["right"]):
                if every is not None:
                    asked = (x % every == 0) | (y % every == 0)
                    x, y = x[asked], y[asked]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return pieces.select("left", "right").mapInArrow(run, "a bigint, b bigint")


def pairs_together(pins: DataFrame, basket: str = "net", item: str = "cell", min_count: int = 1, min_lift: tuple[int, int] = (0, 1), chunk_items: int = 256, every: int | None = None) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n_baskets, lift) of pairs item_a < item_b found together in a basket.

    n_ab baskets hold both, n_a and n_b hold each, lift = n_ab * n_baskets / (n_a * n_b). Pairs with n_ab < min_count or
    a lift below the fraction ``min_lift`` are left out; both tests are exact. Pins with a null end are left out first,
    repeated pins count once; a basket left without a pin does not count. Other columns are ignored. An empty table gives
    no rows.

    Before pairs are made, items go that cannot be in a result: those in fewer than min_count baskets, and those in more
    than n_baskets / min_lift of them, for n_ab <= n_b bounds their lift. This loses no pair. The rest of a basket is cut
    into chunks of about ``chunk_items``, so no task sees a whole huge basket.

    With ``every``, only the pairs of the items divisible by it, with all others, are given.
    """
    scratch = Scratch(pins.sparkSession, "together")
    b, x = F.col(basket).cast("bigint"), F.col(item).cast("bigint")
    rows = scratch.write(pins.select(b.alias("basket"), x.alias("item")).where("basket is not null and item is not null").distinct())
    n = rows.select("basket").distinct().count()
    num, den = min_lift
    items = rows.groupBy("item").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (_wide("n") * num <= F.lit(n).cast("decimal(19,0)") * den))
    items = scratch.write(items)
    kept = rows.join(items.select("item"), "item", "left_semi") if min_count > 1 or num > 0 else rows
    counted = _pairs(_pieces(kept, chunk_items), every).groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    side = lambda s: items.select(F.col("item").alias(s), F.col("n").alias(f"n_{s}"))
    out = counted.join(side("a"), "a").join(side("b"), "b").withColumn("n_baskets", F.lit(n).cast("bigint"))
    out = out.where(_wide("n_ab") * _wide("n_baskets") * den >= _wide("n_a") * _wide("n_b") * num)
    lift = F.col("n_ab").cast("double") * F.col("n_baskets") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", "n_baskets", lift.alias("lift"))

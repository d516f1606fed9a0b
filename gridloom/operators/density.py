"""Density of non-zeros on a grid, and products with a vector."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import ReorderError
from gridloom.model import Dense1D, Sparse2D
from gridloom.operators import features
from gridloom.operators.permute import permute_2d


def heatmap(m: Sparse2D, row_order: DataFrame | None = None, col_order: DataFrame | None = None, num_parts: int = 3) -> DataFrame:
    """(bi, bj, share): the share of all non-zeros in each of num_parts x num_parts blocks after both orders, zeros included.

    The block side is n_rows div num_parts on both axes; the last block takes what is left.
    """
    if num_parts < 1 or num_parts > min(m.n_rows, m.n_cols):
        raise ReorderError("more parts than rows or columns")
    side = m.n_rows // num_parts
    block = lambda c: F.least(F.floor(F.col(c) / side), F.lit(num_parts - 1)).cast("bigint")
    counts = permute_2d(m, row_order, col_order).nz.groupBy(block("i").alias("bi"), block("j").alias("bj")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    cells = m.spark.range(num_parts * num_parts).select(F.floor(F.col("id") / num_parts).alias("bi"), (F.col("id") % num_parts).alias("bj"))
    out = cells.join(counts, ["bi", "bj"], "left").join(F.broadcast(total))  # one row
    return out.select("bi", "bj", F.coalesce(F.col("c") / F.col("total"), F.lit(0.0)).alias("share"))


def density_grid(m: Sparse2D, bucket: int, weighted: bool = False) -> DataFrame:
    """(bi, bj, value): the non-zeros, or the sum of abs(v), in each square of side ``bucket`` that has some."""
    if bucket < 1:
        raise ReorderError("a bucket has at least one row")
    at = lambda c: F.floor(F.col(c) / bucket).alias(f"b{c}")
    value = F.sum(F.abs("v")).cast("double") if weighted else F.count("*").cast("double")
    return m.nz.groupBy(at("i"), at("j")).agg(value.alias("value"))


def spmv(m: Sparse2D, x: Dense1D) -> Dense1D:
    """The product of ``m`` and ``x``; a pattern counts as ones, empty rows give 0."""
    v = F.col("v") if m.valued else F.lit(1.0)
    y = m.nz.join(x.data.select(F.col("idx").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(v * F.col("x")).alias("y"))
    out = m.row_ids().join(y, "i", "left").select(F.col("i").alias("idx"), F.coalesce("y", F.lit(0.0)).alias("v"))
    return Dense1D(out, m.n_rows)


def visualize(m: Sparse2D, orders: Mapping[str, DataFrame], buckets: int = 32, weighted: bool = False) -> str:
    """An HTML page with the density in natural order and under each of ``orders``, with bandwidth and profile of each.

    The grid has at most ``buckets`` squares a side, so what reaches the driver is bounded by that.
    """
    bucket = max(1, -(-max(m.n_rows, m.n_cols) // buckets))
    parts = []
    for name, order in {"natural": None, **orders}.items():
        now = m if order is None else permute_2d(m, order, order)
        cells = {(r["bi"], r["bj"]): r["value"] for r in density_grid(now, bucket, weighted).collect()}
        top = max(cells.values(), default=1.0) or 1.0
        s = features.scalars(now, ["bandwidth", "profile"]).first()
        squares = "".join(f'<rect x="{bj}" y="{bi}" width="1" height="1" fill-opacity="{v / top:.4f}"><title>{v:g}</title></rect>' for (bi, bj), v in sorted(cells.items()))
        parts.append(f'<figure><figcaption>{html.escape(name)}: bandwidth {s["bandwidth"]}, profile {s["profile"]}</figcaption><svg viewBox="0 0 {buckets} {buckets}" width="320" height="320">{squares}</svg></figure>')
    return "<!doctype html><meta charset=utf-8><title>Density</title>" + "".join(parts)

"""Triangles of a pattern, from one listing over edges directed from the end of lower (degree, id).

That direction bounds every list of out-neighbours by the square root of twice the
number of edges, hubs included. To each out-neighbour v of u goes what follows v in
u's list; where that meets v's own list there is a triangle. An edge carries in two bits
which of its directions the pattern holds, so that one listing serves undirected
triangles, directed ones and common neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.model import Sparse2D
from gridloom.runtime import Scratch

#: So many list items are given out at once.
_ITEMS = 1 << 21
#: An item of a list is 4 * id + mask; of the mask, UP means that the pattern holds the edge from the lower end, DOWN that from the higher.
UP, DOWN = 1, 2


def oriented(nz: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, dv, mask): each undirected edge of ``nz`` once, from its end u of lower (degree, id); dv is the degree of v."""
    ends = nz.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(F.col("i") < F.col("j"), UP).otherwise(DOWN).alias("mask"))
    half = scratch.write(ends.groupBy("a", "b").agg(F.bit_or("mask").alias("mask")))
    deg = half.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    both = half.join(deg.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    turn = F.col("da") > F.col("db")
    pick = lambda x, y: F.when(turn, x).otherwise(y)
    swapped = F.shiftright("mask", 1) + F.when(F.col("mask").bitwiseAND(F.lit(UP)) > 0, DOWN).otherwise(0)
    return both.select(pick(F.col("b"), F.col("a")).alias("u"), pick(F.col("a"), F.col("b")).alias("v"), pick(F.col("da"), F.col("db")).alias("dv"), pick(swapped, F.col("mask")).alias("mask"))


def _wedges(lists: DataFrame, kind: str) -> DataFrame:
    """(v, u, uv, items) from (u, items): each list as that of v = u, with u = -1, and what follows v in each list that holds v, with the edge's mask."""

    def rows(v: np.ndarray, u: np.ndarray, uv: np.ndarray, ends: np.ndarray, items: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(uv.astype(np.int8)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)], ["v", "u", "uv", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, items, own = b["items"].value_lengths().to_numpy().astype(np.int64), b["items"].flatten(), b["u"].to_numpy()
            none = np.full(len(size), -1)
            yield rows(own, none, none * 0, np.r_[0, np.cumsum(size)], items)
            codes, row = items.to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
            after = np.cumsum(size)[row] - np.arange(len(row)) - 1
            at = 0
            while at < len(row):
                upto = np.cumsum(after[at : at + _ITEMS])
                end = at + max(1, int(np.searchsorted(upto, _ITEMS, "right")))
                here = np.arange(at, end)[after[at:end] > 0]
                n = after[here]
                take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(here + 1, n)
                yield rows(codes[here] >> 2, own[row[here]], codes[here] & 3, np.r_[0, np.cumsum(n)], items.take(pa.array(take)))
                at = end

    return lists.mapInArrow(run, f"v bigint, u bigint, uv tinyint, items array<{kind}>")


def _meet(batches: Iterator[pa.RecordBatch], n: int, out: Callable[..., pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``out`` of the triangles in batches of ``_wedges`` by (v, u), n being above all ids.

    It gets arrays of the rows' (v, u, mask of u v), of the triangles' (row, w, mask of u w) and (place in list, mask of v w),
    and those of the list items' (v, w).
    """
    held_v, held = np.int64(-1), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        v, u, size, codes = b["v"].to_numpy(), b["u"].to_numpy(), b["items"].value_lengths().to_numpy(), b["items"].flatten().to_numpy().astype(np.int64)
        own, row = u < 0, np.repeat(np.arange(b.num_rows), size)
        turn = np.cumsum(own)  # 0 for what belongs to the list that the batch before ended with
        lists_v = np.r_[held_v, v[own]]
        listed = np.r_[held, codes[own[row]]]
        listed_turn = np.r_[np.zeros(len(held), np.int64), turn[row[own[row]]]]
        key = listed_turn * n + (listed >> 2)
        order = np.argsort(key)
        key, listed, listed_turn = key[order], listed[order], listed_turn[order]
        wedge = ~own[row] & (lists_v[turn] == v)[row]
        row, code = row[wedge], codes[wedge]
        asked = turn[row] * n + (code >> 2)
        place = np.minimum(np.searchsorted(key, asked), max(0, len(key) - 1))
        hit = key[place] == asked if len(key) else np.zeros(len(asked), bool)
        row, code, place = row[hit], code[hit], place[hit]
        got = out((v, u, b["uv"].to_numpy()), (row, code >> 2, code & 3), (place, listed[place] & 3), (lists_v[listed_turn], listed >> 2))
        if got is not None and got.num_rows:
            yield got
        if own.any():
            last = np.flatnonzero(own)[-1]
            start = int(size[:last].sum())
            held_v, held = v[last], codes[start : start + size[last]]


def _listed(m: Sparse2D, out: Callable[..., pa.RecordBatch | None], schema: str, scratch: Scratch) -> DataFrame:
    n = max(m.dimensions)
    kind = "int" if 4 * n < 2**31 else "bigint"  # items take four bytes where they fit
    item = F.struct("dv", "v", (F.col("v") * 4 + F.col("mask")).cast(kind).alias("code"))
    lists = oriented(m.nz, scratch).groupBy("u").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["code"]).alias("items"))
    return _wedges(lists, kind).repartition("v").sortWithinPartitions("v", "u").mapInArrow(lambda batches: _meet(batches, n, out), schema)


def count(m: Sparse2D, directed: bool) -> DataFrame:
    """(triangles): undirected ones, or directed 3-cycles."""

    def out(rows, uw, vw, _lists):
        if directed:
            uv = rows[2][uw[0]]
            around = (uv & UP > 0) & (vw[1] & UP > 0) & (uw[2] & DOWN > 0)
            back = (uw[2] & UP > 0) & (vw[1] & DOWN > 0) & (uv & DOWN > 0)
            total = int(around.sum() + back.sum())
        else:
            total = len(uw[0])
        return pa.RecordBatch.from_arrays([pa.array([total])], ["n"])

    found = _listed(m, out, "n bigint", Scratch(m.spark, "triangles"))
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("triangles"))


def common_neighbours(m: Sparse2D) -> DataFrame:
    """(a, b, c), a < b: how many third vertices have stored edges from both a and b, for pairs with an edge and at least one such."""

    def out(rows, uw, vw, lists):
        v, u, uv = rows
        row, w, m_uw = uw
        place, m_vw = vw
        m_uv = uv[row]
        x = np.r_[u[row], u[row], v[row]]
        y = np.r_[v[row], w, w]
        both = np.r_[(m_uw & UP > 0) & (m_vw & UP > 0), (m_uv & UP > 0) & (m_vw & DOWN > 0), (m_uv & DOWN > 0) & (m_uw & DOWN > 0)]
        x, y = x[both], y[both]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return _listed(m, out, "a bigint, b bigint", Scratch(m.spark, "common")).groupBy("a", "b").agg(F.count("*").alias("c"))

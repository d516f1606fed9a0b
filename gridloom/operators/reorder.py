"""Vertex and row orders. Each gives a table (id, pos) with old id and new position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import FunctionNotFoundError, ReorderError
from gridloom.functions.columns import gray_rank, unsigned_order
from gridloom.model import Sparse2D, degrees_of
from gridloom.operators.graphs import breadth_first, components, running_offset
from gridloom.operators.in_task import listed, rcm_places, slashburn_of
from gridloom.operators.ranking import rank_all
from gridloom.runtime import Scratch, shuffle_width

#: Up to so many stored edges, some 100 MB, a component or graph is ordered within one task.
TASK_EDGES = 2_000_000
#: The same for SlashBurn, whose lists take four bytes an edge and come in order, batch by batch.
SLASHBURN_EDGES = 32_000_000


def degree_order(m: Sparse2D, ascending: bool = True) -> DataFrame:
    """Rows by degree. Ascending, ties stand larger id first; descending is the exact reverse."""
    deg = degrees_of(m).withColumnRenamed("i", "id")
    order = [F.col("degree").asc(), F.col("id").desc()] if ascending else [F.col("degree").desc(), F.col("id").asc()]
    return rank_all(deg, order).select("id", "pos")


def boba_order(m: Sparse2D) -> DataFrame:
    """Vertices by first appearance: as a row when the non-zeros stand by (column, row), then as a column, then the unseen by id.

    The first appearance of a row is that of its least column; a column's is that of the column itself.
    """
    n = max(m.n_rows, m.n_cols)
    as_row = m.nz.groupBy(F.col("i").alias("id")).agg(F.min("j").alias("a")).select("id", F.lit(0).alias("part"), "a", F.col("id").alias("b"))
    as_col = m.nz.select(F.col("j").alias("id")).distinct().select("id", F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    key = as_row.union(as_col).groupBy("id").agg(F.min(F.struct("part", "a", "b")).alias("k"))
    full = m.spark.range(n).join(key, "id", "left").select("id", F.coalesce("k.part", F.lit(2)).alias("part"), F.coalesce("k.a", F.lit(0)).alias("a"), F.coalesce("k.b", F.lit(0)).alias("b"))
    return rank_all(full, ["part", "a", "b", "id"]).select("id", "pos")


def gray_order(m: Sparse2D, resolution: int = 16, nnz_threshold: int = 10, group_size: int = 1) -> DataFrame:
    """Rows by the Gray rank of a bitmap of their columns.

    Columns fall into ``resolution`` (16, 32 or 64) buckets. Rows of at most ``nnz_threshold`` non-zeros are sparse and
    come first: the empty ones by id, then groups of ``group_size`` neighbouring non-zero counts, whose rows stand by
    Gray rank, ascending and descending by turns. The dense rows follow by Gray rank; a bit there needs more than
    nnz / resolution non-zeros. If over 30 % of the sparse non-zeros (20 % of the dense) lie within n_cols / 128 of the
    diagonal, the sparse rows stand by count alone (the dense by id). Ties stand by id. A matrix without columns keeps
    its order.
    """
    if resolution not in (16, 32, 64):
        raise ReorderError("the resolution must be 16, 32 or 64")
    res = min(resolution, m.n_cols)
    if res == 0:
        return m.spark.range(m.n_rows).select("id", F.col("id").alias("pos"))
    width, band = m.n_cols // res, m.n_cols // 128
    bucket = F.least(F.floor(F.col("j") / width), F.lit(res - 1)).cast("int")
    per_bucket = m.nz.groupBy("i", bucket.alias("b")).agg(F.count("*").alias("c"), F.count(F.when(F.abs(F.col("i") - F.col("j")) <= band, 1)).alias("near"))
    total = per_bucket.groupBy("i").agg(F.sum("c").alias("d"), F.sum("near").alias("near"), F.collect_list(F.struct("b", "c")).alias("bs"))
    sparse = F.col("d") <= nnz_threshold
    floor = F.when(sparse, F.lit(0)).otherwise(F.floor(F.col("d") / res))
    one = F.lit(1).cast("bigint")
    bit = lambda x: F.when(x["c"] > F.col("floor"), F.call_function("shiftleft", one, x["b"])).otherwise(F.lit(0).cast("bigint"))
    bits = F.aggregate("bs", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x)))
    rows = total.withColumn("floor", floor).select("i", "d", "near", unsigned_order(gray_rank(bits)).alias("g"))
    scratch = Scratch(m.spark, "gray")
    full = m.row_ids().join(rows, "i", "left").select(F.col("i").alias("id"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("g", F.lit(0)).alias("g"))
    full = scratch.write(full)
    sums = {r["sparse"]: r for r in full.groupBy(sparse.alias("sparse")).agg(F.sum("near").alias("near"), F.sum("d").alias("d")).collect()}  # two rows
    banded = {s: s in sums and sums[s]["d"] > 0 and sums[s]["near"] / sums[s]["d"] > limit for s, limit in ((True, 0.3), (False, 0.2))}
    counts = rank_all(full.where(sparse & (F.col("d") > 0)).select("d").distinct(), ["d"], "nth", scratch)
    full = full.join(counts, "d", "left").withColumn("group", F.when(F.col("nth").isNull(), -1).otherwise(F.floor(F.col("nth") / group_size)))
    if banded[True]:
        key = [F.when(sparse, F.col("d")).otherwise(0), F.lit(0).cast("bigint")]
    else:
        turned = F.when(F.col("group") % 2 == 1, F.bitwise_not(F.col("g"))).otherwise(F.col("g"))
        key = [F.when(sparse, F.col("group")).otherwise(0), F.when(sparse & (F.col("d") > 0), turned).otherwise(0)]
    dense = F.lit(0).cast("bigint") if banded[False] else F.when(sparse, 0).otherwise(F.col("g"))
    keyed = full.select("id", (~sparse).cast("int").alias("k0"), key[0].alias("k1"), key[1].alias("k2"), dense.alias("k3"))
    return rank_all(keyed, ["k0", "k1", "k2", "k3", "id"], scratch=scratch).select("id", "pos")


def _rcm_small(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, comp, place) of components that fit a task, by (id, comp, bucket); those of one bucket share a task."""
    owned = edges.join(comps.withColumnRenamed("id", "u"), "u")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, comp, place = rcm_places(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["comp"].to_numpy())
        return pd.DataFrame({"id": ids, "comp": comp, "place": place})

    return owned.groupBy("bucket").applyInPandas(run, "id bigint, comp bigint, place bigint")


def _rcm_large(edges: DataFrame, sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp, place) of the components in ``sizes``, all a level at a time."""
    deg = scratch.write(edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree")))
    searching, left = scratch.write_counted(sizes.select("comp", "size", F.col("comp").alias("root"), F.lit(0).alias("most")))
    settled = searching.where("false").select("comp", "root")
    while left:
        reached = breadth_first(edges, searching.select(F.col("root").alias("id"), "comp", F.col("root").alias("ord")), [], scratch).join(deg, "id")
        far = reached.groupBy("comp").agg(F.max(F.struct("level", -F.col("degree"), -F.col("ord"), "id")).alias("s"))
        step = searching.join(far.select("comp", F.col("s.level").alias("level"), F.col("s.id").alias("end")), "comp")
        step = scratch.write(step.withColumn("grew", F.col("level") > F.col("most")).withColumn("most", F.greatest("most", "level")))
        on = F.col("grew") & (F.col("size") != F.col("most") + 1)
        settled = settled.union(step.where(~on).select("comp", "root"))
        searching, left = scratch.write_counted(step.where(on).select("comp", "size", F.col("end").alias("root"), "most"))
    keyed = edges.join(deg.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v").select("u", "v", "dv")
    queue = breadth_first(keyed, settled.select(F.col("root").alias("id"), "comp", F.col("root").alias("ord")), ["dv"], scratch)
    placed = rank_all(queue, ["comp", "level", "ord"], "at", scratch)
    starts = running_offset(sizes, ["comp"], scratch).select("comp", "size", F.col("offset").alias("start"))
    return placed.join(starts, "comp").select("id", "comp", (F.col("size") - 1 - (F.col("at") - F.col("start"))).alias("place"))


def rcm_order(m: Sparse2D, task_edges: int = TASK_EDGES) -> DataFrame:
    """Reverse Cuthill-McKee.

    The pattern is symmetrised. Each component starts from a vertex at its far end: from its smallest id, the search
    goes on from the vertex of least degree in the last level (the first such in the queue) while the number of levels
    grows, or until the component is a path. From there vertices are queued by (place of the vertex that reached them,
    degree, id); a component's queue is reversed. Components stand by their smallest id, isolated vertices with them.

    Components of up to ``task_edges`` stored edges are ordered within tasks, so many to a task that their edges come to
    that number; larger ones are ordered together by distributed steps, a level at a time. Both give the same order.
    """
    scratch, n = Scratch(m.spark, "rcm"), max(m.n_rows, m.n_cols)
    edges = scratch.write(m.symmetrised())
    comps = components(m.spark.range(n), edges, scratch)
    own = edges.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("d"))
    sizes = comps.join(own, "id", "left").groupBy("comp").agg(F.count("*").alias("size"), F.coalesce(F.sum("d"), F.lit(0)).alias("edges"))
    sizes = scratch.write(sizes)
    offsets = running_offset(sizes, ["comp"], scratch).select("comp", "size", "edges", "offset")
    alone = comps.join(offsets.where("size = 1"), "comp").select("id", F.col("offset").cast("bigint").alias("pos"))
    fits = sizes.where((F.col("size") > 1) & (F.col("edges") <= task_edges)).select("comp", F.col("edges").alias("size"))
    buckets = running_offset(fits, ["comp"], scratch).select("comp", F.floor(F.col("offset") / max(task_edges, 1)).alias("bucket"))
    places = _rcm_small(edges, comps.join(buckets, "comp").select("id", "comp", "bucket"))
    large, count = scratch.write_counted(sizes.where((F.col("size") > 1) & (F.col("edges") > task_edges)).select("comp", "size"))
    if count:
        places = places.union(_rcm_large(edges, large, scratch))
    return places.join(offsets, "comp").select("id", (F.col("offset") + F.col("place")).cast("bigint").alias("pos")).union(alone)


def _adjacency_keys(m: Sparse2D) -> DataFrame:
    """(u, v, side, turn): edges in both directions; a row's own columns come ascending, then rows that only point to it, descending."""
    own = m.nz.where("i <> j").select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(0).alias("side"))
    into = m.nz.where("i <> j").select(F.col("j").alias("u"), F.col("i").alias("v"), F.lit(1).alias("side"))
    both = own.union(into).groupBy("u", "v").agg(F.min("side").alias("side"))
    return both.withColumn("turn", F.when(F.col("side") == 0, F.col("v")).otherwise(-F.col("v")))


def _hubs(edges: DataFrame, active: DataFrame, k: int, greedy: bool, scratch: Scratch) -> DataFrame:
    """(id, hub): the k active vertices of highest degree (smaller id first); greedy takes them one at a time, lowering degrees."""
    deg = active.join(edges.groupBy("u").agg(F.count("*").alias("d")).withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    if not greedy:
        return rank_all(deg.orderBy(F.col("d").desc(), "id").limit(k), [F.col("d").desc(), "id"], "hub", scratch).select("id", "hub")
    deg, taken = scratch.write(deg), []
    for _ in range(k):
        top = deg.orderBy(F.col("d").desc(), "id").first()["id"]
        taken.append(top)
        near = edges.where(F.col("u") == top).select(F.col("v").alias("id"), F.lit(1).alias("near"))
        old, deg = deg, scratch.write(deg.where(F.col("id") != top).join(near, "id", "left").select("id", (F.col("d") - F.coalesce("near", F.lit(0))).alias("d")))
        scratch.drop(old)
    return deg.sparkSession.createDataFrame([(v, h) for h, v in enumerate(taken)], "id bigint, hub bigint")


def in_stretches(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(u, v, at) in one task, in stretches of the order by (u, ``keys``), for ``in_task.listed``; else that task would sort them all."""
    ordered = edges.repartitionByRange(shuffle_width(edges.sparkSession), "u").sortWithinPartitions("u", *keys)
    return Scratch(edges.sparkSession, "stretches").write(ordered.select("u", "v", F.monotonically_increasing_id().alias("at"))).coalesce(1)


def _slashburn_task(edges: DataFrame, n: int | None, front: int, k: int, greedy: bool, hub_order: bool) -> DataFrame:
    """(id, pos) from ``front`` on, in one task, to which the edges come in stretches of the order of their lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, adj = listed(batches, n)
        pos = front + slashburn_of(adj, k, greedy, hub_order)
        for at in range(0, len(ids), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)].astype(np.int64)) for x in (ids, pos)], ["id", "pos"])

    return in_stretches(edges, ["side", "turn"]).mapInArrow(run, "id bigint, pos bigint")


def _slashburn_small(edges: DataFrame, n: int, k: int, greedy: bool, hub_order: bool) -> DataFrame:
    return _slashburn_task(edges, n, 0, k, greedy, hub_order)


def _slashburn_rest(edges: DataFrame, front: int, k: int, greedy: bool, hub_order: bool) -> DataFrame:
    """(id, pos) of a connected graph of at least k vertices, which takes the positions from ``front`` on."""
    return _slashburn_task(edges, None, front, k, greedy, hub_order)


def slashburn_order(m: Sparse2D, k_size: int = 1, greedy: bool = False, hub_order: bool = False, task_edges: int = SLASHBURN_EDGES) -> DataFrame:
    """Hubs to the front, what falls off to the back, round by round.

    The pattern is symmetrised. All components but the largest (the one of larger smallest id, if equal) go to the back,
    smallest (size, smallest id) last of all, each in breadth-first order from the end. Then each round moves the k_size
    vertices of highest degree in the largest component to the front; of the components left, the largest stays and the
    others go to the back by (size, root), or by (hub, size, root) with ``hub_order``: a component belongs to the last
    hub next to it, and its root is that hub's first neighbour in it. It ends when the largest has fewer than k_size
    vertices or none is left.

    A graph of up to ``task_edges`` vertices and stored edges is ordered within one task, a larger one by distributed steps
    until its largest component is as small as that. Both give the same order.
    """
    n = max(m.n_rows, m.n_cols)
    if k_size < 1:
        raise ReorderError("k_size must be positive")
    scratch = Scratch(m.spark, "slashburn")
    edges, count = scratch.write_counted(_adjacency_keys(m))
    vertices = m.spark.range(n)
    if 0 < count <= task_edges and n <= task_edges:
        return _slashburn_small(edges, n, k_size, greedy, hub_order)
    comps = components(vertices, edges, scratch)
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("root")).withColumn("hub", F.lit(0).cast("bigint"))
    placed, front, back = [], 0, 0
    while True:
        comps, sizes = scratch.write(comps), scratch.write(sizes)
        # ties between largest: in the first pass the last of the heap, later the first that was found
        last = [F.col("size").desc(), F.col("root").desc()] if not placed and not front else [F.col("size").desc(), F.col("found")]
        giant = sizes.orderBy(*last).first()
        if giant is None:
            break
        final = giant["size"] < k_size
        order = ["hub", "size", "root"] if hub_order else ["size", "root"]
        spokes = sizes if final else sizes.where(F.col("comp") != giant["comp"])
        if final:
            spokes = spokes.withColumn("giant", (F.col("comp") == giant["comp"]).cast("int"))
            order = ["giant", *order]
        if not spokes.isEmpty():
            ranked = rank_all(spokes.select(*dict.fromkeys(["comp", "root", *order])), order, "place", scratch)
            inside = edges.join(comps.select(F.col("id").alias("u"), F.col("comp").alias("cu")), "u").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v").where("cu = cv").select("u", "v", "side", "turn")
            walk = breadth_first(inside, ranked.select(F.col("root").alias("id"), F.col("place").alias("comp"), F.col("place").alias("ord")), ["side", "turn"], scratch)
            done = scratch.write(rank_all(walk, ["comp", "level", "ord"], "at", scratch).select("id", (F.lit(n - 1 - back) - F.col("at")).alias("pos")))
            placed.append(done)
            back += done.count()
        if final:
            break
        active = comps.where(F.col("comp") == giant["comp"]).select("id")
        edges, count = scratch.write_counted(edges.join(active.withColumnRenamed("id", "u"), "u", "left_semi").join(active.withColumnRenamed("id", "v"), "v", "left_semi"))
        if 0 < count <= task_edges and giant["size"] <= task_edges:  # it is connected, so its edges name all its vertices
            placed.append(_slashburn_rest(edges, front, k_size, greedy, hub_order))
            break
        hubs = scratch.write(_hubs(edges, active, k_size, greedy, scratch))
        placed.append(hubs.select("id", (F.col("hub") + front).alias("pos")))
        front += hubs.count()
        rest = active.join(hubs, "id", "left_anti")
        ends = hubs.select(F.col("id").alias("u"), "hub")
        spread = edges.join(ends, "u").select("hub", "v", "side", "turn").join(hubs.select(F.col("id").alias("v")), "v", "left_anti")
        spread = scratch.write(spread)
        edges = scratch.write(edges.join(hubs.select(F.col("id").alias("u")), "u", "left_anti").join(hubs.select(F.col("id").alias("v")), "v", "left_anti"))
        comps = scratch.write(components(rest, edges, scratch))
        met = spread.join(comps.withColumnRenamed("id", "v"), "v").groupBy("comp").agg(F.min(F.struct((-F.col("hub")).alias("h"), "side", "turn", "v")).alias("s"))
        sizes = comps.groupBy("comp").agg(F.count("*").alias("size")).join(met, "comp").select("comp", "size", F.col("s.v").alias("root"), (-F.col("s.h")).alias("hub"), F.col("s").alias("found"))
    out = placed[0] if placed else vertices.select("id", F.col("id").alias("pos"))
    for p in placed[1:]:
        out = out.union(p)
    return out.select("id", F.col("pos").cast("bigint").alias("pos"))


def generic_order(m: Sparse2D, kernel: Callable[[Sparse2D], DataFrame]) -> DataFrame:
    """The order of a user's kernel, which takes the matrix and gives (id, pos)."""
    out = kernel(m)
    if set(out.columns) != {"id", "pos"}:
        raise ReorderError("an order has the columns id and pos")
    return out


ORDERS: dict[str, Callable[..., DataFrame]] = {"degree": degree_order, "boba": boba_order, "gray": gray_order, "rcm": rcm_order, "slashburn": slashburn_order}


def register(name: str, kernel: Callable[..., DataFrame]) -> None:
    """Make a kernel (matrix, parameters) to (id, pos) available to ``reorder``; the same name replaces it."""
    ORDERS[name] = kernel


def unregister(name: str) -> None:
    if ORDERS.pop(name, None) is None:
        raise FunctionNotFoundError(f"no order is named {name}")


def reorder(name: str, m: Sparse2D, **params) -> DataFrame:
    """The order named ``name``."""
    if name not in ORDERS:
        raise FunctionNotFoundError(f"no order is named {name}")
    return ORDERS[name](m, **params)

"""Level-synchronous graph steps: components and breadth-first order of many components at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridloom.operators.ranking import in_order, rank_all
from gridloom.runtime import Scratch


def components(vertices: DataFrame, edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, comp) of every vertex: the smallest id of its component, for ``edges`` (u, v) in both directions.

    Labels fall to the least label among the neighbours, the vertex that gave a label learns what its holders met, and
    each label then falls to the label of that label, so that few rounds are needed however long the paths are.
    """
    scratch = scratch or Scratch(vertices.sparkSession, "components")
    first = edges.groupBy("u").agg(F.min("v").alias("low"))
    now = scratch.write(vertices.select("id").join(first.withColumnRenamed("u", "id"), "id", "left").select("id", F.least("id", F.coalesce("low", "id")).alias("comp")))
    while True:
        offered = edges.join(now.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("comp").alias("low"))
        own = now.join(offered.withColumnRenamed("u", "id"), "id", "left").select("id", "comp", F.coalesce("low", "comp").alias("low"))
        hooks = own.where("low < comp").groupBy(F.col("comp").alias("id")).agg(F.min("low").alias("hook"))
        own = own.join(hooks, "id", "left").select("id", "comp", F.least("comp", "low", F.coalesce("hook", "comp")).alias("next"))
        up = now.select(F.col("id").alias("next"), F.col("comp").alias("jump"))
        fell = Observation()
        new = own.join(up, "next").select("id", F.least("next", "jump").alias("low"), "comp").observe(fell, F.count(F.when(F.col("low") < F.col("comp"), 1)).alias("n"))
        old, now = now, scratch.write(new.select("id", F.col("low").alias("comp")))
        scratch.drop(old)
        if not fell.get["n"]:
            return now


def breadth_first(edges: DataFrame, roots: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(id, comp, level, ord) of all that ``roots`` (id, comp, ord) reach over ``edges`` (u, v, keys) in both directions.

    ord grows with the place within the level, over all components: vertices stand by the place of the first vertex that
    reached them, then by ``keys``, then by id, as in a queue.
    """
    at = scratch.write(roots.select(F.col("id").cast("bigint").alias("id"), F.col("comp").cast("bigint").alias("comp"), F.lit(0).alias("level"), F.col("ord").cast("bigint").alias("ord")))
    levels, before = [at], None
    while True:
        seen = at.select("id") if before is None else at.select("id").union(before.select("id"))
        step = edges.join(at.select(F.col("id").alias("u"), "comp", "ord"), "u").groupBy("v").agg(F.min(F.struct("ord", *keys, "comp")).alias("s"))
        step = step.withColumnRenamed("v", "id").join(seen, "id", "left_anti").select("id", "s.*").withColumnRenamed("ord", "parent")
        new, count = in_order(step.withColumn("level", F.lit(len(levels))), ["parent", *keys, "id"], "ord", scratch)
        if not count:
            return scratch.read_all(levels, "id bigint, comp bigint, level int, ord bigint")
        levels.append(new)
        before, at = at, new.select("id", "comp", "level", "ord")


def running_offset(sizes: DataFrame, order: list[Column | str], scratch: Scratch) -> DataFrame:
    """``sizes`` with ``offset``, the sum of ``size`` over the rows before, in ``order``. One row for each component.

    Places are ranked first; sums run within blocks of places and over the blocks' totals, as many as a block has places.
    """
    sizes, n = scratch.write_counted(sizes)
    ranked = rank_all(sizes, order, "place", scratch).withColumn("block", F.floor(F.col("place") / max(1024, math.isqrt(n))))
    totals = ranked.groupBy("block").agg(F.sum("size").alias("t"))
    base = F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.join(totals.select("block", base.alias("base")), "block").withColumn("offset", F.col("base") + own).drop("block", "base")

"""Groups of records linked directly or over others.

Seed-tree pruning. In each round every vertex offers its neighbourhood's minimum
to itself and its neighbours. A vertex that nobody takes for a minimum drops out:
it hangs itself under the least minimum it was offered and waits in the
propagation forest. The others go on, linked to the least of their minima, until
each component has one vertex left, its seed. The seeds' identifiers then flow
down the forest, last round first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import Scratch


def _round(half: DataFrame) -> DataFrame:
    """(x, y, least, stays) of every minimum y offered to x, for edges (a, b), each once with a < b."""
    sym = half.select(F.col("a").alias("u"), F.col("b").alias("v")).union(half.select("b", "a"))
    least = sym.groupBy("u").agg(F.least("u", F.min("v")).alias("y"))
    offers = sym.join(least, "u").select(F.col("v").alias("x"), "y").union(least.select("u", "y")).distinct()
    taken = offers.groupBy("x").agg(F.min("y").alias("least"), F.max(F.col("x") == F.col("y")).alias("stays"))
    return offers.join(taken, "x")


def link_groups(links: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """(id, group_id) of every record linked to another one; group_id is the smallest id of its group.

    A row of ``links`` links its two ends if both are non-null and differ; repeats, reversals and loops add nothing.
    Other columns are ignored. An empty table, or one without a link, gives no rows.

    Every step is an aggregation with a partial step or an equi-join to a table with unique keys, so a record with a
    third of all links costs no more than its share once skewed partitions are split. The number of rounds grows with
    the logarithm of the group sizes; each round writes its tables to the shared folder.
    """
    scratch = Scratch(links.sparkSession, "groups")
    a, b = F.col(i).cast("bigint"), F.col(j).cast("bigint")
    half = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(a.isNotNull() & b.isNotNull() & (a != b))
    half = scratch.write(half.distinct())
    drops = []
    while not half.isEmpty():
        offers = scratch.write(_round(half))
        drops.append(offers.where(~F.col("stays") & (F.col("y") == F.col("least"))).select(F.col("x").alias("id"), F.col("least").alias("parent")))
        done, half = half, scratch.write(offers.where("y <> least").select(F.col("least").alias("a"), F.col("y").alias("b")).distinct())
        scratch.drop(done)
    if not drops:
        return half.select(F.col("a").alias("id"), F.col("b").alias("group_id"))
    known: list[DataFrame] = []
    for drop in reversed(drops):
        if known:
            above = reduce(DataFrame.union, known).select(F.col("id").alias("parent"), "group_id")
            drop = drop.join(above, "parent", "left").select("id", F.coalesce("group_id", "parent").alias("group_id"))
        else:
            drop = drop.select("id", F.col("parent").alias("group_id"))
        known.append(scratch.write(drop))
    below = reduce(DataFrame.union, known)
    return below.union(below.select("group_id", "group_id").distinct())


def all_groups(vertices: DataFrame, links: DataFrame, id: str = "id", i: str = "i", j: str = "j") -> DataFrame:
    """(id, group_id) of every record of ``vertices`` or of a link; a record without links is its own group.

    Repeated vertices come out once; a null id is no record.
    """
    ids = vertices.select(F.col(id).cast("bigint").alias("id"))
    for end in (i, j):
        ids = ids.union(links.select(F.col(end).cast("bigint")))
    ids = ids.where("id is not null").distinct()
    return ids.join(link_groups(links, i, j), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))

"""Global ranks without a single-task window.

Rows are sorted over range partitions; a row's rank is its place within the
partition plus the sizes of the partitions before it, a table with one row for
each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import Scratch, shuffle_width


def in_order(df: DataFrame, order: list[Column | str], name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """``df`` written with a BIGINT that grows in ``order`` but skips numbers, and its number of rows."""
    held = None if hasattr(df, "_gridloom_at") else scratch.write(df)  # a range partitioning reads its input twice, first for a sample
    df = df if held is None else held
    placed = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    out = scratch.write_counted(placed.select(*df.columns, F.monotonically_increasing_id().alias(name)))
    scratch.drop(held)
    return out


def rank_all(df: DataFrame, order: list[Column | str], name: str = "pos", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with the rank of each row from 0 in ``order``, which must be total for the ranks to be defined."""
    scratch = scratch or Scratch(df.sparkSession, "rank")
    placed, _ = in_order(df, order, "_at", scratch)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))  # the number holds the partition above 33 bits
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_at") + F.col("_shift")).cast("bigint").alias(name))

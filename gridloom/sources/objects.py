"""Sparse objects made of the Parquet test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.model import Dense1D, HyperGraph, Sparse2D
from gridloom.runtime import Scratch
from gridloom.sources.tables import table


def _shape(spark: SparkSession, d: str) -> tuple[int, int]:
    top = table(spark, d, "lineitem").agg(F.max("l_partkey"), F.max("l_suppkey")).first()
    return (top[0] + 1, top[1] + 1) if top[0] is not None else (0, 0)


def part_supplier(spark: SparkSession, d: str) -> Sparse2D:
    """Parts x suppliers, with the quantity sold."""
    nz = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return Sparse2D(nz, *_shape(spark, d))


def co_purchase(spark: SparkSession, d: str) -> Sparse2D:
    """Parts bought in one order: symmetric, without loops."""
    n = _shape(spark, d)[0]
    each = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = each.withColumnRenamed("l_partkey", "j")
    half = each.join(other, "l_orderkey").where("l_partkey < j").select(F.col("l_partkey").alias("i"), "j").distinct()
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))  # a union would join twice
    return Sparse2D(half.select(both.alias("e")).select("e.i", "e.j"), n, n)


def co_purchase_stored(spark: SparkSession, d: str) -> Sparse2D:
    """``co_purchase`` written once, for what reads it several times."""
    m = co_purchase(spark, d)
    return m.with_nz(Scratch(spark, "co_purchase").write(m.nz))


def line_order(spark: SparkSession, d: str) -> Sparse2D:
    """Directed: from a part to those on later lines of one order."""
    n = _shape(spark, d)[0]
    each = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    other = each.select("l_orderkey", F.col("l_partkey").alias("j"), F.col("l_linenumber").alias("m"))
    nz = each.join(other, "l_orderkey").where("l_linenumber < m and l_partkey <> j").select(F.col("l_partkey").alias("i"), "j").distinct()
    return Sparse2D(nz, n, n)


def pin_hypergraph(spark: SparkSession, d: str) -> HyperGraph:
    """The distinct pins with both ends, ids as they are."""
    pins = table(spark, d, "pins").select("net", "cell").where("net is not null and cell is not null").distinct()
    top = pins.agg(F.max("net").alias("n"), F.max("cell").alias("c")).first()
    return HyperGraph(pins, (top["n"] if top["n"] is not None else -1) + 1, (top["c"] if top["c"] is not None else -1) + 1)


def supplier_balance(spark: SparkSession, d: str) -> Dense1D:
    """Each supplier's balance in whole cents."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.round(F.col("s_acctbal") * 100).alias("v"))
    return Dense1D(x, _shape(spark, d)[1])

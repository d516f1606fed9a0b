"""Sparse objects: DataFrames of non-zeros with explicit dimensions.

Rows and columns without non-zeros exist only through the dimensions, so every
object carries them. Compressed layouts are views of the same triples and are
built at the boundaries only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import InvalidDataMemberError, TypeMismatchError


@dataclass(frozen=True)
class Sparse2D:
    """A matrix: ``nz`` has i, j BIGINT from 0 and, unless it is a pattern, a numeric v."""

    nz: DataFrame
    n_rows: int
    n_cols: int

    @property
    def valued(self) -> bool:
        return "v" in self.nz.columns

    @property
    def spark(self) -> SparkSession:
        return self.nz.sparkSession

    @property
    def dimensions(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    def nnz(self) -> int:
        return self.nz.count()

    def values(self) -> DataFrame:
        if not self.valued:
            raise InvalidDataMemberError("a pattern has no values")
        return self.nz.select("v")

    def with_nz(self, nz: DataFrame, **dims: int) -> Sparse2D:
        return replace(self, nz=nz, **dims)

    def pattern(self) -> Sparse2D:
        return self.with_nz(self.nz.select("i", "j"))

    def transpose(self) -> Sparse2D:
        rest = [c for c in self.nz.columns if c not in "ij"]
        return Sparse2D(self.nz.select(F.col("j").alias("i"), F.col("i").alias("j"), *rest), self.n_cols, self.n_rows)

    def row_ids(self) -> DataFrame:
        return self.spark.range(self.n_rows).select(F.col("id").alias("i"))

    def col_ids(self) -> DataFrame:
        return self.spark.range(self.n_cols).select(F.col("id").alias("j"))

    def symmetrised(self) -> DataFrame:
        """(u, v), u <> v: each edge in both directions, once."""
        both = F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v"))))
        return self.nz.where("i <> j").select(both.alias("e")).select("e.u", "e.v").distinct()


@dataclass(frozen=True)
class Dense1D:
    """A dense vector: ``data`` has idx BIGINT from 0 to length - 1, each once, and v."""

    data: DataFrame
    length: int


@dataclass(frozen=True)
class Graph:
    """A graph by its square connectivity; ``vertices`` has id and, if there are weights, w ARRAY."""

    connectivity: Sparse2D
    vertices: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.connectivity.n_rows != self.connectivity.n_cols:
            raise TypeMismatchError("a graph needs a square connectivity")

    @property
    def n(self) -> int:
        return self.connectivity.n_rows

    def m(self) -> int:
        return self.connectivity.nnz()


@dataclass(frozen=True)
class HyperGraph:
    """Pins (net, cell) from 0, with the numbers of nets and cells, and weights (net, w) and (cell, w) if there are any."""

    pins: DataFrame
    n_nets: int
    n_cells: int
    base: int = 0
    net_weights: DataFrame | None = None
    cell_weights: DataFrame | None = None

    def nets(self) -> Sparse2D:
        return Sparse2D(self.pins.select(F.col("net").alias("i"), F.col("cell").alias("j")), self.n_nets, self.n_cells)

    def cells(self) -> Sparse2D:
        return self.nets().transpose()


def matrix(nz: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> Sparse2D:
    """A matrix over ``nz`` (i, j[, v]); dimensions that are not given are one past the largest id."""
    if n_rows is None or n_cols is None:
        top = nz.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
        n_rows = (top["i"] + 1 if top["i"] is not None else 0) if n_rows is None else n_rows
        n_cols = (top["j"] + 1 if top["j"] is not None else 0) if n_cols is None else n_cols
    keep = ["i", "j"] + ["v"] * ("v" in nz.columns)
    return Sparse2D(nz.select(*(F.col(c).cast("bigint").alias(c) if c in "ij" else c for c in keep)), n_rows, n_cols)


def degrees_of(m: Sparse2D) -> DataFrame:
    """(i, degree) of every row, rows without non-zeros included."""
    some = m.nz.groupBy("i").agg(F.count("*").alias("degree"))
    return m.row_ids().join(some, "i", "left").select("i", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

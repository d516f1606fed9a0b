"""One place for what users call most: reading, writing, features, orders and permutations by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.errors import DirectExecutionNotAvailableError
from gridloom.model import Graph, HyperGraph, Sparse2D, matrix
from gridloom.operators import convert, features
from gridloom.operators.permute import inverse, permute_1d, permute_2d, permute_cols, permute_rows, permute_same
from gridloom.operators.reorder import register as register_order
from gridloom.operators.reorder import reorder, unregister
from gridloom.sources.edge_list import read_edge_list, write_edge_list
from gridloom.sources.metis import read_metis, write_metis
from gridloom.sources.mtx import read_mtx, read_mtx_vector, write_mtx
from gridloom.sources.patoh import read_patoh, write_patoh
from gridloom.sources.sbff import read_sbff_array, read_sbff_matrix, write_sbff_array, write_sbff_matrix

__all__ = [
    "Graph", "HyperGraph", "Sparse2D", "as_layout", "degree_distribution", "degrees", "graph_from_edge_list", "graph_from_mtx", "hypergraph_from_patoh",
    "inverse", "matrix", "matrix_from_csr", "permute_1d", "permute_2d", "permute_cols", "permute_rows", "permute_same", "read_edge_list",
    "read_metis", "read_mtx", "read_mtx_csr", "read_mtx_vector", "read_patoh", "read_sbff_array", "read_sbff_matrix", "register_order", "reorder",
    "unregister", "write_edge_list", "write_metis", "write_mtx", "write_patoh", "write_sbff_array", "write_sbff_matrix",
]


def degrees(m: Sparse2D) -> DataFrame:
    return features.degrees(m)


def degree_distribution(m: Sparse2D) -> DataFrame:
    return features.degree_distribution(m)


def read_mtx_csr(spark: SparkSession, path: str, **options) -> DataFrame:
    """The compressed rows of a Matrix Market file."""
    return convert.coo_to_csr(read_mtx(spark, path, **options))


def graph_from_mtx(spark: SparkSession, path: str, **options) -> Graph:
    return Graph(read_mtx(spark, path, **options))


def graph_from_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> Graph:
    """Undirected and square; duplicates are kept."""
    return Graph(read_edge_list(spark, path, weighted=weighted, undirected=True, square=True))


def hypergraph_from_patoh(spark: SparkSession, path: str) -> HyperGraph:
    return read_patoh(spark, path)


def matrix_from_csr(rows: DataFrame, n_cols: int, n_rows: int | None = None, id: str = "i", ids: str = "cols", vals: str | None = "vals") -> Sparse2D:
    """The matrix of delivered compressed rows: null columns are dropped, repeated ones kept, a null or short ``vals`` gives null values."""
    cells = F.posexplode(ids)
    each = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("i"), *([F.col(vals).alias("_v")] if vals else []), cells.alias("_p", "j")).where("j is not null")
    nz = each.select("i", "j", *([F.get("_v", F.col("_p")).alias("v")] if vals else []))
    if n_rows is None:
        top = rows.agg(F.max(id)).first()[0]
        n_rows = top + 1 if top is not None else 0
    return matrix(nz, n_rows, n_cols)


def as_layout(m: Sparse2D, layout: str, convert_input: bool = True) -> Sparse2D | DataFrame:
    """``m`` as 'coo', 'csr' or 'csc'; anything but 'coo' is an error if ``convert_input`` is false."""
    if layout != "coo" and not convert_input:
        raise DirectExecutionNotAvailableError(f"the triples would have to become {layout}")
    return convert.default_converter(*m.dimensions).convert(m, "coo", layout)

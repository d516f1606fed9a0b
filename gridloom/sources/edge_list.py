"""Edge lists: lines of two ids from 0 and, if there are weights, a number."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.model import Sparse2D, matrix
from gridloom.sources.text import lines, tokens, write_lines


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, remove_duplicates: bool = False, remove_self_edges: bool = False, undirected: bool = True, square: bool = False, value_type: str = "double") -> Sparse2D:
    """The edges in ``path``.

    Undirected, each edge comes in both directions, self loops twice; dimensions are one past the largest ids, equal if
    the list is undirected or ``square``. Of duplicates the one with the least weight is kept. Blank lines and lines
    that begin with # or % are skipped.
    """
    t = tokens()
    body = lines(spark, path).where("value <> '' and not startswith(value, '#') and not startswith(value, '%')")
    nz = body.select(t[0].cast("bigint").alias("i"), t[1].cast("bigint").alias("j"), *([t[2].cast(value_type).alias("v")] if weighted else []))
    if remove_self_edges:
        nz = nz.where("i <> j")
    if undirected:
        rest = nz.columns[2:]
        both = F.array(F.struct("i", "j", *rest), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *rest))
        nz = nz.select(F.explode(both).alias("s")).select("s.*")
    if remove_duplicates:
        nz = nz.groupBy("i", "j").agg(F.min("v").alias("v")) if weighted else nz.distinct()
    m = matrix(nz)
    if undirected or square:
        n = max(m.dimensions)
        m = m.with_nz(m.nz, n_rows=n, n_cols=n)
    return m


def write_edge_list(m: Sparse2D, path: str, directed: bool = False, single: bool = False) -> None:
    """Write the edges by (i, j). Undirected, each edge is written once, smaller end first, with its least value."""
    nz = m.nz
    if not directed:
        ends = [F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")]
        nz = nz.select(*ends, *nz.columns[2:])
        nz = nz.groupBy("i", "j").agg(F.min("v").alias("v")) if m.valued else nz.distinct()
    text = F.concat_ws(" ", "i", "j", *([F.col("v").cast("string")] if m.valued else []))
    write_lines(nz.select("i", "j", text.alias("value")), ["i", "j", "value"], path, single)

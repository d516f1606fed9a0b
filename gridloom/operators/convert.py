"""Layouts of a matrix and conversions between them and between element types."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.errors import NoConverterError
from gridloom.model import Sparse2D, matrix
from gridloom.operators.ranking import rank_all


def to_compressed(m: Sparse2D, by: str = "i", at: str = "j") -> DataFrame:
    """(by, ids, vals): the sorted ids and aligned values of each row (``by`` = i) or column (j), empty ones included.

    A row's non-zeros become one row of the table; use the triples for rows that do not fit one.
    """
    item = F.struct(at, "v") if m.valued else F.struct(at)
    some = m.nz.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("s"))
    ids = m.row_ids() if by == "i" else m.col_ids()
    kind = dict(m.nz.dtypes).get("v")
    out = ids.join(some, by, "left").select(by, F.coalesce(f"s.{at}", F.array().cast("array<bigint>")).alias("ids"), *([F.coalesce(F.col("s.v"), F.array().cast(f"array<{kind}>")).alias("vals")] if m.valued else []))
    return out


def coo_to_csr(m: Sparse2D) -> DataFrame:
    return to_compressed(m, "i", "j")


def coo_to_csc(m: Sparse2D) -> DataFrame:
    return to_compressed(m, "j", "i")


def compressed_to_coo(c: DataFrame, n_rows: int, n_cols: int, by: str = "i", at: str = "j") -> Sparse2D:
    """The triples of a compressed layout."""
    if "vals" in c.columns:
        nz = c.select(by, F.explode(F.arrays_zip("ids", "vals")).alias("s")).select(by, F.col("s.ids").alias(at), F.col("s.vals").alias("v"))
    else:
        nz = c.select(by, F.explode("ids").alias(at))
    return matrix(nz.select("i", "j", *nz.columns[2:]), n_rows, n_cols)


def csr_to_coo(c: DataFrame, n_rows: int, n_cols: int) -> Sparse2D:
    return compressed_to_coo(c, n_rows, n_cols, "i", "j")


def csc_to_coo(c: DataFrame, n_rows: int, n_cols: int) -> Sparse2D:
    return compressed_to_coo(c, n_rows, n_cols, "j", "i")


def csr_to_csc(c: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    return coo_to_csc(csr_to_coo(c, n_rows, n_cols))


def pointers(m: Sparse2D, by: str = "i") -> DataFrame:
    """(id, ptr) for id from 0 to n: how many non-zeros stand in the rows (or columns) before id.

    The running sum is taken within runs of ids, and over the totals of those, as many as a run has ids; no task sees all rows.
    """
    n = m.n_rows if by == "i" else m.n_cols
    some = m.nz.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("d"))
    full = m.spark.range(n + 1).join(some, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    run = max(1024, math.isqrt(n))
    width = -(-(n + 1) // run)
    part = full.withColumn("part", F.floor(F.col("id") / run))
    totals = part.groupBy("part").agg(F.sum("d").alias("t"))
    if width > 1:
        before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = part.join(totals.select("part", before.alias("base")), "part")
    else:
        part = part.withColumn("base", F.lit(0))
    own = F.coalesce(F.sum("d").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return part.select("id", (F.col("base") + own).cast("bigint").alias("ptr"))


def coo_order(m: Sparse2D) -> DataFrame:
    """The triples with their position in (i, j) order."""
    return rank_all(m.nz, ["i", "j", *(["v"] if m.valued else [])])


def cast_values(m: Sparse2D, kind: str) -> Sparse2D:
    """``m`` with values of another type; a value that does not fit exactly is an error when it is computed."""
    old = dict(m.nz.dtypes)["v"]
    new = F.col("v").cast(kind)
    back = new.cast(old)
    same = back.eqNullSafe(F.col("v")) | (F.isnan(F.col("v").cast("double")) & F.isnan(back.cast("double")))
    checked = F.when(F.col("v").isNull() | same, new).otherwise(F.raise_error(F.concat(F.lit("a value does not fit "), F.lit(kind), F.lit(": "), F.col("v").cast("string"))).cast(kind))
    return m.with_nz(m.nz.select("i", "j", checked.alias("v")))


class Converter:
    """A registry of conversions between named layouts; a missing one is chained from the fewest steps."""

    def __init__(self) -> None:
        self._steps: dict[tuple[str, str], Callable] = {}

    def register(self, source: str, target: str, step: Callable) -> None:
        self._steps[source, target] = step

    def clear(self, source: str | None = None, target: str | None = None) -> None:
        self._steps = {k: f for k, f in self._steps.items() if not ((source in (None, k[0])) and (target in (None, k[1])))}

    def chain(self, source: str, target: str) -> list[str]:
        """The layouts on the way, both ends included."""
        ways, seen = [[source]], {source}
        while ways:
            way = ways.pop(0)
            if way[-1] == target:
                return way
            for a, b in self._steps:
                if a == way[-1] and b not in seen:
                    seen.add(b)
                    ways.append([*way, b])
        raise NoConverterError(f"nothing converts {source} to {target}")

    def can_convert(self, source: str, target: str) -> bool:
        try:
            return bool(self.chain(source, target))
        except NoConverterError:
            return False

    def convert(self, thing, source: str, target: str):
        way = self.chain(source, target)
        for step in zip(way, way[1:], strict=False):
            thing = self._steps[step](thing)
        return thing


def default_converter(n_rows: int, n_cols: int) -> Converter:
    """coo, csr and csc of a matrix of the given shape, each into each."""
    c = Converter()
    c.register("coo", "csr", coo_to_csr)
    c.register("coo", "csc", coo_to_csc)
    c.register("csr", "coo", lambda x: csr_to_coo(x, n_rows, n_cols))
    c.register("csc", "coo", lambda x: csc_to_coo(x, n_rows, n_cols))
    c.register("csr", "csc", lambda x: csr_to_csc(x, n_rows, n_cols))
    return c

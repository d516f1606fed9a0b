"""Structural features. Scalar features of any selection come from one aggregation by rows and one by columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.errors import FeatureError, FeatureParamsError
from gridloom.functions.columns import block_of
from gridloom.model import Sparse2D, degrees_of
from gridloom.operators import triangles
from gridloom.runtime import Scratch


def degrees(m: Sparse2D) -> DataFrame:
    """(id, degree) of every row."""
    return degrees_of(m).withColumnRenamed("i", "id")


def degrees_with_distribution(m: Sparse2D) -> DataFrame:
    """(id, degree, share): the degree of every row and its share of all non-zeros (0 for an empty matrix)."""
    total = m.nz.agg(F.count("*").alias("nnz"))
    share = F.when(F.col("nnz") > 0, F.col("degree") / F.col("nnz")).otherwise(0.0)
    return degrees(m).join(F.broadcast(total)).select("id", "degree", share.alias("share"))


def degree_distribution(m: Sparse2D) -> DataFrame:
    """(id, share) of every row."""
    return degrees_with_distribution(m).select("id", "share")


#: The scalars by their axis: a function of the axis length and of the columns d (degree) and c (how many have it).
_DEGREE: dict[str, Callable[[int], Column]] = {
    "min": lambda n: F.min("d"),
    "max": lambda n: F.max("d"),
    "avg": lambda n: F.sum(F.col("d") * F.col("c")) / F.lit(n),
    "median": lambda n: F.percentile("d", F.lit(0.5), F.col("c")),
    "std": lambda n: F.sqrt(_spread(n)),
    "cv": lambda n: F.sqrt(_spread(n)) / (F.sum(F.col("d") * F.col("c")) / F.lit(n)),
    "geo_avg": lambda n: F.when(F.min("d") == 0, 0.0).otherwise(F.exp(F.sum(F.ln("d") * F.col("c")) / F.lit(n))),
}


def _spread(n: int) -> Column:
    """The sum of squared distances from the mean, from whole sums."""
    s, q = F.sum(F.col("d") * F.col("c")), F.sum(F.col("d") * F.col("d") * F.col("c"))
    return q.cast("double") - s.cast("double") * s.cast("double") / F.lit(n)


#: Name: (axis, statistic of the degrees).
DEGREE_SCALARS = {
    "min_degree": ("i", "min"), "max_degree": ("i", "max"), "avg_degree": ("i", "avg"),
    "min_degree_column": ("j", "min"), "max_degree_column": ("j", "max"), "avg_degree_column": ("j", "avg"),
    "median_degree_column": ("j", "median"), "standard_deviation_degree_column": ("j", "std"),
    "coefficient_of_variation_degree_column": ("j", "cv"), "geometric_avg_degree_column": ("j", "geo_avg"),
}
#: Scalars over the non-zeros of a row at a time.
ROW_SCALARS = ("bandwidth", "profile", "off_diag_block_nnz")
SCALARS = (*DEGREE_SCALARS, *ROW_SCALARS)
TABLES = {"degrees": degrees, "degree_distribution": degree_distribution, "degrees_degree_distribution": degrees_with_distribution}
#: Parameters of the features that have some, with their defaults.
PARAMS: dict[str, dict] = {"off_diag_block_nnz": {"blocks_rows": 1, "blocks_cols": 1}, "standard_deviation_degree_column": {"normalize": False}, "coefficient_of_variation_degree_column": {"normalize": False}, "triangle_count": {"directed": False}}


def _histogram(per: DataFrame, n: int) -> DataFrame:
    """(d, c): how many of n rows have degree d, the empty ones included."""
    full = per.groupBy("d").agg(F.count("*").alias("c"))
    return full.union(per.agg(F.lit(0).cast("bigint").alias("d"), (F.lit(n) - F.count("*")).alias("c")).where("c > 0"))


def scalars(m: Sparse2D, names: Iterable[str], params: dict[str, dict] | None = None) -> DataFrame:
    """One row with a column for each of the scalar features ``names``.

    The non-zeros are aggregated at most twice, by row and by column, whatever is asked for. Statistics of an axis
    without rows or columns are null; bandwidth, profile and off-diagonal counts of an empty matrix are 0.
    """
    names, params = list(names), params or {}
    for n in names:
        if n not in SCALARS:
            raise FeatureError(f"{n} is no scalar feature")
        for p in params.get(n, {}):
            if p not in PARAMS.get(n, {}):
                raise FeatureParamsError(f"{n} has no parameter {p}")
    parts = []
    for axis, length in (("i", m.n_rows), ("j", m.n_cols)):
        degree = [n for n in names if n in DEGREE_SCALARS and DEGREE_SCALARS[n][0] == axis]
        whole = [n for n in names if n in ROW_SCALARS] if axis == "i" else []
        if not degree and not whole:
            continue
        aggs = [F.count("*").alias("d")]
        if "bandwidth" in whole:
            aggs.append(F.max(F.abs(F.col("i") - F.col("j"))).alias("b"))
        if "profile" in whole:
            aggs.append(F.min("j").alias("least"))
        if "off_diag_block_nnz" in whole:
            p = PARAMS["off_diag_block_nnz"] | params.get("off_diag_block_nnz", {})
            off = block_of(F.col("i"), m.n_rows, p["blocks_rows"]) != block_of(F.col("j"), m.n_cols, p["blocks_cols"])
            aggs.append(F.count(F.when(off, 1)).alias("off"))
        per = m.nz.groupBy(axis).agg(*aggs)
        if degree:
            stats = []
            for n in degree:
                c = _DEGREE[DEGREE_SCALARS[n][1]](max(length, 1))
                if params.get(n, {}).get("normalize"):
                    c = c / F.sqrt(F.lit(float(length)))
                stats.append(c.alias(n))
            parts.append(_histogram(per.select("d"), length).agg(*stats))
        if whole:
            sums = {
                "bandwidth": lambda: F.coalesce(F.max("b") + 1, F.lit(0)), "profile": lambda: F.coalesce(F.sum(F.col("i") - F.least("i", "least")), F.lit(0)),
                "off_diag_block_nnz": lambda: F.coalesce(F.sum("off"), F.lit(0)),
            }
            parts.append(per.agg(*(sums[n]().cast("bigint").alias(n) for n in whole)))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # each has exactly one row
    return out.select(*names)


def triangle_count(m: Sparse2D, directed: bool = False) -> DataFrame:
    """(triangles): undirected triangles of the symmetrised pattern, or directed 3-cycles, each orientation once.

    Self loops and repeated edges do not count.
    """
    return triangles.count(m, directed)


def jaccard_weights(m: Sparse2D) -> DataFrame:
    """(i, j, weight) of every stored edge: common neighbours / all neighbours of its two ends, by stored rows.

    Common neighbours come from the listing of triangles and from self loops; degree(i) + degree(j) counts stored
    non-zeros, as in the rows. A self loop has all neighbours in common with itself.
    """
    scratch = Scratch(m.spark, "edges")
    nz = scratch.write(m.nz.select("i", "j"))  # read several times
    deg = nz.groupBy("i").agg(F.count("*").alias("d"), F.max(F.col("i") == F.col("j")).alias("loop"))
    end = lambda s: deg.select(F.col("i").alias(s), F.col("d").alias(f"d_{s}"), F.col("loop").alias(f"loop_{s}"))
    a, b = F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")
    pairs = nz.groupBy(a, b).agg(F.max(F.col("i") < F.col("j")).alias("up"), F.max(F.col("i") > F.col("j")).alias("down"))
    full = pairs.join(triangles.common_neighbours(Sparse2D(nz, *m.dimensions)), ["a", "b"], "left").join(end("a"), "a", "left").join(end("b"), "b", "left")
    one = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    c = F.coalesce("c", F.lit(0)) + one(F.col("loop_a") & F.col("down")) + one(F.col("loop_b") & F.col("up"))
    d = F.coalesce("d_a", F.lit(0)) + F.coalesce("d_b", F.lit(0))
    w = full.withColumn("c", c).select("a", "b", F.when(F.col("c") > 0, F.col("c") / (d - F.col("c"))).otherwise(0.0).alias("weight"))
    loops = nz.where("i = j").select("i").distinct().join(nz, "i").groupBy("i").agg(F.countDistinct("j").alias("c"), F.count("*").alias("d"))
    same = loops.select(F.col("i").alias("a"), F.col("i").alias("b"), (F.col("c") / (2 * F.col("d") - F.col("c"))).alias("weight"))
    keyed = nz.select("i", "j", a, b)
    return keyed.join(w.where("a < b").union(same), ["a", "b"]).select("i", "j", "weight")


#: Users' own features: name to a function of the matrix and the feature's parameters that gives a table.
CUSTOM: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, feature: Callable[..., DataFrame], **defaults) -> None:
    """Make ``feature`` (matrix, parameters) to a table available to extractors, with the parameters it has and their defaults."""
    if name in (*SCALARS, *TABLES, "triangle_count", "jaccard_weights"):
        raise FeatureError(f"{name} is taken")
    CUSTOM[name], PARAMS[name] = feature, defaults


def unregister(name: str) -> None:
    if CUSTOM.pop(name, None) is None:
        raise FeatureError(f"{name} is no feature of a user")
    PARAMS.pop(name, None)


class Extractor:
    """A set of features that run together; scalars share their aggregations."""

    def __init__(self, *names: str, **params: dict):
        self._names: list[str] = []
        self._params: dict[str, dict] = {}
        for n in names:
            self.add(n, **params.get(n, {}))

    def add(self, name: str, **params) -> Extractor:
        if name not in (*SCALARS, *TABLES, *CUSTOM, "triangle_count", "jaccard_weights"):
            raise FeatureError(f"{name} is no feature")
        for p in params:
            if p not in PARAMS.get(name, {}):
                raise FeatureParamsError(f"{name} has no parameter {p}")
        if name not in self._names:
            self._names.append(name)
        self._params[name] = params
        return self

    def subtract(self, name: str) -> Extractor:
        if name not in self._names:
            raise FeatureError(f"{name} is not in the list")
        self._names.remove(name)
        self._params.pop(name, None)
        return self

    def names(self) -> list[str]:
        return list(self._names)

    def params(self, name: str) -> dict:
        return PARAMS.get(name, {}) | self._params.get(name, {})

    def extract(self, m: Sparse2D) -> dict[str, DataFrame]:
        """A table for each list feature, and under 'scalars' one row with all scalars."""
        out = {n: TABLES[n](m) for n in self._names if n in TABLES}
        some = [n for n in self._names if n in SCALARS]
        if some:
            out["scalars"] = scalars(m, some, self._params)
        if "triangle_count" in self._names:
            out["triangle_count"] = triangle_count(m, **self._params["triangle_count"])
        if "jaccard_weights" in self._names:
            out["jaccard_weights"] = jaccard_weights(m)
        return out | {n: CUSTOM[n](m, **self.params(n)) for n in self._names if n in CUSTOM}


def all_features() -> Extractor:
    """An extractor with every feature."""
    return Extractor(*TABLES, *SCALARS, "triangle_count", "jaccard_weights")

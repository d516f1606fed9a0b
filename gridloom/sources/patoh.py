"""PaToH hypergraph files: a header, one line of cells for each net, and cell weights on the last line."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ReaderError, WriterError
from gridloom.model import HyperGraph
from gridloom.sources.text import head, lines, numbered, tokens, write_lines


def read_patoh(spark: SparkSession, path: str) -> HyperGraph:
    """The hypergraph in ``path``. The header is base cells nets pins [scheme [constraints]]; scheme 1 has cell weights, 2 net weights, 3 both."""
    top = head(spark, path)
    words = top[-1].split() if top else []
    if not 4 <= len(words) <= 6 or not all(w.isdigit() for w in words):
        raise ReaderError("the header is base cells nets pins [scheme [constraints]]")
    base, n_cells, n_nets = (int(w) for w in words[:3])
    scheme, constraints = int(words[4]) if len(words) > 4 else 0, int(words[5]) if len(words) > 5 else 1
    if base not in (0, 1) or scheme > 3:
        raise ReaderError("the base is 0 or 1, the scheme 0 to 3")
    rows = numbered(lines(spark, path).where("value <> '' and not startswith(value, '%')")).select("no", tokens().alias("t"))
    nets = rows.where(F.col("no").between(1, n_nets)).select((F.col("no") - 1).alias("net"), "t")
    skip = 1 if scheme & 2 else 0
    pins = nets.select("net", F.explode(F.slice("t", F.lit(skip + 1), F.greatest(F.size("t") - skip, F.lit(0)))).alias("cell")).select("net", (F.col("cell").cast("bigint") - base).alias("cell"))
    net_weights = nets.select("net", F.col("t")[0].cast("bigint").alias("w")) if skip else None
    cell_weights = None
    if scheme & 1:
        last = rows.where(F.col("no") > n_nets).select("no", F.posexplode("t").alias("p", "w"))
        flat = last.select((F.floor(F.col("p") / constraints)).alias("cell"), (F.col("p") % constraints).alias("c"), F.col("w").cast("bigint").alias("w"))
        if constraints == 1:
            cell_weights = flat.select("cell", "w")
        else:
            cell_weights = flat.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"]).alias("w"))
    return HyperGraph(pins, n_nets, n_cells, base, net_weights, cell_weights)


def write_patoh(h: HyperGraph, path: str, base: int | None = None, single: bool = False) -> None:
    """Write ``h`` with the weights it has; those of cells may be arrays of several constraints, all of one length.

    A net without pins is an empty line, which the form cannot hold without net weights. A cell without weights has 0. All
    cell weights are one line by the form of the file and pass through one row, which holds some 200 million of them.
    """
    spark, base = h.pins.sparkSession, h.base if base is None else base
    own = h.pins.groupBy("net").agg(F.array_sort(F.collect_list(F.col("cell") + base)).alias("s"))
    full = spark.range(h.n_nets).select(F.col("id").alias("net")).join(own, "net", "left")
    if h.net_weights is None and not full.where("s is null").isEmpty():
        raise WriterError("a net without pins")
    text = [F.coalesce(F.array_join(F.col("s").cast("array<string>"), " "), F.lit(""))]
    if h.net_weights is not None:
        full = full.join(h.net_weights, "net", "left")
        text.insert(0, F.col("w").cast("string"))
    body = full.select("net", F.trim(F.concat_ws(" ", *text)).alias("value"))
    scheme = (1 if h.cell_weights is not None else 0) + (2 if h.net_weights is not None else 0)
    header, constraints = f"{base} {h.n_cells} {h.n_nets} {h.pins.count()}" + (f" {scheme}" if scheme else ""), 1
    weights = h.cell_weights
    if weights is not None and dict(weights.dtypes)["w"].startswith("array"):
        sizes = weights.agg(F.min(F.size("w")).alias("least"), F.max(F.size("w")).alias("most")).first()
        constraints = sizes["most"] or 1
        if sizes["least"] != sizes["most"]:
            raise WriterError("cells have different numbers of weights")
        header += f" {constraints}"
    elif weights is not None:
        weights = weights.select("cell", F.array("w").alias("w"))
    body = spark.createDataFrame([(-1, header)], "net bigint, value string").unionByName(body)
    if weights is not None:
        none = F.array_repeat(F.lit("0"), constraints)
        each = spark.range(h.n_cells).select(F.col("id").alias("cell")).join(weights, "cell", "left").select("cell", F.coalesce(F.col("w").cast("array<string>"), none).alias("w"))
        line = each.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "w"))), lambda x: x["w"])).alias("s"))
        body = body.unionByName(line.select(F.lit(h.n_nets).cast("bigint").alias("net"), F.array_join("s", " ").alias("value")))
    write_lines(body, ["net"], path, single)

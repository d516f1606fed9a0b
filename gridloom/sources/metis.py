"""METIS graph files: a header and one line of neighbours for each vertex."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.errors import ReaderError, WriterError
from gridloom.model import Graph, Sparse2D
from gridloom.sources.text import head, lines, numbered, tokens, write_lines


def read_metis(spark: SparkSession, path: str, zero_based: bool = False) -> Graph:
    """The graph in ``path``.

    The header is n m [FMT [NCON]]; FMT is up to three digits: vertex sizes (not supported), vertex weights, edge
    weights. Ids count from 1 in the file; unless ``zero_based`` they are kept and a vertex 0 without edges and with
    weights 0 is added. Comment lines begin with %.
    """
    top = head(spark, path)
    words = top[-1].split() if top else []
    if not 2 <= len(words) <= 4 or not all(w.isdigit() for w in words):
        raise ReaderError("the header is n m [FMT [NCON]]")
    n, fmt = int(words[0]), (words[2] if len(words) > 2 else "0").zfill(3)
    if fmt[0] == "1" or set(fmt) - {"0", "1"}:
        raise ReaderError(f"format {fmt} is not supported")
    ncon = (int(words[3]) if len(words) > 3 else 1) if fmt[1] == "1" else 0
    shift = 1 if zero_based else 0
    body = lines(spark, path).where("not startswith(value, '%')")
    rows = numbered(body).where(F.col("no").between(1, n)).select((F.col("no") - shift).alias("id"), F.filter(tokens(), lambda x: x != "").alias("t"))
    rest = F.slice("t", F.lit(ncon + 1), F.greatest(F.size("t") - ncon, F.lit(0)))
    step = 2 if fmt[2] == "1" else 1
    at = F.when(F.size("r") >= step, F.sequence(F.lit(0), F.floor((F.size("r") - step) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    each = rows.select("id", rest.alias("r")).select("id", "r", F.explode(at).alias("k"))
    nz = each.select(F.col("id").alias("i"), (F.get("r", F.col("k") * step).cast("bigint") - shift).alias("j"), *([F.get("r", F.col("k") * 2 + 1).cast("double").alias("v")] if step == 2 else []))
    size = n + 1 - shift
    weights = None
    if ncon:
        w = rows.select("id", F.transform(F.slice("t", 1, ncon), lambda x: x.cast("bigint")).alias("w"))
        if not zero_based:
            w = w.union(spark.range(1).select(F.lit(0).cast("bigint"), F.array_repeat(F.lit(0).cast("bigint"), ncon)))
        weights = w
    return Graph(Sparse2D(nz, size, size), weights)


def write_metis(g: Graph, path: str, zero_based: bool = True, single: bool = False) -> None:
    """Write ``g``; the file has edge weights if its connectivity has values, vertex weights if its vertices have.

    If not ``zero_based``, ids count from 1 and vertex 0, which must have no edges, is left out.
    """
    m, spark = g.connectivity, g.connectivity.spark
    shift = 1 if zero_based else 0
    n = g.n if zero_based else g.n - 1
    if not zero_based and not m.nz.where("i = 0 or j = 0").isEmpty():
        raise WriterError("vertex 0 has edges")
    item = F.struct("j", *(["v"] if m.valued else []))
    rows = m.nz.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("s"))
    words = F.transform("s", lambda x: F.concat_ws(" ", x["j"] + shift, *([x["v"].cast("bigint").cast("string")] if m.valued else [])))
    full = spark.range(0 if zero_based else 1, g.n).join(rows, "id", "left")
    text, ncon = [F.array_join(F.coalesce(words, F.array().cast("array<string>")), " ")], 0
    if g.vertices is not None:
        full = full.join(g.vertices.select("id", "w"), "id", "left")
        ncon = g.vertices.select(F.max(F.size("w"))).first()[0] or 0
        text.insert(0, F.array_join(F.col("w").cast("array<string>"), " "))
    fmt = f"{int(ncon > 0)}{int(m.valued)}".lstrip("0")
    header = " ".join(x for x in (str(n), str(m.nnz() // 2), fmt, str(ncon) if ncon else "") if x)
    body = full.select("id", F.trim(F.concat_ws(" ", *text)).alias("value"))
    write_lines(spark.createDataFrame([(-1, header)], "id bigint, value string").unionByName(body), ["id"], path, single)

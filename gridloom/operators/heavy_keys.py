"""Per-key counts and sums when a few keys hold most of the rows.

Equal input splits are aggregated where they lie: the keys of a chunk are
dictionary-encoded and their rows scattered into dense arrays with ``bincount``.
The arrays are cut into blocks by a hash of the key, and each block is summed
over all chunks in a reduction tree of bounded fan-in. A key takes one slot of a
chunk's arrays however many rows it has, so the heaviest key costs no more than any
other after the first step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import shuffle_width

#: The axes and the column that holds each one's index.
AXES = {"row": "i", "col": "j"}
_ARRAYS = {"file": np.int64, "idx": np.int64, "n": np.int64, "n_v": np.int64, "v": np.float64}
_BLOCK = "axis string, block int, part bigint, file binary, idx binary, n binary, n_v binary, v binary"
_SUMS = "axis string, file_id int, idx bigint, n bigint, n_v bigint, sum_v double"
#: Stands for a null file_id, which is a key like others.
_NO_FILE = np.int64(2) ** 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _encode(file: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the keys (file, idx), and the dictionary as two arrays."""
    f, files = pd.factorize(file)
    i, idxs = pd.factorize(idx)
    codes, keys = pd.factorize(f.astype(np.int64) * len(idxs) + i)
    return codes, files[keys // len(idxs)], idxs[keys % len(idxs)]


def _accumulate(file: np.ndarray, idx: np.ndarray, v: np.ndarray, has: np.ndarray) -> list[np.ndarray]:
    codes, files, idxs = _encode(file, idx)
    k = len(files)
    return [files, idxs, np.bincount(codes, minlength=k), np.bincount(codes[has], minlength=k), np.bincount(codes[has], weights=v[has], minlength=k)]


def _column(a: pa.ChunkedArray, fill: float, kind: type) -> np.ndarray:
    return pc.fill_null(a, fill).to_numpy().astype(kind, copy=False)


def _chunk_blocks(t: pa.Table, blocks: int, part: int) -> Iterator[pa.RecordBatch]:
    file, v = _column(t["file_id"].cast(pa.int64()), int(_NO_FILE), np.int64), _column(t["v"], 0.0, np.float64)
    has = pc.is_valid(t["v"]).to_numpy()
    for axis in AXES:
        there = pc.is_valid(t[axis]).to_numpy()
        if not there.any():
            continue
        arrays = _accumulate(file[there], _column(t[axis], 0, np.int64)[there], v[there], has[there])
        block = (_mix(arrays[0] * np.int64(1_000_003) + arrays[1]) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        arrays, block = [a[order] for a in arrays], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        parts = [[a[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array([axis] * len(starts)), pa.array(block[starts], pa.int32()), pa.array([part] * len(starts)), *(pa.array(p, pa.binary()) for p in parts)], ["axis", "block", "part", *_ARRAYS])


def _added(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The arrays of one block added up."""
    read = {c: np.frombuffer(b"".join(pdf[c]), kind) for c, kind in _ARRAYS.items()}
    codes, file, idx = _encode(read["file"], read["idx"])
    total = lambda c: np.bincount(codes, weights=read[c], minlength=len(file)).astype(_ARRAYS[c])
    return {"file": file, "idx": idx} | {c: total(c) for c in ("n", "n_v", "v")}


def _reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([{"axis": pdf["axis"].iloc[0], "block": pdf["block"].iloc[0], "part": pdf["part"].iloc[0]} | {c: a.tobytes() for c, a in _added(pdf).items()}])


def _sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
    got = _added(pdf)
    return pd.DataFrame({"axis": pdf["axis"].iloc[0], "file_id": pd.Series(got["file"], dtype="Int64").mask(got["file"] == _NO_FILE).astype("Int32"), "idx": got["idx"], "n": got["n"], "n_v": got["n_v"], "sum_v": got["v"]})


def _extent(nonzeros: DataFrame) -> tuple[int, int]:
    """The number of rows, and about how many keys the axis with more of them has."""
    each = [F.approx_count_distinct(F.when(F.col(c).isNotNull(), F.xxhash64("file_id", c))).alias(axis) for axis, c in AXES.items()]
    r = nonzeros.agg(F.count("*").alias("rows"), *each).first()
    return r["rows"], max(r[axis] for axis in AXES)


def key_sums(nonzeros: DataFrame, chunk_rows: int = 1_000_000, blocks: int | None = None, fan_in: int = 32, extent: tuple[int, int] | None = None) -> DataFrame:
    """Entries and sum of v of every row (file_id, i) and every column (file_id, j).

    Takes file_id INT, i, j BIGINT and v DOUBLE; gives axis ('row' or 'col'), file_id, idx, n (stored rows of the
    key, repeats counted), n_v (those with a v) and sum_v (null if n_v is 0). Rows whose i is null have no row key,
    those whose j is null no column key; a null file_id is a key of its own. An empty table gives no rows. Other
    columns are ignored. NaN in v is a value and makes the sum NaN.

    ``blocks`` is the number of array blocks: unless given, four for each shuffle partition and no fewer than leave half
    a million keys to a block, by the number of distinct keys (``extent``, counted in a first pass unless given). A block
    is summed over about ``fan_in`` chunks of ``chunk_rows`` at a time, level by level, so no task holds more than so many
    times the keys of a block. A key lies in exactly one block and comes once from each chunk.
    """
    rows, keys = extent or _extent(nonzeros)
    blocks = blocks or max(4 * shuffle_width(nonzeros.sparkSession), -(-keys // 500_000))
    nz = nonzeros.select(F.col("file_id").cast("int").alias("file_id"), F.col("i").cast("bigint").alias("row"), F.col("j").cast("bigint").alias("col"), F.col("v").cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, TaskContext.get().partitionId() << 24
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk_rows:
                yield from _chunk_blocks(pa.Table.from_batches(held), blocks, part)
                held, n, part = [], 0, part + 1
        if n:
            yield from _chunk_blocks(pa.Table.from_batches(held), blocks, part)

    partial, groups = nz.mapInArrow(run, _BLOCK), -(-rows // chunk_rows)
    while groups > fan_in:
        groups = -(-groups // fan_in)
        partial = partial.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups))).groupBy("axis", "block", "part").applyInPandas(_reduce_block, _BLOCK)
    sums = partial.drop("part").groupBy("axis", "block").applyInPandas(_sum_block, _SUMS)
    return sums.withColumn("sum_v", F.when(F.col("n_v") > 0, F.col("sum_v")))


def heavy_keys(nonzeros: DataFrame, share: tuple[int, int] = (2, 100), sums: DataFrame | None = None) -> DataFrame:
    """The keys of ``key_sums`` that hold at least ``share`` (a fraction of integers) of all stored rows.

    Rows with null keys count in the total. An empty table has no heavy keys.
    """
    extent = _extent(nonzeros) if sums is None else (nonzeros.count(), 0)
    total = extent[0]
    sums = key_sums(nonzeros, extent=extent) if sums is None else sums
    return sums.where((F.col("n") * share[1] >= F.lit(total * share[0])) & (F.col("n") > 0)).withColumn("total", F.lit(total).cast("bigint"))

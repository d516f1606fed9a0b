"""Binary array files: a JSON header of 1,024 bytes, then for each array a JSON header of 1,024 bytes and its raw values.

Writing and reading are done by the executors, a range of each array at a time; the ranges written are then joined to
one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from gridloom.errors import ReaderError
from gridloom.model import Dense1D, Sparse2D, matrix
from gridloom.operators.convert import coo_order, pointers
from gridloom.runtime import shuffle_width
from gridloom.sources.text import join_files

#: The length of a header and the names of the element types.
HEADER = 1024
KINDS = {"f": "float", "i": "signed", "u": "unsigned"}
_SPARK = {("float", 4): "float", ("float", 8): "double", ("signed", 4): "int", ("signed", 8): "bigint", ("unsigned", 4): "bigint", ("unsigned", 8): "bigint"}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_headers(path: str) -> tuple[dict, dict[str, dict]]:
    """The file's header and each array's, with the offset of its data."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        top = json.loads(f.read_at(HEADER, 0).decode().rstrip(" \x00"))
        arrays, offset = {}, HEADER
        for _ in range(top["array_count"]):
            one = json.loads(f.read_at(HEADER, offset).decode().rstrip(" \x00"))
            arrays[one["name"]] = one | {"offset": offset + HEADER}
            offset += HEADER + one["type_size"] * one["array_size"]
    return top, arrays


def _dtype(a: dict, endian: str) -> np.dtype:
    return np.dtype({v: k for k, v in KINDS.items()}[a["type"]] + str(a["type_size"])).newbyteorder("<" if endian == "little" else ">")


class _Values:
    """The values of the arrays in an open file."""

    def __init__(self, f: pa.NativeFile, arrays: dict[str, dict], endian: str):
        self._f, self._arrays, self._kinds = f, arrays, {name: _dtype(a, endian) for name, a in arrays.items()}

    def __call__(self, name: str, first: int, size: int) -> np.ndarray:
        a, kind = self._arrays[name], self._kinds[name]
        got = np.frombuffer(self._f.read_at(size * kind.itemsize, a["offset"] + first * kind.itemsize), kind)
        return got.astype({"float": np.float32, "double": np.float64, "int": np.int32, "bigint": np.int64}[_spark_type(a)])


def _spark_type(a: dict) -> str:
    return _SPARK[a["type"], a["type_size"]]


def read_array(spark: SparkSession, path: str, name: str, column: str, chunk: int = 1 << 22) -> DataFrame:
    """(idx, column) of one array, by ranges of ``chunk`` elements."""
    top, arrays = read_headers(path)
    if name not in arrays:
        raise ReaderError(f"{path} has no array {name}")
    n, endian = arrays[name]["array_size"], top["endian"]
    parts = -(-n // chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            values = _Values(f, arrays, endian)
            for b in batches:
                for part in b["id"].to_pylist():
                    first = part * chunk
                    size = min(chunk, n - first)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + size)), pa.array(values(name, first, size))], ["idx", column])

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, f"idx bigint, {column} {_spark_type(arrays[name])}")


def read_sbff_array(spark: SparkSession, path: str) -> Dense1D:
    top, _ = read_headers(path)
    if top["name"] != "array":
        raise ReaderError(f"{path} holds {top['name']}")
    return Dense1D(read_array(spark, path, "array", "v"), top["dimensions"][0])


def _rows_of(values: _Values, ends: int, first: int, last: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first element, row of each) of the elements from ``first`` to before ``last``, by the ``ends`` pointers, ``step`` rows at a time."""
    row, high = 0, ends - 1
    while row < high:  # the last row that starts no later than the first element
        mid = (row + high + 1) // 2
        if values("row_ptr", mid, 1)[0] <= first:
            row = mid
        else:
            high = mid - 1
    while row < ends - 1:
        ptr = values("row_ptr", row, min(step + 1, ends - row))
        held = np.clip(ptr, first, last)
        yield int(held[0]), np.repeat(np.arange(row, row + len(ptr) - 1), np.diff(held))
        if ptr[-1] >= last:
            return
        row += len(ptr) - 1


def read_sbff_matrix(spark: SparkSession, path: str, chunk: int = 1 << 20) -> Sparse2D:
    """The matrix in a file of the kind 'coo' or 'csr', by ranges of ``chunk`` non-zeros, each with its own piece of every array."""
    top, arrays = read_headers(path)
    layout, endian = top["name"], top["endian"]
    if layout not in ("coo", "csr"):
        raise ReaderError(f"{path} holds {layout}")
    if missing := {"col", "row" if layout == "coo" else "row_ptr"} - set(arrays):
        raise ReaderError(f"{path} has no array {min(missing)}")
    of = {"j": "col"} | ({"v": "vals"} if "vals" in arrays else {}) | ({"i": "row"} if layout == "coo" else {})
    n = min(arrays[a]["array_size"] for a in of.values())
    parts = -(-n // chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = _open(path)
        with fs.open_input_file(at) as f:
            values = _Values(f, arrays, endian)
            for b in batches:
                for first in [part * chunk for part in b["id"].to_pylist()]:
                    last = min(first + chunk, n)
                    got = {c: values(a, first, last - first) for c, a in of.items()}
                    pieces = [(first, got["i"])] if layout == "coo" else _rows_of(values, arrays["row_ptr"]["array_size"], first, last, chunk)
                    for start, i in pieces:
                        own = slice(start - first, start - first + len(i))
                        columns = {"i": i} | {c: got[c][own] for c in ("j", "v") if c in got}
                        yield pa.RecordBatch.from_arrays([pa.array(x if c == "v" else x.astype(np.int64)) for c, x in columns.items()], list(columns))

    schema = "i bigint, j bigint" + (f", v {_spark_type(arrays['vals'])}" if "v" in of else "")
    return matrix(spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, schema), *top["dimensions"])


def _write_values(df: DataFrame, position: str, column: str, folder: str, number: int) -> dict:
    """Write one array as part files, a range of positions each, from the executors; gives its element type."""
    kind = {"int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}[dict(df.dtypes)[column]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, at), name, sink = _open(folder), "", None
        for b in batches:
            if b.num_rows and sink is None:
                name, own = f"{at}/part-{number:04d}-{b[position][0].as_py():020d}", uuid.uuid4().hex
                sink = fs.open_output_stream(f"{at}/_{own}")
            if b.num_rows:
                sink.write(b[column].to_numpy(zero_copy_only=False).astype(kind).tobytes())
        if sink is not None:  # a whole file takes its place at once, so a task may run twice
            sink.close()
            fs.move(f"{at}/_{own}", name)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    placed = df.select(position, column).repartitionByRange(shuffle_width(df.sparkSession), position).sortWithinPartitions(position)
    placed.mapInArrow(run, "name string").count()
    return {"type": KINDS[np.dtype(kind).kind], "type_size": np.dtype(kind).itemsize}


def _write(spark: SparkSession, path: str, name: str, dims: list[int], arrays: list[tuple]) -> None:
    """Arrays are (table, position, column, name, size). Headers and values are part files, which are then joined."""
    parts = path.rstrip("/") + ".parts"
    fs, at = _open(parts)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)
    fs.create_dir(at)

    def header(number: int, what: dict) -> None:
        with fs.open_output_stream(f"{at}/part-{number:04d}") as sink:
            sink.write(json.dumps(what).ljust(HEADER).encode())

    header(0, {"name": name, "array_count": len(arrays), "dimensions": dims, "endian": "little"})
    for k, (df, position, column, array, size) in enumerate(arrays):
        header(2 * k + 1, {"name": array} | _write_values(df, position, column, parts, 2 * k + 2) | {"array_size": size})
    join_files(spark, parts, path)


def write_sbff_array(x: Dense1D, path: str) -> None:
    _write(x.data.sparkSession, path, "array", [x.length], [(x.data, "idx", "v", "array", x.length)])


def write_sbff_matrix(m: Sparse2D, path: str, layout: str = "csr") -> None:
    """Write ``m`` as 'coo' or 'csr', in (i, j) order."""
    placed = coo_order(m)
    n = placed.count()
    rest = [(placed, "pos", "j", "col", n), *([(placed, "pos", "v", "vals", n)] if m.valued else [])]
    first = (placed, "pos", "i", "row", n) if layout == "coo" else (pointers(m), "id", "ptr", "row_ptr", m.n_rows + 1)
    _write(m.spark, path, layout, [m.n_rows, m.n_cols], [first, *rest])

"""Loading delivered matrix lines while setting apart those that do not parse.

The bulk path parses a block of lines with columnar kernels. A block that fails is
halved again and again, by the counts of failures that the kernels left, until the
bad records stand alone; only those are diagnosed, one by one, with a strict reader
that names the reason.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The element types a file may declare.
FIELDS = ("real", "double", "integer", "pattern")
#: The reasons, in the order in which they are tested.
REASONS = (
    "null line", "unknown file", "unsupported field", "no delimiter", "broken quoting", "wrong number of cells",
    "row is not a number", "row out of range", "column is not a number", "column out of range",
    "value is not a number", "value out of range",
)

SCHEMA = "raw_id bigint, file_id int, line_no bigint, row bigint, col bigint, val double, val_int bigint, note string, reason string"
_PARSED = [("row", pa.int64()), ("col", pa.int64()), ("val", pa.float64()), ("val_int", pa.int64()), ("note", pa.string()), ("reason", pa.string())]
_KEYS = ["raw_id", "file_id", "line_no"]

_REAL = re.compile(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", re.ASCII)
_INT = re.compile(r"[+-]?[0-9]+", re.ASCII)
_DIGITS = re.compile(r"[0-9]+", re.ASCII)


@lru_cache(maxsize=None)
def _pattern(kind: str, delim: str) -> str:
    d = re.escape(delim)

    def cell(name: str, body: str) -> str:
        return f'(?P<{name}>" *{body} *"| *{body} *)'

    cells = [cell("r", "[0-9]+"), cell("c", "[0-9]+")]
    if kind == "integer":
        cells.append(cell("v", "[+-]?[0-9]+"))
    elif kind != "pattern":
        cells.append(cell("v", r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"))
    return r"\A" + d.join(cells) + d + rf'(?P<n>"(?:[^"]|"")*"|[^"{d}]*)' + r"\z"


def _integers(cells: pa.Array) -> pa.Array:
    """The numbers in ``cells``; null for those of over 18 digits, which the strict reader takes."""
    bare = pc.ascii_trim(cells, characters=' "')
    digits = pc.ascii_ltrim(pc.ascii_ltrim(bare, characters="+-"), characters="0")
    digits = pc.if_else(pc.equal(digits, ""), "0", digits)
    digits = pc.if_else(pc.less_equal(pc.binary_length(digits), 18), digits, pa.scalar(None, pa.string()))
    return pc.cast(pc.if_else(pc.starts_with(bare, "-"), pc.binary_join_element_wise("-", digits, ""), digits), pa.int64())


def _bulk(lines: pa.Array, n_rows: pa.Array, n_cols: pa.Array, kind: str, delim: str) -> tuple[list[pa.Array], pa.Array]:
    """The parsed columns of a block, and for each line whether the kernels accept it."""
    got = pc.extract_regex(lines, _pattern(kind, delim))
    ok = pc.is_valid(got)
    part = lambda name: pc.struct_field(got, name)
    row, col = _integers(part("r")), _integers(part("c"))
    inside = pc.and_(pc.and_(pc.greater_equal(row, 1), pc.less_equal(row, n_rows)), pc.and_(pc.greater_equal(col, 1), pc.less_equal(col, n_cols)))
    ok = pc.and_(ok, pc.fill_null(inside, False))
    val, val_int = pa.nulls(len(lines), pa.float64()), pa.nulls(len(lines), pa.int64())
    if kind == "integer":
        val_int = _integers(part("v"))
        val = pc.cast(val_int, pa.float64(), safe=False)
        ok = pc.and_(ok, pc.is_valid(val))
    elif kind != "pattern":
        val = pc.cast(pc.ascii_ltrim(pc.ascii_trim(part("v"), characters=' "'), characters="+"), pa.float64())
        ok = pc.and_(ok, pc.fill_null(pc.is_finite(val), False))
    note = part("n")
    inner = pc.replace_substring(pc.utf8_slice_codeunits(note, 1, -1), '""', '"')
    note = pc.if_else(pc.starts_with(note, '"'), inner, note)
    return [row, col, val, val_int, note, pa.nulls(len(lines), pa.string())], ok


def isolate(failed: np.ndarray) -> np.ndarray:
    """The places of the records that fail: blocks that hold a failure are halved until they hold one record.

    Counts of failures up to each record tell whether a half fails, so no record is parsed twice.
    """
    upto = np.r_[0, np.cumsum(failed)]
    first, end = np.array([0]), np.array([len(failed)])
    while True:
        fails = upto[end] > upto[first]
        first, end = first[fails], end[fails]
        many = end - first > 1
        if not many.any():
            return np.sort(first)
        middle = (first + end) // 2
        first, end = np.r_[first, middle[many]], np.r_[np.where(many, middle, end), end[many]]


def split_cells(line: str, delim: str) -> list[str] | None:
    """The unquoted cells of ``line``; None if the quoting is broken."""
    cells, at = [], 0
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if not line.startswith('"', end + 1):
                    break
                end += 2
            cells.append(line[at + 1 : end].replace('""', '"'))
            end += 1
            if end < len(line) and not line.startswith(delim, end):
                return None
            end = end if end < len(line) else -1
        else:
            end = line.find(delim, at)
            cell = line[at:] if end < 0 else line[at:end]
            if '"' in cell:
                return None
            cells.append(cell)
        if end < 0:
            return cells
        at = end + len(delim)


def _number(digits: str) -> float:
    """Digits as an int; beyond 4,000 of them, which Python refuses, infinity."""
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) < 4000 else math.inf


def diagnose(line: str, n_rows: int | None, n_cols: int | None, kind: str, delim: str) -> tuple:
    """(row, col, val, val_int, note, reason) of one line, read strictly; all but the reason are null if there is one."""
    bad = lambda why: (None, None, None, None, None, why)
    cells = split_cells(line, delim)
    if cells is None:
        return bad("broken quoting")
    if len(cells) != (3 if kind == "pattern" else 4):
        return bad("wrong number of cells")
    ends = []
    for cell, top, what in ((cells[0], n_rows, "row"), (cells[1], n_cols, "column")):
        cell = cell.strip(" ")
        if not _DIGITS.fullmatch(cell):
            return bad(f"{what} is not a number")
        if top is None or not 1 <= _number(cell) <= top:
            return bad(f"{what} out of range")
        ends.append(_number(cell))
    val = val_int = None
    if kind != "pattern":
        cell = cells[2].strip(" ")
        if not (_INT if kind == "integer" else _REAL).fullmatch(cell):
            return bad("value is not a number")
        if kind == "integer":
            val_int = _number(cell.lstrip("+-")) * (-1 if cell[0] == "-" else 1)
            if not -(2**63) <= val_int < 2**63:
                return bad("value out of range")
            val = float(val_int)
        else:
            val = float(cell)
            if not math.isfinite(val):
                return bad("value out of range")
    return (*ends, val, val_int, cells[-1], None)


def _block(lines: pa.Array, n_rows: pa.Array, n_cols: pa.Array, kind: str, delim: str) -> tuple[list[pa.Array], np.ndarray]:
    """The parsed columns of a block and the places of the lines that are left to the strict reader."""
    if len(delim) != 1 or delim in ' "+-.0123456789eE':  # a delimiter that could stand within a number
        return [pa.nulls(len(lines), t) for _, t in _PARSED], np.arange(len(lines))
    cols, ok = _bulk(lines, n_rows, n_cols, kind, delim)
    return cols, isolate(~ok.to_numpy(zero_copy_only=False))


def _parse_batch(batch: pa.RecordBatch, block_rows: int) -> Iterator[pa.RecordBatch]:
    names = [*_KEYS, *(n for n, _ in _PARSED)]
    comment = pc.fill_null(pc.starts_with(batch["line"], "%"), False)
    batch = batch.filter(pc.invert(comment))
    if not batch.num_rows:
        return
    line, field, delim = batch["line"], batch["field"], batch["delim"]
    why = pc.case_when(
        pc.make_struct(pc.is_null(line), pc.invert(batch["known"]), pc.invert(pc.is_in(field, value_set=pa.array(FIELDS))), pc.fill_null(pc.equal(delim, ""), True)),
        *(pa.scalar(r) for r in REASONS[:4]), pa.scalar(None, pa.string()),
    )
    late_idx, late_rows = [], []
    out = batch.filter(pc.is_valid(why))
    if out.num_rows:
        none = {n: pa.nulls(out.num_rows, t) for n, t in _PARSED} | {"reason": why.filter(pc.is_valid(why))}
        yield pa.RecordBatch.from_arrays([*(out[k] for k in _KEYS), *(none[n] for n, _ in _PARSED)], names)
    group = pc.dictionary_encode(pc.binary_join_element_wise(field, delim, "\x00", null_handling="replace"))
    group = pc.if_else(pc.is_valid(why), -1, group.indices)
    for g in pc.unique(group).to_pylist():
        if g < 0:
            continue
        idx = pc.indices_nonzero(pc.equal(group, g))
        kind, sep = field[idx[0].as_py()].as_py(), delim[idx[0].as_py()].as_py()
        for at in range(0, len(idx), block_rows):
            some = idx.slice(at, block_rows)
            args = [batch[c].take(some) for c in ("line", "n_rows", "n_cols")]
            cols, alone = _block(*args, kind, sep)
            if len(alone) < len(some):
                clean = np.ones(len(some), bool)
                clean[alone] = False
                clean = pa.array(clean)
                yield pa.RecordBatch.from_arrays([*(batch[k].take(some.filter(clean)) for k in _KEYS), *(c.filter(clean) for c in cols)], names)
            if len(alone):
                alone = pa.array(alone)
                late_idx += some.take(alone).to_pylist()
                late_rows += [diagnose(*x, kind, sep) for x in zip(*(a.take(alone).to_pylist() for a in args), strict=True)]
    if late_rows:
        i = pa.array(late_idx)
        cols = [pa.array(c, t) for c, (_, t) in zip(zip(*late_rows, strict=True), _PARSED, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch[k].take(i) for k in _KEYS), *cols], names)


def parse_entries(lines: DataFrame, files: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Parse every line of ``lines`` (raw_id, file_id, line_no, line) by its file's field, delim, n_rows and n_cols.

    One row for each line that is no comment (does not begin with ``%``): a valid line has its 1-based row and col,
    its value (val; for integer files also the exact val_int; both null for pattern files) and its note, and a null
    reason; any other has only a reason, one of REASONS.

    A null line, a null or unknown file, an unsupported or null field and a null or empty delimiter are reasons.
    Lines sent twice come out twice, under their own raw_id. Of several rows of ``files`` with one file_id the
    smallest counts. Empty tables give no rows. Other columns of either table are ignored, whatever their names.
    There is no shuffle unless ``files`` is too large to broadcast; lines are parsed where they are read, so one file
    with most lines does no harm.

    ``block_rows`` bounds a block, which is otherwise the lines of one format in an Arrow batch. The strict reader gets
    the lines that the kernels do not accept: those that fail, and valid numbers of more than 18 digits. Where the
    delimiter is more than one character, or one that a number may hold, it gets every line.
    """
    shape = ["field", "delim", "n_rows", "n_cols"]
    files = (
        files.where("file_id is not null").groupBy(F.col("file_id").cast("int").alias("file_id"))
        .agg(F.min(F.struct(*(F.col(c).cast("bigint" if c[:2] == "n_" else "string").alias(c) for c in shape))).alias("s"))
        .select("file_id", *(f"s.{c}" for c in shape), F.lit(True).alias("known"))
    )
    lines = lines.select(F.col("raw_id").cast("bigint"), F.col("file_id").cast("int"), F.col("line_no").cast("bigint"), "line")
    full = lines.join(files, "file_id", "left").select(*_KEYS, "line", *shape, F.coalesce("known", F.lit(False)).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _parse_batch(b, block_rows)

    return full.mapInArrow(run, SCHEMA)


def split_entries(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid entries and the rejected lines of ``parse_entries``. Write ``parsed`` once before using both."""
    valid = parsed.where("reason is null").drop("reason")
    return valid, parsed.where("reason is not null").select(*_KEYS, "reason")

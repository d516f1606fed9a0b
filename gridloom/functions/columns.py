"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def block_of(x: Column, n: int, blocks: int) -> Column:
    """The block of index x when n indices are cut into ``blocks`` near-equal runs, the longer ones first."""
    q, r = divmod(n, blocks)
    t = r * (q + 1)
    first = F.floor(x / F.lit(q + 1)) if r else F.lit(0)
    return F.when(x < t, first).otherwise(F.lit(r) + F.floor((x - t) / F.lit(max(q, 1)))).cast("bigint")


def gray_rank(bits: Column, width: int = 64) -> Column:
    """The rank in the Gray code of a bit pattern: the exclusive or of all its right shifts."""
    out, step = bits, 1
    while step < width:
        out = out.bitwiseXOR(F.shiftrightunsigned(out, step))
        step *= 2
    return out


def unsigned_order(x: Column) -> Column:
    """A BIGINT that sorts signed as ``x`` sorts unsigned."""
    return x.bitwiseXOR(F.lit(-(2**63)).cast("bigint"))

"""Where intermediate tables live, and helpers that need the session.

Lineage is cut by writing a table into the folder that the session names in
``spark.checkpoint.dir``: every executor can read it, so losing one loses no data.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_open: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode only, a temporary one if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A folder of written tables for one run of an operator. It goes when Python exits or a ``scratch_of`` ends, single tables by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self._n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        _open.append(self)

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back."""
        return self.write_counted(df, compression)[0]

    def write_counted(self, df: DataFrame, compression: str = "zstd") -> tuple[DataFrame, int]:
        """``write``, with the number of rows, which the write itself counts."""
        out, seen = self.write_observed(df, {"n": F.count(F.lit(1))}, compression)
        return out, seen["n"]

    def write_observed(self, df: DataFrame, metrics: dict[str, Column], compression: str = "zstd") -> tuple[DataFrame, dict]:
        """``write``, with the aggregates ``metrics``, which the write itself computes."""
        at = f"{self.path}/{self._n}"
        self._n += 1
        seen = Observation()
        df.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.option("compression", compression).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._gridloom_at = at
        return out, seen.get

    def read_all(self, tables: list[DataFrame], schema: str) -> DataFrame:
        """The rows of several tables of ``write``, by one scan, however many they are."""
        return self.spark.read.schema(schema).parquet(*(t._gridloom_at for t in tables))

    def folder(self) -> str:
        """The scratch folder, made if need be, for files of other kinds."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p)
        return self.path

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of ``write`` that nothing will read again."""
        for t in tables:
            if t is not None:
                _delete(self.spark, t._gridloom_at)

    def close(self) -> None:
        _delete(self.spark, self.path)


@contextmanager
def scratch_of() -> Iterator[None]:
    """Deletes on leaving what the operators called within have written to the shared folder; use their results before."""
    before = len(_open)
    try:
        yield
    finally:
        for s in _open[before:]:
            s.close()
        del _open[before:]


def drop_scratch() -> None:
    """Delete the intermediate tables of all operators that ran so far; DataFrames that read them are then dead."""
    while _open:
        try:
            _open.pop().close()
        except Exception:  # the JVM may be gone
            pass


atexit.register(drop_scratch)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, for sessions that were started without it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    handle, at = tempfile.mkstemp(prefix="gridloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    atexit.register(lambda: os.path.exists(at) and os.remove(at))
    _shipped.add(app)

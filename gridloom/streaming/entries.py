"""Delivered lines and entries as streams.

Lines are parsed as they arrive, by the same operator as in a batch, which keeps
no state. Degrees of arriving entries are counted by event-time window; a
repeated delivery of an entry counts once within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bad_rows import parse_entries


def parse_stream(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``parse_entries`` of a stream of lines against the table ``files``: valid entries and rejects in one stream, told apart by reason."""
    return parse_entries(lines, files)


def windowed_degrees(entries: DataFrame, time: str = "loaded_at", late: str = "41 days", window: str = "1 day") -> DataFrame:
    """(file_id, i, window_start, degree) of a stream of entries (entry_id, file_id, i, time).

    An entry delivered again within ``late`` of its first time counts once. One that comes later than that counts again, if
    its time is that of the delivery: it is newer, so it passes the watermark, and the first is forgotten. ``late`` must
    therefore exceed the longest lag of a redelivery (just under 40 days in the test data). An entry whose time is behind
    the watermark is dropped. Entries with a null row or time have no degree.
    """
    once = entries.where(F.col("i").isNotNull() & F.col(time).isNotNull()).select("entry_id", "file_id", "i", F.col(time).cast("timestamp").alias("t"))
    once = once.withWatermark("t", late).dropDuplicatesWithinWatermark(["entry_id"])
    counts = once.groupBy("file_id", "i", F.window("t", window)).agg(F.count("*").alias("degree"))
    return counts.select("file_id", "i", F.col("window.start").alias("window_start"), "degree")

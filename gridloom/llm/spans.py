"""Spans of at least a given length that stand word for word in several records.

Seed and extend. Each text is winnowed: of every window of consecutive k-grams
the one with the least hash becomes an anchor, so a span of min_span characters
holds the same anchor wherever it stands. Records are joined on anchors, and around
each anchor that several records hold the match is extended both ways in two steps:
first from the anchor to the cores that neighbouring windows of min_span characters
have in common, then, where a core is shared, to the whole windows. Each step is a
join on what the text then is, so it costs the same per record however many records
hold the anchor. The widest stretch that the shared windows around an anchor cover
is kept, and those of all anchors are merged. An anchor need only be extended within
reach, because a longer match has further anchors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import Scratch

#: An odd multiplier and its inverse modulo 2**64: the base of the rolling hash.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Positions of a piece fit 20 bits; a longer text is winnowed in pieces.
_PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Hashes of all k-grams of an array of code points, modulo 2**64, from one prefix sum."""

    def __init__(self, most: int):
        self.up, self.down = _powers(_BASE, most + 1), _powers(_INVERSE, most + 1)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Prefix sums along the last axis, with a leading 0."""
        terms = _mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * self.down[: codes.shape[-1]]
        return np.concatenate([np.zeros((*codes.shape[:-1], 1), np.uint64), np.cumsum(terms, axis=-1, dtype=np.uint64)], axis=-1)

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        n = sums.shape[-1] - k
        return _mix((sums[..., k:] - sums[..., :n]) * self.up[:n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray, k: int, min_span: int, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie one after the other in ``codes``, of at most _PIECE."""
    keep = lens >= min_span
    starts, lens = starts[keep], lens[keep]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = roller.grams(roller.sums(codes), k)
    low = np.uint64(_PIECE - 1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    window, done = min_span - k + 1, 1
    while done < window:
        step = min(done, window - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    inside = np.zeros(len(least) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lens - min_span + 1, -1)
    at = (low - (least[np.cumsum(inside[:-1]) > 0] & low)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, grams[at]


def _anchors(documents: DataFrame, k: int, min_span: int, most: int = _PIECE) -> DataFrame:
    """(hash, doc_id, pos) of the anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(_PIECE)

        def out(held: list[tuple[int, int, str]]) -> pa.RecordBatch:
            lens = np.array([len(t) for _, _, t in held])
            starts = np.r_[0, np.cumsum(lens)[:-1]]
            at, grams = winnow(_codes("".join(t for _, _, t in held)), starts, lens, k, min_span, roller)
            which = np.searchsorted(starts, at, "right") - 1
            ids, first = np.array([d for d, _, _ in held], np.int64), np.array([o for _, o, _ in held], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(ids[which]), pa.array((first[which] + at - starts[which]).astype(np.int32))], ["hash", "doc_id", "pos"])

        held, chars = [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                step = most - min_span + 1
                for at in range(0, max(1, len(text) - min_span + 1), step):
                    piece = text[at : at + most]
                    if chars + len(piece) > most:
                        yield out(held)
                        held, chars = [], 0
                    held.append((doc, at, piece))
                    chars += len(piece)
        if held:
            yield out(held)

    long = documents.where((F.length("text") >= min_span) & F.col("doc_id").isNotNull())
    return long.mapInArrow(run, "hash bigint, doc_id bigint, pos int")


def _contexts(documents: DataFrame, met: DataFrame, k: int, reach: int) -> DataFrame:
    """(hash, doc_id, pos, left, ctx): the text around each anchor of ``met``, of which ``left`` characters precede it."""
    at = met.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "hash")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["hash", "doc_id", "pos", "left", "ctx"])

        rows: list[tuple] = []
        for b in batches:
            for doc, text, ats in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["at"].to_pylist(), strict=True):
                for x in ats:
                    p = x["pos"]
                    left = min(reach, p)
                    rows.append((x["hash"], doc, p, left, text[p - left : p + k + reach]))
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return documents.join(at, "doc_id").select("doc_id", "text", "at").mapInArrow(run, "hash bigint, doc_id bigint, pos int, left int, ctx string")


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, x) for each x from first to last of each row."""
    n = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]


def _steps(classes: DataFrame, k: int, min_span: int, width: int, whole: bool) -> DataFrame:
    """(hash, ck, lo, hi, at, w) of the stretches around the anchor of each class that a step of the extension compares.

    A window that starts s characters before the anchor belongs to the run at = s div width. In the first step w is the
    hash of the core of a run, for each run of which the class holds a window; in the second (``whole``) that of a window,
    and at is s, for the windows of the runs in ``runs``.
    """
    reach = min_span - k

    def out(t: pa.RecordBatch, roller: Roller) -> pa.RecordBatch:
        ctx, left = t["ctx"].to_pylist(), t["left"].to_numpy().astype(np.int64)
        lens = np.array([len(c) for c in ctx])
        sums, anchor = roller.sums(_codes("".join(ctx))), np.cumsum(lens) - lens + left
        first, last = np.maximum(0, reach - (lens - left - k)), np.minimum(left, reach)  # the s of the windows it holds
        if whole:
            runs = t["runs"].flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(ctx)), t["runs"].value_lengths().to_numpy())
            row, at = _ranges(np.maximum(first[of], runs * width), np.minimum(last[of], runs * width + width - 1))
            row, before, after = of[row], at, reach - at
        else:
            row, at = _ranges(first // width, last // width)
            before, after = at * width, np.maximum(reach - at * width - width + 1, 0)
        a = anchor[row] - before
        w = _mix((sums[anchor[row] + k + after] - sums[a]) * roller.up[a]).view(np.int64)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([*(t[c].take(take) for c in ("hash", "ck", "lo", "hi")), pa.array(at.astype(np.int32)), pa.array(w)], ["hash", "ck", "lo", "hi", "at", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _PIECE // (2 * min_span))
        roller = Roller(max(_PIECE, 2 * min_span))
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield out(b.slice(at, rows), roller)

    columns = ["hash", "ck", "left", "ctx", "lo", "hi", *(["runs"] if whole else [])]
    return classes.where(F.length("ctx") >= min_span).select(*columns).mapInArrow(run, "hash bigint, ck bigint, lo bigint, hi bigint, at int, w bigint")


def _several(each: DataFrame) -> DataFrame:
    """The rows of ``_steps`` whose stretch stands in more than one document."""
    keys = ["hash", "at", "w"]
    shared = each.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select(*keys)
    return each.select("hash", "ck", "at", "w").join(shared, keys, "left_semi")


def _extend(classes: DataFrame, k: int, min_span: int) -> DataFrame:
    """(hash, ck, start, end) of each class that shares a window with another one: the stretch of its shared windows, from the anchor."""
    width = max(1, math.isqrt(min_span - k + 1))
    runs = _several(_steps(classes, k, min_span, width, False)).groupBy("hash", "ck").agg(F.collect_set("at").alias("runs"))  # some dozen runs at most
    windows = _several(_steps(classes.join(runs, ["hash", "ck"]), k, min_span, width, True))
    return windows.groupBy("hash", "ck").agg((-F.max("at")).alias("start"), (F.lit(min_span) - F.min("at")).alias("end"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): the runs of positions that (doc_id, start, end) cover."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end")).select("doc_id", "span_start", "span_end")


def shared_spans(documents: DataFrame, min_span: int = 200, k: int = 64) -> DataFrame:
    """(doc_id, span_start, span_end) of each maximal run of positions of a text that lie in a substring of at least
    ``min_span`` code points that stands in the text of another doc_id as well.

    Takes (doc_id, text) with unique doc_ids; positions count code points from 0, span_end is one past the last. Texts
    are compared as stored; a repeat within one document does not count. Null doc_ids, null texts and texts shorter than
    min_span have no spans; an empty table gives no rows. Other columns are ignored. Repeated rows of one doc_id are one
    document.

    ``k`` is the length of the grams, at most min_span. Around an anchor that several documents hold, equal surroundings
    are first counted as one class, so copies cost one comparison; a class has one stretch, which each of its anchors
    gets. Classes, cores and windows are told apart by two 64-bit hashes, one of the anchor and one of the rest.
    """
    if not 0 < k <= min_span:
        raise ValueError("k must lie between 1 and min_span")
    scratch = Scratch(documents.sparkSession, "spans")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    anchors = scratch.write(_anchors(docs, k, min_span))
    several = anchors.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("hash")
    met = anchors.join(several, "hash", "left_semi")
    found = scratch.write(_contexts(docs, met, k, min_span - k).withColumn("ck", F.xxhash64("ctx", "left")))
    scratch.drop(anchors)
    classes = found.groupBy("hash", "ck").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("ctx").alias("ctx"), F.min("left").alias("left"))
    classes = scratch.write(classes)
    others = classes.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    apart = scratch.write(classes.join(others, "hash", "left_semi"))
    whole = classes.where((F.col("lo") != F.col("hi")) & (F.length("ctx") >= min_span)).select("hash", "ck", (-F.col("left")).alias("start"), (F.length("ctx") - F.col("left")).alias("end"))
    stretches = _extend(apart, k, min_span).union(whole).groupBy("hash", "ck").agg(F.min("start").alias("start"), F.max("end").alias("end"))  # all hold the anchor
    spans = found.select("hash", "ck", "doc_id", "pos").join(stretches, ["hash", "ck"])
    return merge_spans(spans.select("doc_id", (F.col("pos") + F.col("start")).cast("bigint").alias("start"), (F.col("pos") + F.col("end")).cast("bigint").alias("end")))


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, shared_share) of every non-null doc_id; null texts have 0 of each."""
    docs = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
    own = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    out = docs.join(own, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))

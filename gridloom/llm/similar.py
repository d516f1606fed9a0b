"""All pairs of records whose sets overlap at or above a Jaccard threshold.

Metric pivot partitioning. With distance d = 1 - Jaccard and the bound e = 1 -
threshold, pivots are elected among the records, and each record is assigned to
the nearest pivot it meets within the radius R = 2/3 of the threshold, whose cell it
shares with others. A record y is replicated to the cell of pivot p, of actual radius
r(p) <= R, if d(y, p) <= r(p) + e: by the triangle inequality no other record can be
within e of one in the cell. As R + e < 1, such a y shares values with p, and the
cells to try are found through some of the pivot's rarer values. Pairs within a cell
are compared exactly, unless their distances to the pivot differ by more than e.

Sets of sparse values are mostly at distance 1 from each other, where the inequality
excludes nothing. So only live records take part: those that share a signature, two
of their rarer values, with another, as any two records within e of each other do.
Pivots are elected among the records of a signature, and a record that no other could
be paired with but those that have a cell needs none of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.runtime import Scratch

#: Bounds on distances, which are doubles, are widened by this; pairs themselves are tested in integers.
_NEAR = 1e-9
#: Values are ordered by the count of their hash bucket, rarer ones first: a table of this size, whatever the data.
_BUCKETS = 1 << 16
#: So many keys of 8 bytes may be broadcast; more are joined by a shuffle.
_FEW_KEYS = 1_000_000
#: Records of more values have single values as signatures, whose number does not grow with the square of the size.
_PAIRED = 64


def record_sets(rows: DataFrame, id: str = "i", values: str = "cols") -> DataFrame:
    """(rec, vals) of each non-null id that has a non-null value: the sorted distinct values of all its rows."""
    tidy = lambda a: F.array_sort(F.array_distinct(a))
    own = rows.select(F.col(id).cast("bigint").alias("rec"), tidy(F.filter(F.col(values).cast("array<bigint>"), lambda v: v.isNotNull())).alias("vals"))
    own = own.where("rec is not null and size(vals) > 0")
    return own.groupBy("rec").agg(tidy(F.flatten(F.collect_set("vals"))).alias("vals"))


def _within(common: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """|A and B| / |A or B| >= num / den."""
    return common * den >= (a + b - common) * num


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(_BUCKETS - 1)).astype(np.int64)


def bucket_counts(reps: DataFrame) -> np.ndarray:
    """How often values of each hash bucket occur in all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_BUCKETS, np.int64)
        for b in batches:
            n += np.bincount(_bucket(_mix(b["vals"].flatten().to_numpy())), minlength=_BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    out = np.zeros(_BUCKETS, np.int64)
    for r in reps.select("vals").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most _BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def _ordered(b: pa.RecordBatch, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, size, hashes, values): of each set, its values rarest first, from place ``first`` on."""
    size = b["vals"].value_lengths().to_numpy().astype(np.int64)
    vals = b["vals"].flatten().to_numpy()
    h = _mix(vals)
    order = np.lexsort((h, counts[_bucket(h)], np.repeat(np.arange(len(size)), size)))
    return np.cumsum(size) - size, size, h[order], vals[order]


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the n places from ``first`` on of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]


def signatures(reps: DataFrame, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """(rec, sig): two sets within the threshold that differ share a signature.

    They have at least t = num / den of the values of either in common, so their first m - t + 1 values share one, and
    their first m - t + 2 values two, if they have two in common. Sets of up to _PAIRED values have each two of the latter
    as signatures, sets that have a partner above that size, or one with which they share but one value, each of the former.
    """

    def out(b: pa.RecordBatch) -> pa.RecordBatch:
        first, m, h, _ = _ordered(b, counts)
        t = -(-m * num // den)
        rows, sigs = [], []
        paired = np.flatnonzero(m <= _PAIRED)
        head = np.minimum(m, m - t + 2)
        for n in np.unique(head[paired]):
            own = paired[head[paired] == n]
            x, y = np.triu_indices(n, 1)
            a, c = h[(first[own][:, None] + x).ravel()], h[(first[own][:, None] + y).ravel()]
            rows.append(np.repeat(own, len(x)))
            sigs.append(_mix(a * np.uint64(0x9E3779B97F4A7C15) + c))
        single = np.flatnonzero((m * den > _PAIRED * num) | (t <= 1))
        row, at = _spread(first[single], (m - t + 1)[single])
        rows.append(single[row])
        sigs.append(h[at])
        return pa.RecordBatch.from_arrays([b["rec"].take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sigs).view(np.int64))], ["rec", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield out(b)

    return reps.select("rec", "vals").mapInArrow(run, "rec bigint, sig bigint")


def rarest_first(reps: DataFrame, counts: np.ndarray) -> DataFrame:
    """(rec, m, vals): each set with its size, its values rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, m, _, vals = _ordered(b, counts)
            ends = pa.array(np.r_[first, len(vals)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["rec"], pa.array(m.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(vals))], ["rec", "m", "vals"])

    return reps.select("rec", "vals").mapInArrow(run, "rec bigint, m int, vals array<bigint>")


def live_records(reps: DataFrame, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(live, heads): the records that share a signature with another (``rarest_first``), and (rec, h, sig) of those signatures."""
    counts = bucket_counts(reps)
    each = scratch.write(signatures(reps, counts, num, den))
    groups = each.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    heads = scratch.write(each.join(groups, "sig", "left_semi").select("rec", F.xxhash64("rec").alias("h"), "sig"))
    scratch.drop(each)
    return scratch.write(rarest_first(reps.join(heads.select("rec"), "rec", "left_semi"), counts)), heads


def _side(live: DataFrame, s: str) -> DataFrame:
    return live.select(F.col("rec").alias(s), F.col("m").alias(f"m_{s}"), F.col("vals").alias(f"v_{s}"))


def _compared(pairs: DataFrame, live: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with common, m_a and m_b."""
    full = pairs.join(_side(live, a), a).join(_side(live, b), b)
    return full.select(*pairs.columns, F.size(F.array_intersect(f"v_{a}", f"v_{b}")).cast("bigint").alias("common"), f"m_{a}", f"m_{b}")


def _jaccard(a: str, b: str) -> Column:
    return F.col("common") / (F.col(f"m_{a}") + F.col(f"m_{b}") - F.col("common"))


def elect_homes(live: DataFrame, heads: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(rec, pivot, j): the nearest pivot within the radius that each assigned record met, and their similarity.

    In each round the records without a home that share a signature elect the one of least hash, from the second round on
    16 times as many each time; the others go to the nearest elected one they share a signature with, if it is within the
    radius. It ends when no two records without a home share a signature: of any two records within e of each other,
    which must share one, at least one then has a home.
    """
    homes, r = [], 0
    while True:
        groups = heads.groupBy("sig").agg(F.count("*").alias("n"), F.min(F.struct("h", "rec")).alias("s")).where("n > 1")
        place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
        chosen = (F.col("rec") == F.col("s.rec")) | (place * F.col("n") < F.lit(float(16**r if r else 0)))
        met, count = scratch.write_counted(heads.join(groups, "sig").select("sig", "rec", "h", chosen.alias("chosen")))
        if not count:
            break
        pivots = met.where("chosen").select(F.col("rec").alias("pivot")).distinct()
        links = met.where("not chosen").select("sig", F.col("rec").alias("x")).join(met.where("chosen").select("sig", F.col("rec").alias("pivot")), "sig")
        links = links.select("x", "pivot").distinct().join(pivots.select(F.col("pivot").alias("x")), "x", "left_anti")
        near = _compared(links, live, "x", "pivot")
        near = near.where(_within(F.col("common"), F.col("m_x"), F.col("m_pivot"), 3 * den - 2 * num, 3 * den))
        best = near.groupBy("x").agg(F.max(F.struct(_jaccard("x", "pivot").alias("j"), (-F.col("pivot")).alias("p"))).alias("s"))
        found = best.select(F.col("x").alias("rec"), (-F.col("s.p")).alias("pivot"), F.col("s.j").alias("j"))
        homes.append(scratch.write(found.union(pivots.select("pivot", "pivot", F.lit(1.0)))))
        heads, left = scratch.write_counted(met.join(homes[-1].select("rec"), "rec", "left_anti").select("rec", "h", "sig"))
        scratch.drop(met)
        if not left:
            break
        r += 1
    if not homes:
        return heads.select("rec", F.col("rec").alias("pivot"), F.lit(1.0).alias("j"))  # without rows
    return reduce(DataFrame.union, homes)


def replicate(live: DataFrame, homes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(pivot, y, j): the live records that the cell of each pivot must hold, by the triangle inequality."""
    e = (den - num) / den
    reach = homes.groupBy("pivot").agg((F.min("j") - (e + _NEAR)).alias("t"))
    own = reach.join(live.withColumnRenamed("rec", "pivot"), "pivot")
    # the values of the pivot that a record in reach cannot all lack
    need = F.greatest(F.ceil(F.col("t") * F.col("m")), F.lit(1))
    probes = own.select("pivot", "t", F.col("m").alias("mp"), F.explode(F.slice("vals", F.lit(1), F.greatest(F.size("vals") - need + 1, F.lit(0)).cast("int"))).alias("val"))
    each = live.select(F.col("rec").alias("y"), F.col("m").alias("my"), F.explode("vals").alias("val"))
    met = probes.join(each, "val").where(F.least("mp", "my") >= F.col("t") * F.greatest("mp", "my")).select("pivot", "y", "t").distinct()
    near = _compared(met, live, "y", "pivot").withColumn("j", _jaccard("y", "pivot")).where(F.col("j") >= F.col("t"))
    return scratch.write(near.select("pivot", "y", "j"))


def similar_classes(sets: DataFrame, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) for ``record_sets`` at the threshold num / den, 0 < num <= den.

    members: (rec, rep, copies) of each record; records with equal sets form a class of so many copies, whose smallest
    record stands for it.
    pairs: (rep_a, rep_b, common, size_a, size_b) of each two classes at or above the threshold, once, in either order.
    Without rows both are empty.
    """
    scratch = Scratch(sets.sparkSession, "similar")
    sets = scratch.write(sets.select("rec", "vals", F.xxhash64("vals").alias("key")))
    classes = sets.groupBy("key", "vals").agg(F.min("rec").alias("rep"), F.count("*").alias("copies"))
    classes, seen = scratch.write_observed(classes, {"several": F.count(F.when(F.col("copies") > 1, 1))})
    several = classes.where("copies > 1")
    keys = several.select("key")
    keys = F.broadcast(keys) if seen["several"] <= _FEW_KEYS else keys
    copied = sets.join(keys, "key", "left_semi").join(several, ["key", "vals"]).select("rec", "rep", "copies")
    members = classes.where("copies = 1").select(F.col("rep").alias("rec"), "rep", "copies").union(copied)
    live, heads = live_records(classes.select(F.col("rep").alias("rec"), "vals"), num, den, scratch)
    homes = elect_homes(live, heads, num, den, scratch)
    cells = replicate(live, homes, num, den, scratch)
    housed = homes.select(F.col("rec").alias("y"), F.lit(True).alias("housed"))
    cells = cells.join(housed, "y", "left").select("pivot", F.col("y").alias("b"), F.col("j").alias("jb"), F.coalesce("housed", F.lit(False)).alias("housed"))
    inside = homes.select("pivot", F.col("rec").alias("a"), F.col("j").alias("ja")).join(cells, "pivot")
    once = (F.col("a") != F.col("b")) & (~F.col("housed") | (F.col("a") < F.col("b")))  # the other one's cell has the pair too
    inside = inside.where(once & (F.abs(F.col("ja") - F.col("jb")) <= (den - num) / den + _NEAR)).select("a", "b")
    pairs = _compared(inside, live, "a", "b").where(_within(F.col("common"), F.col("m_a"), F.col("m_b"), num, den))
    pairs = pairs.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "common", F.col("m_a").alias("size_a"), F.col("m_b").alias("size_b"))
    return scratch.write(pairs), scratch.write(members)


def similar_pairs(rows: DataFrame, num: int = 3, den: int = 4, id: str = "i", values: str = "cols") -> DataFrame:
    """(row_a, row_b, common, jaccard), row_a < row_b, of all pairs of records at or above the threshold num / den.

    A record's set is that of the distinct non-null ``values`` in all its rows; null ids and empty sets have no pairs,
    rows delivered again change nothing. The test is exact, in integers. Other columns are ignored. Equal sets are
    compared once for all their records, and their pairs are then listed, as the result asks for each.
    """
    pairs, members = similar_classes(record_sets(rows, id, values), num, den)
    m = lambda s: members.select(F.col("rec").alias(f"row_{s}"), F.col("rep").alias(f"rep_{s}"))
    across = pairs.join(m("a"), "rep_a").join(m("b"), "rep_b")
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    across = across.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b"), (F.col("common") / union).alias("jaccard"))
    copied = members.where("copies > 1").select(F.col("rec").alias("row_a"), "rep")
    equal = copied.join(copied.withColumnRenamed("row_a", "row_b"), "rep").where("row_a < row_b")
    return across.union(equal.select("row_a", "row_b", F.lit(1.0)))


def similar_summary(rows: DataFrame, num: int = 3, den: int = 4, id: str = "i", values: str = "cols") -> DataFrame:
    """(rec, class_id, n_links) of each record with a set: its class of equal sets and its number of similar records.

    No pair within a class is made, so groups of copies cost no more than other records.
    """
    pairs, members = similar_classes(record_sets(rows, id, values), num, den)
    copies = members.where("rec = rep").select("rep", "copies")
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).union(pairs.select("rep_b", "rep_a"))
    links = both.join(copies.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("copies").alias("links"))
    whole = copies.join(links, "rep", "left").select("rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return members.join(whole, "rep").select("rec", F.col("rep").alias("class_id"), "n_links")

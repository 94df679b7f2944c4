"""Interval operators on DataFrames: union, point and overlap joins, containment, coverage.

Joins go over buckets: an interval is listed in each bucket of `width` positions that it touches, so that Spark
hashes on (key, bucket) and a long chromosome is spread over many tasks. A pair of overlapping intervals meets in
every bucket that they share and is kept in the first of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_union(df: DataFrame, key: str, start: str, end: str, aggs: dict[str, Column], merge: dict[str, Column], gap: int = 1, width: int = 1 << 12) -> DataFrame:
    """Maximal runs of intervals (inclusive ends) that follow each other within `gap`: key, start, end, and aggregates.

    Rows go to the task of their (key, bucket of the start). There equal intervals become one row, with `aggs` over
    their rows, before any are put in order: however many reads lie at one place, a task sorts its places. Runs are
    built within the bucket, and these partial runs, far fewer, are then united along the key; `merge` unites
    aggregates. So no task sees all rows of a key.
    """
    dealt = df.withColumn("_b", F.floor(F.col(start) / width)).repartition(key, "_b")
    same = dealt.groupBy(key, "_b", start, end).agg(*(a.alias(n) for n, a in aggs.items()))
    part = _runs(same, [key, "_b"], start, end, gap)
    part = part.groupBy(key, "_b", "_run").agg(F.min(start).alias("_s"), F.max(end).alias("_e"), *(m.alias(n) for n, m in merge.items()))
    whole = _runs(part.drop("_run"), [key], "_s", "_e", gap)
    return whole.groupBy(key, "_run").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), *(m.alias(n) for n, m in merge.items())).drop("_run")


def _runs(df: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Adds the number of the run that a row is in: a new one begins where the start is beyond all ends before."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _before(df: DataFrame, key: str, total: Column, bucket: str = "_b") -> DataFrame:
    """(_key, _bucket, _before): sum of `total` over the buckets of a key before each, from one row a bucket."""
    w = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, bucket).agg(total.alias("_n"))
    return sums.select(F.col(key).alias("_key"), F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def ranked(df: DataFrame, key: str, pos: str, order: list, name: str, width: int = 1 << 16) -> DataFrame:
    """Rank of each row along its key (null: a key too), from 1, by `order`, which begins with pos. Rows are put in order within buckets of positions only; how many lie in the buckets before is added."""
    d = df.withColumn("_b", F.floor(F.col(pos) / width))
    place = d.withColumn(name, F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)))
    both = place.join(_before(d, key, F.count("*")), F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_bucket")))
    return both.withColumn(name, F.col(name) + F.col("_before")).drop("_b", "_key", "_bucket", "_before")


def number(df: DataFrame, key: str, start: str, name: str) -> DataFrame:
    """Rank of an interval along its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(start)).cast("long"))


def in_buckets(df: DataFrame, start: str, end: str, width: int, name: str = "_bucket") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))


def dealt(df: DataFrame, key: str, start: str, end: str, tasks: int, width: int = 1024) -> DataFrame:
    """Intervals (inclusive ends), listed in each `bucket` of places that they touch, dealt to `tasks` by (key, bucket)."""
    return in_buckets(df.where(F.col(start) <= F.col(end)), start, end, width, "bucket").repartition(tasks, key, "bucket")


def places(df: DataFrame, key: str, start: str, end: str, tasks: int, width: int = 1024) -> DataFrame:
    """A row for each `place` that an interval (inclusive ends) covers, with its `bucket` of places.

    Intervals are dealt to `tasks` by (key, bucket) before they unfold, cut at the borders of buckets. So their letters
    are made where they are counted: what groups by key, bucket and place (and more) afterwards moves no rows.
    """
    first = F.col("bucket") * width
    return dealt(df, key, start, end, tasks, width).select("*", F.explode(F.sequence(F.greatest(F.col(start), first), F.least(F.col(end), first + width - 1))).alias("place"))


def point_join(points: DataFrame, pos: str, intervals: DataFrame, start: str, end: str, key: str, width: int = 4096, how: str = "inner") -> DataFrame:
    """Points with the intervals (inclusive ends) that hold them. Column names other than the key must differ. how: inner or left."""
    listed = in_buckets(intervals, start, end, width).withColumnRenamed(key, "_key")
    on = (F.col(key) == F.col("_key")) & (F.floor(F.col(pos) / width) == F.col("_bucket")) & F.col(pos).between(F.col(start), F.col(end))
    return points.join(listed, on, how).drop("_key", "_bucket")


def overlap_join(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, width: int = 4096) -> DataFrame:
    """Pairs of intervals (inclusive ends) that overlap, each once."""
    a, b = in_buckets(left, l_start, l_end, width, "_l"), in_buckets(right, r_start, r_end, width, "_r").withColumnRenamed(key, "_key")
    c = F.col
    on = (c(key) == c("_key")) & (c("_l") == c("_r")) & (c(l_start) <= c(r_end)) & (c(r_start) <= c(l_end)) & (c("_l") == F.floor(F.greatest(c(l_start), c(r_start)) / width))
    return a.join(b, on).drop("_key", "_l", "_r")


def overlap_semi(left: DataFrame, right: DataFrame, key: str, l_start: str, l_end: str, r_start: str, r_end: str, width: int = 4096) -> DataFrame:
    """Rows of the left that overlap some row of the right; needs columns `_id` that tell left rows apart."""
    hits = overlap_join(left.select("_id", key, l_start, l_end), right, key, l_start, l_end, r_start, r_end, width).select("_id").distinct()
    return left.join(hits, "_id", "left_semi")


def following(points: DataFrame, pos: str, intervals: DataFrame, start: str, end: str, key: str, width: int = 1 << 16) -> DataFrame:
    """Points with the interval of their key that holds them or else comes next (none past the last); intervals are disjoint.

    An interval answers for the positions after its predecessor's end, so this is a point join over these ranges.
    """
    w = Window.partitionBy(key).orderBy(start)
    reach = intervals.withColumn("_from", F.coalesce(F.lag(end).over(w) + 1, F.lit(0)))
    return point_join(points, pos, reach, "_from", end, key, width, "left").drop("_from")


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))


def coverage_changes(df: DataFrame, key: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """Depth as a step function: (key, pos, depth) where it changes. Events are summed by position, put in order within buckets of positions, and what the buckets before come to is added."""
    events = df.select(key, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    summed = events.groupBy(key, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    b = summed.withColumn("_b", F.floor(F.col("pos") / width))
    own = b.withColumn("_own", F.sum("d").over(Window.partitionBy(key, "_b").orderBy("pos")))
    return own.join(_before(b, key, F.sum("d")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_b") == F.col("_bucket"))).select(key, "pos", (F.col("_own") + F.col("_before")).alias("depth"))


def ucsc_bin(beg: Column, end: Column) -> Column:
    """Smallest bin of the six-level scheme that holds [beg, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.lit(first) + F.shiftright(beg, shift)).otherwise(out)
    return out

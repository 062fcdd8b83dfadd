"""Ordered-log operators: replay, ranges, as-of lookup, segment statistics, retention and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.sources.scratch import written

#: Ranges of a block of nearest_at_or_before().
BLOCK = 1024


def replay(log: DataFrame, order: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows with ``first`` <= order <= ``last``, in order; both ends are inclusive and optional."""
    if first is not None:
        log = log.filter(F.col(order) >= first)
    if last is not None:
        log = log.filter(F.col(order) <= last)
    return log.orderBy(order)


def after(log: DataFrame, version: str, v: int) -> DataFrame:
    """The rows strictly after version ``v``."""
    return log.filter(F.col(version) > v)


def keep_newest(log: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows with the highest ``order`` of each key; none for ``n`` <= 0.

    Spark plans a group limit before the shuffle, so each task forwards at most ``n`` rows a key.
    """
    if n <= 0:
        return log.limit(0)
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return log.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def keep_unexpired(log: DataFrame, keys: Sequence[str], order: str, n: int, expires: Column, now: Column) -> DataFrame:
    """As keep_newest, of the rows that have not expired at ``now``; a null expiry never comes."""
    return keep_newest(log.filter(expires.isNull() | (expires > now)), keys, order, n)


def last_record(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``: one aggregate with map-side combine, no sort."""
    rest = [c for c in log.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(key).agg(newest).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def compact_latest(log: DataFrame, key: str, operation: str, *order: str) -> DataFrame:
    """Segment compaction: the last record of each key, without keys whose last record deletes them."""
    return last_record(log, key, *order).filter(F.col(operation) != "DELETE")


def rewritten_as_creates(log: DataFrame, key: str, operation: str, *order: str) -> DataFrame:
    """Registry compaction: what compact_latest keeps, each as the CREATE of its entity (earlier metadata is lost)."""
    return compact_latest(log, key, operation, *order).withColumn(operation, F.lit("CREATE"))


def segment_statistics(log: DataFrame, segment: str, lsn: str, operation: str, ts: str) -> DataFrame:
    """First and last LSN, entries, tombstones and creation time of each segment."""
    return log.groupBy(segment).agg(
        F.min(lsn).alias("start_lsn"),
        F.max(lsn).alias("end_lsn"),
        F.count("*").alias("entry_count"),
        F.count_if(F.col(operation) == "DELETE").alias("tombstone_count"),
        F.min(ts).alias("created_at"),
    )


def log_metrics(segments: DataFrame, now: Column) -> DataFrame:
    """Totals over segments: count, entries, tombstones, tombstone ratio, age of the oldest."""
    return segments.agg(
        F.count("*").alias("segments"),
        F.coalesce(F.sum("entry_count"), F.lit(0)).alias("entries"),
        F.coalesce(F.sum("tombstone_count"), F.lit(0)).alias("tombstones"),
        F.coalesce(F.try_divide(F.sum("tombstone_count"), F.sum("entry_count")), F.lit(0.0)).alias("tombstone_ratio"),
        F.max(now - F.col("created_at")).alias("oldest_age"),
    )


def nearest_at_or_before(points: DataFrame, targets: DataFrame, point: str, target: str, width: int) -> DataFrame:
    """``targets`` with nearest_<point>: the greatest ``point`` <= ``target``, null if there is none; both are integers.

    The axis is cut in ranges of ``width``. A target looks in its own range, and if nothing there is early enough it
    takes the last point of an earlier range; only one row a range crosses the ranges. Ranges are tasks of their own.
    """
    of = lambda c: F.floor(F.col(c) / width)
    row = targets.select(F.struct(*targets.columns).alias("r")).schema["r"].dataType
    spots = points.select(of(point).alias("_range"), F.col(point).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_row"))
    marks = targets.select(of(target).alias("_range"), F.col(target).alias("_at"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_row"))
    ends = spots.groupBy("_range").agg(F.max("_at").alias("_end"))
    ranges = ends.select("_range", "_end").unionByName(marks.select("_range", F.lit(None).cast("long").alias("_end")).distinct())
    ranges = ranges.groupBy("_range").agg(F.max("_end").alias("_end"))
    # The last point before each range: within its block of ranges, else at the end of an earlier block.
    ranges = ranges.withColumn("_block", F.floor(F.col("_range") / BLOCK))
    blocks = ranges.groupBy("_block").agg(F.max("_end").alias("_last"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.max("_last").over(earlier).alias("_carried"))
    before = Window.partitionBy("_block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.join(blocks, "_block").select("_range", F.coalesce(F.max("_end").over(before), "_carried").alias("_before"))
    inside = Window.partitionBy("_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = spots.unionByName(marks).withColumn("_own", F.max(F.when(F.col("_side") == 0, F.col("_at"))).over(inside))
    found = found.filter("_side = 1").join(ranges, "_range", "left")
    return found.select("_row.*", F.coalesce("_own", "_before").alias(f"nearest_{point}"))


def overlap_groups(segments: DataFrame, start: str, end: str, keys: Sequence[str] = ()) -> DataFrame:
    """``segments`` with ``overlap_group``: intervals that overlap, also through others, share one (from 1, by start).

    Without keys, intervals are dealt to ranges of their starts; a range knows from the one before it how far earlier
    intervals reach and how many groups they have, so no task orders all of them.
    """
    if keys:
        before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
        upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
        opens = F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1)
        return segments.withColumn("_opens", opens).withColumn("overlap_group", F.sum("_opens").over(upto)).drop("_opens")
    n = max(8, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(segments.repartitionByRange(n, start, end).withColumn("_p", F.spark_partition_id()), "overlaps")
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    reach = dealt.groupBy("_p").agg(F.max(end).alias("_e")).select("_p", F.max("_e").over(earlier).alias("_reach"))
    before = Window.partitionBy("_p").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    known = F.greatest(F.max(end).over(before), F.col("_reach"))
    opened = dealt.join(F.broadcast(reach), "_p").withColumn("_opens", F.when(F.col(start) <= known, 0).otherwise(1))
    counts = opened.groupBy("_p").agg(F.sum("_opens").alias("_o")).select("_p", F.coalesce(F.sum("_o").over(earlier), F.lit(0)).alias("_base"))
    upto = Window.partitionBy("_p").orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    found = opened.join(F.broadcast(counts), "_p").withColumn("overlap_group", F.col("_base") + F.sum("_opens").over(upto))
    return found.select(*segments.columns, "overlap_group")

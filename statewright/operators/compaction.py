"""Compaction planners over segment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.operators.logs import overlap_groups
from statewright.operators.ordered import folded

MIB = 1 << 20


def tier_of(size: Column, bounds: Sequence[int] = (MIB, 10 * MIB, 100 * MIB)) -> Column:
    """The first tier whose bound is not exceeded; the last tier has no bound."""
    out = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        out = F.when(size <= bounds[k], k).otherwise(out)
    return out


def size_tiered(segments: DataFrame, size: str, least: int = 4) -> DataFrame:
    """The segments of the fullest tier, if it has ``least`` at least; of equally full tiers the lowest."""
    tiered = segments.withColumn("tier", tier_of(F.col(size)))
    counts = tiered.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    best = counts.agg(F.max_by("tier", F.struct("n", -F.col("tier"))).alias("tier"))
    return tiered.join(F.broadcast(best), "tier").select(*segments.columns, "tier")


def leveled(segments: DataFrame, size: str, base: int = 10 * MIB) -> DataFrame:
    """``segments`` with ``level``: 0 up to ``base`` bytes, then one more for each factor of ten."""
    level = F.greatest(F.lit(0), F.ceil(F.round(F.log10(F.col(size) / base), 9))).cast("int")
    return segments.withColumn("level", F.when(F.col(size) <= base, 0).otherwise(level))


def leveled_plan(segments: DataFrame, size: str, name: str, start: str, end: str, least: int = 4, base: int = 10 * MIB) -> DataFrame:
    """``segments`` to merge, with level and overlap_group: level 0 if it has ``least`` segments, else the largest group of overlapping
    segments of one level (two at least; of equal ones that of the lowest level, then the first)."""
    levels = leveled(segments, size, base)
    grouped = overlap_groups(levels, start, end, ["level"])
    sizes = grouped.groupBy("level", "overlap_group").agg(F.count("*").alias("_n"))
    low = sizes.filter("level = 0").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_low"))
    best = sizes.filter("level > 0 AND _n >= 2").agg(F.max_by(F.struct("level", "overlap_group"), F.struct("_n", -F.col("level"), -F.col("overlap_group"))).alias("_b"))
    plan = grouped.join(F.broadcast(low.join(best)))
    first = (F.col("_low") >= least) & (F.col("level") == 0)
    other = (F.col("_low") < least) & (F.col("level") == F.col("_b.level")) & (F.col("overlap_group") == F.col("_b.overlap_group"))
    return plan.filter(first | F.coalesce(other, F.lit(False))).drop("_low", "_b")


def best_group(groups: DataFrame, keys: Sequence[str], group: str, score: str) -> DataFrame:
    """The rows of the group whose summed ``score`` is highest, of equal ones the first."""
    sums = groups.groupBy(*keys, group).agg(F.sum(score).alias("_s"))
    best = sums.agg(F.max_by(F.struct(*keys, group), F.struct("_s", *[-F.col(k) for k in keys], -F.col(group))).alias("_b"))
    met = [F.col(f"_b.{c}").alias(c) for c in (*keys, group)]
    return groups.join(F.broadcast(best.select(*met)), [*keys, group], "left_semi")


def time_plan(segments: DataFrame, keys: Sequence[str], order: str, name: str, size: str, age: Column, half: int, checkpoint: int, budget: int, day: int) -> DataFrame:
    """``segments`` (with end_lsn, entry_count, tombstone_count) to compact, with benefit and priority: of those that are older than ``half``
    the highest age, end below the ``checkpoint``, or have over 30 % tombstones, the consecutive ones under ``budget`` bytes whose
    benefit is highest. priority is high above 0.7, medium above 0.4, else low, by the benefit."""
    due = (age > half) | (F.col("end_lsn") < checkpoint) | (F.col("tombstone_count") > 0.3 * F.col("entry_count"))
    scored = benefit(segments.filter(due), "tombstone_count", "entry_count", age, day, half)
    grouped = budget_groups(scored, keys, order, name, size, budget).select(name, "budget_group")
    best = best_group(scored.join(grouped, name), list(keys), "budget_group", "benefit")
    rank = F.when(F.col("benefit") > 0.7, "high").when(F.col("benefit") > 0.4, "medium").otherwise("low")
    return best.drop("due").withColumn("priority", rank)


def fragmented(segments: DataFrame, size: str, ideal: int, least: float = 0.3) -> DataFrame:
    """segments, fragmentation, vacuum: how far the segments' mean size lies below ``ideal`` bytes, and whether that calls for a vacuum."""
    found = segments.agg(F.count("*").alias("segments"), F.greatest(F.lit(0.0), 1 - F.avg(size) / ideal).alias("fragmentation"))
    return found.withColumn("vacuum", (F.col("segments") > 1) & (F.col("fragmentation") >= least))


def plan_errors(plan: DataFrame, segments: DataFrame, name: str) -> DataFrame:
    """name, error of each input of ``plan`` that can't be compacted: missing, still written to, or with its ends the wrong way round."""
    here = segments.select(name, "is_immutable", "start_lsn", "end_lsn").withColumn("_here", F.lit(True))
    error = F.when(F.col("_here").isNull(), "missing").when(~F.col("is_immutable"), "not immutable").when(F.col("start_lsn") > F.col("end_lsn"), "empty range")
    return plan.select(name).join(here, name, "left").select(name, error.alias("error")).filter("error IS NOT NULL")


def benefit(segments: DataFrame, tombstones: str, entries: str, age: Column, day: int, due_age: int) -> DataFrame:
    """tombstone_ratio, benefit (0.7 of the ratio and 0.3 of the age up to a day) and whether a segment is due."""
    ratio = F.coalesce(F.try_divide(F.col(tombstones), F.col(entries)), F.lit(0.0))
    scored = segments.withColumn("tombstone_ratio", ratio).withColumn("benefit", 0.7 * ratio + 0.3 * F.least(F.lit(1.0), age / float(day)))
    return scored.withColumn("due", (age > due_age) | (F.col(tombstones) > 0.3 * F.col(entries)))


def vacuum_candidates(segments: DataFrame, name: str, tombstones: str, entries: str, least: float = 0.2, n: int = 4) -> DataFrame:
    """The ``n`` segments with the highest share of dead entries (a tombstone counts itself and what it deletes)."""
    dead = F.try_divide(F.least(2 * F.col(tombstones), F.col(entries)), F.col(entries))
    return segments.select(name, dead.alias("dead_ratio")).filter(F.col("dead_ratio") >= least).orderBy(F.desc("dead_ratio"), name).limit(n)


def budget_groups(segments: DataFrame, keys: Sequence[str], order: str, name: str, size: str, budget: int) -> DataFrame:
    """``keys``, ``name``, ``size_bytes``, ``budget_group``: runs in order, a new one where the sum would pass ``budget``.

    The sum starts anew with each run, so this is an ordered fold over one key's segments (a log's file list).
    """

    def step(state, segment, n):
        total, group = state
        total, group = (n, group + 1) if total > 0 and total + n > budget else (total + n, group)
        return (total, group), [(segment, n, group)]

    kind = segments.schema[name].dataType.simpleString()
    values = [name, F.coalesce(F.col(size).cast("long"), F.lit(0))]
    return folded(segments, keys, [order], values, lambda: (0, 0), step, f"{name} {kind}, size_bytes long, budget_group long")


def estimate(segments: DataFrame, size: str, tombstones: str, entries: str, bytes_a_second: float) -> DataFrame:
    """What compacting all of them would leave and take: an estimate from counts, never a result."""
    kept = F.greatest(F.lit(0), F.sum(F.col(entries) - 2 * F.col(tombstones)))
    return segments.agg(kept.alias("entries_kept"), F.sum(size).alias("bytes_read"), (F.sum(size) / bytes_a_second).alias("seconds"))


def recommended(write_heavy: bool, read_heavy: bool, many_deletes: bool, time_ordered: bool) -> str:
    """The planner to use for a kind of workload."""
    if many_deletes:
        return "vacuum"
    if time_ordered:
        return "time-based"
    return "leveled" if read_heavy and not write_heavy else "size-tiered"

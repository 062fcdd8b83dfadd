"""Quorum decisions over a membership table (id, status, role, region, zone); each is one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alive(members: DataFrame) -> DataFrame:
    """Members that are alive."""
    return members.filter(F.col("status") == "ALIVE")


def _valid_groups(members: DataFrame, level: str, least: int) -> DataFrame:
    """One row: how many values of ``level`` have ``least`` alive members."""
    sizes = alive(members).groupBy(F.coalesce(level, F.lit("unknown")).alias("g")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count_if(F.col("n") >= least).alias(f"{level}s"))


def simple(members: DataFrame, least: int, regions: int) -> DataFrame:
    """alive, regions, has_quorum: enough members, half of all at least, and in enough regions."""
    alive = F.col("status") == "ALIVE"
    found = members.agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.countDistinct(F.when(alive, F.coalesce("region", F.lit("unknown")))).alias("regions"))
    ok = (F.col("alive") >= least) & (F.col("alive") >= F.ceil(F.col("total") / 2)) & (F.col("regions") >= regions)
    return found.select("alive", "regions", ok.alias("has_quorum"))


def multilevel(members: DataFrame, least: int, regions: int, a_region: int, zones: int, a_zone: int) -> DataFrame:
    """alive, regions, zones, has_quorum: cluster, region and zone level at once."""
    found = alive(members).agg(F.count("*").alias("alive")).join(_valid_groups(members, "region", a_region)).join(_valid_groups(members, "zone", a_zone))
    return found.select("alive", "regions", "zones", ((F.col("alive") >= least) & (F.col("regions") >= regions) & (F.col("zones") >= zones)).alias("has_quorum"))


def by_role(members: DataFrame, roles: DataFrame, weight: float) -> DataFrame:
    """weight, roles_met, has_quorum; ``roles`` has role, min_count, weight, required. Up to two members above the minimum
    count for a role; members of unknown roles weigh 1."""
    have = alive(members).groupBy(F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))
    both = roles.join(have, "role", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    weighs = F.when(F.col("min_count").isNull(), F.col("n").cast("double")).otherwise(F.least("n", F.col("min_count") + 2) * F.col("weight"))
    unmet = F.coalesce("required", F.lit(False)) & (F.col("n") < F.col("min_count"))
    found = both.agg(F.coalesce(F.sum(weighs), F.lit(0.0)).alias("weight"), (F.count_if(unmet) == 0).alias("roles_met"))
    return found.withColumn("has_quorum", F.col("roles_met") & (F.col("weight") >= weight))


def by_zone(members: DataFrame, zones: int, a_zone: int, failures: int, worst_case: bool = False) -> DataFrame:
    """active_zones, remaining, has_quorum: enough zones with enough members, also after losing ``failures`` zones.

    The largest zones are taken to remain; with ``worst_case`` the smallest do.
    """
    sizes = alive(members).groupBy(F.coalesce("zone", F.lit("unknown")).alias("z")).agg(F.count("*").alias("n"))
    listed = sizes.agg(F.array_sort(F.collect_list("n")).alias("sizes"))  # a number for each zone; zones are configuration
    kept = F.greatest(F.lit(0), F.size("sizes") - failures)
    remain = F.slice("sizes", 1, kept) if worst_case else F.slice(F.reverse("sizes"), 1, kept)
    total = F.aggregate(remain, F.lit(0).cast("long"), lambda a, x: a + x)
    active = F.size(F.filter("sizes", lambda n: n >= a_zone))
    ok = (active >= zones) & (F.size("sizes") - failures >= zones) & (total >= (F.size("sizes") - failures) * a_zone)
    return listed.select(active.cast("long").alias("active_zones"), total.alias("remaining"), ok.alias("has_quorum"))


def consensus(members: DataFrame, algorithm: str, total_nodes: int | None = None) -> DataFrame:
    """alive, required, has_quorum for raft, paxos (a majority) or pbft (2f + 1 of at least 3f + 1), of the alive or of ``total_nodes``."""
    found = alive(members).agg(F.count("*").alias("alive"))
    n = F.lit(total_nodes) if total_nodes is not None else F.col("alive")
    faulty = F.floor((n - 1) / 3)
    required = 2 * faulty + 1 if algorithm == "pbft" else F.floor(n / 2) + 1
    enough = (n >= 4) & (F.col("alive") >= required) if algorithm == "pbft" else F.col("alive") >= required
    return found.select("alive", required.cast("long").alias("required"), enough.alias("has_quorum"))


def adaptive(members: DataFrame, strategy: str, latency: float, partition: float, level: str) -> DataFrame:
    """alive, required, has_quorum: a majority raised for slow or splitting networks, and for the consistency level."""
    n = F.col("alive")
    base = F.floor(n / 2) + 1
    if strategy == "latency-based":
        required = F.ceil(base * F.lit(1.3 if latency > 1000 else 1.15 if latency > 500 else 1.0))
    elif strategy == "failure-based":
        required = F.ceil(n * 0.75) if partition > 0.5 else F.ceil(n * 0.67) if partition > 0.3 else base
    else:
        slow = 1.4 if latency > 1000 else 1.2 if latency > 500 else 1.1 if latency > 200 else 1.0
        split = 1.5 if partition > 0.5 else 1.3 if partition > 0.3 else 1.1 if partition > 0.1 else 1.0
        required = F.ceil(base * F.lit(max(slow, split)))
    floor = {"strict": 0.8, "strong": 0.67}.get(level)
    if floor:
        required = F.greatest(required, F.ceil(n * floor))
    found = alive(members).agg(F.count("*").alias("alive")).withColumn("required", F.least(required, n).cast("long"))
    return found.withColumn("has_quorum", n >= F.col("required"))


def partition(members: DataFrame) -> DataFrame:
    """visible, total, ratio, kind: a partition is likely where fewer than half of the members (rounded up) are alive (majority), or
    all alive ones are in one zone while others are missing (zone-based); else kind is null."""
    alive = F.col("status") == "ALIVE"
    zones = F.countDistinct(F.when(alive, F.coalesce("zone", F.lit("unknown"))))
    found = members.agg(F.count_if(alive).alias("visible"), F.count("*").alias("total"), zones.alias("_z"))
    kind = F.when(F.col("visible") < F.ceil(F.col("total") / 2), "majority").when((F.col("_z") == 1) & (F.col("total") > F.col("visible")), "zone-based")
    return found.select("visible", "total", F.coalesce(F.try_divide("visible", "total"), F.lit(0.0)).alias("ratio"), kind.alias("kind"))


def zone_balance(members: DataFrame) -> DataFrame:
    """zone, members, share of alive members; balanced if no zone has over 0.6 of them, to be rebalanced above 0.7."""
    sizes = alive(members).groupBy(F.coalesce("zone", F.lit("unknown")).alias("zone")).agg(F.count("*").alias("members"))
    total = sizes.agg(F.sum("members").alias("_all"), F.max("members").alias("_most"))
    most = F.col("_most") / F.col("_all")
    return sizes.join(F.broadcast(total)).select("zone", "members", (F.col("members") / F.col("_all")).alias("share"), (most <= 0.6).alias("balanced"), (most > 0.7).alias("rebalance"))


def recommended(n: int, regions: int, zones: int, roles: int, byzantine: bool, unstable: bool) -> str:
    """The strategy for a kind of cluster."""
    if byzantine:
        return "consensus"
    if unstable:
        return "adaptive"
    if regions > 1:
        return "multi-level"
    if zones > 2:
        return "zone"
    return "role" if roles > 1 and n > 5 else "simple"

"""Statistics over channels, presence, connections, queues, batches, pools and the whole system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(rows: DataFrame, **columns: str) -> DataFrame:
    """total and the number of different values of each column; exact."""
    return rows.agg(F.count("*").alias("total"), *[F.countDistinct(c).alias(k) for k, c in columns.items()])


def memberships(members: DataFrame, group: str, owner: Column) -> DataFrame:
    """groups, owned, mean_members over a table with one row for each member of a group."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.max(owner.cast("int")).alias("own"))
    return sizes.agg(F.count("*").alias("groups"), F.sum("own").alias("owned"), F.avg("n").alias("mean_members"))


def by_status(rows: DataFrame, key: str, status: str, names: tuple[str, ...]) -> DataFrame:
    """key, total and the count of each status."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == n).alias(f"n_{n.lower()}") for n in names])


def batch_stats(batches: DataFrame, messages: str, raw: str, sent: str) -> DataFrame:
    """batches, mean_messages, compression_ratio, oldest_first: the earliest opening, not the last in priority order."""
    return batches.agg(F.count("*").alias("batches"), F.avg(messages).alias("mean_messages"), F.try_divide(F.sum(sent), F.sum(raw)).alias("compression_ratio"))


def outcome_rates(calls: DataFrame, key: str, ok: Column) -> DataFrame:
    """key, calls, failure_rate, success_rate."""
    found = calls.groupBy(key).agg(F.count("*").alias("calls"), F.avg((~ok).cast("int")).alias("failure_rate"))
    return found.withColumn("success_rate", 1 - F.col("failure_rate"))


def pools(rows: DataFrame, total: str, active: str) -> DataFrame:
    """Connections over all pools, and the band of their use: critical above 0.9, high above 0.7."""
    found = rows.agg(F.sum(total).alias("connections"), F.sum(active).alias("in_use"), F.avg(F.try_divide(active, total)).alias("mean_use"))
    use = F.try_divide("in_use", "connections")
    return found.withColumn("band", F.when(use > 0.9, "critical").when(use > 0.7, "high").otherwise("normal"))


def network(samples: DataFrame, rtt: str, responsive: Column) -> DataFrame:
    return samples.agg(F.avg(F.when(responsive, F.col(rtt))).alias("mean_rtt"), F.count_if(responsive).alias("responsive"), F.count_if(~responsive).alias("unresponsive"))


def dashboard(nodes: DataFrame, region: str, healthy: Column, connections: str) -> DataFrame:
    """region, nodes, connections, health and status of each region: healthy above 0.8, warning above 0.5."""
    found = nodes.groupBy(region).agg(F.count("*").alias("nodes"), F.sum(connections).alias("connections"), F.avg(healthy.cast("int")).alias("health"))
    return found.withColumn("status", F.when(F.col("health") > 0.8, "healthy").when(F.col("health") > 0.5, "warning").otherwise("critical"))


def throttled(transfers: DataFrame, key: str, micros: str, size: str, a_second: int) -> DataFrame:
    """key, second, sent, over: bytes above the limit of each second."""
    found = transfers.groupBy(key, F.floor(F.col(micros) / 1_000_000).alias("second")).agg(F.sum(size).alias("sent"))
    return found.withColumn("over", F.greatest(F.lit(0), F.col("sent") - a_second))


def bandwidth(syncs: DataFrame, full: str, delta: str) -> DataFrame:
    """syncs, sent, saved, mean_saving of delta transfers against full ones."""
    return syncs.agg(F.count("*").alias("syncs"), F.sum(delta).alias("sent"), F.sum(F.col(full) - F.col(delta)).alias("saved"), F.avg(1 - F.try_divide(delta, full)).alias("mean_saving"))


def recent_alerts(alerts: DataFrame, micros: str, severity: str, now: Column, span: int) -> DataFrame:
    """severity, alerts of the last ``span``."""
    return alerts.filter(F.col(micros) > now - span).groupBy(severity).agg(F.count("*").alias("alerts"))


def queue_ages(messages: DataFrame, queue: str, micros: str, now: Column) -> DataFrame:
    """queue, waiting, oldest: the age of the message that has waited longest, whatever its priority."""
    return messages.groupBy(queue).agg(F.count("*").alias("waiting"), F.max(now - F.col(micros)).alias("oldest"))


def seed_health(seeds: DataFrame, status: str, most_failures: int = 3) -> DataFrame:
    """total, available, permanent, failed, ratio, state: of seeds (status, failures, permanent): healthy from half of them available,
    degraded below, failed with none."""
    ok = (F.col(status) == "available") & (F.col("failures") < most_failures)
    found = seeds.agg(F.count("*").alias("total"), F.count_if(ok).alias("available"), F.count_if("permanent").alias("permanent"), F.count_if(~ok).alias("failed"))
    found = found.withColumn("ratio", F.coalesce(F.try_divide("available", "total"), F.lit(0.0)))
    return found.withColumn("state", F.when(F.col("available") == 0, "failed").when(F.col("ratio") < 0.5, "degraded").otherwise("healthy"))


def geography(nodes: DataFrame, region: str, healthy: Column, load: str, latency: DataFrame) -> DataFrame:
    """region, nodes, healthy, load, latency of each region: its nodes, the healthy ones, the mean load, and the mean latency to the
    other regions (``latency``: from_region, to_region, latency)."""
    found = nodes.groupBy(region).agg(F.count("*").alias("nodes"), F.count_if(healthy).alias("healthy"), F.avg(load).alias("load"))
    far = latency.filter("from_region <> to_region").groupBy(F.col("from_region").alias(region)).agg(F.avg("latency").alias("latency"))
    return found.join(far, region, "left")

"""Topology and health rollups over members, resources and connections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by(members: DataFrame, *levels: str) -> DataFrame:
    """level, value, members: how many members each value of each level has, in one pass; a missing value is 'unknown'."""
    named = members.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in levels])
    level = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in levels])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in levels])
    return named.groupingSets([[c] for c in levels], *levels).agg(level.alias("level"), value.alias("value"), F.count("*").alias("members")).select("level", "value", "members")


def query(rows: DataFrame, where: dict[str, Sequence] | None = None, since: Column | None = None, group_by: Sequence[str] = (), **measures: Column) -> DataFrame:
    """Rows whose columns have one of the listed values, and that meet ``since``; grouped, with the measures, if asked."""
    for column, values in (where or {}).items():
        rows = rows.filter(F.col(column).isin(*values))
    if since is not None:
        rows = rows.filter(since)
    return rows.groupBy(*group_by).agg(*[m.alias(k) for k, m in measures.items()]) if measures else rows


def cluster_health(members: DataFrame, status: str) -> DataFrame:
    """One row: total, alive, suspect, dead, ratio, healthy (alive members are a majority)."""
    found = members.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(status) == s.upper()).alias(s) for s in ("alive", "suspect", "dead")],
    )
    return found.withColumn("ratio", F.coalesce(F.try_divide("alive", "total"), F.lit(0.0))).withColumn("healthy", F.col("alive") >= F.floor(F.col("total") / 2) + 1)


def health_rollup(reports: DataFrame) -> DataFrame:
    """Merged health reports (total, alive, coverage): the highest counts, the lowest coverage; healthy from half upwards."""
    found = reports.agg(F.max("total").alias("total"), F.max("alive").alias("alive"), F.min("coverage").alias("coverage"))
    return found.withColumn("healthy", F.col("alive") >= F.ceil(0.5 * F.col("total")))


def region_health(nodes: DataFrame, region: str, healthy: Column) -> DataFrame:
    return nodes.groupBy(region).agg(F.avg(healthy.cast("int")).alias("health"), F.count("*").alias("nodes"))


def node_report(nodes: DataFrame, name: str, status: Column, cpu: Column, memory: Column) -> DataFrame:
    """name, class: healthy (under 0.8 of the processor), degraded, unhealthy, overloaded (0.9 of either); classes overlap."""
    classes = F.array(
        F.when((status == "healthy") & (cpu < 0.8), "healthy"),
        F.when(status == "degraded", "degraded"),
        F.when(status == "unhealthy", "unhealthy"),
        F.when((cpu >= 0.9) | (memory >= 0.9), "overloaded"),
    )
    return nodes.select(name, F.explode(F.filter(classes, lambda c: c.isNotNull())).alias("class"))


def bottlenecks(nodes: DataFrame, name: str, **shares: Column) -> DataFrame:
    """name, resource, share: each use above 0.9."""
    found = F.array(*[F.struct(F.lit(k).alias("resource"), v.alias("share")) for k, v in shares.items()])
    return nodes.select(name, F.explode(F.filter(found, lambda x: x.share > 0.9)).alias("b")).select(name, "b.resource", "b.share")


def scaling(nodes: DataFrame, share: Column, by: Sequence[str] = ()) -> DataFrame:
    """nodes, utilization, action, add: above 0.85 add a fifth at once, above 0.7 soon, below 0.3 with over three nodes shrink."""
    found = nodes.groupBy(*by).agg(F.count("*").alias("nodes"), F.avg(share).alias("utilization"))
    u = F.col("utilization")
    action = F.when(u > 0.85, "scale-up-critical").when(u > 0.7, "scale-up").when((u < 0.3) & (F.col("nodes") > 3), "scale-down").otherwise("none")
    return found.withColumn("action", action).withColumn("add", F.when(u > 0.7, F.ceil(0.2 * F.col("nodes"))).otherwise(0).cast("long"))


def sharding(rooms: DataFrame, name: str, participants: Column, rate: Column, broadcast: Column) -> DataFrame:
    """name, shards: one for each 10,000 participants or 1,000 messages a second, three at least for a broadcast above 5,000."""
    by_size = F.greatest(F.lit(1), F.ceil(participants / 10_000), F.ceil(rate / 1_000))
    return rooms.select(name, F.when(broadcast & (participants > 5_000), F.greatest(by_size, F.lit(3))).otherwise(by_size).cast("long").alias("shards"))


def consistency(states: DataFrame, services: DataFrame) -> DataFrame:
    """score: nodes (node, size) whose size is within one of the mean, plus one if no service is on two nodes, over nodes + 1."""
    mean = states.agg(F.avg("size").alias("mean"), F.count("*").alias("n"))
    near = states.join(F.broadcast(mean)).agg(F.count_if(F.abs(F.col("size") - F.col("mean")) <= 1).alias("near"), F.count("*").alias("n"))
    twice = services.groupBy("service").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))
    score = F.when(F.col("n") <= 1, 1.0).otherwise((F.col("near") + (F.col("most") <= 1).cast("int")) / (F.col("n") + 1))
    return near.join(F.broadcast(twice)).select(score.alias("score"))


def cross_region_latency(nodes: DataFrame, links: DataFrame, default: float = 100.0) -> DataFrame:
    """from_region, to_region, latency: the mean of measured links (node, to_region, latency), 0 within a region, else the default.

    The region grid is the regions' own product; regions are configuration, their number does not follow the data.
    """
    regions = nodes.select("region").distinct()
    grid = regions.select(F.col("region").alias("from_region")).crossJoin(F.broadcast(regions.select(F.col("region").alias("to_region"))))
    seen = links.join(nodes.select("node", "region"), "node").groupBy(F.col("region").alias("from_region"), "to_region").agg(F.avg("latency").alias("mean"))
    value = F.when(F.col("from_region") == F.col("to_region"), 0.0).otherwise(F.coalesce("mean", F.lit(default)))
    return grid.join(seen, ["from_region", "to_region"], "left").select("from_region", "to_region", value.alias("latency"))


def overview(resources: DataFrame, *levels: str) -> DataFrame:
    """Resource counts and capacity by each level and in all, as grouping sets: level, value, resources, capacity."""
    level = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in levels], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in levels])
    return resources.groupingSets([*[[c] for c in levels], []], *levels).agg(level.alias("level"), value.alias("value"), F.count("*").alias("resources"), F.sum("capacity").alias("capacity")).select("level", "value", "resources", "capacity")


def stability(samples: DataFrame, now: Column, micros: str, changed: Column, window: int) -> DataFrame:
    """churn (changes in the last window), mean_age in microseconds, calm (share of windows without a change)."""
    windows = samples.groupBy(F.floor(F.col(micros) / window).alias("w")).agg(F.count_if(changed).alias("c")).agg(F.avg((F.col("c") == 0).cast("int")).alias("calm"))
    recent = samples.agg(F.count_if(changed & (F.col(micros) > now - window)).alias("churn"), F.avg(now - F.col(micros)).alias("mean_age"))
    return recent.join(F.broadcast(windows))


def worst_status(checks: DataFrame, by: str, status: str, order: Sequence[str] = ("healthy", "degraded", "unhealthy")) -> DataFrame:
    """by, status: the worst of each; a check without a status counts as degraded."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in order]), F.coalesce(F.col(status), F.lit("degraded"))), F.lit(2))
    return checks.groupBy(by).agg(F.max(rank).alias("_r")).select(by, F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_r").cast("int")).alias("status"))


def band(value: Column, high: float, middle: float, names: tuple[str, str, str]) -> Column:
    return F.when(value > high, names[0]).when(value > middle, names[1]).otherwise(names[2])


def tag_values(members: DataFrame, tags: str) -> DataFrame:
    """tag, values: the distinct values of each tag (a map column), sorted."""
    pairs = members.select(F.explode(tags).alias("tag", "v")).distinct()
    return pairs.groupBy("tag").agg(F.array_sort(F.collect_list("v")).alias("values"))


def unreachable(members: DataFrame, collected: DataFrame, name: str) -> DataFrame:
    """Members of which no state has been collected."""
    return members.join(collected.select(name).distinct(), name, "left_anti")


def endpoints(services: DataFrame, alive: DataFrame, unhealthy: DataFrame, prefix: str) -> DataFrame:
    """Services whose id starts with ``prefix``, owned by an alive node and not reported unhealthy."""
    own = services.filter(F.col("service_id").startswith(prefix))
    return own.join(alive.select("node_id"), "node_id", "left_semi").join(unhealthy.select("service_id"), "service_id", "left_anti")


def top(rows: DataFrame, by: Sequence[str], score: Column, name: str, n: int) -> DataFrame:
    """The ``n`` best rows of each group by score, ties by name."""
    best = Window.partitionBy(*by).orderBy(score.desc(), F.col(name))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def performance(samples: DataFrame, means: Sequence[str], sums: Sequence[str], highest: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Performance samples of several nodes as one: rates and latencies averaged, message rates and throughput summed, sizes and
    times by their highest."""
    return samples.groupBy(*by).agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in highest])


def cluster_performance(resources: DataFrame, nodes: DataFrame) -> DataFrame:
    """mean_latency, throughput, error_rate over resources (latency, throughput, error_rate), and utilization: the active over the
    possible resources of all nodes (active, most); all 0 where there is nothing."""
    none = lambda c: F.coalesce(c, F.lit(0.0))
    found = resources.agg(none(F.avg("latency")).alias("mean_latency"), none(F.sum("throughput")).alias("throughput"), none(F.avg("error_rate")).alias("error_rate"))
    used = nodes.agg(none(F.try_divide(F.sum("active"), F.sum("most"))).alias("utilization"))
    return found.join(F.broadcast(used))


def consistent_view(states: DataFrame, services: DataFrame, least: int = 1, score: float = 0.8) -> DataFrame:
    """nodes, required, score, verdict: consistent, or what is missing: insufficient nodes (fewer than ``least`` or than half, rounded
    up) or inconsistency (a score below ``score``). States and services as for consistency()."""
    found = consistency(states, services).join(F.broadcast(states.agg(F.count("*").alias("nodes"))))
    required = F.greatest(F.lit(least), F.ceil(F.col("nodes") / 2))
    verdict = F.when(F.col("nodes") < required, "insufficient nodes").when(F.col("score") < score, "inconsistent").otherwise("consistent")
    return found.select("nodes", required.alias("required"), "score", verdict.alias("verdict"))


def room_places(rooms: DataFrame, nodes: DataFrame, owner: str, node: str, *levels: str) -> DataFrame:
    """level, value, rooms, sharded, replicated: rooms by the places of the nodes that own them and by their type, in one pass; rooms of
    unknown owners count under 'unknown'. ``rooms`` has room_type, sharded, ha; ``levels`` are columns of ``nodes``."""
    at = rooms.join(F.broadcast(nodes.select(F.col(node).alias(owner), *levels)), owner, "left")
    names = [*levels, "room_type"]
    named = at.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in names], "sharded", "ha")
    level = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in names])
    sets = named.groupingSets([[c] for c in names], *names)
    return sets.agg(level.alias("level"), value.alias("value"), F.count("*").alias("rooms"), F.count_if("sharded").alias("sharded"), F.count_if("ha").alias("replicated")).select("level", "value", "rooms", "sharded", "replicated")


def totals(nodes: DataFrame, capacity: Sequence[str], shares: Sequence[str], healthy: Column) -> DataFrame:
    """One row: sums of ``capacity``, means of ``shares``, health (share of healthy nodes) and its band: healthy above 0.8, warning above 0.5."""
    found = nodes.agg(*[F.sum(c).alias(c) for c in capacity], *[F.avg(c).alias(c) for c in shares], F.avg(healthy.cast("int")).alias("health"))
    return found.withColumn("band", F.when(F.col("health") > 0.8, "healthy").when(F.col("health") > 0.5, "warning").otherwise("critical"))

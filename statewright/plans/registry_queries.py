"""Queries that look up, select and count over registries, connections, channels and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import lookups, stats
from statewright.plans.base import query
from statewright.plans.log_queries import UPDATES
from statewright.plans.topology_queries import MEMBERS, members
from statewright.sources.tables import entity_updates, table


@query(f"WITH {UPDATES} SELECT lsn, entity_id FROM u WHERE owner = 'node-3'")
def entities_by_node(spark, sf_dir):
    return lookups.owned_by(entity_updates(spark, sf_dir), "owner", "node-3").select("lsn", "entity_id")


def _connections(spark, sf_dir):
    """Orders as connections with tags: a priority, and the set of their lines' flags."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("flags"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderpriority").alias("priority"), "o_custkey")
    return orders.join(lines, "id").select("id", "o_custkey", F.map_concat(F.create_map(F.lit("priority"), "priority"), F.create_map(F.lit("flags"), "flags")).alias("tags"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def connections_by_tags(spark, sf_dir):
    return lookups.tagged(_connections(spark, sf_dir), "tags", {"priority": "1-URGENT", "flags": "R"}).select("id")


@query(f"WITH {MEMBERS} SELECT l_orderkey, l_linenumber, l_suppkey AS owner, CASE WHEN status = 'ALIVE' THEN 'host-' || id END AS address FROM lineitem LEFT JOIN m ON id = l_suppkey")
def route_addresses(spark, sf_dir):
    nodes = members(spark, sf_dir).select("id", "status", F.concat(F.lit("host-"), F.col("id").cast("string")).alias("address"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("owner"))
    return lookups.with_address(lines, nodes, "owner", "id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click')")
def online_clients(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return lookups.online(events.filter("event_type = 'view'"), events.filter("event_type = 'click'"), "user_id")


@query(
    """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 = 0 AS permanent, s_acctbal AS priority FROM supplier WHERE s_suppkey % 2 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY permanent ORDER BY priority DESC, id) AS r FROM s) SELECT id, permanent, priority FROM r WHERE permanent OR r <= 3"""
)
def bootstrap_seeds(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7 == 0).alias("permanent"), F.col("s_acctbal").alias("priority"), (F.col("s_suppkey") % 2 == 0).alias("available"))
    return lookups.bootstrap_seeds(seeds, "id", "priority").drop("available")


@query("SELECT s_suppkey AS node, count(l_suppkey) AS connections FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 2, 1 LIMIT 5")
def least_connected_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return lookups.least_connected(nodes, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node")), "node", 5)


@query(f"WITH {MEMBERS} SELECT id, region FROM m ORDER BY (region <> 'ASIA')::INTEGER, md5(id || ':7'), id LIMIT 8")
def zone_first_targets(spark, sf_dir):
    return lookups.zone_first(members(spark, sf_dir).select("id", "region"), "id", "region", "ASIA", 8, 7)


@query(f"WITH {MEMBERS} SELECT id FROM m ORDER BY md5(id || ':3'), id LIMIT 6")
def gossip_targets(spark, sf_dir):
    return lookups.sample(members(spark, sf_dir).select("id"), "id", 6, 3)


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) > 20")
def history_evicted(spark, sf_dir):
    return lookups.evicted(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id", 20)


@query("SELECT event_id, user_id % 16 AS range_id, 'node-' || (user_id % 16 % 5) AS node FROM events")
def message_ranges(spark, sf_dir):
    owners = spark.range(16).select(F.col("id").alias("range_id"), F.concat(F.lit("node-"), (F.col("id") % 5).cast("string")).alias("node"))
    return lookups.hashed_range(table(spark, sf_dir, "events").select("event_id", "user_id"), F.pmod("user_id", F.lit(16)), F.broadcast(owners)).select("event_id", "range_id", "node")


@query("SELECT count(*) AS total, count(DISTINCT o_custkey) AS users, count(DISTINCT o_orderpriority) AS kinds FROM orders")
def connection_stats(spark, sf_dir):
    return stats.distinct_counts(table(spark, sf_dir, "orders"), users="o_custkey", kinds="o_orderpriority")


@query("SELECT count(*) AS groups, sum(own)::BIGINT AS owned, avg(n) AS mean_members FROM (SELECT l_partkey, count(*) AS n, max((l_suppkey % 3 = 0)::INTEGER) AS own FROM lineitem GROUP BY 1)")
def channel_stats(spark, sf_dir):
    return stats.memberships(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_suppkey") % 3 == 0)


@query("SELECT o_orderpriority AS queue, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def queue_stats(spark, sf_dir):
    return stats.by_status(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "queue"), "queue", "o_orderstatus", ("F", "O", "P"))


@query("SELECT count(*) AS batches, avg(n) AS mean_messages, sum(raw * (1 - d)) / sum(raw) AS compression_ratio FROM (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS raw, max(l_discount) AS d FROM lineitem GROUP BY 1)")
def batch_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("raw"), F.max("l_discount").alias("d"))
    return stats.batch_stats(rows.withColumn("sent", F.col("raw") * (1 - F.col("d"))), "n", "raw", "sent")


@query("SELECT user_id, count(*) AS calls, avg((event_type = 'error')::INTEGER) AS failure_rate, 1 - avg((event_type = 'error')::INTEGER) AS success_rate FROM events GROUP BY 1")
def breaker_rates(spark, sf_dir):
    return stats.outcome_rates(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error")


@query(
    """WITH p AS (SELECT s_nationkey, count(*) * 10 AS total, sum(s_suppkey % 10) AS active FROM supplier GROUP BY 1), a AS (SELECT sum(total)::BIGINT AS connections, sum(active)::BIGINT AS in_use, avg(active / total) AS mean_use FROM p)
       SELECT *, CASE WHEN in_use / connections > 0.9 THEN 'critical' WHEN in_use / connections > 0.7 THEN 'high' ELSE 'normal' END AS band FROM a"""
)
def pool_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.count("*") * 10).alias("total"), F.sum(F.col("s_suppkey") % 10).alias("active"))
    return stats.pools(rows, "total", "active")


@query("SELECT avg(value) FILTER (event_type <> 'error') AS mean_rtt, count(*) FILTER (event_type <> 'error') AS responsive, count(*) FILTER (event_type = 'error') AS unresponsive FROM events")
def network_stats(spark, sf_dir):
    return stats.network(table(spark, sf_dir, "events"), "value", F.col("event_type") != "error")


@query(
    f"""WITH {MEMBERS}, d AS (SELECT region, count(*) AS nodes, sum(id % 50)::BIGINT AS connections, avg((status = 'ALIVE')::INTEGER) AS health FROM m GROUP BY 1)
        SELECT *, CASE WHEN health > 0.8 THEN 'healthy' WHEN health > 0.5 THEN 'warning' ELSE 'critical' END AS status FROM d"""
)
def region_dashboard(spark, sf_dir):
    return stats.dashboard(members(spark, sf_dir).withColumn("connections", F.col("id") % 50), "region", F.col("status") == "ALIVE", "connections")


@query("SELECT user_id % 5 AS peer, epoch_us(ts) // 1000000 AS second, sum(value) AS sent, greatest(0, sum(value) - 90) AS over FROM events GROUP BY 1, 2")
def bandwidth_throttle(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("peer"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return stats.throttled(rows, "peer", "us", "value", 90)


@query("SELECT count(*) AS syncs, sum(l_discount * l_extendedprice) AS sent, sum(l_extendedprice - l_discount * l_extendedprice) AS saved, avg(1 - l_discount * l_extendedprice / l_extendedprice) AS mean_saving FROM lineitem")
def sync_bandwidth(spark, sf_dir):
    return stats.bandwidth(table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_discount") * F.col("l_extendedprice")), "l_extendedprice", "part")


@query("SELECT event_type AS severity, count(*) AS alerts FROM events WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - 86400000000 GROUP BY 1")
def recent_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("severity"))
    return stats.recent_alerts(rows.join(F.broadcast(rows.agg(F.max("us").alias("now")))), "us", "severity", F.col("now"), 86_400_000_000)


@query("SELECT event_type AS queue, count(*) AS waiting, max((SELECT max(epoch_us(ts)) FROM events) - epoch_us(ts)) AS oldest FROM events GROUP BY 1")
def queue_ages(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("queue"))
    return stats.queue_ages(rows.join(F.broadcast(rows.agg(F.max("us").alias("now")))), "queue", "us", F.col("now"))

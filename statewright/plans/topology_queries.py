"""Queries over topology, health and quorum: suppliers are the members, their nation the zone and its region the region."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import quorum, topology
from statewright.plans.base import query
from statewright.sources.tables import table

MEMBERS = """m AS (SELECT s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'DEAD' WHEN s_suppkey % 10 = 0 THEN 'SUSPECT' ELSE 'ALIVE' END AS status,
  CASE s_suppkey % 4 WHEN 0 THEN 'leader' WHEN 1 THEN 'worker' WHEN 2 THEN 'cache' END AS role, r_name AS region, n_name AS zone,
  (s_suppkey * 37 % 100) / 100.0 AS cpu, (s_suppkey * 53 % 100) / 100.0 AS mem, s_acctbal AS load
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def members(spark, sf_dir):
    """Members with their place; nations and regions are lookup tables of fixed size."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("zone"), F.col("r_name").alias("region"))
    role = F.when(F.col("s_suppkey") % 4 == 0, "leader").when(F.col("s_suppkey") % 4 == 1, "worker").when(F.col("s_suppkey") % 4 == 2, "cache")
    status = F.when(F.col("s_acctbal") < 0, "DEAD").when(F.col("s_suppkey") % 10 == 0, "SUSPECT").otherwise("ALIVE")
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("s_suppkey").alias("id"), status.alias("status"), role.alias("role"), "region", "zone",
        ((F.col("s_suppkey") * 37 % 100) / 100.0).alias("cpu"), ((F.col("s_suppkey") * 53 % 100) / 100.0).alias("mem"), F.col("s_acctbal").alias("load"),
    )


HEALTH = "CASE WHEN status = 'ALIVE' THEN 'healthy' WHEN status = 'SUSPECT' THEN 'degraded' ELSE 'unhealthy' END"


def _health():
    return F.when(F.col("status") == "ALIVE", "healthy").when(F.col("status") == "SUSPECT", "degraded").otherwise("unhealthy")


@query(
    f"""WITH {MEMBERS} SELECT 'region' AS level, region AS value, count(*) AS members FROM m GROUP BY region UNION ALL SELECT 'zone', zone, count(*) FROM m GROUP BY zone
        UNION ALL SELECT 'role', coalesce(role, 'unknown'), count(*) FROM m GROUP BY 2"""
)
def topology_by_level(spark, sf_dir):
    return topology.counts_by(members(spark, sf_dir), "region", "zone", "role")


@query(f"""WITH {MEMBERS} SELECT count(*) AS total, count(*) FILTER (status = 'ALIVE') AS alive, count(*) FILTER (status = 'SUSPECT') AS suspect, count(*) FILTER (status = 'DEAD') AS dead,
        count(*) FILTER (status = 'ALIVE') / count(*) AS ratio, count(*) FILTER (status = 'ALIVE') >= count(*) // 2 + 1 AS healthy FROM m""")
def cluster_health(spark, sf_dir):
    return topology.cluster_health(members(spark, sf_dir), "status")


@query(f"WITH {MEMBERS} SELECT region, avg((status = 'ALIVE')::INTEGER) AS health, count(*) AS nodes FROM m GROUP BY 1")
def region_health(spark, sf_dir):
    return topology.region_health(members(spark, sf_dir), "region", F.col("status") == "ALIVE")


@query(
    f"""WITH {MEMBERS}, r AS (SELECT region, count(*) AS total, count(*) FILTER (status = 'ALIVE') AS alive, avg(cpu) AS coverage FROM m GROUP BY 1)
        SELECT max(total) AS total, max(alive) AS alive, min(coverage) AS coverage, max(alive) >= ceil(0.5 * max(total)) AS healthy FROM r"""
)
def health_rollup(spark, sf_dir):
    reports = members(spark, sf_dir).groupBy("region").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ALIVE").alias("alive"), F.avg("cpu").alias("coverage"))
    return topology.health_rollup(reports)


@query(
    f"""WITH {MEMBERS}, h AS (SELECT *, {HEALTH} AS h FROM m) SELECT id, 'healthy' AS class FROM h WHERE h = 'healthy' AND cpu < 0.8 UNION ALL SELECT id, h FROM h WHERE h <> 'healthy'
        UNION ALL SELECT id, 'overloaded' FROM h WHERE cpu >= 0.9 OR mem >= 0.9"""
)
def node_health_report(spark, sf_dir):
    return topology.node_report(members(spark, sf_dir), "id", _health(), F.col("cpu"), F.col("mem"))


@query(f"WITH {MEMBERS} SELECT id, 'cpu' AS resource, cpu AS share FROM m WHERE cpu > 0.9 UNION ALL SELECT id, 'memory', mem FROM m WHERE mem > 0.9")
def bottlenecks(spark, sf_dir):
    return topology.bottlenecks(members(spark, sf_dir), "id", cpu=F.col("cpu"), memory=F.col("mem"))


@query(
    f"""WITH {MEMBERS}, u AS (SELECT zone, count(*) AS nodes, avg(cpu) AS utilization FROM m GROUP BY 1)
        SELECT *, CASE WHEN utilization > 0.85 THEN 'scale-up-critical' WHEN utilization > 0.7 THEN 'scale-up' WHEN utilization < 0.3 AND nodes > 3 THEN 'scale-down' ELSE 'none' END AS action,
          CASE WHEN utilization > 0.7 THEN ceil(0.2 * nodes) ELSE 0 END::BIGINT AS add FROM u"""
)
def scaling_recommendations(spark, sf_dir):
    return topology.scaling(members(spark, sf_dir), F.col("cpu"), ["zone"])


@query(
    """WITH r AS (SELECT p_partkey AS room, count(*) * 900 AS participants, sum(l_quantity) AS rate, p_size > 25 AS broadcast FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_size)
       SELECT room, CASE WHEN broadcast AND participants > 5000 THEN greatest(3, 1, ceil(participants / 10000), ceil(rate / 1000)) ELSE greatest(1, ceil(participants / 10000), ceil(rate / 1000)) END::BIGINT AS shards FROM r"""
)
def room_sharding(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.count("*") * 900).alias("participants"), F.sum("l_quantity").alias("rate"))
    rooms = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return topology.sharding(rooms.withColumnRenamed("p_partkey", "room"), "room", F.col("participants"), F.col("rate"), F.col("p_size") > 25)


@query(
    """WITH s AS (SELECT l_suppkey AS node, count(*) AS size FROM lineitem GROUP BY 1), a AS (SELECT avg(size) AS m, count(*) AS n FROM s),
       d AS (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY l_partkey))
       SELECT CASE WHEN any_value(n) <= 1 THEN 1.0 ELSE (count(*) FILTER (abs(size - m) <= 1) + (any_value(most) <= 1)::INTEGER) / (any_value(n) + 1) END AS score FROM s, a, d"""
)
def consistency_score(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    states = lines.groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("size"))
    return topology.consistency(states, lines.select("l_suppkey", F.col("l_partkey").alias("service")).distinct())


@query(
    f"""WITH {MEMBERS}, l AS (SELECT m.region AS a, r_name AS b, avg((id * 13 + r_regionkey * 29) % 90 + 10.0) AS mean FROM m, region WHERE r_name <> 'ASIA' GROUP BY 1, 2),
        g AS (SELECT a.region AS from_region, b.region AS to_region FROM (SELECT DISTINCT region FROM m) a, (SELECT DISTINCT region FROM m) b)
        SELECT from_region, to_region, CASE WHEN from_region = to_region THEN 0.0 ELSE coalesce(mean, 100.0) END AS latency FROM g LEFT JOIN l ON a = from_region AND b = to_region"""
)
def cross_region_latency(spark, sf_dir):
    nodes = members(spark, sf_dir).select(F.col("id").alias("node"), "region")
    to = F.broadcast(table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"))  # of no node the way to Asia is measured
    links = nodes.join(to).select("node", F.col("r_name").alias("to_region"), ((F.col("node") * 13 + F.col("r_regionkey") * 29) % 90 + 10.0).alias("latency"))
    return topology.cross_region_latency(nodes, links)


@query(
    """WITH o AS (SELECT o_orderstatus AS status, o_orderpriority AS type, o_totalprice AS capacity FROM orders)
       SELECT 'status' AS level, status AS value, count(*) AS resources, sum(capacity) AS capacity FROM o GROUP BY status UNION ALL SELECT 'type', type, count(*), sum(capacity) FROM o GROUP BY type
       UNION ALL SELECT 'all', NULL, count(*), sum(capacity) FROM o"""
)
def resource_overview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("capacity"))
    return topology.overview(orders, "status", "type")


@query(
    """WITH e AS (SELECT epoch_us(ts) AS us, event_type = 'error' AS c FROM events), n AS (SELECT max(us) AS now FROM e), w AS (SELECT avg((c = 0)::INTEGER) AS calm FROM (SELECT us // 600000000 AS w, count(*) FILTER (c) AS c FROM e GROUP BY 1))
       SELECT count(*) FILTER (c AND us > now - 600000000) AS churn, avg(now - us) AS mean_age, any_value(calm) AS calm FROM e, n, w"""
)
def stability_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    samples = events.join(F.broadcast(events.agg(F.max("us").alias("now"))))
    return topology.stability(samples, F.col("now"), "us", F.col("event_type") == "error", 600_000_000)


@query(f"WITH {MEMBERS}, h AS (SELECT region, {HEALTH} AS h FROM m) SELECT region, CASE max(CASE h WHEN 'healthy' THEN 1 WHEN 'degraded' THEN 2 ELSE 3 END) WHEN 1 THEN 'healthy' WHEN 2 THEN 'degraded' ELSE 'unhealthy' END AS status FROM h GROUP BY 1")
def worst_status(spark, sf_dir):
    return topology.worst_status(members(spark, sf_dir).select("region", _health().alias("h")), "region", "h")


@query(f"WITH {MEMBERS}, t AS (SELECT 'role' AS tag, role AS v FROM m WHERE role IS NOT NULL UNION SELECT 'region', region FROM m) SELECT tag, string_agg(v, ',' ORDER BY v) AS values FROM t GROUP BY 1")
def tag_values(spark, sf_dir):
    tags = F.map_filter(F.create_map(F.lit("role"), "role", F.lit("region"), "region"), lambda _, v: v.isNotNull())
    return topology.tag_values(members(spark, sf_dir).select(tags.alias("tags")), "tags").select("tag", F.array_join("values", ",").alias("values"))


@query("SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey * 3 FROM lineitem)")
def partition_unreachable(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    seen = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("node"))  # states of each third member only
    return topology.unreachable(nodes, seen, "node")


@query(
    f"""WITH {MEMBERS} SELECT l_partkey || '-' || l_orderkey AS service_id, l_suppkey AS node_id FROM lineitem WHERE l_partkey || '-' || l_orderkey LIKE '1%'
        AND l_suppkey IN (SELECT id FROM m WHERE status = 'ALIVE') AND l_partkey || '-' || l_orderkey NOT IN (SELECT l_partkey || '-' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def service_endpoints(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("service_id", F.concat_ws("-", "l_partkey", "l_orderkey"))
    alive = members(spark, sf_dir).filter("status = 'ALIVE'").select(F.col("id").alias("node_id"))
    own = lines.select("service_id", F.col("l_suppkey").alias("node_id"))
    return topology.endpoints(own, alive, lines.filter("l_returnflag = 'R'"), "1")


ALIVE = "(SELECT * FROM m WHERE status = 'ALIVE')"


@query(f"WITH {MEMBERS} SELECT count(*) FILTER (status = 'ALIVE') AS alive, count(DISTINCT region) FILTER (status = 'ALIVE') AS regions, count(*) FILTER (status = 'ALIVE') >= greatest(5, ceil(count(*) / 2)) AND count(DISTINCT region) FILTER (status = 'ALIVE') >= 3 AS has_quorum FROM m")
def quorum_simple(spark, sf_dir):
    return quorum.simple(members(spark, sf_dir), 5, 3)


@query(
    f"""WITH {MEMBERS}, a AS (SELECT count(*) AS alive FROM {ALIVE}), r AS (SELECT count(*) AS regions FROM (SELECT region FROM {ALIVE} GROUP BY 1 HAVING count(*) >= 10)),
        z AS (SELECT count(*) AS zones FROM (SELECT zone FROM {ALIVE} GROUP BY 1 HAVING count(*) >= 3)) SELECT alive, regions, zones, alive >= 10 AND regions >= 3 AND zones >= 9 AS has_quorum FROM a, r, z"""
)
def quorum_multilevel(spark, sf_dir):
    return quorum.multilevel(members(spark, sf_dir), 10, 3, 10, 9, 3)


@query(
    f"""WITH {MEMBERS}, c(role, min_count, weight, required) AS (VALUES ('leader', 3, 3.0, true), ('worker', 5, 1.0, true), ('gpu', 1, 2.0, false)), n AS (SELECT coalesce(role, 'unknown') AS role, count(*) AS n FROM {ALIVE} GROUP BY 1),
        b AS (SELECT min_count, weight, required, coalesce(n, 0) AS n FROM c FULL JOIN n ON c.role = n.role)
        SELECT sum(CASE WHEN min_count IS NULL THEN n ELSE least(n, min_count + 2) * weight END)::DOUBLE AS weight, count(*) FILTER (required AND n < min_count) = 0 AS roles_met, roles_met AND sum(CASE WHEN min_count IS NULL THEN n ELSE least(n, min_count + 2) * weight END) >= 20 AS has_quorum FROM b"""
)
def quorum_role(spark, sf_dir):
    roles = spark.createDataFrame([("leader", 3, 3.0, True), ("worker", 5, 1.0, True), ("gpu", 1, 2.0, False)], "role string, min_count long, weight double, required boolean")
    return quorum.by_role(members(spark, sf_dir), roles, 20.0)


@query(
    f"""WITH {MEMBERS}, z AS (SELECT zone, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, zone) AS r FROM {ALIVE} GROUP BY 1)
        SELECT count(*) FILTER (n >= 2) AS active_zones, (sum(n) FILTER (r <= (SELECT count(*) - 2 FROM z)))::BIGINT AS remaining,
          active_zones >= 5 AND count(*) - 2 >= 5 AND sum(n) FILTER (r <= (SELECT count(*) - 2 FROM z)) >= (count(*) - 2) * 2 AS has_quorum FROM z"""
)
def quorum_zone(spark, sf_dir):
    return quorum.by_zone(members(spark, sf_dir), 5, 2, 2)


@query(f"WITH {MEMBERS} SELECT count(*) AS alive, (2 * ((count(*) - 1) // 3) + 1)::BIGINT AS required, count(*) >= 4 AND count(*) >= 2 * ((count(*) - 1) // 3) + 1 AS has_quorum FROM {ALIVE}")
def quorum_consensus(spark, sf_dir):
    return quorum.consensus(members(spark, sf_dir), "pbft")


@query(f"WITH {MEMBERS} SELECT count(*) AS alive, least(greatest(ceil((count(*) // 2 + 1) * 1.3), ceil(count(*) * 0.67)), count(*))::BIGINT AS required, count(*) >= required AS has_quorum FROM {ALIVE}")
def quorum_adaptive(spark, sf_dir):
    return quorum.adaptive(members(spark, sf_dir), "hybrid", 600.0, 0.4, "strong")


@query(
    f"""WITH {MEMBERS}, z AS (SELECT zone, count(*) AS members FROM {ALIVE} GROUP BY 1), a AS (SELECT sum(members) AS s, max(members) AS m FROM z)
        SELECT zone, members, members / s AS share, m / s <= 0.6 AS balanced, m / s > 0.7 AS rebalance FROM z, a"""
)
def zone_balance(spark, sf_dir):
    return quorum.zone_balance(members(spark, sf_dir))

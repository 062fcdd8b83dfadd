"""Queries over retention, checkpoints, replacement, chunking, validation, ranking and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import compaction, diff, fold, metrics, placement, reconcile, topology, workflow
from statewright.plans.base import query
from statewright.plans.log_queries import SEGMENTS, UPDATES, segments
from statewright.plans.metric_queries import SNAP, _observed
from statewright.plans.placement_queries import RING, _ring
from statewright.plans.topology_queries import MEMBERS, members
from statewright.plans.workflow_queries import ARRIVALS, _arrivals
from statewright.sources.tables import entity_updates, table


@query(f"WITH {UPDATES} SELECT lsn, entity_id FROM u WHERE ts_us > (SELECT max(ts_us) FROM u) - 259200000000")
def update_log_retention(spark, sf_dir):
    log = entity_updates(spark, sf_dir)
    return fold.log_kept(log.join(F.broadcast(log.agg(F.max("ts_us").alias("now")))), F.col("now"), 259_200_000_000).select("lsn", "entity_id")


@query(
    f"""WITH {UPDATES}, d AS (SELECT entity_id, max(lsn) FILTER (operation = 'DELETE') AS cleared FROM u GROUP BY 1), o AS (SELECT u.* FROM u JOIN d USING (entity_id) WHERE cleared IS NULL OR lsn > cleared),
        m AS (SELECT entity_id, min(lsn) AS c, arg_min(version, lsn) AS v, arg_min(owner, lsn) AS o FROM o WHERE operation = 'CREATE' GROUP BY 1),
        c AS (SELECT o.entity_id, max(version) AS v, arg_max(owner, lsn) FILTER (operation = 'TRANSFER') AS w FROM o JOIN m USING (entity_id) WHERE lsn > c AND operation IN ('UPDATE', 'TRANSFER') GROUP BY 1)
        SELECT m.entity_id, coalesce(c.v, m.v) AS version, coalesce(c.w, m.o) AS owner FROM m LEFT JOIN c USING (entity_id)"""
)
def restore_from_checkpoint(spark, sf_dir):
    """The state at LSN 500 and the log after it give what the whole log gives."""
    log = entity_updates(spark, sf_dir)
    state = fold.version_state(log.filter("lsn <= 500")).select("entity_id", "owner", "version")
    return fold.version_state(fold.from_checkpoint(state, log, 500)).select("entity_id", "version", "owner")


@query(f"WITH {MEMBERS} SELECT id, status FROM m WHERE NOT (status = 'DEAD' AND load < -500)")
def members_pruned(spark, sf_dir):
    """Dead members not seen for long are dropped; the negative balance stands for the time since they were seen."""
    return fold.pruned(members(spark, sf_dir).withColumn("last_seen", F.col("load")), F.lit(0.0), 500).select("id", "status")


@query(f"WITH {SEGMENTS}, s AS (SELECT segment_id, entry_count * 2048 * (1 + segment_id % 5 * 20) AS size_bytes FROM seg) SELECT *, CASE WHEN size_bytes <= 10485760 THEN 0 ELSE greatest(0, ceil(round(log10(size_bytes / 10485760), 9))) END::INTEGER AS level FROM s")
def compaction_levels(spark, sf_dir):
    sized = segments(spark, sf_dir).select("segment_id", (F.col("entry_count") * 2048 * (1 + F.col("segment_id") % 5 * 20)).alias("size_bytes"))
    return compaction.leveled(sized, "size_bytes")


@query(f"WITH {SEGMENTS} SELECT greatest(0, sum(entry_count - 2 * tombstone_count))::BIGINT AS entries_kept, sum(entry_count)::BIGINT AS bytes_read, sum(entry_count) / 1000.0 AS seconds FROM seg")
def compaction_estimate(spark, sf_dir):
    return compaction.estimate(segments(spark, sf_dir), "entry_count", "tombstone_count", "entry_count", 1000.0)


@query("SELECT o_orderkey AS id, o_orderstatus AS operation, CASE WHEN o_orderstatus = 'F' THEN 'unknown operation' WHEN o_orderstatus = 'O' AND o_custkey % 3 = 0 THEN 'missing data' ELSE '' END AS errors FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'O' WHEN 'P' THEN 'P' ELSE 'F' END AS o_orderstatus, o_custkey FROM orders)")
def delta_validation(spark, sf_dir):
    """Orders as operations: O adds (without data for some customers), P deletes, F is no operation."""
    verb = F.when(F.col("o_orderstatus") == "O", "add").when(F.col("o_orderstatus") == "P", "delete").otherwise("noop")
    ops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), verb.alias("operation"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("data"))
    name = F.when(F.col("operation") == "add", "O").when(F.col("operation") == "delete", "P").otherwise("F")
    return diff.valid(ops, "id", "data").select("id", name.alias("operation"), F.array_join("errors", ",").alias("errors"))


@query("SELECT o_orderkey AS id, o_custkey % 8 AS bucket, ((row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) - 1) // 100)::BIGINT AS chunk FROM orders")
def delta_chunks(spark, sf_dir):
    return diff.numbered_chunks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("bucket")), "bucket", "id", 100)


@query(
    """SELECT event_id, user_id % 10 AS sender FROM events WHERE event_type <> 'view' AND user_id % 10 NOT IN (SELECT user_id % 10 FROM events WHERE event_type = 'view' AND value > 90)
       UNION ALL SELECT event_id, user_id % 10 FROM events WHERE event_type = 'view' AND value > 90"""
)
def presence_replace_sender(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("sender"), "event_type", "value")
    update = events.filter("event_type = 'view' AND value > 90").select("event_id", "sender")
    return diff.replaced(events.filter("event_type <> 'view'").select("event_id", "sender"), update, "sender").select("event_id", "sender")


@query("SELECT l_partkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS items FROM lineitem GROUP BY 1")
def resolve_union(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.array("l_returnflag").alias("items"))
    return reconcile.union_merged(rows, "id", "items").withColumn("items", F.array_join("items", ","))


@query(
    """SELECT p_partkey AS id, p_brand AS name, coalesce(r.value, p_size) AS value FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS value FROM lineitem GROUP BY 1) r ON l_partkey = p_partkey AND p_brand = 'Brand#11'"""
)
def resolutions_applied(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").alias("value"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_linenumber").alias("value")).withColumn("name", F.lit("Brand#11"))
    return reconcile.with_resolutions(parts, found, "id", "name", "value")


@query(f"WITH {MEMBERS}, {RING}, o AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_custkey NOT IN (SELECT id FROM m WHERE status = 'ALIVE')) SELECT o.id, coalesce(arg_min(node, ring.h) FILTER (ring.h >= k.h), arg_min(node, ring.h)) AS claimed_by FROM o JOIN k USING (id), ring GROUP BY 1")
def orphans_reclaimed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"))
    lost = placement.orphans(orders, members(spark, sf_dir), "owner_id", "id")
    return placement.reclaims(lost, "id", _ring(spark, sf_dir)).select("id", "claimed_by")


@query(f"WITH {MEMBERS} SELECT id, zone, rank::INTEGER AS rank FROM (SELECT id, zone, row_number() OVER (PARTITION BY zone ORDER BY (1 - cpu) * (1 - mem) DESC, id) AS rank FROM m) WHERE rank <= 2")
def best_nodes_by_zone(spark, sf_dir):
    return topology.top(members(spark, sf_dir), ["zone"], (1 - F.col("cpu")) * (1 - F.col("mem")), "id", 2).select("id", "zone", "rank")


@query(f"WITH {ARRIVALS}, n AS (SELECT DISTINCT run_id, s AS arrival_no FROM a, range(1, 8) t(s)) SELECT n.run_id, n.arrival_no::INTEGER AS arrival_no FROM n ANTI JOIN a ON n.run_id = a.run_id AND n.arrival_no = a.arrival_no")
def steps_skipped(spark, sf_dir):
    steps = _arrivals(spark, sf_dir)
    nodes = steps.select("run_id").distinct().withColumn("arrival_no", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return workflow.skipped(nodes, steps, ["run_id"], "arrival_no")


@query(
    f"""WITH {SNAP} SELECT 'counter' AS type, event_type AS series, sum(value) AS value FROM events GROUP BY 2 UNION ALL SELECT 'gauge', event_type, arg_max(value, event_id) FROM events GROUP BY 2
        UNION ALL SELECT 'histogram', type, mean FROM h"""
)
def metrics_snapshot(spark, sf_dir):
    observed = _observed(spark, sf_dir).withColumnRenamed("type", "series")
    gauges = metrics.gauges(observed.withColumn("kind", F.lit("set")), "series")
    return metrics.snapshot(observed.groupBy("series").agg(F.sum("value").alias("value")), gauges, metrics.histograms(observed, ["series"], "seq", "value"))


@query("SELECT o_orderkey || ',' || o_orderstatus || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS line FROM orders")
def csv_export(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.to_csv(F.struct("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))).alias("line"))

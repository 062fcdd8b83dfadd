"""Queries that fold, compare and reconcile state."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import diff, fold, reconcile
from statewright.plans.base import query
from statewright.plans.log_queries import UPDATES
from statewright.sources.tables import entity_updates, table


@query(
    f"""WITH {UPDATES}, d AS (SELECT entity_id, max(lsn) FILTER (operation = 'DELETE') AS cleared FROM u GROUP BY 1),
        o AS (SELECT u.* FROM u JOIN d USING (entity_id) WHERE cleared IS NULL OR lsn > cleared),
        m AS (SELECT entity_id, min(lsn) AS created_lsn, arg_min(version, lsn) AS v, arg_min(owner, lsn) AS o FROM o WHERE operation = 'CREATE' GROUP BY 1),
        c AS (SELECT o.entity_id, max(version) AS v, arg_max(owner, lsn) FILTER (operation = 'TRANSFER') AS w FROM o JOIN m USING (entity_id) WHERE lsn > created_lsn AND operation IN ('UPDATE', 'TRANSFER') GROUP BY 1)
        SELECT m.entity_id, created_lsn, coalesce(c.v, m.v) AS version, coalesce(c.w, m.o) AS owner FROM m LEFT JOIN c USING (entity_id)"""
)
def registry_state_version_fold(spark, sf_dir):
    return fold.version_state(entity_updates(spark, sf_dir))


@query(
    f"""WITH {UPDATES}, w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, owner DESC) AS r FROM u)
        SELECT entity_id, version, owner FROM w WHERE r = 1 AND operation <> 'DELETE'"""
)
def crdt_live_entities(spark, sf_dir):
    return fold.lww_state(entity_updates(spark, sf_dir)).filter("live").select("entity_id", "version", "owner")


@query(
    f"""WITH {UPDATES}, w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, owner DESC) AS r FROM u)
        SELECT entity_id, version FROM w WHERE r = 1 AND operation = 'DELETE' AND ts_us > (SELECT max(ts_us) FROM u) - 43200000000"""
)
def crdt_tombstones(spark, sf_dir):
    log = entity_updates(spark, sf_dir)
    states = fold.lww_state(log).join(F.broadcast(log.agg(F.max("ts_us").alias("now"))))
    return fold.tombstones_kept(states, F.col("now"), 43200000000).select("entity_id", "version")


def _arrivals(spark, sf_dir):
    """The change log with metadata, arriving in another order than its versions."""
    log = entity_updates(spark, sf_dir).withColumn("ord", (F.col("lsn") + F.col("lsn") * 7919 % 50) * 1_000_000 + F.col("lsn"))
    return log.select("ord", "entity_id", "operation", "owner", "version", F.col("ts_us").alias("ts"), F.map_from_arrays(F.array(F.concat(F.lit("k"), F.col("lsn") % 3)), F.array(F.col("lsn").cast("string"))).alias("metadata"))


# The arrivals of each entity numbered in order; metadata has the keys k0, k1, k2.
ARRIVED = f"""WITH RECURSIVE {UPDATES}, o AS (SELECT entity_id, operation, owner, version, lsn % 3 AS k, lsn::VARCHAR AS v, row_number() OVER (PARTITION BY entity_id ORDER BY (lsn + lsn * 7919 % 50) * 1000000 + lsn) AS n FROM u)"""
ENTRIES = "concat_ws(',', 'k0=' || k0, 'k1=' || k1, 'k2=' || k2)"


def _entries(metadata):
    return F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat_ws("=", e.key, e.value)), ",")


@query(
    ARRIVED
    + """, s AS (SELECT entity_id, n, operation <> 'DELETE' AS live, CASE WHEN operation <> 'DELETE' THEN owner END AS owner, version, owner AS author,
           CASE WHEN operation <> 'DELETE' AND k = 0 THEN v END AS k0, CASE WHEN operation <> 'DELETE' AND k = 1 THEN v END AS k1, CASE WHEN operation <> 'DELETE' AND k = 2 THEN v END AS k2 FROM o WHERE n = 1
         UNION ALL SELECT entity_id, m, CASE WHEN wins THEN op <> 'DELETE' ELSE live END, CASE WHEN NOT wins THEN owner WHEN op <> 'DELETE' THEN new END, CASE WHEN wins THEN ver ELSE version END, CASE WHEN wins THEN new ELSE author END,
           CASE WHEN NOT wins THEN k0 WHEN op = 'DELETE' THEN NULL WHEN k = 0 THEN v WHEN op = 'UPDATE' THEN k0 END, CASE WHEN NOT wins THEN k1 WHEN op = 'DELETE' THEN NULL WHEN k = 1 THEN v WHEN op = 'UPDATE' THEN k1 END,
           CASE WHEN NOT wins THEN k2 WHEN op = 'DELETE' THEN NULL WHEN k = 2 THEN v WHEN op = 'UPDATE' THEN k2 END
         FROM (SELECT s.*, o.n AS m, o.operation AS op, o.owner AS new, o.version AS ver, o.k, o.v, NOT (s.version > o.version OR (s.version = o.version AND s.author > o.owner)) AS wins FROM s JOIN o ON o.entity_id = s.entity_id AND o.n = s.n + 1))
       SELECT entity_id, live, owner, version, CASE WHEN live THEN """
    + ENTRIES
    + """ END AS metadata FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1"""
)
def crdt_fold_arrival_order(spark, sf_dir):
    """The exact fold with metadata; a unit test compares it with a plain fold under permuted arrivals."""
    return fold.lww_fold(_arrivals(spark, sf_dir)).select("entity_id", "live", "owner", "version", _entries("metadata").alias("metadata"))


@query(
    ARRIVED
    + """, s AS (SELECT entity_id, n, operation = 'CREATE' AS live, owner, version, CASE WHEN k = 0 THEN v END AS k0, CASE WHEN k = 1 THEN v END AS k1, CASE WHEN k = 2 THEN v END AS k2 FROM o WHERE n = 1
         UNION ALL SELECT entity_id, m, CASE WHEN made THEN true WHEN op = 'DELETE' THEN false ELSE live END, CASE WHEN made OR (later AND op = 'TRANSFER') THEN new ELSE owner END, CASE WHEN made OR later THEN ver ELSE version END,
           CASE WHEN (made OR (later AND op = 'UPDATE')) AND k = 0 THEN v WHEN made THEN NULL ELSE k0 END, CASE WHEN (made OR (later AND op = 'UPDATE')) AND k = 1 THEN v WHEN made THEN NULL ELSE k1 END,
           CASE WHEN (made OR (later AND op = 'UPDATE')) AND k = 2 THEN v WHEN made THEN NULL ELSE k2 END
         FROM (SELECT s.*, o.n AS m, o.operation AS op, o.owner AS new, o.version AS ver, o.k, o.v, o.operation = 'CREATE' AND NOT s.live AS made, o.operation IN ('UPDATE', 'TRANSFER') AND s.live AND o.version > s.version AS later FROM s JOIN o ON o.entity_id = s.entity_id AND o.n = s.n + 1))
       SELECT entity_id, owner, version, """
    + ENTRIES
    + """ AS metadata FROM s QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) = 1 AND live"""
)
def version_fold_arrival_order(spark, sf_dir):
    return fold.version_fold(_arrivals(spark, sf_dir)).select("entity_id", "owner", "version", _entries("metadata").alias("metadata"))


@query(
    f"""WITH {UPDATES}, p AS (SELECT *, last_value(CASE WHEN operation IN ('CREATE', 'DELETE') THEN operation END IGNORE NULLS)
          OVER (PARTITION BY entity_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM u)
        SELECT entity_id, lsn, operation, CASE WHEN operation = 'CREATE' THEN 'already exists' ELSE 'not found' END AS reason FROM p
        WHERE (operation = 'CREATE') = coalesce(last = 'CREATE', false)"""
)
def registry_rejected_mutations(spark, sf_dir):
    return fold.rejected_mutations(entity_updates(spark, sf_dir))


@query(
    """SELECT l_suppkey AS node_id, arg_max(l_linestatus, (l_linenumber, l_shipdate, l_orderkey)) AS status, max(l_linenumber)::BIGINT AS version
       FROM lineitem WHERE l_suppkey <> 1 GROUP BY 1"""
)
def membership_merge(spark, sf_dir):
    """Reports about suppliers: the line number is the version, shipping date and order the last sight."""
    reports = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("node_id"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").cast("long").alias("version"), F.struct("l_shipdate", "l_orderkey").alias("last_seen")
    )
    return fold.membership(reports.withColumn("node_id", F.col("node_id")), "node_id", own=1).select("node_id", "status", "version")


@query(
    """SELECT l_partkey AS entity_id, l_linenumber::BIGINT AS version, l_orderkey AS responder FROM
       (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1"""
)
def bootstrap_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").cast("long").alias("version"), F.col("l_orderkey").alias("responder"))
    return fold.first_highest(rows, "entity_id", "version", "responder")


@query(
    """SELECT p_partkey AS key, coalesce(s.value, p.p_size) AS value FROM part p LEFT JOIN (SELECT ps AS k, max(q) AS value FROM
       (SELECT l_partkey AS ps, l_quantity::INTEGER AS q FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY 1) s ON s.k = p.p_partkey"""
)
def config_with_defaults(spark, sf_dir):
    defaults = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'")
    settings = lines.groupBy(F.col("l_partkey").alias("key")).agg(F.max(F.col("l_quantity").cast("int")).alias("value"))
    return fold.with_defaults(settings, defaults, "key", "value")


# Two replicas of a table: the target lacks some orders, has others changed, and has some that the source lacks.
REPLICAS = """s AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 11 <> 0),
  t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 13 <> 0)"""
CHANGES = """c AS (SELECT coalesce(s.id, t.id) AS id, CASE WHEN t.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'removed' WHEN s.status <> t.status OR s.owner <> t.owner THEN 'modified' END AS change
  FROM s FULL JOIN t ON s.id = t.id)"""


def _replicas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    source = orders.filter("id % 11 <> 0")
    return source, orders.filter("id % 13 <> 0").withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status")))


@query(f"WITH {REPLICAS}, {CHANGES} SELECT * FROM c WHERE change IS NOT NULL")
def fingerprint_diff(spark, sf_dir):
    source, target = _replicas(spark, sf_dir)
    return diff.compared(diff.fingerprints(source, "id", "status", "owner"), diff.fingerprints(target, "id", "status", "owner"), "id")


@query(
    f"""WITH {REPLICAS}, {CHANGES} SELECT c.id % 16 AS bucket, c.id, CASE change WHEN 'added' THEN 'add' WHEN 'removed' THEN 'delete' ELSE 'modify' END AS operation, s.status, s.owner
        FROM c LEFT JOIN s ON s.id = c.id WHERE change IS NOT NULL"""
)
def delta_generate(spark, sf_dir):
    source, target = _replicas(spark, sf_dir)
    return diff.delta(source, target, "id", "status", "owner")


@query(f"WITH {REPLICAS} SELECT * FROM s")
def delta_apply(spark, sf_dir):
    """A delta applied to the target gives the source."""
    source, target = _replicas(spark, sf_dir)
    return diff.applied(target, diff.delta(source, target, "id", "status", "owner"), "id", "status", "owner")


@query(
    """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 5 AS version FROM orders WHERE o_orderkey % 3 <> 0),
       o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'delete' ELSE 'modify' END AS operation, o_orderkey % 7 AS previous_version FROM orders)
       SELECT o.id, operation, CASE WHEN operation = 'modify' AND s.id IS NULL THEN 'missing-dependency' WHEN operation = 'modify' AND version <> previous_version THEN 'version'
         WHEN operation = 'add' AND s.id IS NOT NULL THEN 'version' WHEN operation = 'delete' AND s.id IS NULL THEN 'already-deleted' ELSE 'applied' END AS outcome FROM o LEFT JOIN s ON s.id = o.id"""
)
def delta_apply_outcomes(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    state = ids.filter("id % 3 <> 0").withColumn("version", F.col("id") % 5)
    verb = F.when(F.col("id") % 4 == 0, "add").when(F.col("id") % 4 == 1, "delete").otherwise("modify")
    return diff.apply_outcome(state, ids.select("id", verb.alias("operation"), (F.col("id") % 7).alias("previous_version")), "id")


@query("SELECT user_id AS id, max(event_id) AS sequence, arg_max(event_type, event_id) AS operation FROM events GROUP BY 1")
def delta_merge_last_op(spark, sf_dir):
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("sequence"), F.col("event_type").alias("operation"))
    return diff.merged(ops, "id", "sequence")


@query(
    """WITH h AS (SELECT o_orderkey AS id, sha256('{"id":' || o_orderkey || ',"owner":' || o_custkey || ',"status":"' || o_orderstatus || '"}') AS hash FROM orders)
       SELECT id // 1000 AS leaf, sha256(string_agg(hash, '' ORDER BY id)) AS leaf_hash FROM h GROUP BY 1"""
)
def merkle_leaves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    return diff.merkle_leaves(diff.fingerprints(orders, "id", "status", "owner"), "id", 1000)


@query(
    """WITH t AS (SELECT user_id AS id, 'node-' || (event_id % 3) AS node, max(event_id) AS tick FROM events GROUP BY 1, 2)
       SELECT id, string_agg(node || '=' || tick, ',' ORDER BY node) AS clock FROM t GROUP BY 1"""
)
def vector_clock_merge(spark, sf_dir):
    clocks = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.create_map(F.concat(F.lit("node-"), F.col("event_id") % 3), F.col("event_id")).alias("clock"))
    merged = diff.merged_clock(clocks, "id", "clock")
    return merged.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("clock")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("clock"))


@query(f"WITH {REPLICAS} SELECT s.id, s.status FROM s JOIN t ON s.id = t.id WHERE s.status <> t.status")
def patch_fields(spark, sf_dir):
    source, target = _replicas(spark, sf_dir)
    return diff.patch(target, source, "id", "status", "owner").select("id", F.col("patch")["status"].alias("status"))


@query(
    """SELECT l_partkey AS service_id, l_suppkey AS name, count(*) AS replicas, avg(l_quantity) AS mean, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1, 2
       HAVING count(*) > 1 AND (max(l_quantity) - min(l_quantity) > 0.2 * avg(l_quantity) OR max(l_quantity) - min(l_quantity) > 10)"""
)
def conflict_detect_stats(spark, sf_dir):
    stats = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("service_id"), F.col("l_suppkey").alias("name"), "l_quantity")
    return reconcile.stat_conflicts(stats, "service_id", "name", "l_quantity")


@query("SELECT l_partkey AS service_id, count(*) AS replicas, min(l_linenumber)::BIGINT AS lowest, max(l_linenumber)::BIGINT AS highest FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND min(l_linenumber) <> max(l_linenumber)")
def conflict_detect_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("service_id"), F.col("l_linenumber").cast("long").alias("version"))
    return reconcile.version_conflicts(rows, "service_id", "version")


@query("SELECT l_partkey AS service_id, l_suppkey AS name, count(*) AS replicas, count(DISTINCT l_returnflag) AS values FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1")
def conflict_detect_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("service_id"), F.col("l_suppkey").alias("name"), "l_returnflag")
    return reconcile.metadata_conflicts(rows, "service_id", "name", "l_returnflag")


@query(
    """WITH c AS (SELECT l_partkey AS service_id, l_linenumber AS v, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2)
       SELECT service_id, max(v) AS max_value, min(v) AS min_value, sum(v * n) / sum(n) AS average, arg_max(v, (n, -f)) AS majority, arg_min(v, f) AS first_value FROM c GROUP BY 1"""
)
def resolve_conflicts(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("service_id"), F.col("l_linenumber").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return reconcile.resolved(values, "service_id", "v", "ord")


@query(
    """WITH c AS (SELECT l_partkey AS service_id, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT service_id, sum(n) AS a, count(*) AS u, max(n) AS m FROM c GROUP BY 1)
       SELECT service_id, CASE WHEN a <= 1 THEN 1.0 ELSE least(greatest((1 - (u - 1) / nullif(a - 1, 0)) * CASE WHEN m / a > 0.6 THEN 0.9 ELSE 0.6 END, 0.1), 1.0) END AS confidence FROM g"""
)
def resolution_confidence(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("service_id"), "l_returnflag")
    return reconcile.confidence(values, "service_id", "l_returnflag", "majority")


@query(
    """SELECT p_partkey AS id, CASE WHEN regexp_full_match(p_type, '.*BRASS') THEN 'max-value' WHEN regexp_full_match(p_type, 'S.*') THEN 'majority'
         WHEN p_brand = 'Brand#11' THEN 'average' ELSE 'last-writer-wins' END AS strategy FROM part"""
)
def resolution_strategy(spark, sf_dir):
    chosen = reconcile.strategy_of(F.col("p_type"), F.col("p_brand"), [("*BRASS", "max-value"), ("S*", "majority")], {"Brand#11": "average"}, "last-writer-wins")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), chosen.alias("strategy"))

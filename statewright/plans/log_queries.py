"""Queries over ordered logs and their compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import compaction, logs, lookups
from statewright.plans.base import query
from statewright.sources.tables import bus_events, entity_updates

#: The change log that entity_updates() makes of events.
UPDATES = """u AS (SELECT event_id AS lsn, user_id AS entity_id, 'node-' || (event_id % 5) AS owner, event_id AS version, epoch_us(ts) AS ts_us,
  CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'purchase' THEN 'TRANSFER' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, value FROM events)"""
SEGMENTS = f"""{UPDATES}, seg AS (SELECT lsn // 500 AS segment_id, min(lsn) AS start_lsn, max(lsn) AS end_lsn, count(*) AS entry_count,
  count(*) FILTER (operation = 'DELETE') AS tombstone_count, min(ts_us) AS created_at FROM u GROUP BY 1)"""


def segments(spark, sf_dir):
    log = entity_updates(spark, sf_dir).withColumn("segment_id", F.expr("lsn div 500"))
    return logs.segment_statistics(log, "segment_id", "lsn", "operation", "ts_us")


def newest_ts(spark, sf_dir):
    return entity_updates(spark, sf_dir).agg(F.max("ts_us").alias("now_us"))


@query(
    """SELECT event_id AS version, event_type AS type, user_id AS source_node_id, value
       FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100"""
)
def eventlog_compact_top_n(spark, sf_dir):
    events = bus_events(spark, sf_dir).select("version", "type", "source_node_id", "value")
    return logs.keep_newest(events, ["type"], "version", 100)


@query("SELECT event_id AS version, event_type AS type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id >= 200")
def eventlog_replay_from(spark, sf_dir):
    events = logs.replay(bus_events(spark, sf_dir), "version", first=200)
    return events.select("version", "type", F.from_json("payload", "k BIGINT").k.alias("k"))


@query(f"WITH {UPDATES} SELECT lsn, entity_id, operation FROM u WHERE lsn BETWEEN 100 AND 400")
def log_read_range(spark, sf_dir):
    return logs.replay(entity_updates(spark, sf_dir), "lsn", 100, 400).select("lsn", "entity_id", "operation")


@query(f"WITH {UPDATES} SELECT lsn, entity_id, version FROM u WHERE version > 500")
def updates_after_version(spark, sf_dir):
    return logs.after(entity_updates(spark, sf_dir), "version", 500).select("lsn", "entity_id", "version")


@query(
    f"""WITH {UPDATES} SELECT entity_id, lsn, owner, operation FROM
        (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY lsn DESC, ts_us DESC) AS r FROM u) WHERE r = 1 AND operation <> 'DELETE'"""
)
def wal_compact_latest(spark, sf_dir):
    return logs.compact_latest(entity_updates(spark, sf_dir), "entity_id", "operation", "lsn", "ts_us").select("entity_id", "lsn", "owner", "operation")


@query(
    f"""WITH {UPDATES} SELECT entity_id, lsn, owner, 'CREATE' AS operation, value FROM
        (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY lsn DESC) AS r FROM u) WHERE r = 1 AND operation <> 'DELETE'"""
)
def registry_compact_last_record(spark, sf_dir):
    return logs.rewritten_as_creates(entity_updates(spark, sf_dir), "entity_id", "operation", "lsn").select("entity_id", "lsn", "owner", "operation", "value")


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def segments_metadata(spark, sf_dir):
    return segments(spark, sf_dir)


@query(
    f"""WITH {SEGMENTS} SELECT count(*) AS segments, sum(entry_count)::BIGINT AS entries, sum(tombstone_count)::BIGINT AS tombstones,
        sum(tombstone_count) / sum(entry_count) AS tombstone_ratio, max((SELECT max(ts_us) FROM u) - created_at) AS oldest_age FROM seg"""
)
def wal_metrics(spark, sf_dir):
    found = segments(spark, sf_dir).join(F.broadcast(newest_ts(spark, sf_dir)))
    return logs.log_metrics(found, F.col("now_us"))


@query(
    """SELECT event_id, (SELECT max(c.event_id) FROM events c WHERE c.event_type = 'signup' AND c.event_id <= e.event_id) AS nearest_checkpoint
       FROM events e WHERE event_type = 'error'"""
)
def checkpoint_nearest(spark, sf_dir):
    events = bus_events(spark, sf_dir)
    points = events.filter("type = 'signup'").select(F.col("version").alias("checkpoint"))
    targets = events.filter("type = 'error'").select(F.col("version").alias("event_id"))
    return logs.nearest_at_or_before(points, targets, "checkpoint", "event_id", width=1000)


@query(
    """SELECT event_id AS version, user_id, event_type FROM events
       WHERE epoch_us(ts) + event_id % 30 * 86400000000 > (SELECT max(epoch_us(ts)) FROM events) - 86400000000 * 10
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3"""
)
def snapshots_keep_unexpired(spark, sf_dir):
    events = bus_events(spark, sf_dir).select("version", F.col("source_node_id").alias("user_id"), F.col("type").alias("event_type"), F.unix_micros("ts").alias("us"))
    now = events.agg((F.max("us") - F.lit(86400000000 * 10)).alias("now"))
    live = events.join(F.broadcast(now))
    kept = logs.keep_unexpired(live, ["user_id"], "version", 3, F.col("us") + F.col("version") % 30 * 86400000000, F.col("now"))
    return kept.select("version", "user_id", "event_type")


@query(
    """SELECT user_id, event_id AS created FROM events c WHERE event_type = 'signup'
       AND NOT EXISTS (SELECT 1 FROM events d WHERE d.user_id = c.user_id AND d.event_type = 'error' AND d.event_id > c.event_id)"""
)
def snapshots_alive(spark, sf_dir):
    """Creates minus the deletes that follow them."""
    events = bus_events(spark, sf_dir).select(F.col("source_node_id").alias("user_id"), F.col("version").alias("created"), "type")
    return lookups.created_alive(events.filter("type = 'signup'"), events.filter("type = 'error'"), "user_id", "created").select("user_id", "created")


@query(
    f"""WITH {SEGMENTS}, s AS (SELECT segment_id, entry_count * 2048 * (1 + segment_id % 5 * 20) AS size_bytes FROM seg),
        t AS (SELECT *, CASE WHEN size_bytes <= 1048576 THEN 0 WHEN size_bytes <= 10485760 THEN 1 WHEN size_bytes <= 104857600 THEN 2 ELSE 3 END AS tier FROM s),
        g AS (SELECT tier, count(*) AS n FROM t GROUP BY tier HAVING count(*) >= 4 ORDER BY n DESC, tier LIMIT 1)
        SELECT t.segment_id, t.size_bytes, t.tier FROM t JOIN g USING (tier)"""
)
def compaction_plan_tiered(spark, sf_dir):
    sized = segments(spark, sf_dir).select("segment_id", (F.col("entry_count") * 2048 * (1 + F.col("segment_id") % 5 * 20)).alias("size_bytes"))
    return compaction.size_tiered(sized, "size_bytes")


@query(
    f"""WITH {SEGMENTS}, s AS (SELECT segment_id, start_lsn - segment_id % 3 * 100 AS start_lsn, end_lsn FROM seg),
        o AS (SELECT *, CASE WHEN start_lsn <= max(end_lsn) OVER (ORDER BY start_lsn, end_lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM s)
        SELECT segment_id, start_lsn, end_lsn, sum(opens) OVER (ORDER BY start_lsn, end_lsn ROWS UNBOUNDED PRECEDING)::BIGINT AS overlap_group FROM o"""
)
def compaction_overlap_groups(spark, sf_dir):
    moved = segments(spark, sf_dir).select("segment_id", (F.col("start_lsn") - F.col("segment_id") % 3 * 100).alias("start_lsn"), "end_lsn")
    return logs.overlap_groups(moved, "start_lsn", "end_lsn")


@query(
    f"""WITH {SEGMENTS}, n AS (SELECT max(ts_us) AS now_us FROM u)
        SELECT segment_id, tombstone_count / entry_count AS tombstone_ratio,
          0.7 * (tombstone_count / entry_count) + 0.3 * least(1.0, (now_us - created_at) / 86400000000.0) AS benefit,
          (now_us - created_at) > 86400000000 * 3 OR tombstone_count > 0.3 * entry_count AS due FROM seg, n"""
)
def compaction_benefit(spark, sf_dir):
    found = segments(spark, sf_dir).join(F.broadcast(newest_ts(spark, sf_dir)))
    return compaction.benefit(found, "tombstone_count", "entry_count", F.col("now_us") - F.col("created_at"), 86400000000, 3 * 86400000000).select(
        "segment_id", "tombstone_ratio", "benefit", "due"
    )


@query(
    f"""WITH {SEGMENTS}, v AS (SELECT segment_id, least(2 * tombstone_count, entry_count) / entry_count AS dead_ratio FROM seg)
        SELECT segment_id, dead_ratio FROM v WHERE dead_ratio >= 0.2 ORDER BY dead_ratio DESC, segment_id LIMIT 4"""
)
def compaction_vacuum_candidates(spark, sf_dir):
    return compaction.vacuum_candidates(segments(spark, sf_dir), "segment_id", "tombstone_count", "entry_count")


@query(
    f"""WITH RECURSIVE {SEGMENTS}, o AS (SELECT segment_id % 4 AS log_id, segment_id, entry_count * 2048 AS size_bytes, row_number() OVER (PARTITION BY segment_id % 4 ORDER BY start_lsn) AS n FROM seg),
        s AS (SELECT log_id, segment_id, size_bytes, n, size_bytes AS total, 0 AS g FROM o WHERE n = 1
          UNION ALL SELECT o.log_id, o.segment_id, o.size_bytes, o.n, CASE WHEN s.total > 0 AND s.total + o.size_bytes > 4194304 THEN o.size_bytes ELSE s.total + o.size_bytes END,
            CASE WHEN s.total > 0 AND s.total + o.size_bytes > 4194304 THEN s.g + 1 ELSE s.g END FROM s JOIN o ON o.log_id = s.log_id AND o.n = s.n + 1)
        SELECT log_id, segment_id, size_bytes, g::BIGINT AS budget_group FROM s"""
)
def compaction_time_based_groups(spark, sf_dir):
    """Consecutive segments under a byte budget (a reset-dependent recurrence; a unit test compares it with a plain loop)."""
    sized = segments(spark, sf_dir).select("segment_id", "start_lsn", (F.col("entry_count") * 2048).alias("size_bytes"), (F.col("segment_id") % 4).alias("log_id"))
    return compaction.budget_groups(sized, ["log_id"], "start_lsn", "segment_id", "size_bytes", budget=4 << 20)

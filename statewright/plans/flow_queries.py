"""Queries over the event stream as flow control sees it; unit tests compare the folds with plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import flow
from statewright.plans.base import query
from statewright.sources.tables import table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"), "value")


# The rows of each key numbered in order, for recursion row by row.
ORDERED = "WITH RECURSIVE o AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events)"
TOKENS = f"""{ORDERED}, s AS (SELECT user_id, event_id, us, n, 3.0::DOUBLE AS had FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.us, o.n, least(3.0::DOUBLE, (s.had - CASE WHEN s.had >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + (o.us - s.us) / 1e6::DOUBLE * (1::DOUBLE / 7200)) FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
  SELECT event_id, user_id, allowed, tokens, retry_after FROM (SELECT event_id, user_id, had >= 1 AS allowed, had - CASE WHEN had >= 1 THEN 1 ELSE 0 END AS tokens,
  CASE WHEN had < 1 THEN ceil((1 - had) / (1::DOUBLE / 7200) * 1e6)::BIGINT END AS retry_after FROM s)"""


@query(
    f"""{ORDERED}, s AS (SELECT user_id, us, n, us AS opened FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.us, o.n, CASE WHEN o.us < s.opened + 3600000000 THEN s.opened ELSE o.us END FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
        SELECT user_id, opened, count(*) AS updates FROM s GROUP BY 1, 2"""
)
def coalesce_windows(spark, sf_dir):
    return flow.coalesced(_events(spark, sf_dir), ["user_id"], "us", 3_600_000_000)


@query(
    """WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(us) AS started, max(us) AS ended, count(*) AS events FROM n GROUP BY user_id, k"""
)
def idle_sessions(spark, sf_dir):
    found = flow.sessions(_events(spark, sf_dir), ["user_id"], "ts", "2 hours")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "events")


@query(TOKENS)
def token_bucket(spark, sf_dir):
    return flow.token_bucket(_events(spark, sf_dir), ["user_id"], "us", "event_id", 1 / 7200, 3.0)


@query("SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS flush FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY event_id DESC) <= 2")
def backpressure_drop_oldest(spark, sf_dir):
    return flow.bounded(_events(spark, sf_dir), ["user_id"], "us", "event_id", 86_400_000_000, 2, "drop-oldest").select("event_id", "user_id", "flush")


@query("SELECT event_id, user_id, epoch_us(ts) // 86400000000 AS flush FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY event_id) <= 2")
def backpressure_drop_newest(spark, sf_dir):
    return flow.bounded(_events(spark, sf_dir), ["user_id"], "us", "event_id", 86_400_000_000, 2, "drop-newest").select("event_id", "user_id", "flush")


@query(
    f"""{ORDERED}, s AS (SELECT user_id, event_id, us, n, us AS last, true AS new FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.event_id, o.us, o.n, CASE WHEN o.us >= s.last + 14400000000 THEN o.us ELSE s.last END, o.us >= s.last + 14400000000 FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1)
        SELECT s.event_id, s.user_id, s.us, e.event_type, e.value FROM s JOIN events e USING (event_id) WHERE new"""
)
def dedup_first_seen(spark, sf_dir):
    return flow.first_seen(_events(spark, sf_dir).drop("ts"), "user_id", "us", 14_400_000_000, "event_id")


@query("SELECT event_id, user_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000")
def dedup_ttl(spark, sf_dir):
    return flow.dedup_refreshed(_events(spark, sf_dir), "user_id", "us", 14_400_000_000).select("event_id", "user_id")


@query(
    """WITH RECURSIVE o AS (SELECT event_type, epoch_us(ts) AS us, trunc(value)::BIGINT AS b, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS n FROM events WHERE user_id % 13 <> 0),
       s AS (SELECT event_type, us AS opened, 1 AS messages, b AS bytes, n FROM o WHERE n = 1
         UNION ALL SELECT o.event_type, CASE WHEN fits THEN opened ELSE us END, CASE WHEN fits THEN messages + 1 ELSE 1 END, CASE WHEN fits THEN bytes + b ELSE b END, o.n
         FROM (SELECT o.*, s.opened, s.messages, s.bytes, s.messages < 100 AND s.bytes + o.b <= 4000 AND o.us < s.opened + 7200000000 AS fits FROM s JOIN o ON o.event_type = s.event_type AND o.n = s.n + 1) o),
       z AS (SELECT *, lead(messages) OVER (PARTITION BY event_type ORDER BY n) AS next FROM s)
       SELECT event_type, opened, messages::BIGINT AS messages, bytes FROM z WHERE next IS NULL OR next = 1
       UNION ALL SELECT event_type, epoch_us(ts), 1, trunc(value)::BIGINT FROM events WHERE user_id % 13 = 0"""
)
def message_batches(spark, sf_dir):
    return flow.batches(_events(spark, sf_dir), ["event_type"], "us", "value", 100, 4000, 7_200_000_000, urgent=F.col("user_id") % 13 == 0, seq="event_id")


@query(
    f"""{ORDERED}, s AS (SELECT user_id, n, 'CLOSED' AS state, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS run, NULL::BIGINT AS opened, 0 AS rejected FROM o WHERE n = 1
        UNION ALL SELECT user_id, m, CASE WHEN away THEN state WHEN ok THEN 'CLOSED' WHEN state = 'OPEN' OR run + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN away THEN run WHEN ok THEN 0 ELSE run + 1 END,
          CASE WHEN away OR ok THEN opened WHEN state = 'OPEN' OR run + 1 >= 2 THEN us ELSE opened END, CASE WHEN away THEN rejected + 1 ELSE rejected END
        FROM (SELECT s.*, o.n AS m, o.us, o.event_type <> 'error' AS ok, s.state = 'OPEN' AND o.us < s.opened + 36000000000 AS away FROM s JOIN o ON o.user_id = s.user_id AND o.n = s.n + 1))
        SELECT user_id, arg_max(state, n) AS state, arg_max(rejected, n)::BIGINT AS rejected FROM s GROUP BY 1"""
)
def circuit_breaker(spark, sf_dir):
    return flow.breaker(_events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error"), ["user_id"], "us", 2, 36_000_000_000, "event_id")


LEASES = """WITH RECURSIVE o AS (SELECT event_id % 97 AS range_id, epoch_us(ts) AS us, 'node-' || (user_id % 7) AS node, row_number() OVER (PARTITION BY event_id % 97 ORDER BY epoch_us(ts), 'node-' || (user_id % 7)) AS n FROM events),
       s AS (SELECT range_id, n, node, 1 AS version, us + 21600000000 AS expires FROM o WHERE n = 1
         UNION ALL SELECT o.range_id, o.n, CASE WHEN {free} THEN o.node ELSE s.node END, CASE WHEN {free} THEN s.version + 1 ELSE s.version END, CASE WHEN {free} THEN o.us + 21600000000 ELSE s.expires END FROM s JOIN o ON o.range_id = s.range_id AND o.n = s.n + 1)
       SELECT range_id, arg_max(node, n) AS node, max(version)::BIGINT AS version, arg_max(expires, n) AS expires FROM s GROUP BY 1"""


def _claims(spark, sf_dir):
    return _events(spark, sf_dir).select((F.col("event_id") % 97).alias("range_id"), "us", F.concat(F.lit("node-"), F.col("user_id") % 7).alias("node"))


@query(LEASES.format(free="(s.expires <= o.us OR s.node = o.node)"))
def lease_fold(spark, sf_dir):
    return flow.leases(_claims(spark, sf_dir), "range_id", "us", "node", 21_600_000_000)


@query(LEASES.format(free="s.expires <= o.us"))
def lease_acquire(spark, sf_dir):
    """As lease_fold, but a holder's own claim leaves its lease as it is."""
    return flow.leases(_claims(spark, sf_dir), "range_id", "us", "node", 21_600_000_000, renew=False)


@query(
    """WITH n AS (SELECT max(epoch_us(ts)) AS now FROM events) SELECT user_id, max(epoch_us(ts)) AS last_seen,
       CASE WHEN any_value(now) - max(epoch_us(ts)) > 36000000000 THEN 'DEAD' WHEN any_value(now) - max(epoch_us(ts)) > 10800000000 THEN 'SUSPECT' ELSE 'ALIVE' END AS status FROM events, n GROUP BY 1"""
)
def liveness_status(spark, sf_dir):
    events = _events(spark, sf_dir)
    now = events.agg(F.max("us").alias("now"))
    seen = flow.liveness(events.join(F.broadcast(now)), "user_id", "us", F.col("now"), 10_800_000_000, 36_000_000_000, extra=["now"])
    return seen.drop("now")


LOG = """q AS (SELECT event_id AS lsn, event_id % 3000 AS message_id, user_id % 5 AS queue, CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
  CASE WHEN event_type = 'view' THEN 'dead-letter' ELSE 'pending' END AS status FROM events)"""


@query(
    f"""WITH {LOG}, l AS (SELECT queue, message_id, arg_max(operation, lsn) AS o, arg_max(status, lsn) AS s FROM q GROUP BY 1, 2)
        SELECT queue, count(*) FILTER (o <> 'DELETE' AND NOT (o = 'UPDATE' AND s = 'dead-letter')) AS pending, count(*) FILTER (o = 'DELETE') AS acknowledged, count(*) FILTER (o = 'UPDATE' AND s = 'dead-letter') AS dead FROM l GROUP BY 1"""
)
def queue_recovery_stats(spark, sf_dir):
    operation = F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    status = F.when(F.col("event_type") == "view", "dead-letter").otherwise("pending")
    log = _events(spark, sf_dir).select(F.col("event_id").alias("lsn"), (F.col("event_id") % 3000).alias("message_id"), (F.col("user_id") % 5).alias("queue"), operation.alias("operation"), status.alias("status"))
    return flow.queue_recovery(log, "message_id", "queue", "lsn")


@query(
    """WITH t AS (SELECT l_orderkey AS message_id, min(l_linenumber) FILTER (l_linestatus = 'F') AS ok, max(l_linenumber) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
       SELECT message_id, CASE WHEN ok IS NOT NULL THEN 'completed' WHEN n >= 3 THEN 'dead-letter' ELSE 'pending' END AS status, coalesce(ok, n) AS attempts FROM t"""
)
def queue_delivery(spark, sf_dir):
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_linestatus") == "F").alias("ok"))
    return flow.delivery(attempts, "message_id", "attempt", 3)

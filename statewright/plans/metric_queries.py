"""Queries over metric observations: events are the observations, their type the metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.operators import metrics
from statewright.plans.base import query
from statewright.sources.tables import bus_events, table


def _observed(spark, sf_dir):
    return bus_events(spark, sf_dir).select(F.col("version").alias("seq"), "type", F.col("source_node_id").alias("user_id"), F.unix_micros("ts").alias("us"), "value")


LAST = "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)"
SNAP = f"""h AS (SELECT event_type AS type, count(*) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, avg(value) AS mean,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM {LAST} WHERE r <= 1000 GROUP BY 1)"""


@query("SELECT 'app_' || event_type || '{region=\"eu\",shard=\"' || (user_id % 3) || '\"}' AS series, sum(value) AS value FROM events GROUP BY 1")
def counter_by_labels(spark, sf_dir):
    observed = _observed(spark, sf_dir).select(F.col("type").alias("name"), F.create_map(F.lit("shard"), (F.col("user_id") % 3).cast("string")).alias("labels"), "value")
    return metrics.counters(observed, "app", {"region": "eu", "shard": "none"})


@query(
    """WITH o AS (SELECT user_id, event_id AS seq, value, CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'dec' ELSE 'inc' END AS kind FROM events),
       l AS (SELECT user_id, max(seq) FILTER (kind = 'set') AS s, arg_max(value, seq) FILTER (kind = 'set') AS v FROM o GROUP BY 1)
       SELECT l.user_id, coalesce(any_value(l.v), 0.0) + coalesce(sum(CASE kind WHEN 'inc' THEN value WHEN 'dec' THEN -value ELSE 0 END) FILTER (l.s IS NULL OR seq > l.s), 0.0) AS value
       FROM l JOIN o USING (user_id) GROUP BY 1"""
)
def gauge_values(spark, sf_dir):
    kind = F.when(F.col("type") == "signup", "set").when(F.col("type") == "error", "dec").otherwise("inc")
    return metrics.gauges(_observed(spark, sf_dir).withColumn("kind", kind), "user_id")


@query(f"WITH {SNAP} SELECT * FROM h")
def histogram_snapshot(spark, sf_dir):
    return metrics.histograms(_observed(spark, sf_dir), ["type"], "seq", "value")


@query(
    """SELECT event_id AS seq, event_type AS type, user_id, epoch_us(ts) AS us, value, count(*) OVER w AS rolling_count, sum(value) OVER w AS rolling_sum, quantile_disc(value, 0.9) OVER w AS rolling_p
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""
)
def rolling_histogram(spark, sf_dir):
    return metrics.rolling_histogram(_observed(spark, sf_dir), ["user_id"], "seq", "value", 20, 0.9)


@query(
    """SELECT event_id AS seq, event_type AS type, user_id, epoch_us(ts) AS us, value, quantile_cont(value, 0.95) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS rolling_p FROM events"""
)
def rolling_p95_time(spark, sf_dir):
    return metrics.rolling_linear(_observed(spark, sf_dir), ["type"], "us", "value", 3_600_000_000, 0.95)


_BOUNDS = ", ".join(str(b) for b in metrics.BUCKETS)


@query(
    f"""WITH {SNAP}, b AS (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS le), a AS (SELECT type, count, unnest([min, p50, p90, p99, max]) AS x, unnest([0.0, 0.5, 0.9, 0.99, 1.0]) AS f FROM h),
        p AS (SELECT type, le, any_value(count) AS n, arg_max(x, (x, f)) FILTER (x <= le) AS x0, max((x, f)) FILTER (x <= le) AS lo, min((x, f)) FILTER (x > le) AS hi FROM a, b GROUP BY type, le)
        SELECT type, le, CASE WHEN le = 'inf' THEN n WHEN lo IS NULL THEN 0 WHEN hi IS NULL THEN n
          ELSE floor((lo[2] + (le - lo[1]) / (hi[1] - lo[1]) * (hi[2] - lo[2])) * n + 0.5) END::BIGINT AS cumulative FROM p"""
)
def prometheus_buckets(spark, sf_dir):
    return metrics.cumulative_counts(metrics.histograms(_observed(spark, sf_dir), ["type"], "seq", "value"), ["type"])


@query(f"WITH b AS (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS le) SELECT event_type AS type, le, count(*) FILTER (value <= le) AS cumulative FROM events, b GROUP BY 1, 2")
def exact_buckets(spark, sf_dir):
    return metrics.exact_cumulative_counts(_observed(spark, sf_dir), ["type"], "value")


DAYS = "d AS (SELECT event_type AS type, date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY 1, 2)"


def _days(spark, sf_dir):
    """Daily totals by type, with the day's start in microseconds."""
    days = bus_events(spark, sf_dir).groupBy("type", F.unix_micros(F.date_trunc("day", "ts")).alias("us")).agg(F.sum("value").alias("total"))
    return days


@query(
    f"""WITH {DAYS}, f AS (SELECT type, epoch_us(day) AS us, total, first_value(total) OVER w AS a FROM d WINDOW w AS (PARTITION BY type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
        c AS (SELECT *, CASE WHEN a = 0 AND total = 0 THEN 0.0 ELSE (total - a) / nullif(a, 0) END AS change FROM f)
        SELECT type, us, total, change, CASE WHEN change > 0.1 THEN 'increasing' WHEN change < -0.1 THEN 'decreasing' WHEN change IS NOT NULL THEN 'stable' END AS trend FROM c"""
)
def metric_trend(spark, sf_dir):
    return metrics.trend(_days(spark, sf_dir), ["type"], "us", "total")


@query(
    f"""WITH {DAYS}, r AS (SELECT type, epoch_us(day) AS us, total, total - lag(total) OVER (PARTITION BY type ORDER BY day) AS rate FROM d)
        SELECT *, CASE WHEN rate > 0 THEN 'up' WHEN rate < 0 THEN 'down' WHEN rate IS NOT NULL THEN 'stable' END AS direction, total + rate AS after_1, total + 6 * rate AS after_6, total + 24 * rate AS after_24 FROM r"""
)
def step_prediction(spark, sf_dir):
    return metrics.step_change(_days(spark, sf_dir), ["type"], "us", "total")


@query(
    f"""WITH {DAYS}, f AS (SELECT type, epoch_us(day) AS us, total, coalesce((total - first_value(total) OVER w) / nullif(epoch_us(day) - first_value(epoch_us(day)) OVER w, 0), 0.0) AS s FROM d
          WINDOW w AS (PARTITION BY type ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
        SELECT type, us, total, greatest(0.0, total + s * 3600000000) AS in_1h, greatest(0.0, total + s * 6 * 3600000000) AS in_6h, greatest(0.0, total + s * 24 * 3600000000) AS in_24h FROM f"""
)
def growth_projection(spark, sf_dir):
    return metrics.growth(_days(spark, sf_dir), ["type"], "us", "total")


@query(
    """WITH f AS (SELECT user_id, event_id, (event_type = 'error')::INTEGER AS f FROM events), s AS (SELECT user_id, f = 1 AND coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY event_id), 0) = 0 AS starts FROM f)
       SELECT user_id, sum(starts::INTEGER)::BIGINT AS islands FROM s GROUP BY 1"""
)
def failure_islands(spark, sf_dir):
    return metrics.failure_islands(_observed(spark, sf_dir), ["user_id"], "seq", F.col("type") == "error")


@query(f"""WITH {SNAP}, b AS (SELECT unnest([{_BOUNDS}]) AS le), e AS (SELECT event_type AS type, le, count(*) FILTER (value <= le) AS c FROM events, b GROUP BY 1, 2)
        SELECT 'latency_bucket{{type="' || type || '",le="' || regexp_replace(le::VARCHAR, '\\.0$', '') || '"}} ' || c AS line FROM e
        UNION ALL SELECT 'latency_bucket{{type="' || event_type || '",le="+Inf"}} ' || count(*) FROM events GROUP BY event_type
        UNION ALL SELECT '# HELP latency Time taken' UNION ALL SELECT '# TYPE latency histogram' UNION ALL SELECT 'latency_sum{{type="' || type || '"}} ' || sum FROM h UNION ALL SELECT 'latency_count{{type="' || type || '"}} ' || count FROM h""")
def prometheus_text(spark, sf_dir):
    observed = _observed(spark, sf_dir)
    return metrics.prometheus_lines(metrics.exact_cumulative_counts(observed, ["type"], "value"), metrics.histograms(observed, ["type"], "seq", "value"), "latency", "type", "Time taken")


@query("SELECT 'orders,status=' || o_orderstatus || ',priority=' || substr(o_orderpriority, 1, 1) || ' customer=' || o_custkey || ' ' || epoch_ms(o_orderdate) || '000000' AS line FROM orders")
def influx_export(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_custkey").alias("customer"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms")
    )
    return metrics.influx_lines(orders, "orders", ["status", "priority"], ["customer"], "ms")


@query("""SELECT '{"source":"tracker","metrics":{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' AS line FROM orders""")
def json_export(spark, sf_dir):
    return metrics.json_envelope(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")), "tracker")

"""Queries over workflow runs: an order is a join, its lines are the arrivals, shipped lines (F) the successes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewright.functions import columns
from statewright.operators import workflow
from statewright.plans.base import query
from statewright.sources.tables import table

ARRIVALS = """a AS (SELECT l_orderkey AS run_id, l_linenumber AS arrival_no, l_linestatus = 'F' AS ok, l_quantity, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1),
  r AS (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY run_id ORDER BY arrival_no) AS g, sum((NOT ok)::INTEGER) OVER (PARTITION BY run_id ORDER BY arrival_no) AS b, count(*) OVER (PARTITION BY run_id) AS m FROM a)"""


def _arrivals(spark, sf_dir):
    """One arrival a run and number."""
    lines = table(spark, sf_dir, "lineitem")
    first = F.min_by(F.struct("l_linestatus", "l_quantity", "l_returnflag"), F.struct("l_partkey", "l_suppkey"))
    rows = lines.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("arrival_no")).agg(first.alias("x"))
    return rows.select("run_id", "arrival_no", (F.col("x.l_linestatus") == "F").alias("ok"), "x.l_quantity", "x.l_returnflag")


@query(f"WITH {ARRIVALS}, f AS (SELECT *, CASE WHEN b = 0 THEN 'completed' ELSE 'failed' END AS outcome FROM r WHERE g + b >= m) SELECT run_id, min(arrival_no) AS fire_no, arg_min(outcome, arrival_no) AS outcome FROM f GROUP BY 1")
def join_fire_all(spark, sf_dir):
    return workflow.firings(_arrivals(spark, sf_dir), ["run_id"], "arrival_no", "all")


@query(f"WITH {ARRIVALS}, f AS (SELECT *, CASE WHEN g >= 1 THEN 'completed' ELSE 'failed' END AS outcome FROM r WHERE g >= 1 OR m - b < 1) SELECT run_id, min(arrival_no) AS fire_no, arg_min(outcome, arrival_no) AS outcome FROM f GROUP BY 1")
def join_fire_any(spark, sf_dir):
    return workflow.firings(_arrivals(spark, sf_dir), ["run_id"], "arrival_no", "any")


@query(f"WITH {ARRIVALS}, f AS (SELECT *, CASE WHEN g >= 2 THEN 'completed' ELSE 'failed' END AS outcome FROM r WHERE g >= 2 OR m - b < 2) SELECT run_id, min(arrival_no) AS fire_no, arg_min(outcome, arrival_no) AS outcome FROM f GROUP BY 1")
def join_fire_n_of_m(spark, sf_dir):
    return workflow.firings(_arrivals(spark, sf_dir), ["run_id"], "arrival_no", "n_of_m", 2)


@query(f"WITH {ARRIVALS}, f AS (SELECT run_id, min(arrival_no) AS fire_no FROM r WHERE g >= 1 OR m - b < 1 GROUP BY 1) SELECT a.run_id, a.arrival_no FROM a JOIN f USING (run_id) WHERE arrival_no > fire_no")
def join_late_arrivals(spark, sf_dir):
    arrivals = _arrivals(spark, sf_dir)
    return workflow.late(arrivals, workflow.firings(arrivals, ["run_id"], "arrival_no", "any"), ["run_id"], "arrival_no").select("run_id", "arrival_no")


@query(f"WITH {ARRIVALS} SELECT run_id, l_returnflag AS name, arg_max(l_quantity, arrival_no) AS value FROM a GROUP BY 1, 2")
def context_last_writer(spark, sf_dir):
    return workflow.merged_context(_arrivals(spark, sf_dir).withColumnsRenamed({"l_returnflag": "name", "l_quantity": "value"}), ["run_id"], "arrival_no", "name", "value", "last-writer-wins")


@query(f"WITH {ARRIVALS} SELECT run_id, l_returnflag AS name, string_agg(l_quantity::BIGINT::VARCHAR, ',' ORDER BY arrival_no) AS value FROM a GROUP BY 1, 2")
def context_array_collect(spark, sf_dir):
    rows = _arrivals(spark, sf_dir).withColumnRenamed("l_returnflag", "name").withColumn("value", F.col("l_quantity").cast("long").cast("string"))
    return workflow.merged_context(rows, ["run_id"], "arrival_no", "name", "value", "array-collect").withColumn("value", F.array_join("value", ","))


@query(
    f"""WITH {ARRIVALS}, y AS (SELECT run_id, arrival_no, l_quantity > 10 AS approve, sum((l_quantity > 10)::INTEGER) OVER (PARTITION BY run_id ORDER BY arrival_no) AS yes FROM a)
        SELECT run_id, min(arrival_no) AS decided_at, CASE WHEN arg_min(approve, arrival_no) THEN 'approved' ELSE 'rejected' END AS result FROM y WHERE NOT approve OR yes >= 3 GROUP BY 1"""
)
def approvals(spark, sf_dir):
    return workflow.approvals(_arrivals(spark, sf_dir).withColumn("approve", F.col("l_quantity") > 10), ["run_id"], "arrival_no", 3)


RUNS = """e AS (SELECT event_id // 4 AS run_id, CASE event_id % 4 WHEN 0 THEN 'started' WHEN 1 THEN 'step' WHEN 2 THEN 'completed' ELSE CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'step' ELSE 'completed' END END AS kind, epoch_us(ts) AS us, user_id % 10 AS pipeline FROM events),
  d AS (SELECT run_id, min(us) FILTER (kind = 'started') AS a, max(us) FILTER (kind IN ('completed', 'failed')) AS z, arg_max(kind, (us, kind)) FILTER (kind IN ('completed', 'failed')) AS s FROM e GROUP BY 1)"""


def _runs(spark, sf_dir):
    last = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "step").otherwise("completed")
    place = F.col("event_id") % 4
    kind = F.when(place == 0, "started").when(place == 1, "step").when(place == 2, "legacy:completed").otherwise(last)
    events = table(spark, sf_dir, "events").select(F.expr("event_id div 4").alias("run_id"), kind.alias("kind"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return workflow.durations(workflow.canonical(events, "kind", {"legacy:completed": "completed"}), ["run_id"], "kind", "us")


@query(f"WITH {RUNS} SELECT run_id, coalesce(s, 'running') AS status, z - a AS duration FROM d")
def run_durations(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(
    f"""WITH {RUNS}, x AS (SELECT run_id % 10 AS pipeline, coalesce(s, 'running') AS status, z - a AS duration FROM d)
        SELECT pipeline, count(*) AS started, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, avg(duration) FILTER (status = 'completed') AS mean_duration,
          count(*) FILTER (status = 'failed') / count(*) AS error_rate, count(*) FILTER (status = 'failed') / count(*) > 0.1 AS warning FROM x GROUP BY 1"""
)
def run_metrics(spark, sf_dir):
    return workflow.run_metrics(_runs(spark, sf_dir).withColumn("pipeline", F.col("run_id") % 10), ["pipeline"])


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS source, t.t AS target FROM part, (SELECT unnest([2, 3]) AS k) x, LATERAL (SELECT p_partkey * x.k AS t) t),
       w(node, depth) AS (SELECT 1::BIGINT, 0 UNION ALL SELECT e.target, depth + 1 FROM w JOIN e ON e.source = w.node) SELECT node, min(depth) AS depth FROM w GROUP BY 1"""
)
def graph_reachable(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    edges = parts.select(F.col("p_partkey").alias("source"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 3)).alias("target"))
    return workflow.reachable(spark, edges, 1)


@query(
    """WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'join' ELSE 'step' END AS type FROM part), e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS source, l_partkey + 40 * l_linenumber AS target FROM lineitem),
       d AS (SELECT id, source AS node FROM e UNION ALL SELECT id, target FROM e)
       SELECT DISTINCT 'unknown-node' AS code, id FROM d WHERE node NOT IN (SELECT id FROM n) UNION ALL SELECT 'isolated-node', id FROM n WHERE id NOT IN (SELECT node FROM d)
       UNION ALL SELECT 'join-with-one-input', n.id FROM n LEFT JOIN (SELECT target, count(*) AS c FROM e GROUP BY 1) i ON i.target = n.id WHERE type = 'join' AND coalesce(c, 0) < 2"""
)
def graph_validation(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "join").otherwise("step").alias("type"))
    edges = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("source"), (F.col("l_partkey") + 40 * F.col("l_linenumber")).alias("target")
    )
    return workflow.graph_errors(nodes, edges)


@query("SELECT event_id, json_extract_string(props, '$.k') = '7' AS taken, 'k is ' || coalesce(json_extract_string(props, '$.k'), '') || '!' AS message FROM events")
def condition_and_template(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", columns.condition("context.k === 7", F.col("props")).alias("taken"), columns.template("k is {{context.k}}!", F.col("props")).alias("message"))


@query(
    """SELECT c_custkey AS id, least(30000.0, 100.0 * pow(2.0, c_custkey % 10)) AS exponential, least(500.0, 40.0 * (c_custkey % 20 + 1)) AS linear, lpad(c_custkey::VARCHAR, 8, '0') AS padded FROM customer"""
)
def backoff_and_padding(spark, sf_dir):
    attempt = F.col("c_custkey") % 10 + 1
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), columns.exponential_backoff(attempt, 100.0, 2.0, 30000.0).alias("exponential"), columns.linear_backoff(F.col("c_custkey") % 20 + 1, 40.0, 500.0).alias("linear"), columns.padded(F.col("c_custkey")).alias("padded")
    )


@query(
    """WITH h AS (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296) AS f FROM customer),
       s AS (SELECT c_custkey, CASE WHEN f >= 2147483648 THEN f - 4294967296 ELSE f END AS hash FROM h) SELECT c_custkey, hash, abs(hash) % 16 AS range_id FROM s"""
)
def string_hash_buckets(spark, sf_dir):
    """Range of each customer name; a unit test compares the hash with a plain loop."""
    return table(spark, sf_dir, "customer").select("c_custkey", columns.string_hash(F.col("c_name")).alias("hash"), columns.bucket_of(F.col("c_name"), 16).alias("range_id"))

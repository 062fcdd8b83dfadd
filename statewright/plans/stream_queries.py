"""The stream forms over the events table, drained; they give what the batch forms give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from statewright.operators import flow
from statewright.operators.flow import SharedState
from statewright.plans.base import query
from statewright.plans.flow_queries import TOKENS
from statewright.sources.scratch import shared_path
from statewright.sources.tables import table
from statewright.streaming import events as streams


#: Rows of a file of a batch.
FILE_ROWS = 250_000
SCHEMA = "event_id bigint, user_id bigint, type string, ts timestamp, us bigint, value double"


def _events(spark, sf_dir, repeats=False):
    """The events as a stream of four batches in time order, of as many files each; with ``repeats`` each batch has a tenth of the
    rows of the one before it again."""
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("type"), at.alias("ts"), F.unix_micros(at).alias("us"), "value")
    ends = rows.agg(F.min("us").alias("a"), F.max("us").alias("z"))
    n = 1 + rows.count() // (4 * FILE_ROWS)
    part = F.least(F.lit(3), F.floor((F.col("us") - F.col("a")) * 4 / F.greatest(F.lit(1), F.col("z") - F.col("a")))).cast("int")
    rows = rows.join(F.broadcast(ends)).withColumn("part", part).drop("a", "z")
    if repeats:
        rows = rows.unionByName(rows.filter("event_id % 10 = 0 AND part < 3").withColumn("part", F.col("part") + 1))
    path = shared_path(spark, "event-files")
    for k in range(4):  # one batch after the other, so that files come in this order
        batch = rows.filter(F.col("part") == k).drop("part")
        (batch.repartition(n, "event_id") if n > 1 else batch.coalesce(1)).write.mode("append").parquet(path)
        for _ in range((k + 1) * n - len(spark.read.schema(SCHEMA).parquet(path).inputFiles())):  # tasks without rows write no file
            batch.limit(0).coalesce(1).write.mode("append").parquet(path)
    return streams.event_stream(spark, path, SCHEMA, n)


@query("SELECT event_type AS type, epoch_us(date_trunc('day', ts)) AS day_us, sum(value) AS total, count(*) AS events FROM events GROUP BY 1, 2")
def stream_daily_counters(spark, sf_dir):
    """Four batches add to the same state."""
    counts = streams.rolling_counters(_events(spark, sf_dir), ["type"], "ts", "value", "1 day", "1 hour")
    return streams.drained(counts, "complete").select("type", F.unix_micros("start").alias("day_us"), "total", "events")


@query("SELECT event_id, event_type AS type FROM events")
def stream_dedup(spark, sf_dir):
    """A tenth of the rows come again in the batch after; they are dropped by the state."""
    rows = streams.once(_events(spark, sf_dir, repeats=True), "event_id", "ts", "400 days").select("event_id", "type")
    return streams.drained(rows)


@query(TOKENS.replace("SELECT event_id, user_id, allowed, tokens, retry_after", "SELECT event_id, user_id, allowed"))
def stream_token_bucket(spark, sf_dir):
    """The batch token bucket, with its state carried over four batches."""
    return streams.drained(streams.token_bucket(_events(spark, sf_dir), "user_id", "us", "event_id", 1 / 7200, 3.0))


class Totals(SharedState):
    """A session's state: how many updates of each kind."""

    def apply(self, state, update):
        return {**state, update: state.get(update, 0) + 1}

    def serialize(self, state):
        return json.dumps(state, sort_keys=True, separators=(",", ":"))


@query(
    """WITH c AS (SELECT user_id, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id, sum(n)::BIGINT AS updates, '{' || string_agg('"' || t || '":' || n, ',' ORDER BY t) || '}' AS state FROM c GROUP BY 1"""
)
def stream_session_state(spark, sf_dir):
    """The last state of each session over four batches."""
    states = streams.drained(streams.session_state(_events(spark, sf_dir), "user_id", ["us", "event_id"], "type", Totals(), json.loads), "update")
    return states.groupBy("user_id").agg(F.max("updates").alias("updates"), F.max_by("state", "updates").alias("state"))


@query(
    """WITH c AS (SELECT user_id, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2)
       SELECT user_id, sum(n)::BIGINT AS updates, '{' || string_agg('"' || t || '":' || n, ',' ORDER BY t) || '}' AS state FROM c GROUP BY 1"""
)
def session_states(spark, sf_dir):
    """The batch form of the same fold."""
    return flow.session_states(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", Totals())


@query("SELECT event_id AS version, event_type AS type FROM events WHERE event_type IN ('view', 'error') AND event_id % 7 = 0")
def subscription_dead_letters(spark, sf_dir):
    """Of the events of two types, each seventh one fails; those alone are dead letters."""
    state = shared_path(spark, "subscription")

    def handle(event):
        if event["version"] % 7 == 0:
            raise ValueError("refused")

    stream = _events(spark, sf_dir).withColumnRenamed("event_id", "version")
    streams.subscribe_each(stream, ["view", "error"], handle, state, f"{state}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{state}/dead").select("version", "type")

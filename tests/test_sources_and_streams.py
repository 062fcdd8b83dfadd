import json

from pyspark.sql import functions as F

from statewright.operators import flow
from statewright.sources import wal
from statewright.streaming import events as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"
SCHEMA = "event_id bigint, us bigint, ts timestamp, user_id bigint, type string, value double"


def log_changes(spark, n):
    rows = [(k, f"e{k % 5}", f"n{k % 3}", k, 1000 + k, "DELETE" if k % 7 == 0 else "UPDATE") for k in range(n)]
    return spark.createDataFrame(rows, "k long, entity_id string, owner string, version long, changed_at long, operation string").withColumn("ts", F.lit(5))


def test_log_files(spark, tmp_path):
    path = str(tmp_path / "log")
    wal.append(log_changes(spark, 50), path, 1, "k")
    wal.append(log_changes(spark, 20), path, 51, "k")
    bad = json.dumps({"logSequenceNumber": 999, "timestamp": 1, "checksum": "00", "data": {"entityId": "x"}}, separators=(",", ":"))
    spark.createDataFrame([("not json",), (bad,)], "value string").write.mode("append").text(path)
    found = wal.read(spark, path).collect()
    assert sorted(r.lsn for r in found) == list(range(1, 71))
    first = {r.lsn: r.version for r in found}
    assert [first[k] for k in range(1, 51)] == list(range(50))
    assert sorted(r.lsn for r in wal.read(spark, path, 10, 20).collect()) == list(range(10, 21))
    assert wal.truncated(wal.read(spark, path), 60).count() == 11
    parts = wal.segments(spark, path).collect()
    assert sum(p.entry_count for p in parts) == 71 and sum(p.tombstone_count for p in parts) == 8 + 3
    states = str(tmp_path / "states")
    for lsn in (10, 20, 30):
        wal.write_checkpoint(spark.range(lsn), states, lsn)
    assert wal.read_checkpoint(spark, states).count() == 30 and wal.read_checkpoint(spark, states, 25).count() == 20
    seeds = wal.seed_nodes(spark, "seeds:\n  - a: 10.0.0.1:7000  # first\n  - host.example:7001\n").collect()
    assert [tuple(s) for s in seeds] == [("a", "10.0.0.1", 7000), ("host.example", "host.example", 7001)]


def files(spark, tmp_path):
    """The events as four files in time order."""
    rows = spark.read.parquet(EVENTS).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("type"), "value")
    n = rows.count()
    for k in range(4):
        rows.filter(f"event_id >= {k * n // 4} AND event_id < {(k + 1) * n // 4}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in")


def finished(stream, tmp_path, spark, mode="append"):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.parquet(out)


def test_sessions_equal_the_batch_form(spark, tmp_path):
    rows, path = files(spark, tmp_path)
    got = finished(streams.sessions(streams.event_stream(spark, path, SCHEMA), ["user_id"], "ts", "2 hours", "1 hour"), tmp_path, spark).collect()
    want = {tuple(r) for r in flow.sessions(rows, ["user_id"], "ts", "2 hours").collect()}
    newest = rows.agg(F.max("us")).first()[0]
    open_ = {w for w in want if w[2].timestamp() * 1e6 > newest - 4 * 3600e6}
    assert {tuple(r) for r in got} <= want and want - {tuple(r) for r in got} <= open_


def test_token_bucket_equals_the_batch_form(spark, tmp_path):
    rows, path = files(spark, tmp_path)
    got = finished(streams.token_bucket(streams.event_stream(spark, path, SCHEMA, 4), "user_id", "us", "event_id", 1 / 7200, 3.0), tmp_path, spark)
    want = flow.token_bucket(rows, ["user_id"], "us", "event_id", 1 / 7200, 3.0)
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_dedup_and_windows_run(spark, tmp_path):
    _, path = files(spark, tmp_path)
    kept = finished(streams.once(streams.event_stream(spark, path, SCHEMA), "event_id", "ts", "1 hour"), tmp_path, spark)
    assert kept.count() == kept.select("event_id").distinct().count() > 0


def test_subscription_resumes_and_keeps_failures(spark, tmp_path):
    rows, path = files(spark, tmp_path)
    seen, dead = [], str(tmp_path / "dead")

    def handle(batch, number):
        if number == 1:
            raise ValueError("no")
        seen.extend(r.event_id for r in batch.collect())

    for _ in range(2):  # the second run has nothing left to do
        streams.subscribe(streams.event_stream(spark, path, SCHEMA), ["view", "click"], handle, dead, str(tmp_path / "cp")).awaitTermination(120)
    lost = [r.event_id for r in spark.read.parquet(dead).collect()]
    assert sorted(seen + lost) == sorted(r.event_id for r in rows.filter("type IN ('view', 'click')").collect()) and lost

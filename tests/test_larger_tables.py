"""What larger tables and odd inputs broke."""

import hashlib
import json

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from statewright.functions import columns, digests
from statewright.operators import metrics, placement, workflow
from statewright.plans import added_queries, stream_queries
from statewright.plans.registry import ORACLES
from statewright.sources import wal
from statewright.streaming import events as streams


def test_csv_times_are_the_nearest_millisecond(spark):
    """As DuckDB's epoch_ms rounds; the text has the milliseconds that have passed."""
    want = {-1500: -2, -1400: -1, -501: -1, -500: -1, -499: 0, 0: 0, 499: 0, 500: 1, 1499: 1, 1500: 2, 999_999: 1000}
    df = spark.createDataFrame([(u,) for u in want], "us long")
    assert {r.us: r.ms for r in df.select("us", columns.nearest_millis(F.col("us")).alias("ms")).collect()} == want
    row = df.filter("us = 1500").select("us", F.expr("us div 1000").alias("timestamp"), *[F.lit(1).alias(c) for c in metrics.CSV_COLUMNS[1:]])
    got = metrics.csv_lines(row, columns.nearest_millis(F.col("us"))).first()
    assert got.at == 2 and got.line.startswith("1970-01-01T00:00:00.001Z,1,")


def test_candidates_that_agree_are_scored_once(spark):
    parts = spark.range(200).select("id", (F.col("id") * 7 % 50).alias("size"))
    nodes = spark.range(900).select(F.col("id").alias("node"), (F.col("id") * 37 % 20 / 20.0).alias("cpu"))
    near = lambda _, node: F.abs(node.cpu * 50 - F.col("size"))
    for least in (True, False):
        every, few = (placement.placed(parts, "id", nodes, near, least, by) for by in (None, ["cpu"]))
        assert {tuple(r) for r in every.collect()} == {tuple(r) for r in few.collect()} and few.count() == 200


def test_keys_are_routed_by_many_tasks(spark):
    members = spark.range(40).select("id", F.lit("ALIVE").alias("status"), F.lit("z").alias("zone"))
    found = placement.routed(spark.range(0, 50, 1, 1), "id", "random", None, members, 3, seed=5)
    assert found.rdd.getNumPartitions() >= 32 and {len(set(r.nodes)) for r in found.collect()} == {3}


@pytest.mark.parametrize("strategy", ("round-robin", "first", "local-preferred", "random"))
def test_endpoints_are_met_by_turn(spark, strategy):
    ends = [(s, e, e % 4) for s in range(3) for e in range(s, 60, s + 2)]
    endpoints = spark.createDataFrame(ends, "service long, endpoint long, node long")
    requests = spark.range(400).select((F.col("id") % 4).alias("service"), F.col("id").alias("n"), (F.col("id") % 5).alias("here"))
    df = placement.endpoint_of(requests, endpoints, "service", "n", "endpoint", strategy, "here", 3)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.n: r.endpoint for r in df.collect()}
    draws = {r.n: r.d for r in requests.select("n", F.xxhash64("n", F.lit(3)).alias("d")).collect()}
    for n in range(400):
        own = sorted(e for s, e, _ in ends if s == n % 4)
        turn = 0 if strategy == "first" else draws[n] if strategy == "random" else n
        here = [e for e in own if e % 4 == n % 5] if strategy == "local-preferred" else []
        assert got[n] == ((here or [own[turn % len(own)]])[0] if own else None)


def test_a_batch_is_whole_whatever_the_files(spark, tmp_path, monkeypatch):
    """Batches of several files, some of them empty, and with repeats."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 7)
    at = F.timestamp_seconds(F.col("id") * F.col("id") + 1_000_000)
    rows = spark.range(100).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    for repeats in (False, True):
        seen = []
        stream = stream_queries._events(spark, str(tmp_path), repeats)
        stream.writeStream.foreachBatch(lambda b, k: seen.append(sorted(r.event_id for r in b.collect()))).option("checkpointLocation", str(tmp_path / f"c{repeats}")).trigger(availableNow=True).start().awaitTermination(120)  # noqa: B023
        part = [[i for i in range(100) if min(3, i * i * 4 // 9801) == k] for k in range(4)]
        again = [[], *[[i for i in p if i % 10 == 0] for p in part[:3]]] if repeats else [[]] * 4
        assert seen == [sorted(a + b) for a, b in zip(part, again, strict=True)]


def test_state_of_many_keys_is_held_by_groups(spark, tmp_path, monkeypatch):
    """Keys of one group and null keys have states of their own over batches; groups do not grow with the keys."""
    monkeypatch.setattr(streams, "GROUPS", 2)
    schema, path = "key bigint, us bigint, ts timestamp, type string", str(tmp_path / "in")
    key = F.when(F.col("id") % 9 != 0, F.col("id") % 9 + (1 << 60))
    rows = spark.range(360).select(key.alias("key"), (F.col("id") * 1_000_000).alias("us"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("t"), F.col("id") % 5).alias("type"))
    for k in range(3):
        rows.filter(f"us div 120000000 = {k}").coalesce(1).write.mode("append").parquet(path)
    load = json.loads
    states = streams.drained(streams.session_state(streams.event_stream(spark, path, schema), "key", ["us"], "type", stream_queries.Totals(), load), "update")
    got = {r.key: (r.n, load(r.s)) for r in states.groupBy("key").agg(F.max("updates").alias("n"), F.max_by("state", "updates").alias("s")).collect()}
    assert got == {k and k + (1 << 60): (40, {f"t{t}": 8 for t in range(5)}) for k in (None, *range(1, 9))}
    bucket = streams.drained(streams.token_bucket(streams.event_stream(spark, path, schema), "key", "us", "us", 0.05, 3.0).toDF("key", "seq", "allowed"))
    want = {}
    for k in range(9):
        tokens, last = 3.0, k
        for t in range(k, 360, 9):
            tokens, last = min(3.0, tokens + (t - last) * 0.05), t
            want[t * 1_000_000] = tokens >= 1
            tokens -= tokens >= 1
    assert {r.seq: r.allowed for r in bucket.collect()} == want


def test_idle_sessions_of_a_group_start_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "GROUPS", 1)
    schema, path = "key bigint, ts timestamp, type string", str(tmp_path / "in")
    batches = ([(1, 0), (2, 0)], [(1, 100)], [(1, 200)], [(1, 300), (3, 300)], [(1, 310), (2, 310)])
    for batch in batches:
        spark.createDataFrame(batch, "key long, s long").select("key", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), F.lit("a").alias("type")).coalesce(1).write.mode("append").parquet(path)
    events = streams.event_stream(spark, path, schema).withWatermark("ts", "10 seconds")
    states = streams.drained(streams.session_state(events, "key", ["ts"], "type", stream_queries.Totals(), json.loads, 150_000_000, "ts"), "update").collect()
    assert sorted((r.key, r.updates) for r in states) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 1), (3, 1)]


def test_log_lines_are_parsed_once_and_whole_files_stay(spark, tmp_path):
    path = tmp_path / "log"
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit("e").alias("entity_id"), F.lit("n").alias("owner"), F.col("id").alias("version"), F.lit(0).alias("changed_at"), F.lit("UPDATE").alias("operation"), F.lit(1).alias("ts"))
    for k in range(4):
        wal.append(rows.filter(f"k div 100 = {k}").withColumn("k", -F.col("k")), str(path), 100 * k + 1, "k")
    assert wal.read(spark, str(path))._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    got = {r.lsn: r.version for r in wal.read(spark, str(path)).collect()}
    assert got == {100 * k + i + 1: 100 * k + 99 - i for k in range(4) for i in range(100)}
    names = {f.name for f in path.iterdir() if f.name.startswith("part-")}
    wal.truncate(spark, str(path), 151)
    assert sorted(r.lsn for r in wal.read(spark, str(path)).collect()) == list(range(151, 401))
    assert len(names & {f.name for f in path.iterdir()}) >= len(names) // 2
    with_operation = wal.replayed(wal.read(spark, str(path)), lambda e: 1 // (e["lsn"] % 2), keep=["operation"]).collect()
    assert len(with_operation) == 250 and {(r.operation, r.error is None) for r in with_operation if r.lsn % 2} == {("UPDATE", True)}


def test_ways_of_a_graph_are_joined_once(spark):
    nodes = spark.createDataFrame([(k, "step") for k in range(30)], "id long, type string")
    edges = spark.createDataFrame([(k, k, k + 1, "out") for k in range(29)], "id long, source long, target long, source_handle string")
    outcomes = nodes.select(F.lit(0).alias("run"), F.col("id").alias("node"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("handle"))
    found = workflow.traversed(nodes, edges, outcomes, spark.range(1).select(F.lit(0).alias("run"), F.col("id").alias("node")))
    assert {r.node: r.depth for r in found.collect()} == {k: k for k in range(30)}


def test_rolling_percentile_by_slices(spark):
    """Rows of equal time, frames that reach over slices, nulls and no numbers, against a plain loop."""
    rows = [(k % 2, k * k % 997 * 10, None if k % 11 == 0 else float("nan") if k % 97 == 5 else float(k * 7 % 50)) for k in range(600)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n long, key long, us long, value double")
    got = {r.n: r.rolling_p for r in metrics.rolling_linear(df, ["key"], "us", "value", 100, 0.95).collect()}
    want = df.select("n", F.percentile("value", 0.95).over(Window.partitionBy("key").orderBy("us").rangeBetween(-100, 0)).alias("p"))
    assert {k: str(v) for k, v in got.items()} == {r.n: str(r.p) for r in want.collect()} and len(got) == 600


def test_joins_beyond_twelve_edges_are_not_reported_to(spark, tmp_path):
    """A chain of doubled steps whose only join is thirteen edges behind the first branch."""
    chain = [95 * 2**k for k in range(14)]
    parts = spark.createDataFrame([(p,) for p in (*chain, chain[-1] // 3)], "p_partkey long")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = {r.branch: (r.join_id, r.edge_id) for r in added_queries.first_joins(spark, str(tmp_path)).collect()}
    assert got[95 * 4] == (None, None) and got[95 * 2 * 4] == (chain[-1] // 3, chain[-1] * 4 + 2)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert {(b, *j) for b, j in got.items()} == set(con.execute(ORACLES["first_joins"]).fetchall())
    nodes, edges = added_queries._graph(spark, str(tmp_path))
    whole = workflow.first_joins(nodes, edges, edges.filter("id = 380").select("id")).first()
    assert tuple(whole) == (95 * 4, chain[-1] // 3, chain[-1] * 4 + 2)


def test_every_order_is_routed_at_random(spark):
    sf_dir = "/root/testdata/sf0.001"
    orders = {r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect()}
    assert {r.id for r in added_queries.routes_at_random(spark, sf_dir).collect()} == orders


def test_least_hashes_of_all_pairs(monkeypatch):
    """Messages of one and of several blocks, heads and tails that share words, against hashlib pair by pair."""
    names = ["", "7", "a", "é", "b:1", *(str(k) for k in range(95, 130)), "x" * 60, "y" * 60, "z" * 130]
    keys = [None, "", "1", "é", "123", "1234", *(str(k) for k in range(4990, 5010)), "k" * 50, "k" * 63, "l" * 64, "m" * 140]
    hashed = lambda k, n: hashlib.md5(("" if k is None else f"{k}:").encode() + f"{n}:5".encode()).hexdigest()
    want = [sorted(names, key=lambda n: (hashed(k, n), n)) for k in keys]
    for block, held in ((1 << 15, 1 << 22), (3, 1), (64, 100)):
        monkeypatch.setattr(digests, "BLOCK", block)
        monkeypatch.setattr(digests, "HELD", held)
        for count in (0, 1, 3, 99):
            assert digests.least(keys, names, "5", count) == [w[:count] for w in want]
    assert digests.least(["1"], [], "5", 3) == [[]]


def test_keys_at_random_are_hashed_by_batches(spark):
    """No expression hashes pair by pair; rows with equal or null keys keep their other columns."""
    members = spark.range(45).select("id", F.when(F.col("id") % 9 == 0, "DEAD").otherwise("ALIVE").alias("status"), F.lit("z").alias("zone"))
    keys = spark.range(3000).select(F.when(F.col("id") % 100 != 7, F.expr("id div 2")).alias("k"), F.col("id").alias("n"))
    df = placement.routed(keys, "k", "random", None, members, 3, seed=5)
    assert "md5(" not in df._jdf.queryExecution().optimizedPlan().toString() and df.columns == ["k", "n", "nodes"]
    alive = [str(k) for k in range(45) if k % 9]
    hashed = lambda k, n: hashlib.md5(f"{'' if k is None else f'{k}:'}{n}:5".encode()).hexdigest()
    got = {r.n: (r.k, r.nodes) for r in df.collect()}
    assert len(got) == 3000
    for n, (k, nodes) in got.items():
        assert k == (n // 2 if n % 100 != 7 else None) and nodes == sorted(alive, key=lambda m: (hashed(k, m), m))[:3]
    nobody = placement.routed(keys, "k", "random", None, members.filter("false"), 3, seed=5)
    assert {(r.n, *r.nodes) for r in nobody.collect()} == {(n,) for n in range(3000)}
    assert placement.routed(keys.filter("false"), "k", "random", None, members, 3, seed=5).count() == 0

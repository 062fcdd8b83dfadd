"""Log files at a size where Spark plans matter, graph walks, deltas, streams of several files, and plain-Python checks."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from statewright.functions import columns
from statewright.operators import compaction, diff, logs, metrics, placement, quorum, workflow
from statewright.sources import wal
from statewright.streaming import events as streams


def test_append_of_many_rows(spark, tmp_path):
    """Each row once, numbered without a gap in order, while Spark coalesces and splits partitions as it likes."""
    n, path = 200_000, str(tmp_path / "log")
    rows = spark.range(n).select(
        F.col("id").alias("k"), F.concat(F.lit("e"), F.col("id") % 97).alias("entity_id"), F.lit("n").alias("owner"), F.col("id").alias("version"), F.col("id").alias("changed_at"), F.lit("UPDATE").alias("operation"), F.lit(1).alias("ts")
    )
    assert wal.append(rows.repartition(7), path, 1, "k") == n + 1
    assert wal.append(rows.limit(10), path, n + 1, "k") == n + 11
    found = wal.read(spark, path)
    got = found.filter(F.col("lsn") <= n).agg(F.count("*"), F.countDistinct("lsn"), F.min("lsn"), F.max("lsn"), F.count_if(F.col("lsn") != F.col("version") + 1)).first()
    assert tuple(got) == (n, n, 1, n, 0) and found.count() == n + 10
    with pytest.raises(ValueError, match="more than"):
        wal.append(rows, path, n + 11, "k", max_bytes=1000)
    wal.truncate(spark, path, n - 4)
    assert sorted(r.lsn for r in wal.read(spark, path).collect()) == list(range(n - 4, n + 11))


def test_checkpoints_that_stay(spark, tmp_path):
    path = str(tmp_path / "states")
    for lsn in (10, 20, 30, 25):
        wal.write_checkpoint(spark.range(lsn), path, lsn, keep=2)
    assert sorted(r.lsn for r in wal.checkpoints(spark, path).collect()) == [25, 30]
    assert wal.read_checkpoint(spark, path).count() == 25 and wal.read_checkpoint(spark, path, 40).count() == 30
    with pytest.raises(ValueError):
        wal.read_checkpoint(spark, path, 5)


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "source long, target long")


def test_walks_over_diamonds_and_cycles(spark):
    diamonds = [(k, k + 1) for k in range(60)] * 2 + [(5, 0), (60, 3)]
    got = {r.node: r.depth for r in workflow.reachable(spark, edges_of(spark, diamonds), 0).collect()}
    assert got == {k: k for k in range(61)}


def test_first_join_is_the_nearest(spark):
    nodes = spark.createDataFrame([(k, "join" if k in (5, 6) else "step") for k in range(8)], "id long, type string")
    edges = spark.createDataFrame([(10, 0, 1), (11, 0, 2), (12, 1, 3), (13, 3, 5), (14, 2, 6), (15, 3, 1), (16, 0, 7), (17, 7, 99), (18, 0, 5)], "id long, source long, target long")
    got = {r.branch: (r.join_id, r.edge_id) for r in workflow.first_joins(nodes, edges, edges.filter("source = 0").select("id")).collect()}
    assert got == {10: (5, 13), 11: (6, 14), 16: (None, None), 18: (5, 18)}


def test_contexts(spark):
    rows = spark.createDataFrame([("r", 1, '{"x":{"p":1},"l":[1]}'), ("r", 2, '{"x":{"q":2},"l":[2]}')], "run string, no long, context string")
    merged = lambda how: json.loads(workflow.joined_context(rows, ["run"], "no", "context", how).first().context)
    assert merged("deep-merge") == {"x": {"p": 1, "q": 2}, "l": [2]}
    assert merged("last-writer-wins") == {"x": {"q": 2}, "l": [2]}
    assert merged("array-collect") == {"joined": [{"x": {"p": 1}, "l": [1]}, {"x": {"q": 2}, "l": [2]}]}
    named = rows.select("run", "no", F.lit("c").alias("name"), F.col("context").alias("value"))
    assert json.loads(workflow.merged_context(named, ["run"], "no", "name", "value", "deep-merge").first().value) == {"x": {"p": 1, "q": 2}, "l": [2]}
    for f in (lambda: workflow.merged_context(named, ["run"], "no", "name", "value", "newest"), lambda: workflow.joined_context(rows, ["run"], "no", "context", "newest")):
        with pytest.raises(ValueError):
            f()
    steps = spark.createDataFrame([("r", 1, "a", '{"v":1}', None), ("r", 2, "b", "[2]", None), ("r", 3, "c", '{"v":3}', "out"), ("r", 4, "d", None, None)], "run string, no long, node string, output string, output_key string")
    got = json.loads(workflow.accumulated(steps, ["run"], "no", "node", "output", "output_key").first().context)
    assert got == {"steps": {"a": {"v": 1}, "b": [2], "c": {"v": 3}, "d": None}, "v": 1, "out": {"v": 3}}


def test_row_hash_tells_rows_apart(spark):
    kind = "id long, a string, b string, m map<string,long>"
    rows = [(1, "x|b=y", None, {"p": 1, "q": 2}), (1, "x", "y", {"p": 1, "q": 2}), (1, "x", None, {"p": 1, "q": 2}), (1, "x", "", {"p": 1, "q": 2}), (1, "x", "null", {"p": 1, "q": 2}), (1, 'x","b":"y', None, {"p": 1, "q": 2}), (1, "x", "y", None)]
    df = spark.createDataFrame(rows, kind)
    assert len({r.hash for r in diff.fingerprints(df, "id", "a", "b", "m").collect()}) == len(rows)
    turned = spark.createDataFrame([(1, "x", "y", {"q": 2, "p": 1})], kind)
    assert diff.fingerprints(turned, "id", "a", "b", "m").first().hash in {r.hash for r in diff.fingerprints(df.filter("b = 'y'"), "id", "a", "b", "m").collect()}


@pytest.mark.parametrize("n", (0, 1, 2, 9, 10, 11, 73))
def test_merkle_root(spark, n):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    hashes = [sha(str(k)) for k in range(n)]
    level = [sha("".join(hashes[k : k + 10])) for k in range(0, n, 10)] if n != 1 else hashes
    while len(level) > 1:
        level = [sha(a + b) for a, b in zip(level[::2], [*level[1::2], *([level[-1]] if len(level) % 2 else [])], strict=True)]
    prints = spark.createDataFrame([(k * 3, h) for k, h in enumerate(hashes)], "id long, hash string")
    assert diff.merkle_root(diff.row_chunks(prints, "id", 10)).first().root == (level[0] if level else sha(""))


def test_patches_merge_maps(spark):
    state = spark.createDataFrame([(1, {"a": 1, "b": 2}, 5), (2, None, 6)], "id long, stats map<string,long>, version long")
    patches = spark.createDataFrame([(1, ({"b": 3, "c": 4}, None)), (2, ({"z": 1}, 9))], "id long, patch struct<stats:map<string,long>,version:long>")
    assert {r.id: (r.stats, r.version) for r in diff.patched(state, patches, "id").collect()} == {1: ({"a": 1, "b": 3, "c": 4}, 5), 2: ({"z": 1}, 9)}


def test_failed_delta_leaves_state_alone(spark):
    state = spark.createDataFrame([(1, 1, "a")], "id long, version long, value string")
    kind = "sequence long, id long, operation string, previous_version long, version long, value string"
    deltas = spark.createDataFrame([(2, 1, "modify", 2, 3, "c"), (1, 1, "modify", 1, 2, "b"), (3, 1, "modify", 1, 9, "x"), (3, 5, "add", None, 1, "y"), (4, 7, "add", None, 1, "z"), (5, 8, "noop", None, 1, "q")], kind)
    found, outcomes = diff.applied_in_sequence(state, deltas, "id", "version", "value")
    assert {tuple(r) for r in found.select("id", "version", "value").collect()} == {(1, 3, "c"), (7, 1, "z")}
    assert [tuple(r) for r in outcomes.orderBy("sequence").collect()] == [(1, 1, 0), (2, 1, 0), (3, 2, 1), (4, 1, 0), (5, 1, 1)]


def test_overlaps_across_ranges(spark):
    rng = random.Random(6)
    rows = [(k, s := rng.randrange(10_000), s + rng.choice((1, 5, 20, 400))) for k in range(400)]
    want, reach, group = {}, -1, 0
    for _, s, e in sorted(rows, key=lambda r: (r[1], r[2])):
        group += s > reach
        reach = max(reach, e)
        want[s, e] = group
    got = logs.overlap_groups(spark.createDataFrame(rows, "id long, s long, e long"), "s", "e").collect()
    assert len(got) == 400 and {(r.s, r.e): r.overlap_group for r in got} == want


def test_nearest_over_many_blocks(spark):
    points = spark.createDataFrame([(p,) for p in (3, 4000, 5_000_000)], "p long")
    targets = spark.createDataFrame([(t,) for t in (2, 3, 10, 4001, 4_999_999, 90_000_000)], "t long")
    got = {r.t: r.nearest_p for r in logs.nearest_at_or_before(points, targets, "p", "t", 7).collect()}
    assert got == {2: None, 3: 3, 10: 3, 4001: 4000, 4_999_999: 4000, 90_000_000: 5_000_000}


def test_compaction_plans(spark):
    kind = "segment_id long, start_lsn long, end_lsn long, size_bytes long, entry_count long, tombstone_count long, age long"
    mb = 1 << 20
    rows = [(1, 0, 10, 5 * mb, 10, 0, 5), (2, 20, 40, 50 * mb, 10, 9, 90), (3, 30, 60, 60 * mb, 10, 8, 90), (4, 70, 80, 40 * mb, 10, 0, 90), (5, 75, 90, 700 * mb, 10, 1, 5)]
    df = spark.createDataFrame(rows, kind)
    plan = lambda least: sorted(r.segment_id for r in compaction.leveled_plan(df, "size_bytes", "segment_id", "start_lsn", "end_lsn", least).collect())
    assert plan(1) == [1] and plan(4) == [2, 3]
    timed = compaction.time_plan(df.withColumn("log", F.lit(0)), ["log"], "start_lsn", "segment_id", "size_bytes", F.col("age"), 50, 5, 120 * mb, 100)
    assert sorted((r.segment_id, r.priority) for r in timed.collect()) == [(2, "high"), (3, "high")]
    assert [compaction.recommended(*f) for f in ((False, False, True, False), (False, False, False, True), (False, True, False, False), (True, False, False, False))] == ["vacuum", "time-based", "leveled", "size-tiered"]
    assert [quorum.recommended(*f) for f in ((9, 1, 1, 1, True, False), (9, 1, 1, 1, False, True), (9, 2, 1, 1, False, False), (9, 1, 3, 1, False, False), (9, 1, 1, 2, False, False), (3, 1, 1, 2, False, False))] == ["consensus", "adaptive", "multi-level", "zone", "role", "simple"]


def test_ring_looks_ahead_until_it_has_seen_enough(spark):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(5)], "node string")
    ring = placement.ring(nodes, "node", 40)
    places = sorted((r.h, r.node) for r in ring.collect())
    keys = spark.range(300)
    for replicas in (1, 3, 5, 9):
        got = {r.id: r.owners for r in placement.owners(keys, "id", ring, replicas).collect()}
        for k in range(300):
            h = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16)
            turn = [n for p, n in places if p >= h] + [n for p, n in places if p < h]
            assert got[k] == list(dict.fromkeys(turn))[:replicas]


def test_text_exports(spark):
    odd = spark.createDataFrame([('a "b"\\c', "x y,z=1", 1.5, 3)], "t string, tag string, v double, ms long")
    line = metrics.influx_lines(odd, "m", ["tag"], ["v", "t"], "ms").first().line
    assert line == 'm,tag=x\\ y\\,z\\=1 v=1.5,t="a \\"b\\"\\\\c" 3000000'
    samples = odd.select(F.create_map(F.lit("l"), F.col("t")).alias("labels"), "v", "ms").withColumnRenamed("v", "cpu")
    lines = [r.line for r in metrics.family_text(samples, {"cpu": ("gauge", "Use")}, "labels", "ms").orderBy("family", "part").collect()]
    assert lines == ["# HELP cpu Use", "# TYPE cpu gauge", 'cpu{l="a \\"b\\"\\\\c"} 1.5 3']
    point = json.loads(metrics.series_points(odd, {"v": "m.v"}, {"env": "t"}, "ms").first().line)
    assert point == {"metric": "m.v", "points": [[0.0, 1.5]], "tags": ["env:t"], "type": "gauge"}
    summary = spark.createDataFrame([(5, "a<b", 0.5, 0.25)], "timestamp long, status string, cpu double, memory double")
    assert metrics.report(summary, "csv").first().content == "timestamp,status,cpu,memory\n5,a<b,0.5,0.25"
    assert "a&lt;b" in metrics.report(summary, "html").first().content
    with pytest.raises(ValueError):
        metrics.report(summary, "pdf")


def test_small_functions(spark):
    df = spark.createDataFrame([(1, bytearray(b"a" * 500)), (2, bytearray(b"q8")), (3, None)], "id long, b binary")
    packed = df.select("id", columns.compressed(F.col("b")).alias("p"))
    assert {r.id: r.p["compressed"] for r in packed.collect() if r.p} | {3: None} == {1: True, 2: False, 3: None}
    opened = {r.id: r.o for r in packed.select("id", columns.decompressed(F.col("p")).alias("o")).collect()}
    assert bytes(opened[1]) == b"a" * 500 and bytes(opened[2]) == b"q8" and opened[3] is None
    waits = [r.w for r in spark.range(200).select(columns.jittered(F.lit(100.0), 0.2, F.col("id")).alias("w")).collect()]
    assert all(80 <= w <= 120 for w in waits) and len(set(waits)) > 150


SCHEMA = "version bigint, ts timestamp, user_id bigint, type string"


def test_each_event_of_a_subscription(spark, tmp_path):
    """Late and repeated rows over several files, a failing event alone, a restart, and one with a new stream checkpoint."""
    at, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = spark.range(60).select(F.col("id").alias("version"), F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 4).alias("user_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("type"))
    seen = tmp_path / "seen"
    seen.mkdir()

    def handle(event):
        with open(f"{seen}/{event['version']}", "a") as f:
            f.write("x")
        if event["version"] % 9 == 0:
            raise ValueError("no")

    def run(checkpoint):
        streams.subscribe_each(streams.event_stream(spark, at, SCHEMA), ["a"], handle, state, str(tmp_path / checkpoint), every=4).awaitTermination(120)

    rows.filter("version < 30").coalesce(1).write.mode("append").parquet(at)
    run("c1")
    rows.filter("version >= 30").unionByName(rows.filter("version IN (3, 6)")).coalesce(1).write.mode("append").parquet(at)
    run("c1")
    calls = {int(f.name): len(f.read_text()) for f in seen.iterdir()}
    assert sorted(calls) == list(range(0, 60, 3)) and calls[3] == calls[6] == 1
    dead = spark.read.parquet(f"{state}/dead")
    assert sorted(r.version for r in dead.collect()) == [v for v in range(0, 60, 3) if v % 9 == 0] and "no" in dead.first().error
    run("c2")
    again = {int(f.name): len(f.read_text()) for f in seen.iterdir()}
    done = streams._progress(spark, f"{state}/progress").version
    assert done >= 27 and all(again[v] == calls[v] for v in calls if v <= done)


def test_dedup_over_batches(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = spark.range(100).select(F.col("id").alias("version"), F.timestamp_seconds(F.col("id") * 60 + 1_000_000).alias("ts"), (F.col("id") % 4).alias("user_id"), F.lit("a").alias("type"))
    for part in (rows.filter("version < 50"), rows.filter("version >= 40"), rows.filter("version >= 90")):
        part.coalesce(1).write.mode("append").parquet(at)
    out = streams.drained(streams.once(streams.event_stream(spark, at, SCHEMA), "version", "ts", "1 day"))
    assert sorted(r.version for r in out.collect()) == list(range(100))

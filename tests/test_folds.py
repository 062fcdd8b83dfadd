"""The folds against plain loops over the same rows."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from statewright.functions.columns import condition, fibonacci_backoff, string_hash, template
from statewright.operators import compaction, flow, fold
from statewright.operators.workflow import stop_order

LOG = "ord long, entity_id string, operation string, owner string, version long, ts long, metadata map<string,string>"


def changes(seed, n=400):
    rng = random.Random(seed)
    ops = ["CREATE", "UPDATE", "UPDATE", "TRANSFER", "DELETE"]
    return [(k, f"e{rng.randrange(12)}", rng.choice(ops), rng.choice(["a", "b", "c", None]), rng.randrange(40), 1000 + k, rng.choice([None, {f"k{rng.randrange(3)}": str(k)}])) for k in range(n)]


def plain_lww(rows):
    state = {}
    for _, e, op, owner, version, ts, meta in sorted(rows):
        s, author = state.get(e), owner or ""
        if s and (s["version"], s["author"]) > (version, author):
            continue
        if op == "DELETE":
            state[e] = {"live": False, "owner": None, "version": version, "author": author, "metadata": None, "deleted_at": ts}
        else:
            old = s["metadata"] if s and s["metadata"] and op == "UPDATE" else {}
            prior = s["owner"] if s else None
            state[e] = {"live": True, "owner": owner if owner is not None else prior or "", "version": version, "author": author, "metadata": {**old, **(meta or {})}, "deleted_at": None}
    return state


def plain_version(rows):
    state = {}
    for _, e, op, owner, version, _, meta in sorted(rows):
        s = state.get(e)
        if op == "CREATE" and not s:
            state[e] = {"owner": owner, "version": version, "metadata": meta or {}}
        elif op == "DELETE":
            state.pop(e, None)
        elif op in ("UPDATE", "TRANSFER") and s and version > s["version"]:
            s["version"] = version
            if op == "TRANSFER":
                s["owner"] = owner
            else:
                s["metadata"] = {**s["metadata"], **(meta or {})}
    return state


@pytest.mark.parametrize("seed", range(3))
def test_folds_under_any_arrival_order(spark, seed):
    rows = changes(seed)
    df = spark.createDataFrame(rows, LOG).repartition(4)
    got = {r.entity_id: r.asDict() for r in fold.lww_fold(df).collect()}
    want = plain_lww(rows)
    assert {e: {k: v for k, v in r.items() if k != "entity_id"} for e, r in got.items()} == want
    got = {r.entity_id: {"owner": r.owner, "version": r.version, "metadata": r.metadata} for r in fold.version_fold(df).collect()}
    assert got == plain_version(rows)


def test_lww_ties_and_resurrection(spark):
    def final(*rows):
        df = spark.createDataFrame([(k, "x", op, owner, v, k, None) for k, (op, owner, v) in enumerate(rows)], LOG)
        r = fold.lww_fold(df).first()
        return r.live, r.owner, r.version

    assert final(("CREATE", "node-B", 5), ("CREATE", "node-C", 10)) == (True, "node-C", 10)
    assert final(("CREATE", "node-B", 5), ("CREATE", "node-C", 5)) == (True, "node-C", 5)
    assert final(("CREATE", "node-C", 5), ("CREATE", "node-B", 5)) == (True, "node-C", 5)
    assert final(("CREATE", "n", 5), ("DELETE", "n", 6), ("UPDATE", "n", 4)) == (False, None, 6)
    assert final(("CREATE", "n", 5), ("DELETE", "n", 6), ("UPDATE", "n", 7)) == (True, "n", 7)


def test_version_state_is_the_fold_of_an_ordered_log(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(9), rng.choice(["CREATE", "UPDATE", "TRANSFER", "DELETE"]), rng.choice("abc"), k, k, None) for k in range(500)]
    want = {e: (s["version"], s["owner"]) for e, s in plain_version([(r[0], r[1], *r[2:]) for r in rows]).items()}
    df = spark.createDataFrame(rows, LOG.replace("entity_id string", "entity_id long")).withColumnRenamed("ord", "lsn")
    assert {r.entity_id: (r.version, r.owner) for r in fold.version_state(df).collect()} == want


def events(seed, n=600):
    rng = random.Random(seed)
    return sorted((rng.randrange(5), rng.randrange(10**9), k, rng.randrange(1, 50), rng.random() < 0.6) for k in range(n))


@pytest.fixture(scope="module")
def stream(spark):
    rows = events(1)
    return rows, spark.createDataFrame(rows, "key long, us long, seq long, size long, ok boolean")


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_coalesced(stream):
    rows, df = stream
    want = []
    for k, own in by_key(rows).items():
        windows = []
        for _, t, *_ in own:
            if windows and t < windows[-1][0] + 20_000_000:
                windows[-1][1] += 1
            else:
                windows.append([t, 1])
        want += [(k, *w) for w in windows]
    assert sorted(tuple(r) for r in flow.coalesced(df, ["key"], "us", 20_000_000).collect()) == sorted(want)


def test_token_bucket(stream):
    rows, df = stream
    want = {}
    for own in by_key(rows).values():
        tokens, last = 3.0, None
        for _, t, seq, *_ in own:
            tokens = min(3.0, tokens + (0 if last is None else t - last) / 1e6 * 0.05)
            want[seq] = tokens >= 1
            tokens -= tokens >= 1
            last = t
    assert {r.seq: r.allowed for r in flow.token_bucket(df, ["key"], "us", "seq", 0.05, 3.0).collect()} == want


def test_first_seen_batches_breaker_leases(stream):
    rows, df = stream
    seen, batches, states, held = [], [], {}, {}
    for k, own in by_key(rows).items():
        last, b = None, []
        state, run, opened, rejected = "CLOSED", 0, None, 0
        for _, t, _, size, ok in own:
            if last is None or t >= last + 30_000_000:
                seen.append((k, t))
                last = t
            if b and b[-1][1] < 5 and b[-1][2] + size <= 100 and t < b[-1][0] + 60_000_000:
                b[-1][1] += 1
                b[-1][2] += size
            else:
                b.append([t, 1, size])
            if state == "OPEN" and t < opened + 10_000_000:
                rejected += 1
            elif ok:
                state, run = "CLOSED", 0
            else:
                run += 1
                if state == "OPEN" or run >= 2:
                    state, opened = "OPEN", t
        batches += [(k, *x) for x in b]
        states[k] = (state, rejected)
        node, version, expires = None, 0, None
        for _, t, seq, *_ in own:
            if node is None or node == seq % 3 or expires <= t:
                node, version, expires = seq % 3, version + 1, t + 5_000_000
        held[k] = (node, version, expires)
    assert sorted(tuple(r) for r in flow.first_seen(df, "key", "us", 30_000_000, "seq").select("key", "us").collect()) == sorted(seen)
    assert sorted(tuple(r) for r in flow.batches(df, ["key"], "us", "size", 5, 100, 60_000_000).collect()) == sorted(batches)
    assert {r.key: (r.state, r.rejected) for r in flow.breaker(df, ["key"], "us", 2, 10_000_000).collect()} == states
    claims = df.withColumn("node", F.col("seq") % 3)
    got = flow.leases(claims.withColumn("node", F.col("node").cast("string")), "key", "us", "node", 5_000_000).collect()
    assert {r.key: (int(r.node), r.version, r.expires) for r in got} == held


def test_budget_groups(spark):
    rng = random.Random(2)
    rows = [(k % 3, k, k, rng.randrange(1, 60)) for k in range(90)]
    want = []
    for log in range(3):
        total, group = 0, 0
        for _, k, _, b in (r for r in rows if r[0] == log):
            if total and total + b > 100:
                total, group = 0, group + 1
            total += b
            want.append((log, k, b, group))
    df = spark.createDataFrame(rows, "log long, o long, s long, b long")
    assert sorted(tuple(r) for r in compaction.budget_groups(df, ["log"], "o", "s", "b", 100).collect()) == sorted(want)


def test_scalar_functions(spark):
    names = ["", "a", "Customer#000000007", "zzzzzzzzzzzzzzzz"]

    def plain(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.h for r in df.select(string_hash(F.col("n")).alias("h")).collect()] == [plain(n) for n in names]
    ctx = spark.createDataFrame([('{"a":{"b":"x"},"n":3,"t":true}',)], "c string")
    tests = {"context.a.b === 'x'": True, "context.a.b === 'y'": False, "context.n === 3": True, "context.t === true": True, "context.zz === 1": False, "Math.random() > 0": None}
    for text, want in tests.items():
        assert ctx.select(condition(text, F.col("c")).alias("v")).first().v is want
    assert ctx.select(template("<{{context.a.b}}|{{context.no}}>", F.col("c")).alias("v")).first().v == "<x|>"
    assert [r.v for r in spark.range(1, 8).select(fibonacci_backoff(F.col("id"), 1.0, 10.0).alias("v")).collect()] == [1, 1, 2, 3, 5, 8, 10]
    assert stop_order([("web", "db"), ("job", "db"), ("db", "disk")], ["web", "job", "db", "disk"]) == ["job", "web", "db", "disk"]


def test_one_key_with_a_million_rows(spark):
    """Folds take time in proportion to a key's rows."""
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("key"), (F.col("id") * 1000).alias("us"), F.col("id").alias("seq"), (F.col("id") % 40 + 1).alias("size"), (F.col("id") % 3 > 0).alias("ok"))
    checks = [
        lambda: flow.batches(rows, ["key"], "us", "size", 100, 10**9, 10**9).count() == 10_000,
        lambda: flow.token_bucket(rows, ["key"], "us", "seq", 1.0, 3.0).filter("allowed").count() == 1_002,
        lambda: flow.coalesced(rows, ["key"], "us", 1_000_000).agg(F.sum("updates")).first()[0] == 1_000_000,
        lambda: flow.first_seen(rows, "key", "us", 1_000_000, "seq").count() == 1_000,
        lambda: flow.breaker(rows, ["key"], "us", 2, 10).first().state == "CLOSED",
    ]
    for check in checks:
        begun = time.time()
        assert check()
        assert time.time() - begun < 60


@pytest.mark.parametrize("policy", ("drop-oldest", "drop-newest", "reject"))
def test_queue_flushes(spark, policy):
    rng = random.Random(4)
    rows = [(k % 3, k, rng.choice(["put", "put", "put", "put", "flush", "failed-flush"])) for k in range(300)]
    want = []
    for key in range(3):
        queue = []
        for _, k, what in (r for r in rows if r[0] == key):
            if what == "flush":
                want += [(key, q, "delivered", k) for q in queue]
                queue = []
            elif what == "put" and len(queue) < 4:
                queue.append(k)
            elif what == "put" and policy == "drop-oldest":
                want.append((key, queue.pop(0), "dropped", k))
                queue.append(k)
            elif what == "put":
                want.append((key, k, "dropped" if policy == "drop-newest" else "rejected", k))
        want += [(key, q, "queued", None) for q in queue]
    df = spark.createDataFrame([(a, b, b, c) for a, b, c in rows], "key long, us long, seq long, kind string")
    got = [tuple(r) for r in flow.queue_flushes(df, ["key"], "us", "seq", "kind", 4, policy).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_urgent_messages_and_merged_updates(spark):
    rows = spark.createDataFrame([("a", t, t, 10, t == 3) for t in range(6)], "key string, us long, seq long, size long, urgent boolean")
    got = [tuple(r)[1:] for r in flow.batches(rows, ["key"], "us", "size", 3, 100, 100, F.col("urgent"), "seq").collect()]
    assert sorted(got) == [(0, 3, 30), (3, 1, 10), (4, 2, 20)]
    merged = flow.coalesced(rows, ["key"], "us", 3, "seq", lambda a, b: a + b, "long").collect()
    assert sorted(tuple(r)[1:] for r in merged) == [(0, 3, 3), (3, 3, 12)]


class Counts(flow.SharedState):
    def apply(self, state, update):
        return {**state, update: state.get(update, 0) + 1}

    def serialize(self, state):
        return json.dumps(state, sort_keys=True)


def test_session_states(spark):
    rows = spark.createDataFrame([(k % 2, k, "xyz"[k % 3]) for k in range(10)], "session long, seq long, item string")
    got = {r.session: (r.updates, json.loads(r.state)) for r in flow.session_states(rows, "session", ["seq"], "item", Counts()).collect()}
    assert got == {0: (5, {"x": 2, "y": 1, "z": 2}), 1: (5, {"x": 2, "y": 2, "z": 1})}
    assert sorted((r.session, r.updates) for r in flow.session_states(rows, "session", ["seq"], "item", Counts(), every=2).collect()) == [(0, 2), (0, 4), (0, 5), (1, 2), (1, 4), (1, 5)]


def test_capped_leases(spark):
    claims = [("c", "r1", 0, "a"), ("c", "r2", 1, "a"), ("c", "r3", 2, "a"), ("c", "r3", 3, "b"), ("c", "r1", 4, "b"), ("c", "r1", 12, "b"), ("c", "r4", 13, "a")]
    df = spark.createDataFrame(claims, "cluster string, range_id string, us long, node string")
    got = sorted(tuple(r)[1:] for r in flow.capped_leases(df, "cluster", "range_id", "us", "node", 10, 2).collect())
    assert got == [("r1", "b", 2, 22), ("r2", "a", 1, 11), ("r3", "b", 1, 13), ("r4", "a", 1, 23)]


def test_snapshots_and_foreign_mutations(spark):
    states = fold.lww_fold(spark.createDataFrame(changes(5), LOG))
    snap = fold.exported(states, "n1", F.lit(7))
    live = {r.entity_id: (r.owner, r.version) for r in states.filter("live").collect()}
    assert {r.entity_id: (r.owner, r.version) for r in snap.collect()} == live
    clock = states.agg(F.max("version")).first()[0]
    back = fold.imported(snap, states.filter("version < 3")).collect()
    assert {r.entity_id: (r.owner, r.version) for r in back} == live and {(r.live, r.clock) for r in back} == {(True, clock)}
    e = sorted(live)[0]
    tries = [(e, "CREATE", live[e][0]), (e, "UPDATE", live[e][0]), (e, "DELETE", "other"), ("nobody", "TRANSFER", "a"), ("nobody", "CREATE", "a")]
    got = {tuple(r)[:3]: r.reason for r in fold.foreign_mutations(spark.createDataFrame(tries, "entity_id string, operation string, actor string"), states, "actor").collect()}
    assert [got[t] for t in tries] == ["already exists", None, "not the owner", "not found", None]

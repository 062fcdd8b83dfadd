"""Workflow runs: join firing, outcomes, context merge, approvals, run metrics, and walks over the step graph."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statewright.operators.ordered import folded
from statewright.sources.scratch import written


def firings(arrivals: DataFrame, keys: list[str], order: str, mode: str, n: Column | int = 1, expected: Column | None = None) -> DataFrame:
    """keys, fire_no, outcome: where a join fires and how; joins that do not fire are left out.

    Arrivals have a boolean ``ok``. "all" fires when every expected arrival has come and fails on any failure; "any" fires at
    the first success, or fails when all have failed; "n_of_m" fires at the n-th success, or fails when it is out of reach.
    ``expected`` is the number of incoming edges; by default the number of arrivals.
    """
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    m = expected if expected is not None else F.count("*").over(whole)
    good, bad = F.sum(F.col("ok").cast("int")).over(run), F.sum((~F.col("ok")).cast("int")).over(run)
    rows = arrivals.select(*keys, order, good.alias("_g"), bad.alias("_b"), m.alias("_m"))
    need = F.lit(1) if mode == "any" else F.lit(n) if isinstance(n, int) else n
    if mode == "all":
        fires, outcome = F.col("_g") + F.col("_b") >= F.col("_m"), F.when(F.col("_b") == 0, "completed").otherwise("failed")
    else:
        fires = (F.col("_g") >= need) | (F.col("_m") - F.col("_b") < need)
        outcome = F.when(F.col("_g") >= need, "completed").otherwise("failed")
    first = rows.withColumn("outcome", outcome).filter(fires)
    return first.groupBy(*keys).agg(F.min(order).alias("fire_no"), F.min_by("outcome", order).alias("outcome"))


def late(arrivals: DataFrame, fired: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Arrivals after their join has fired; they are dropped."""
    return arrivals.join(fired.select(*keys, "fire_no"), keys).filter(F.col(order) > F.col("fire_no")).drop("fire_no")


def deep_merge(old: dict, new: dict) -> dict:
    """Objects on both sides are merged; everything else is replaced."""
    return old | {k: deep_merge(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def _text(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def merged_context(arrivals: DataFrame, keys: list[str], order: str, name: str, value: str, how: str) -> DataFrame:
    """keys, name, value: contexts of a join merged in arrival order: the last writer wins, all values as an array, or
    (deep-merge) JSON values whose objects are merged key by key; what is no object replaces what was there."""
    if how == "array-collect":
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return arrivals.groupBy(*keys, name).agg(F.transform(rows, lambda r: r.v).alias(value))
    if how == "last-writer-wins":
        return arrivals.groupBy(*keys, name).agg(F.max_by(value, order).alias(value))
    if how != "deep-merge":
        raise ValueError(f"unknown merge strategy: {how}")
    first = (False, None)

    def step(state, text):
        if text is None:
            return state, ()
        new = json.loads(text)
        both = isinstance(new, dict) and isinstance(state[1], dict)
        return (True, deep_merge(state[1], new) if both else new), ()

    return folded(arrivals, [*keys, name], [order], [value], lambda: first, step, f"{value} string", lambda s: [(_text(s[1]) if s[0] else None,)])


def joined_context(arrivals: DataFrame, keys: list[str], order: str, context: str, how: str) -> DataFrame:
    """keys, context: the whole contexts (JSON objects) of a join's arrivals merged in order; array-collect puts them under ``joined``."""
    if how not in ("array-collect", "last-writer-wins", "deep-merge"):
        raise ValueError(f"unknown merge strategy: {how}")

    def step(state, text):
        new = json.loads(text) if text else {}
        if how == "array-collect":
            return {"joined": [*state.get("joined", []), new]}, ()
        return (state | new if how == "last-writer-wins" else deep_merge(state, new)), ()

    return folded(arrivals, keys, [order], [context], dict, step, f"{context} string", lambda s: [(_text(s),)])


def accumulated(steps: DataFrame, keys: list[str], order: str, node: str, output: str, output_key: str) -> DataFrame:
    """keys, context: what the steps of a run leave in its context, in order.

    Each output (JSON) lies under steps.<node>, and besides under its ``output_key``, or, without one, an object's entries lie
    at the root.
    """

    def step(context, name, text, under):
        value = json.loads(text) if text is not None else None
        context = context | {"steps": (context.get("steps") or {}) | {name: value}}
        if under:
            context = context | {under: value}
        elif isinstance(value, dict) and value:
            context = context | value
        return context, ()

    return folded(steps, keys, [order], [F.col(node).cast("string"), output, output_key], dict, step, "context string", lambda c: [(_text(c),)])


def timed_out(requests: DataFrame, decided: DataFrame, keys: list[str], asked: str, span: str, action: str, now: Column) -> DataFrame:
    """keys, decided_at, result of ``requests`` (keys, the time they were asked, how long they wait, action) with no decision
    in time: approve approves, reject and escalate reject. Decisions (keys, decided_at, result) in time stand; the rest wait."""
    both = requests.join(decided, keys, "left")
    limit = F.col(asked) + F.col(span)
    in_time = F.col("decided_at").isNotNull() & (F.col(span).isNull() | (F.col("decided_at") <= limit))
    late_ = F.col(span).isNotNull() & (now > limit)
    result = F.when(in_time, F.col("result")).when(late_, F.when(F.col(action) == "approve", "approved").otherwise("rejected"))
    return both.withColumn("_r", result).filter("_r IS NOT NULL").select(*keys, F.when(in_time, F.col("decided_at")).otherwise(limit).alias("decided_at"), F.col("_r").alias("result"))


def approvals(decisions: DataFrame, keys: list[str], order: str, required: Column | int) -> DataFrame:
    """keys, decided_at, result: the first rejection, or the approval that completes the required number (1 at least)."""
    run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    need = F.greatest(F.lit(1), F.lit(required) if isinstance(required, int) else required)
    rows = decisions.withColumn("_yes", F.sum(F.col("approve").cast("int")).over(run))
    decisive = rows.filter(~F.col("approve") | (F.col("_yes") >= need))
    result = F.when(F.min_by("approve", order), "approved").otherwise("rejected")
    return decisive.groupBy(*keys).agg(F.min(order).alias("decided_at"), result.alias("result"))


def canonical(events: DataFrame, name: str, aliases: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """``events`` under canonical names only, each once.

    Writers emit an event under its canonical and its deprecated name; older ones under the deprecated name alone. A
    deprecated row is renamed, and dropped only where a canonical one has the same ``keys`` (by default all other columns).
    """
    if not aliases:
        return events
    known = list(keys) or [c for c in events.columns if c != name]
    old = F.col(name).isin(*aliases)
    new = F.lit(None).cast("string")
    for was, now in aliases.items():
        new = F.when(F.col(name) == was, now).otherwise(new)
    renamed = events.filter(old).withColumn(name, new)
    current = events.filter(~old | F.col(name).isNull())
    a, b = renamed.alias("a"), current.filter(F.col(name).isin(*set(aliases.values()))).select(name, *known).distinct().alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (name, *known)])
    alone = a.join(b, same, "left_anti")
    once = alone.dropDuplicates([name, *known])
    return current.unionByName(once.select(*events.columns))


def durations(events: DataFrame, keys: list[str], kind: str, micros: str) -> DataFrame:
    """keys, status, duration: from the first start to the last end; runs without an end are running, and of two ends at the same
    time failed counts."""
    found = events.groupBy(*keys).agg(
        F.min(F.when(F.col(kind) == "started", F.col(micros))).alias("_a"),
        F.max(F.when(F.col(kind).isin("completed", "failed"), F.col(micros))).alias("_z"),
        F.max(F.when(F.col(kind).isin("completed", "failed"), F.struct(F.col(micros).alias("at"), F.col(kind).alias("kind"))))["kind"].alias("_s"),
    )
    return found.select(*keys, F.coalesce("_s", F.lit("running")).alias("status"), (F.col("_z") - F.col("_a")).alias("duration"))


def run_metrics(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: started, completed, failed, error_rate, mean duration of the completed, and warning above a tenth of errors."""
    found = runs.groupBy(*by).agg(
        F.count("*").alias("started"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(F.when(F.col("status") == "completed", F.col("duration"))).alias("mean_duration"),
    )
    rate = F.try_divide("failed", "started")
    return found.withColumn("error_rate", rate).withColumn("warning", rate > 0.1)


def skipped(nodes: DataFrame, steps: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Nodes of each run that no step has reached."""
    return nodes.join(steps.select(*keys, node).distinct(), [*keys, node], "left_anti")


def stopped(nodes: DataFrame, steps: DataFrame, runs: DataFrame, keys: list[str], node: str, status: str) -> DataFrame:
    """keys, node, status: the steps of cancelled ``runs``: what runs is cancelled, what has ended stays, the rest is skipped."""
    of = nodes.join(runs.select(*keys), keys, "left_semi").join(steps.select(*keys, node, status), [*keys, node], "left")
    now = F.when(F.col(status).isNull(), "skipped").when(F.col(status).isin("completed", "failed"), F.col(status)).otherwise("cancelled")
    return of.select(*keys, node, now.alias(status))


def _walked(edges: DataFrame, front: DataFrame) -> DataFrame:
    """key, node, depth and what ``front`` (key, node) brings along: every node reached over ``edges`` (key, source, target,
    name), at its least depth. ``first`` of the frontier decides between ways of equal length.

    Each round joins the frontier with the edges and takes away what has been visited; it is written, so that neither
    paths nor lineage pile up. A cycle ends where nothing is new.
    """
    front = written(front.withColumn("depth", F.lit(0)), "walk")
    visited, out = front.select("key", "node"), front
    depth = 0
    while not front.isEmpty():
        depth += 1
        met = front.select("key", F.col("node").alias("source")).join(edges, ["key", "source"])
        met = met.groupBy("key", F.col("target").alias("node")).agg(F.min("name").alias("via"))
        front = written(met.join(visited, ["key", "node"], "left_anti").withColumn("depth", F.lit(depth)), "walk")
        visited, out = visited.unionByName(front.select("key", "node")), out.unionByName(front)
    return out


def reachable(spark: SparkSession, edges: DataFrame, start: int, limit: int | None = None) -> DataFrame:
    """node, depth: the least number of edges (source, target) from ``start``. Cycles and diamonds cost nothing extra: a node
    is visited once. ``limit`` is kept for callers and has no effect."""
    keyed = edges.select(F.lit(0).alias("key"), "source", "target", F.lit(None).cast("string").alias("name")).filter("source IS NOT NULL AND target IS NOT NULL")
    kind = edges.schema["source"].dataType
    front = spark.range(1).select(F.lit(0).alias("key"), F.lit(start).cast(kind).alias("node"), F.lit(None).cast("string").alias("via"))
    return _walked(written(keyed.distinct(), "ways"), front).select("node", "depth")


def first_joins(nodes: DataFrame, edges: DataFrame, branches: DataFrame, limit: int | None = None) -> DataFrame:
    """branch, join_id, edge_id: the nearest join downstream of each branch edge (its id), and the edge that reaches it; null
    if there is none. ``nodes`` has id, type; ``edges`` id, source, target. Ways end at a join; of ways of equal length the
    least edge id counts. With a ``limit``, joins more than so many edges behind the branch edge are not its joins."""
    joins = nodes.filter("type = 'join'").select(F.col("id").alias("node"))
    known = nodes.select(F.col("id").alias("node"))
    # What goes on from each node is written once for all rounds, with whether it is a join.
    ends = known.join(joins.withColumn("_join", F.lit(True)).hint("merge"), "node", "left").withColumn("_join", F.coalesce("_join", F.lit(False)))
    from_ = edges.join(joins.select(F.col("node").alias("source")).hint("merge"), "source", "left_anti")
    onward = written(from_.join(ends.withColumnRenamed("node", "target").hint("merge"), "target").select("source", "target", F.col("id").alias("via"), F.col("_join").alias("hit")), "onward")
    start = branches.select(F.col("id").alias("key")).join(edges.select(F.col("id").alias("key"), F.col("target").alias("node")).hint("merge"), "key")
    start = start.join(joins.withColumn("hit", F.lit(True)).hint("merge"), "node", "left")
    front = written(start.select("key", "node", F.col("key").alias("via"), F.coalesce("hit", F.lit(False)).alias("hit")), "branches")
    hits, visited = [], [front]
    while not front.isEmpty():  # the front of round k is k edges behind the branch edges
        found = front.filter("hit").groupBy("key").agg(F.min(F.struct("via", "node")).alias("_h"))
        found = written(found.select("key", F.col("_h.node").alias("join_id"), F.col("_h.via").alias("edge_id")), "branches")
        hits.append(found)
        if len(hits) - 1 == limit:
            break
        open_ = front.select("key", F.col("node").alias("source")).join(found.select("key"), "key", "left_anti")
        met = open_.join(onward, "source").groupBy("key", F.col("target").alias("node")).agg(F.min("via").alias("via"), F.max("hit").alias("hit"))
        seen = reduce(DataFrame.unionByName, [v.select("key", "node") for v in visited])
        front = written(met.join(seen, ["key", "node"], "left_anti").select("key", "node", "via", "hit"), "branches")
        visited.append(front)
    hits = reduce(DataFrame.unionByName, hits) if hits else None
    ids = branches.select(F.col("id").alias("key"))
    return ids.join(hits, "key", "left").withColumnRenamed("key", "branch") if hits is not None else ids.select(F.col("key").alias("branch"), F.lit(None).cast("string").alias("join_id"), F.lit(None).cast("string").alias("edge_id"))


def traversed(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame, start: DataFrame) -> DataFrame:
    """run, node, depth: the nodes that each run visits from its ``start`` (run, node).

    ``outcomes`` has run, node, status and handle. A completed step goes on over the edges of its handle (out if it has none),
    a fork over all but the error edges, a failed step over its error edges only; a cancelled one, or one without an
    outcome, goes nowhere. ``edges`` has source, source_handle and target.
    """
    # Whole tables meet by sorting both, not by sending one of them everywhere; what they give is written once for all rounds.
    steps = outcomes.join(nodes.select(F.col("id").alias("node"), "type").hint("merge"), "node")
    done = steps.filter("status IN ('completed', 'failed')").withColumn("handle", F.when(F.col("status") == "failed", "error").otherwise(F.coalesce("handle", F.lit("out"))))
    ways = done.join(edges.select(F.col("source").alias("node"), F.coalesce("source_handle", F.lit("out")).alias("_by"), "target").hint("merge"), "node")
    fork = (F.col("type") == "fork") & (F.col("status") == "completed")
    taken = ways.filter((fork & (F.col("_by") != "error")) | (~fork & (F.col("_by") == F.col("handle"))))
    keyed = taken.select(F.col("run").alias("key"), F.col("node").alias("source"), "target", F.lit(None).cast("string").alias("name")).distinct()
    front = start.select(F.col("run").alias("key"), "node", F.lit(None).cast("string").alias("via"))
    return _walked(written(keyed, "ways"), front).select(F.col("key").alias("run"), "node", "depth")


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """code, id: edges to or from unknown nodes, nodes without any edge, and joins with fewer than two incoming edges."""
    ids = nodes.select("id")
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("node"))
    unknown = ends.join(ids.select(F.col("id").alias("node")), "node", "left_anti").select(F.lit("unknown-node").alias("code"), "id").distinct()
    alone = ids.join(ends.select(F.col("node").alias("id")), "id", "left_anti").select(F.lit("isolated-node").alias("code"), "id")
    incoming = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    thin = nodes.filter("type = 'join'").join(incoming, "id", "left").filter("coalesce(n, 0) < 2").select(F.lit("join-with-one-input").alias("code"), "id")
    return unknown.unionByName(alone).unionByName(thin)


def stop_order(edges: list[tuple[str, str]], names: list[str]) -> list[str]:
    """Modules with their dependents first; ``edges`` are (module, what it depends on). For module lists, on the driver."""
    needs: dict[str, list[str]] = {n: [] for n in names}
    for module, dependency in edges:
        needs[module].append(dependency)
    done: dict[str, None] = {}

    def start(name: str) -> None:
        for d in needs[name]:
            if d not in done:
                start(d)
        done.setdefault(name)

    for n in names:
        start(n)
    return [*done][::-1]

"""Flow control in event time: coalescing, rate limits, bounded queues, dedup, batching, breakers, leases, shared state.

Where a window or an aggregate can say the same, it does; the rest are ordered folds (``operators.ordered``). Folds whose
state surely starts anew after a pause are cut there first, so that a hot key is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.operators.ordered import cut_at_gaps, folded


def coalesced(
    rows: DataFrame, keys: Sequence[str], ts: str, span: int, update: str | None = None, merge: Callable[[object, object], object] | None = None, kind: str = "string"
) -> DataFrame:
    """keys, opened, updates: windows that the first row opens for ``span``; the next row after it opens the next one.

    With ``update`` and ``merge`` also merged (of type ``kind``): the updates of a window, merged two by two in order.
    """
    values = [ts, update if update is not None else F.lit(None).cast("string")]

    def step(window, t, value):
        if window and t < window[0] + span:
            return (window[0], window[1] + 1, merge(window[2], value) if merge else None), ()
        return (t, 1, value if merge else None), [window] if window else ()

    merged = f", merged {kind if merge else 'string'}"
    found = folded(cut_at_gaps(rows, keys, ts, span), keys, [ts], values, lambda: None, step, f"opened long, updates long{merged}", lambda w: [w] if w else (), ["_piece"])
    return found if merge else found.drop("merged")


def sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap: str) -> DataFrame:
    """keys, started, ended, events: runs without a pause of ``gap``."""
    found = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))
    return found.drop("w")


def token_bucket(rows: DataFrame, keys: Sequence[str], ts: str, seq: str, a_second: float, burst: float) -> DataFrame:
    """keys, seq, allowed, tokens (left), retry_after (microseconds until there is a token, for refused rows).

    The bucket refills with time up to ``burst`` and gives one token for each row; after a pause that fills it, it is as new.
    """

    def step(state, t, number):
        last, tokens = state
        tokens = min(burst, tokens + (t - (t if last is None else last)) / 1e6 * a_second)
        allowed = tokens >= 1
        tokens -= allowed
        wait = None if allowed else math.ceil((1 - tokens) / a_second * 1e6)
        return (t, tokens), [(number, allowed, tokens, wait)]

    full = math.ceil(burst / a_second * 1e6) + 1
    kind = rows.schema[seq].dataType.simpleString()
    return folded(cut_at_gaps(rows, keys, ts, full), keys, [ts, seq], [ts, seq], lambda: (None, burst), step, f"{seq} {kind}, allowed boolean, tokens double, retry_after long", within=["_piece"])


def bounded(rows: DataFrame, keys: Sequence[str], ts: str, seq: str, interval: int, limit: int, keep: str) -> DataFrame:
    """The rows that a queue of ``limit`` rows delivers at each flush: of each interval the newest ("drop-oldest") or the first."""
    newest = F.col(seq).desc() if keep == "drop-oldest" else F.col(seq).asc()
    place = F.row_number().over(Window.partitionBy(*keys, "flush").orderBy(newest))
    return rows.withColumn("flush", F.floor(F.col(ts) / interval)).withColumn("_p", place).filter(F.col("_p") <= limit).drop("_p")


def queue_flushes(rows: DataFrame, keys: Sequence[str], ts: str, seq: str, kind: str, limit: int, policy: str) -> DataFrame:
    """keys, seq, outcome, at: what becomes of each row put into a bounded queue, in order of ``ts`` and ``seq``.

    ``kind`` is put, flush or failed-flush. A flush delivers all that waits; a failed one leaves it queued. A full queue
    drops its oldest row (drop-oldest), drops the new one (drop-newest) or refuses it (reject): outcomes are delivered,
    dropped, rejected and, at the end, queued. ``at`` is the time at which that was decided.
    """
    if policy not in ("drop-oldest", "drop-newest", "reject"):
        raise ValueError(f"unknown policy: {policy}")

    def step(queue, t, number, what):
        if what == "flush":
            return [], [(q, "delivered", t) for q in queue]
        if what == "failed-flush":
            return queue, ()
        if len(queue) < limit:
            return [*queue, number], ()
        if policy == "drop-oldest":
            return [*queue[1:], number], [((queue or [number])[0], "dropped", t)]
        return queue, [(number, "rejected" if policy == "reject" else "dropped", t)]

    number = rows.schema[seq].dataType.simpleString()
    return folded(rows, keys, [ts, seq], [ts, seq, kind], list, step, f"{seq} {number}, outcome string, at long", lambda queue: [(q, "queued", None) for q in queue])


def first_seen(rows: DataFrame, key: str, ts: str, ttl: int, seq: str | None = None) -> DataFrame:
    """The rows that are new: not within ``ttl`` of the row that last counted as new with the same key.

    The time runs from first sight, so a steady stream is new once each ``ttl``. Of rows of the same time, the first by
    ``seq`` counts.
    """
    rest = [c for c in rows.columns if c != key]
    at = rest.index(ts)

    def step(last, *row):
        new = last is None or row[at] >= last + ttl
        return (row[at] if new else last), [row] if new else ()

    gives = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    order = [ts, seq] if seq else [ts]
    return folded(cut_at_gaps(rows, [key], ts, ttl), [key], order, rest, lambda: None, step, gives, within=["_piece"]).select(*rows.columns)


def dedup_refreshed(rows: DataFrame, key: str, ts: str, ttl: int) -> DataFrame:
    """Rows that are new when each sight renews the time: those after a pause of ``ttl``."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col(ts) - F.col("_b") > ttl)).drop("_b")


def batches(rows: DataFrame, keys: Sequence[str], ts: str, size: str, most: int, most_bytes: int, age: int, urgent: Column | None = None, seq: str | None = None) -> DataFrame:
    """keys, opened, messages, bytes: batches closed by count, bytes, or the age of their first message.

    ``urgent`` messages pass the queue by: each is a batch of its own, and has no part in the others. ``seq`` orders messages
    of the same time.
    """

    def step(batch, t, n, at_once):
        if at_once:
            return batch, [(t, 1, n)]
        if batch and batch[1] < most and batch[2] + n <= most_bytes and t < batch[0] + age:
            return (batch[0], batch[1] + 1, batch[2] + n), ()
        return (t, 1, n), [batch] if batch else ()

    values = [ts, F.coalesce(F.col(size).cast("long"), F.lit(0)), F.coalesce(urgent, F.lit(False)) if urgent is not None else F.lit(False)]
    return folded(cut_at_gaps(rows, keys, ts, age), keys, [ts, seq] if seq else [ts], values, lambda: None, step, "opened long, messages long, bytes long", lambda b: [b] if b else (), ["_piece"])


def breaker(calls: DataFrame, keys: Sequence[str], ts: str, failures: int, cooldown: int, seq: str | None = None) -> DataFrame:
    """keys, state, rejected: a circuit breaker's last state over calls (ok boolean) and the calls that it turned away.

    ``failures`` in a row open it; after ``cooldown`` one call is let through, and its outcome closes or opens it again.
    """

    def step(state, t, ok):
        name, run, opened, rejected = state
        if name == "OPEN" and t < opened + cooldown:
            return (name, run, opened, rejected + 1), ()
        if ok:
            return ("CLOSED", 0, opened, rejected), ()
        if name == "OPEN" or run + 1 >= failures:
            return ("OPEN", run + 1, t, rejected), ()
        return ("CLOSED", run + 1, opened, rejected), ()

    return folded(calls, keys, [ts, seq] if seq else [ts], [ts, "ok"], lambda: ("CLOSED", 0, None, 0), step, "state string, rejected long", lambda s: [(s[0], s[3])])


def leases(claims: DataFrame, range_: str, ts: str, node: str, ttl: int, renew: bool = True) -> DataFrame:
    """range, node, version, expires: who holds each range after its claims; another node's valid lease turns a claim away.

    The holder's own claim renews its lease, or leaves it as it is (``renew`` false). Claims of the same time come by node.
    """
    kind = claims.schema[node].dataType.simpleString()

    def step(lease, t, claimer):
        holder, version, expires = lease
        free = holder is None or expires <= t
        if free or (renew and holder == claimer):
            return (claimer, version + 1, t + ttl), ()
        return lease, ()

    return folded(claims, [range_], [ts, node], [ts, node], lambda: (None, 0, None), step, f"node {kind}, version long, expires long", lambda s: [s])


def capped_leases(claims: DataFrame, cluster: str, range_: str, ts: str, node: str, ttl: int, most: int) -> DataFrame:
    """cluster, range, node, version, expires: as leases() without renewal, where a node holds ``most`` valid leases at most.

    The cap ties the ranges of a cluster together, so a cluster's claims are one fold; its state has a row a range.
    """
    kinds = [claims.schema[c].dataType.simpleString() for c in (range_, node)]

    def step(held, t, wanted, claimer):
        lease = held.get(wanted)
        if not (lease and lease[2] > t) and sum(n == claimer and e > t for n, _, e in held.values()) < most:
            held[wanted] = (claimer, lease[1] + 1 if lease else 1, t + ttl)
        return held, ()

    return folded(claims, [cluster], [ts, range_, node], [ts, range_, node], dict, step, f"{range_} {kinds[0]}, node {kinds[1]}, version long, expires long", lambda held: [(r, *x) for r, x in held.items()])


class SharedState:
    """What a user supplies to fold updates into a session's state: a new state, one update applied, the state as text."""

    def create(self) -> object:
        return {}

    def apply(self, state: object, update: object) -> object:
        raise NotImplementedError

    def merge(self, updates: list) -> list:
        """Fewer updates with the same effect; by default as they are."""
        return updates

    def serialize(self, state: object) -> str:
        raise NotImplementedError


def session_states(updates: DataFrame, session: str, order: Sequence[str], update: str, adapter: SharedState, every: int | None = None) -> DataFrame:
    """session, updates, state: each session's state after all its updates, as ``adapter`` serializes it.

    With ``every``, a row after each so many updates too (snapshots), the last one being the state at the end.
    """

    def step(state, value):
        n, inner = state
        inner = adapter.apply(inner, value)
        given = [(n + 1, adapter.serialize(inner))] if every and (n + 1) % every == 0 else ()
        return (n + 1, inner), given

    def finish(state):
        return () if every and state[0] % every == 0 else [(state[0], adapter.serialize(state[1]))]

    return folded(updates, [session], order, [update], lambda: (0, adapter.create()), step, "updates long, state string", finish)


def liveness(beats: DataFrame, node: str, ts: str, now: Column, suspect: int, dead: int, pings: DataFrame | None = None, most_missed: int = 3, extra: Sequence[str] = ()) -> DataFrame:
    """node, last_seen, status: silent for longer than ``suspect`` or ``dead``.

    With ``pings`` (node, ts) also missed: the pings since the last sign of life; ``most_missed`` of them mean dead. Columns of
    ``extra``, which ``now`` may read, are the same in all rows and kept.
    """
    silent = now - F.col("last_seen")
    seen = beats.groupBy(node).agg(F.max(ts).alias("last_seen"), *[F.max(c).alias(c) for c in extra])
    gone = silent > dead
    if pings is not None:
        after = pings.select(node, F.col(ts).alias("_ping")).join(seen, node).filter(F.col("_ping") > F.col("last_seen"))
        missed = after.groupBy(node).agg(F.count("*").alias("missed"))
        seen = seen.join(missed, node, "left").withColumn("missed", F.coalesce("missed", F.lit(0)))
        gone = gone | (F.col("missed") >= most_missed)
    return seen.withColumn("status", F.when(gone, "DEAD").when(silent > suspect, "SUSPECT").otherwise("ALIVE"))


def idle(rows: DataFrame, last: str, now: Column, most: int) -> DataFrame:
    return rows.filter(now - F.col(last) > most)


def queue_recovery(log: DataFrame, message: str, queue: str, lsn: str) -> DataFrame:
    """queue, pending, acknowledged, dead: each message's last log record decides."""
    last = log.groupBy(queue, message).agg(F.max_by(F.struct("operation", "status"), lsn).alias("_l"))
    state = F.when(F.col("_l.operation") == "DELETE", "acknowledged").when((F.col("_l.operation") == "UPDATE") & (F.col("_l.status") == "dead-letter"), "dead").otherwise("pending")
    found = last.withColumn("_s", state)
    return found.groupBy(queue).agg(*[F.count_if(F.col("_s") == s).alias(s) for s in ("pending", "acknowledged", "dead")])


def delivery(attempts: DataFrame, message: str, number: str, most: int, failed_at: str | None = None, delay: int = 0) -> DataFrame:
    """message, status, attempts: completed at the first success, a dead letter after ``most`` failures, else waiting.

    With ``failed_at`` (the time of each attempt) also visible_after: a waiting message is hidden for ``delay`` after its last failure.
    """
    tried = attempts.filter(F.col(number) <= most)
    last = [F.max_by(failed_at, number).alias("_at")] if failed_at else []
    first = tried.groupBy(message).agg(F.min(F.when(F.col("ok"), F.col(number))).alias("_ok"), F.max(number).alias("_n"), *last)
    status = F.when(F.col("_ok").isNotNull(), "completed").when(F.col("_n") >= most, "dead-letter").otherwise("pending")
    visible = [F.when(status == "pending", F.col("_at") + delay).alias("visible_after")] if failed_at else []
    return first.select(message, status.alias("status"), F.coalesce("_ok", "_n").alias("attempts"), *visible)


def handled_by_range(messages: DataFrame, range_: str, order: Sequence[str], values: Sequence[str], join: Callable[[], object], handle: Callable[..., tuple[object, Sequence[tuple]]], gives: str) -> DataFrame:
    """range and ``gives``: what the caller's handler of a range answers to its messages, in order.

    ``join()`` makes a range's state, ``handle(state, *values)`` returns the next one and the rows to send on. Ranges are
    dealt over the tasks; a task holds one range's state at a time.
    """
    return folded(messages, [range_], order, values, join, handle, gives)

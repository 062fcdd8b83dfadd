"""State folding: current entity state from change logs under three merge rules, and membership merges.

Where a rule has a closed form, it is used: aggregates with map-side combine. The exact folds depend on arrival order and
read an entity's changes one by one (``operators.ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.operators.ordered import folded


def version_state(log: DataFrame, key: str = "entity_id", order: str = "lsn") -> DataFrame:
    """The version fold of a log in which versions rise with ``order``: the live entities.

    A delete clears; after the last delete the first create makes the entity, later updates and transfers apply, and
    later creates are ignored. Columns: key, created_lsn, version, owner (of the last transfer, or the create).
    Two aggregates by key, each combined within tasks.
    """
    cleared = log.groupBy(key).agg(F.max(F.when(F.col("operation") == "DELETE", F.col(order))).alias("_cleared"))
    open_ = log.join(cleared, key).filter(F.col("_cleared").isNull() | (F.col(order) > F.col("_cleared")))
    made = open_.filter("operation = 'CREATE'").groupBy(key).agg(F.min_by(F.struct(F.col(order).alias("at"), "version", "owner"), order).alias("_made"))
    changes = open_.filter("operation IN ('UPDATE', 'TRANSFER')").join(made, key).filter(F.col(order) > F.col("_made.at"))
    later = changes.groupBy(key).agg(
        F.max("version").alias("_version"), F.max_by(F.when(F.col("operation") == "TRANSFER", F.col("owner")), F.when(F.col("operation") == "TRANSFER", F.col(order))).alias("_owner")
    )
    return made.join(later, key, "left").select(
        key, F.col("_made.at").alias("created_lsn"), F.coalesce("_version", "_made.version").alias("version"), F.coalesce("_owner", "_made.owner").alias("owner")
    )


_CHANGE = ("operation", "owner", "version", "ts", "metadata")


def version_fold(log: DataFrame, key: str = "entity_id", order: str = "ord") -> DataFrame:
    """The exact version fold in arrival order, with metadata (map<string,string>).

    CREATE applies only to an absent entity, UPDATE and TRANSFER only to a present one of a lower version; UPDATE merges
    metadata and TRANSFER takes the owner only; DELETE is unconditional. Columns: key, owner, version, created_at,
    last_updated, metadata of the live entities. A task holds one entity's state, not its history.
    """

    def step(state, operation, owner, version, ts, metadata):
        if operation == "DELETE":
            return None, ()
        if operation == "CREATE":
            return state or (owner, version, ts, ts, dict(metadata or ())), ()
        if state is None or version is None or state[1] is None or version <= state[1]:
            return state, ()
        if operation == "TRANSFER":
            return (owner, version, state[2], ts, state[4]), ()
        return ((state[0], version, state[2], ts, state[4] | dict(metadata or ())) if operation == "UPDATE" else state), ()

    gives = "owner string, version long, created_at long, last_updated long, metadata map<string,string>"
    return folded(log, [key], [order], _CHANGE, lambda: None, step, gives, lambda s: [(*s[:4], [*s[4].items()])] if s else ())


def lww_fold(log: DataFrame, key: str = "entity_id", order: str = "ord") -> DataFrame:
    """The last-writer-wins fold with tombstones, in arrival order: key, live, owner, version, author, metadata, deleted_at.

    The higher (version, author) wins and an exact tie lets the incoming row apply; a row without an owner has the author
    ''. A delete leaves a tombstone that beats older rows; deletes of absent entities refresh it. UPDATE merges metadata onto
    what is there, CREATE and TRANSFER replace it, so metadata depends on arrival order; owner and version do not.
    """

    def step(state, operation, owner, version, ts, metadata):
        author = owner or ""
        if state and (state[2], state[3]) > (version, author):
            return state, ()
        if operation == "DELETE":
            return (False, None, version, author, None, ts), ()
        kept = (state[4] if state and operation == "UPDATE" else None) or {}
        holder = owner if owner is not None else (state[1] if state else None) or ""
        return (True, holder, version, author, kept | dict(metadata or ()), None), ()

    gives = "live boolean, owner string, version long, author string, metadata map<string,string>, deleted_at long"
    return folded(log, [key], [order], _CHANGE, lambda: None, step, gives, lambda s: [(*s[:4], None if s[4] is None else [*s[4].items()], s[5])])


def lww_state(log: DataFrame, key: str = "entity_id") -> DataFrame:
    """The order-free part of the last-writer-wins merge: the winning operation, version and owner of each key, in one aggregate."""
    author = F.coalesce("owner", F.lit(""))
    won = F.max(F.struct(F.col("version"), author.alias("author"), F.col("operation"), F.col("ts_us").alias("ts"))).alias("_w")
    return log.groupBy(key).agg(won).select(key, (F.col("_w.operation") != "DELETE").alias("live"), "_w.version", F.col("_w.author").alias("owner"), F.col("_w.ts").alias("ts"))


def tombstones_kept(states: DataFrame, now: Column, ttl: int | None, key: str = "entity_id") -> DataFrame:
    """Tombstones younger than ``ttl`` (kept for ever if None); fencing records never expire."""
    dead = states.filter(~F.col("live"))
    return dead if ttl is None else dead.filter((F.col("ts") > now - ttl) | F.col(key).cast("string").startswith("__fence__:"))


def log_kept(log: DataFrame, now: Column, retention: int | None, key: str = "entity_id", ts: str = "ts_us") -> DataFrame:
    """Log rows younger than ``retention``; fencing records always stay."""
    return log if retention is None else log.filter((F.col(ts) > now - retention) | F.col(key).cast("string").startswith("__fence__:"))


def from_checkpoint(checkpoint: DataFrame, tail: DataFrame, lsn: int) -> DataFrame:
    """Checkpoint rows as creates, then the log after ``lsn``: the input of a fold that need not read the whole log."""
    start = checkpoint.select(F.lit(lsn).cast("long").alias("lsn"), "entity_id", "owner", "version", F.lit("CREATE").alias("operation"))
    return start.unionByName(tail.filter(F.col("lsn") > lsn).select("lsn", "entity_id", "owner", "version", "operation"))


def rejected_mutations(log: DataFrame, key: str = "entity_id", order: str = "lsn") -> DataFrame:
    """Local mutations that ownership forbids: creates of live entities, others on absent ones, and by whom (key, order, reason)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("operation").isin("CREATE", "DELETE"), F.col("operation")), ignorenulls=True).over(before)
    live = F.coalesce(last == "CREATE", F.lit(False))
    reason = F.when((F.col("operation") == "CREATE") & live, "already exists").when((F.col("operation") != "CREATE") & ~live, "not found")
    return log.withColumn("reason", reason).filter("reason IS NOT NULL").select(key, order, "operation", "reason")


def exported(states: DataFrame, node: str, now: Column) -> DataFrame:
    """A registry's snapshot: its live entities with node, clock (the highest version) and the time at which it was taken."""
    live = states.filter("live")
    clock = states.agg(F.coalesce(F.max("version"), F.lit(0)).alias("clock"))
    return live.join(F.broadcast(clock)).select("entity_id", "owner", "version", "metadata", F.lit(node).alias("node"), "clock", now.alias("taken_at"))


def imported(snapshot: DataFrame, states: DataFrame) -> DataFrame:
    """The registry after an import: what the snapshot has replaces everything, tombstones too; entity_id, live, owner,
    version, author, metadata, deleted_at, and clock, the higher of the registry's and the snapshot's."""
    clock = states.agg(F.max("version").alias("clock")).unionByName(snapshot.agg(F.max("clock").alias("clock"))).agg(F.coalesce(F.max("clock"), F.lit(0)).alias("clock"))
    rows = snapshot.select("entity_id", F.lit(True).alias("live"), "owner", "version", F.col("owner").alias("author"), "metadata", F.lit(None).cast("long").alias("deleted_at"))
    return rows.join(F.broadcast(clock))


def foreign_mutations(log: DataFrame, states: DataFrame, node: str, key: str = "entity_id") -> DataFrame:
    """Mutations (key, operation, actor) of ``node``'s registry with what forbids them, null where they may go on.

    A create needs an absent entity; release, update and transfer need one that is there and that the actor owns.
    """
    here = states.filter("live").select(key, F.col("owner").alias("_owner"))
    absent = F.col("_owner").isNull()
    reason = (
        F.when((F.col("operation") == "CREATE") & ~absent, "already exists")
        .when((F.col("operation") != "CREATE") & absent, "not found")
        .when((F.col("operation") != "CREATE") & (F.col("_owner") != F.col(node)), "not the owner")
    )
    return log.join(here, key, "left").withColumn("reason", reason).drop("_owner")


def membership(reports: DataFrame, key: str, own: str | None = None) -> DataFrame:
    """The merged membership: a higher version wins, at equal versions the later last_seen; reports about ``own`` are ignored."""
    rest = [c for c in reports.columns if c != key]
    others = reports if own is None else reports.filter(F.col(key) != own)
    won = F.max_by(F.struct(*rest), F.struct("version", "last_seen")).alias("_w")
    return others.groupBy(key).agg(won).select(key, *[F.col(f"_w.{c}").alias(c) for c in rest])


def pruned(members: DataFrame, now: Column, age: int) -> DataFrame:
    """Members without those that are dead and have not been seen for ``age``."""
    return members.filter(~((F.col("status") == "DEAD") & (now - F.col("last_seen") > age)))


def first_highest(rows: DataFrame, key: str, version: str, order: str) -> DataFrame:
    """The row of the highest version of each key, of equal ones the first: the merge of several responders' snapshots."""
    rest = [c for c in rows.columns if c != key]
    won = F.max_by(F.struct(*rest), F.struct(F.col(version), -F.col(order))).alias("_w")
    return rows.groupBy(key).agg(won).select(key, *[F.col(f"_w.{c}").alias(c) for c in rest])


def with_defaults(settings: DataFrame, defaults: DataFrame, key: str, value: str) -> DataFrame:
    """Each key of ``defaults`` with its setting, or its default."""
    own = settings.select(key, F.col(value).alias("_own"))
    return defaults.join(own, key, "left").select(key, F.coalesce("_own", value).alias(value))


def valid_settings(settings: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``settings`` with valid: whether the rule of each setting's key (a Column over the row) holds; settings without a rule are valid."""
    ok = F.lit(True)
    for name, rule in rules.items():
        ok = F.when(F.col(key) == name, F.coalesce(rule, F.lit(False))).otherwise(ok)
    return settings.withColumn("valid", ok)

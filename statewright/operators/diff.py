"""Fingerprints, Merkle roots, differences between replicas, deltas and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from statewright.sources.scratch import written


def row_hash(state: DataFrame, *columns: str) -> Column:
    """SHA-256 of a row as a JSON object with the columns in name order.

    Strings are quoted and escaped and nulls are written, so no value can look like the end of one and the start of another,
    and a null is unlike any text. Map columns are written as entries in key order.
    """
    entries = lambda c: F.array_sort(F.map_entries(c)).alias(c)
    written_as = [entries(c) if isinstance(state.schema[c].dataType, MapType) else F.col(c) for c in sorted(columns)]
    return F.sha2(F.to_json(F.struct(*written_as), {"ignoreNullFields": "false"}), 256)


def fingerprints(state: DataFrame, key: str, *columns: str) -> DataFrame:
    return state.select(key, row_hash(state, key, *columns).alias("hash"))


def merkle_leaves(prints: DataFrame, key: str, width: int) -> DataFrame:
    """leaf, leaf_hash: the hash of each run of hashes in key order. Integer keys; leaves are ranges of ``width`` keys.

    Fixed key ranges let every range be a group of its own, without numbering all rows in one task.
    """
    leaf = F.floor(F.col(key) / width)
    rows = prints.groupBy(leaf.alias("leaf")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "hash"))).alias("rows"))
    return rows.select("leaf", F.sha2(F.array_join(F.transform("rows", lambda r: r.hash), ""), 256).alias("leaf_hash"))


def row_chunks(prints: DataFrame, key: str, size: int) -> DataFrame:
    """leaf, leaf_hash over runs of ``size`` rows in key order, numbered from 0: the hash of their hashes one after another.

    Rows are numbered by ranges of the key, whose sizes are added up: no task orders them all. A single row is its own leaf.
    """
    n = max(8, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(prints.select(key, "hash").repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()), "merkle")
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    total = F.sum("n").over(Window.partitionBy())
    rows = ordered.join(F.broadcast(sizes.select("_p", before.alias("_before"), total.alias("_all"))), "_p").withColumn("_n", F.col("_before") + place)
    chunks = rows.groupBy(F.expr(f"_n div {size}").alias("leaf")).agg(F.max("_all").alias("_all"), F.array_sort(F.collect_list(F.struct("_n", "hash"))).alias("rows"))
    joined = F.sha2(F.array_join(F.transform("rows", lambda r: r.hash), ""), 256)
    return chunks.select("leaf", F.when(F.col("_all") == 1, F.col("rows")[0].hash).otherwise(joined).alias("leaf_hash"))


def merkle_root(leaves: DataFrame) -> DataFrame:
    """root: the hash over leaves (leaf from 0, leaf_hash), two by two; an odd node is paired with itself, a single one is the
    root, and without any it is the hash of nothing. Each level is one aggregate of half the rows."""
    spark = leaves.sparkSession
    level = written(leaves.select(F.col("leaf").cast("long").alias("leaf"), "leaf_hash"), "merkle-level")
    while level.count() > 1:
        pairs = level.groupBy(F.expr("leaf div 2").alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("leaf", "leaf_hash"))).alias("p"))
        level = written(pairs.select("leaf", F.sha2(F.concat(F.col("p")[0].leaf_hash, F.element_at("p", -1).leaf_hash), 256).alias("leaf_hash")), "merkle-level")
    return level.select(F.col("leaf_hash").alias("root")) if not level.isEmpty() else spark.range(1).select(F.sha2(F.lit(""), 256).alias("root"))


def compared(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, change: what turns ``target`` into ``source`` (tables of key and hash): added, removed or modified."""
    s, t = source.select(key, F.col("hash").alias("_s")), target.select(key, F.col("hash").alias("_t"))
    both = s.join(t, key, "full_outer")
    change = F.when(F.col("_t").isNull(), "added").when(F.col("_s").isNull(), "removed").when(F.col("_s") != F.col("_t"), "modified")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(key, "change")


def delta(source: DataFrame, target: DataFrame, key: str, *columns: str, buckets: int = 16) -> DataFrame:
    """The operations that turn ``target`` into ``source``: bucket, key, operation (add, modify, delete) and the new values."""
    changes = compared(fingerprints(source, key, *columns), fingerprints(target, key, *columns), key)
    verb = F.when(F.col("change") == "added", "add").when(F.col("change") == "removed", "delete").otherwise("modify")
    ops = changes.join(source.select(key, *columns), key, "left")
    return ops.select(F.pmod(F.col(key), F.lit(buckets)).alias("bucket"), key, verb.alias("operation"), *columns)


def applied(state: DataFrame, ops: DataFrame, key: str, *columns: str) -> DataFrame:
    """``state`` after a delta with one operation for each key at most."""
    changes = ops.select(key, "operation", *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = state.join(changes, key, "full_outer").filter("operation IS NULL OR operation <> 'delete'")
    new = F.col("operation").isNotNull()
    return both.select(key, *[F.when(new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def apply_outcome(state: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """For each operation (key, operation, previous_version): applied, or the class of its conflict.

    An addition or change of a row whose version is not the one that it was made from is a version conflict; a change of
    an absent row has a missing dependency; a delete of an absent row is already done, which is a warning only.
    """
    here = state.select(key, F.col("version").alias("_have"))
    missing = F.col("_have").isNull()
    outcome = (
        F.when((F.col("operation") == "modify") & missing, "missing-dependency")
        .when((F.col("operation") == "modify") & (F.col("_have") != F.col("previous_version")), "version")
        .when((F.col("operation") == "add") & ~missing, "version")
        .when((F.col("operation") == "delete") & missing, "already-deleted")
        .otherwise("applied")
    )
    return ops.join(here, key, "left").select(key, "operation", outcome.alias("outcome"))


def merged(ops: DataFrame, key: str, *order: str) -> DataFrame:
    """The last operation of each key over several deltas."""
    rest = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_o")).select(key, *[F.col(f"_o.{c}").alias(c) for c in rest])


def merged_clock(clocks: DataFrame, key: str, clock: str) -> DataFrame:
    """The vector clock of each key: the highest counter of each node."""
    ticks = clocks.select(key, F.explode(clock).alias("node", "tick")).groupBy(key, "node").agg(F.max("tick").alias("tick"))
    return ticks.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "tick")))).alias(clock))


def happens_before(a: Column, b: Column) -> Column:
    """No counter of ``a`` is above ``b``'s and one is below; an absent counter is 0."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    return F.forall(pairs, lambda p: p.x <= p.y) & F.exists(pairs, lambda p: p.x < p.y)


def valid(ops: DataFrame, key: str, value: str) -> DataFrame:
    """``ops`` with ``errors``: an array of what is wrong with each operation."""
    found = F.array(
        F.when(F.col(key).isNull(), "missing id"),
        F.when(F.col("operation").isNull() | ~F.col("operation").isin("add", "modify", "delete"), "unknown operation"),
        F.when(F.col("operation").isin("add", "modify") & F.col(value).isNull(), "missing data"),
    )
    return ops.withColumn("errors", F.filter(found, lambda e: e.isNotNull()))


def patch(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """For rows on both sides: a map of the fields that differ to their new values (as strings); rows without any are left out."""
    both = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]).join(new.select(key, *columns), key)
    entries = F.array(*[F.when(~F.col(f"_o_{c}").eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in columns])
    return both.select(key, F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())).alias("patch")).filter(F.size("patch") > 0)


def patched(state: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``state`` with the fields that ``patches`` (key, patch) name; a map column is merged with the patch's, others are replaced.

    A patch is a map of field to text, or a struct with a field for each column, of which nulls change nothing.
    """
    rest = [c for c in state.columns if c != key]
    given = patches.select(key, F.col("patch").alias("_patch"))
    both = state.join(given, key, "left")
    if not isinstance(patches.schema["patch"].dataType, MapType):
        fields = set(patches.schema["patch"].dataType.fieldNames())

        def value(c: str) -> Column:
            new, kind = F.col(f"_patch.{c}"), state.schema[c].dataType
            if isinstance(kind, MapType):
                kept = F.map_filter(c, lambda k, _: ~F.map_contains_key(new, k))
                return F.when(new.isNull(), F.col(c)).when(F.col(c).isNull(), new).otherwise(F.map_concat(kept, new))
            return F.coalesce(new, F.col(c))

        return both.select(key, *[(value(c) if c in fields else F.col(c)).alias(c) for c in rest])
    named = lambda c: F.coalesce(F.map_contains_key("_patch", F.lit(c)), F.lit(False))
    return both.select(key, *[F.when(named(c), F.col("_patch")[c].cast(state.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rest])


def applied_in_sequence(state: DataFrame, deltas: DataFrame, key: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """The state after all deltas, and sequence, operations, failed of each.

    ``deltas`` has sequence, key, operation, previous_version and the new values (version among them); one operation a key in each.
    Deltas go in order of their sequence number (a list of a few, so the driver steps through them); one with a conflict,
    an unknown operation or a missing key is left out whole, and the next one meets the state before it.
    """
    numbers = [r[0] for r in deltas.select("sequence").distinct().orderBy("sequence").collect()]
    outcomes = []
    for number in numbers:
        ops = deltas.filter(F.col("sequence") == number).drop("sequence")
        bad = F.col(key).isNull() | ~F.coalesce(F.col("operation").isin("add", "modify", "delete"), F.lit(False))
        judged = apply_outcome(state, ops, key)
        counts = ops.agg(F.count("*"), F.count_if(bad)).first()
        failed = counts[1] + judged.filter("outcome IN ('version', 'missing-dependency')").count()
        outcomes.append((number, counts[0], failed))
        if not failed:
            state = written(applied(state, ops, key, *columns), "deltas")
    return state, state.sparkSession.createDataFrame(outcomes, "sequence long, operations long, failed long")


def causality(deltas: DataFrame, by: str, causes: str) -> DataFrame:
    """by, causality: the different ids in the arrays ``causes`` of each group of deltas, sorted."""
    return deltas.select(by, F.explode(causes).alias("_c")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("_c")).alias("causality"))


def replaced(rows: DataFrame, update: DataFrame, sender: str) -> DataFrame:
    """``rows`` with all rows of the senders of ``update`` replaced by those that it has."""
    return rows.join(update.select(sender).distinct(), sender, "left_anti").unionByName(update)


def numbered_chunks(ops: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """``ops`` with ``chunk``: at most ``size`` operations each, within each value of ``by``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return ops.withColumn("chunk", F.floor(place / size))

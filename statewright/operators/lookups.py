"""Filters, lookups and selections over registries, connections, presence and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owned_by(entities: DataFrame, owner: str, node: str) -> DataFrame:
    return entities.filter(F.col(owner) == node)


def tagged(connections: DataFrame, tags: str, wanted: dict[str, str]) -> DataFrame:
    """Connections that have all wanted tags; a tag (map to arrays) holds one value or several."""
    for tag, value in wanted.items():
        connections = connections.filter(F.array_contains(F.col(tags)[tag], value))
    return connections


def with_tag(connections: DataFrame, tags: str, tag: str) -> DataFrame:
    return connections.filter(F.map_contains_key(tags, tag))


def with_address(resources: DataFrame, members: DataFrame, owner: str, node: str) -> DataFrame:
    """``resources`` with the address of their owner, null for owners that are unknown or not alive."""
    known = members.select(F.col(node).alias(owner), F.when(F.col("status") == "ALIVE", F.col("address")).alias("address"))
    return resources.join(known, owner, "left")


def online(local: DataFrame, remote: DataFrame, client: str) -> DataFrame:
    """Clients of this node and of the others, each once."""
    return local.select(client).unionByName(remote.select(client)).distinct()


def bootstrap_seeds(seeds: DataFrame, name: str, priority: str, temporary: int = 3) -> DataFrame:
    """Available seeds to start from: all permanent ones and the best few temporary ones."""
    best = Window.partitionBy("permanent").orderBy(F.desc(priority), name)
    ranked = seeds.filter("available").withColumn("_r", F.row_number().over(best))
    return ranked.filter(F.col("permanent") | (F.col("_r") <= temporary)).drop("_r")


def least_connected(nodes: DataFrame, connections: DataFrame, node: str, n: int) -> DataFrame:
    """The ``n`` nodes with the fewest connections, ties by name."""
    counts = connections.groupBy(node).agg(F.count("*").alias("connections"))
    return nodes.join(counts, node, "left").fillna(0, "connections").orderBy("connections", node).limit(n)


def zone_first(nodes: DataFrame, node: str, zone: str, own: str, n: int, seed: int) -> DataFrame:
    """``n`` targets, those of the own zone first, in an order that the seed gives."""
    order = F.md5(F.concat_ws(":", F.col(node).cast("string"), F.lit(str(seed))))
    return nodes.orderBy((F.col(zone) != own).cast("int"), order, node).limit(n)


def sample(nodes: DataFrame, node: str, n: int, seed: int) -> DataFrame:
    """``n`` nodes drawn without replacement: the first in an order that the seed gives."""
    return nodes.orderBy(F.md5(F.concat_ws(":", F.col(node).cast("string"), F.lit(str(seed)))), node).limit(n)


def by_priority(messages: DataFrame, priority: str, seq: str) -> DataFrame:
    """Messages with their place: higher priority first, then arrival."""
    return messages.orderBy(F.desc(priority), seq)


def evicted(rows: DataFrame, keys: Sequence[str], order: str, capacity: int) -> DataFrame:
    """What a first-in-first-out store of ``capacity`` rows has dropped."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") > capacity).drop("_r")


def hashed_range(messages: DataFrame, bucket: Column, owners: DataFrame) -> DataFrame:
    """``messages`` with the node that owns the range of their key (range_id, node)."""
    return messages.withColumn("range_id", bucket).join(owners, "range_id")


def found(entities: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return entities.filter(F.col(key) == F.lit(value))


def owned_resources(resources: DataFrame, entities: DataFrame, key: str, kind: str | None = None, node: str | None = None) -> DataFrame:
    """``resources`` of live entities (key, owner, version) with owner, version taken from the entity whatever the resource says;
    those of a kind or of a node's, if asked."""
    plain = resources.drop("owner", "version")
    if kind is not None:
        plain = plain.filter(F.col("kind") == kind)
    own = entities.select(key, "owner", "version")
    return plain.join(own if node is None else own.filter(F.col("owner") == node), key)


def active_runs(runs: DataFrame, status: str = "status") -> DataFrame:
    """Runs that have not ended."""
    return runs.filter(F.col(status).isin("running", "awaiting-approval", "pending"))


def pending_approvals(steps: DataFrame, path: str = "$.approvers") -> DataFrame:
    """Approval steps that wait, with the approvers that their payload (JSON) names."""
    waiting = steps.filter((F.col("type") == "approval") & (F.col("status") == "awaiting-approval"))
    return waiting.withColumn("approvers", F.get_json_object("payload", path))


def run_history(events: DataFrame, run: str, value: object, version: str, first: int = 0) -> DataFrame:
    """The events of one run from version ``first`` on, whose payload (JSON) names the run under ``run``."""
    return events.filter((F.get_json_object("payload", f"$.{run}") == F.lit(str(value))) & (F.col(version) >= first))


def created_alive(created: DataFrame, deleted: DataFrame, key: str, at: str) -> DataFrame:
    """What was created and not deleted afterwards: rows of ``created`` (key, at) without a row of ``deleted`` that is later."""
    last = deleted.groupBy(key).agg(F.max(at).alias("_deleted"))
    return created.join(last, key, "left").filter(F.col("_deleted").isNull() | (F.col("_deleted") < F.col(at))).drop("_deleted")


def longest_name(names: DataFrame, by: Sequence[str], name: str, sep: str = ", ") -> DataFrame:
    """by, joined, longest: the different names of each group joined in order, and the longest of them (of equally long ones the least)."""
    different = names.select(*by, name).distinct()
    least = F.min(F.struct((-F.length(name)).alias("l"), F.col(name).alias("n")))
    return different.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(name)), sep).alias("joined"), least.alias("_l")).select(*by, "joined", F.col("_l.n").alias("longest"))

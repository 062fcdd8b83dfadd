"""Placement: consistent-hash ring, replicas, load-aware choice, rebalancing and leases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewright.functions import digests
from statewright.functions.columns import ring_hash, usable_load

#: Virtual nodes of each node, and the shift that cuts the 32-bit circle into 4096 sectors.
VIRTUAL, SECTOR = 100, 20
#: Keys that are ranked with all members at once, by one task.
BATCH = 1024


def ring(nodes: DataFrame, name: str, virtual: int = VIRTUAL) -> DataFrame:
    """h, node: the places of each node's virtual nodes; of places that coincide, the least node."""
    spots = nodes.select(F.col(name).cast("string").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return spots.groupBy(ring_hash(F.concat_ws(":", "node", F.col("i").cast("string"))).alias("h")).agg(F.min("node").alias("node"))


def arcs(ring_: DataFrame, replicas: int = 1, ahead: int | None = None) -> DataFrame:
    """sector, low, high, owner, owners: the arcs low < hash <= high by the sectors that they cross; the last arc wraps.

    owners lists the next ``replicas`` different nodes. The ring is configuration: nodes times virtual nodes. Each place looks
    at the ``ahead`` places that follow it; places that see too few nodes there look twice as far, until all see enough.
    """
    order = Window.orderBy("h")
    n = ring_.agg(F.count("*"), F.countDistinct("node")).first()  # two numbers about the configuration
    size, nodes = n[0], n[1]
    wanted = min(replicas, nodes)
    ahead = min(size, ahead or 4 * replicas)
    # The ring's start is laid behind its end, so that a frame of following places wraps.
    head = ring_.orderBy("h").limit(size if replicas > 1 else 0).withColumn("h", F.col("h") + (1 << 32))
    line = ring_.unionByName(head).withColumn("low", F.coalesce(F.lag("h").over(order), F.lit(-1)))
    found = None
    while True:
        frame = order.rowsBetween(0, max(0, ahead - 1))
        seen = line.withColumn("owners", F.slice(F.array_distinct(F.collect_list("node").over(frame)), 1, replicas)).filter(F.col("h") < 1 << 32)
        if replicas == 1 or ahead >= size or seen.filter(F.size("owners") < wanted).isEmpty():
            found = seen
            break
        ahead = min(size, 2 * ahead)
    whole = found.select("low", F.col("h").alias("high"), F.col("node").alias("owner"), "owners")
    last = whole.agg(F.max("high").alias("low"), F.lit((1 << 32) - 1).alias("high"), F.min_by("owner", "high").alias("owner"), F.min_by("owners", "high").alias("owners"))
    every = whole.unionByName(last)
    sectors = F.sequence(F.shiftright(F.col("low") + 1, SECTOR), F.shiftright("high", SECTOR))
    return every.filter("low < high").select(F.explode(sectors).alias("sector"), "low", "high", "owner", "owners")


def owners(keys: DataFrame, key: str, ring_: DataFrame, replicas: int = 1) -> DataFrame:
    """``keys`` with owner and owners: the first node at or after the key's hash. An equi-join by sector, not by comparison."""
    hashed = keys.withColumn("_h", ring_hash(F.col(key).cast("string"))).withColumn("sector", F.shiftright("_h", SECTOR))
    found = hashed.join(arcs(ring_, replicas), "sector").filter((F.col("_h") > F.col("low")) & (F.col("_h") <= F.col("high")))
    return found.select(*keys.columns, "owner", "owners")


def least_loaded(candidates: DataFrame, resources: DataFrame, group: str, node: str, local: str) -> DataFrame:
    """group, node: the candidate with the fewest resources; ties go to the local one, then to the least name."""
    load = resources.groupBy(node).agg(F.count("*").alias("_n"))
    loaded = candidates.join(load, node, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return loaded.groupBy(group).agg(F.min_by(node, F.struct("_n", (~F.col(local)).cast("int").alias("l"), node)).alias(node))


def routed(keys: DataFrame, key: str, strategy: str, ring_: DataFrame, members: DataFrame, replicas: int = 3, zone: str | None = None, seed: int = 0) -> DataFrame:
    """``keys`` with nodes: consistent-hash (the ring's owners), round-robin (all alive members by id), random (``replicas`` of
    them, in an order that key and seed give) or locality-aware (the first alive members of ``zone`` if it has ``replicas``,
    else as consistent-hash). ``members`` (id, status, zone) is the configuration of the cluster."""
    if strategy == "consistent-hash" or (strategy == "locality-aware" and zone is None):
        return owners(keys, key, ring_, replicas).select(*keys.columns, F.col("owners").alias("nodes"))
    alive = members.filter("status = 'ALIVE'").select(F.col("id").cast("string").alias("id"), "zone")
    if strategy in ("round-robin", "random"):
        listed = alive.agg(F.array_sort(F.collect_list("id")).alias("_all"))
        if strategy == "random":
            return _ranked(keys, key, listed, str(seed), replicas)
        return _dealt(keys).join(F.broadcast(listed)).select(*keys.columns, F.col("_all").alias("nodes"))
    if strategy != "locality-aware":
        raise ValueError(f"unknown strategy: {strategy}")
    near = alive.filter(F.col("zone") == zone).agg(F.array_sort(F.collect_list("id")).alias("_near"))
    found = owners(keys, key, ring_, replicas).join(F.broadcast(near))
    return found.select(*keys.columns, F.when(F.size("_near") >= replicas, F.slice("_near", 1, replicas)).otherwise(F.col("owners")).alias("nodes"))


def _ranked(keys: DataFrame, key: str, listed: DataFrame, seed: str, replicas: int) -> DataFrame:
    """``keys`` with nodes: the first of the names in ``listed`` (one row: _all) by the md5 of key:name:seed.

    Every key meets every name, so keys go in batches, each to a task that hashes its pairs by columns of numpy.
    """

    @F.pandas_udf("array<array<string>>")
    def least(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([digests.least(t, n, seed, replicas) for t, n in zip(texts, names, strict=True)])

    batches = max(32, -(-keys.count() // BATCH))
    dealt = keys.withColumn("_b", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)).cast("int")).repartitionById(batches, F.col("_b"))
    rows = dealt.groupBy("_b").agg(F.collect_list(F.struct(*keys.columns)).alias("_rows")).join(F.broadcast(listed))
    texts = F.transform("_rows", lambda r: r[key].cast("string"))
    found = rows.select("_rows", least(texts, "_all").alias("_nodes"))
    each = found.select(F.explode(F.arrays_zip("_rows", "_nodes")).alias("_r"))
    return each.select(*[F.col(f"_r._rows.{c}").alias(c) for c in keys.columns], F.col("_r._nodes").alias("nodes"))


def placed(resources: DataFrame, key: str, candidates: DataFrame, strategy: Callable[[Column, Column], Column], least: bool = True, by: Sequence[str] | None = None) -> DataFrame:
    """``resources`` with node: the candidate (node and whatever ``strategy`` reads) with the least or highest value of
    ``strategy(key, candidate)``, a Column that the caller builds; ties go to the least name. Candidates are configuration.

    ``by`` names the columns of a candidate that ``strategy`` reads, if its name is none of them: candidates that agree in
    these have the same value, so only the least name of each such group is scored.
    """
    if by is not None:
        candidates = candidates.groupBy(*by).agg(F.min("node").alias("node"))
    listed = candidates.agg(F.collect_list(F.struct(*candidates.columns)).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct((strategy(F.col(key), c) if least else -strategy(F.col(key), c)).alias("s"), c.node.alias("n")))
    return _dealt(resources).join(F.broadcast(listed)).select(*resources.columns, F.array_min(scored).n.alias("node"))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over many tasks, where much is done for each row: a small table is read in one."""
    return rows.repartition(max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def random_node(key: Column, candidate: Column) -> Column:
    """A strategy for placed(): an order of the candidates that the key gives."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), candidate.node.cast("string"))), 1, 12), 16, 10).cast("long")


def ring_stats(ring_: DataFrame) -> DataFrame:
    """nodes, places, virtual: different nodes, their places on the ring, and the mean places of a node."""
    found = ring_.agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("places"))
    return found.withColumn("virtual", F.try_divide("places", "nodes"))


def ideal_moves(owned: DataFrame, key: str, owner: str, decisions: DataFrame, ring_: DataFrame) -> DataFrame:
    """key, from, to: the resources that nodes with the decision to rebalance give to the node that the ring wants them on."""
    shedding = decisions.filter("decision = 'rebalance'").select(F.col("node").cast("string").alias("_from"))
    mine = owned.select(key, F.col(owner).cast("string").alias("_from")).join(F.broadcast(shedding), "_from")
    wanted = owners(mine, key, ring_)
    return wanted.filter(F.col("owner") != F.col("_from")).select(key, F.col("_from").alias("from"), F.col("owner").alias("to"))


def orphans(resources: DataFrame, members: DataFrame, owner: str, node: str) -> DataFrame:
    """Resources whose owner is not an alive member."""
    return resources.join(members.filter("status = 'ALIVE'").select(F.col(node).alias(owner)), owner, "left_anti")


def reclaims(orphaned: DataFrame, key: str, ring_: DataFrame) -> DataFrame:
    """``orphaned`` with the node that should claim each."""
    return owners(orphaned, key, ring_).drop("owners").withColumnRenamed("owner", "claimed_by")


def rebalance(samples: DataFrame, node: str, micros: str, load: str, now: Column, span: int, threshold: float) -> DataFrame:
    """node, load, p95, decision: whether a node sheds load.

    Its latest load must be over the mean of all nodes' by ``threshold``, and the interpolated 95th percentile of its recent
    load over their mean of that by 0.85 of it; a peak alone is dampened.
    """
    usable = samples.withColumn("_l", usable_load(F.col(load))).filter(F.col(micros) >= now - span)
    each = usable.groupBy(node).agg(F.max_by("_l", micros).alias("load"), F.percentile("_l", 0.95).alias("p95"))
    mean = each.agg(F.avg("load").alias("_m"), F.avg("p95").alias("_p"))
    over = F.try_divide(F.col("load"), F.col("_m")) > 1 + threshold
    lasting = F.try_divide(F.col("p95"), F.col("_p")) > 1 + 0.85 * threshold
    decision = F.when(F.col("_m") == 0, "idle").when(~over, "balanced").when(~lasting, "dampened").otherwise("rebalance")
    return each.join(F.broadcast(mean)).select(node, "load", "p95", decision.alias("decision"))


def high_availability(primaries: DataFrame, nodes: DataFrame, replicas: int, spread: str = "cross-zone") -> DataFrame:
    """resource, replica, rank: the best nodes by (1 - cpu) * availability: in other zones of the primary's region (cross-zone),
    in other regions (cross-region), or anywhere but the primary's own node (any).

    ``primaries`` has resource and region, zone (and node, for any) of its primary; ``nodes`` has node, region, zone, cpu,
    availability. Only the best few nodes of each zone can be chosen, so those are ranked first, before they meet the resources.
    """
    if spread not in ("cross-zone", "cross-region", "any"):
        raise ValueError(f"unknown spread: {spread}")
    scored = nodes.withColumn("score", (1 - F.col("cpu")) * F.col("availability"))
    best = Window.partitionBy("region", "zone").orderBy(F.desc("score"), "node")
    few = scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= replicas + 1)
    by = [F.col("region")] if spread == "cross-zone" else []
    few = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node", "zone", F.col("region").alias("r")))).alias("few"))
    met = primaries.join(few, "region") if by else primaries.join(F.broadcast(few))
    apart = {"cross-zone": "f.zone <> zone", "cross-region": "f.r <> region", "any": "f.node <> node"}[spread]
    chosen = met.withColumn("_c", F.expr(f"slice(filter(few, f -> {apart}), 1, {replicas})"))
    return chosen.select("resource", F.posexplode("_c").alias("rank", "c")).select("resource", F.col("c.node").alias("replica"), (F.col("rank") + 1).alias("rank"))


def ranges_for(nodes: int) -> int:
    """How many ranges a cluster of ``nodes`` has."""
    return max(2 * nodes, 8)


def free_ranges(all_ranges: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Ranges without a valid lease."""
    return all_ranges.join(leases.filter(F.col("expires") > now).select("range_id"), "range_id", "left_anti")


def range_targets(members: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """node, owned, target, needed, first_free for each alive member (id): the ranges range-0, range-1, ... number twice the
    nodes and 8 at least, each node should have its share rounded up, and the first without a valid lease is next."""
    alive = members.filter("status = 'ALIVE'").select(F.col("id").cast("string").alias("node"))
    n = alive.agg(F.count("*").alias("n")).withColumn("total", F.greatest(F.lit(8), 2 * F.col("n")))
    n = n.withColumn("target", F.ceil(F.col("total") / F.greatest("n", F.lit(1))))
    held = leases.filter(F.col("expires") > now).select("range_id", F.col("node").cast("string").alias("node"))
    every = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("k")).withColumn("range_id", F.concat(F.lit("range-"), F.col("k")))
    free = every.join(held.select("range_id"), "range_id", "left_anti").agg(F.min("k").alias("_k"))
    first = free.select(F.when(F.col("_k").isNotNull(), F.concat(F.lit("range-"), F.col("_k"))).alias("first_free"))
    own = alive.join(held.groupBy("node").agg(F.count("*").alias("owned")), "node", "left").withColumn("owned", F.coalesce("owned", F.lit(0)))
    needed = F.greatest(F.lit(0), F.col("target") - F.col("owned"))
    return own.join(F.broadcast(n.select("target"))).join(F.broadcast(first)).select("node", "owned", "target", needed.alias("needed"), "first_free")


def endpoint_of(requests: DataFrame, endpoints: DataFrame, service: str, number: str, endpoint: str, strategy: str = "round-robin", local: str | None = None, seed: int = 0) -> DataFrame:
    """``requests`` with the endpoint chosen for each: round-robin, first, random (by request number and seed) or local-preferred
    (the first endpoint on the requester's node, else its turn). ``endpoints`` has service, endpoint and node. Requests for a
    service without any get null. A request meets its endpoint by equality with its turn, not by a search of all endpoints."""
    turns = Window.partitionBy(service).orderBy(endpoint, "node")
    placed_ = endpoints.select(service, F.col(endpoint).alias("_e"), (F.row_number().over(turns) - 1).cast("long").alias("_turn"))
    sizes = endpoints.groupBy(service).agg(F.count("*").alias("_n"))
    if strategy == "first":
        turn = F.lit(0)
    elif strategy == "random":
        turn = F.pmod(F.xxhash64(number, F.lit(seed)), F.col("_n"))
    elif strategy in ("round-robin", "local-preferred"):
        turn = F.pmod(F.col(number), F.col("_n"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    asked = requests.join(F.broadcast(sizes), service, "left").withColumn("_turn", turn.cast("long"))
    found = asked.join(placed_, [service, "_turn"], "left")
    chosen = F.col("_e")
    if strategy == "local-preferred":
        own = endpoints.groupBy(service, F.col("node").alias("_here")).agg(F.min(F.struct(F.col(endpoint).alias("e"))).alias("_own"))
        found = found.withColumn("_here", F.col(local)).join(own, [service, "_here"], "left")
        chosen = F.coalesce(F.col("_own.e"), "_e")
    return found.select(*[F.col(c) for c in requests.columns if c != endpoint], chosen.alias(endpoint))


def round_robin(requests: DataFrame, endpoints: DataFrame, service: str, number: str, endpoint: str) -> DataFrame:
    """``requests`` with the endpoint whose turn it is: the request number modulo the endpoints of its service."""
    listed = endpoints.groupBy(service).agg(F.array_sort(F.collect_list(endpoint)).alias("_e"))
    return requests.join(listed, service).withColumn(endpoint, F.element_at("_e", (F.pmod(F.col(number), F.size("_e")) + 1).cast("int"))).drop("_e")


def autoscale(groups: DataFrame, n: str, load: str, least: int, most: int, up: float = 0.8, down: float = 0.3) -> DataFrame:
    """``groups`` with target: one more above ``up``, one fewer below ``down``, within bounds."""
    target = F.when(F.col(load) > up, F.col(n) + 1).when(F.col(load) < down, F.col(n) - 1).otherwise(F.col(n))
    return groups.withColumn("target", F.least(F.greatest(target, F.lit(least)), F.lit(most)))


def resource_health(resources: DataFrame, cpu: str, memory: str, errors: str, **more: Column) -> DataFrame:
    """``resources`` with issues, healthy, migrate: processor above 0.95, memory above 0.9, errors above 0.1, and each check of
    ``more`` (name to a Column that is true where it fails); over two issues mean that it should move."""
    checks = {"cpu": F.col(cpu) > 0.95, "memory": F.col(memory) > 0.9, "errors": F.col(errors) > 0.1} | more
    issues = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    found = resources.withColumn("issues", issues)
    return found.withColumn("healthy", F.size("issues") == 0).withColumn("migrate", F.size("issues") > 2)


def with_capacity(resources: DataFrame, **calculators: Column) -> DataFrame:
    """``resources`` with what each of the caller's calculators (a Column) says; what is missing, negative or no number is none."""
    return resources.withColumns({name: usable_load(value.cast("double")) for name, value in calculators.items()})


def violations(resources: DataFrame, **validators: Column) -> DataFrame:
    """``resources`` that break a constraint, with ``violations``: the names of the caller's validators (Columns that are true where
    the constraint holds) that do not hold; one that gives null does not hold."""
    broken = F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in validators.items()])
    return resources.withColumn("violations", F.filter(broken, lambda v: v.isNotNull())).filter(F.size("violations") > 0)

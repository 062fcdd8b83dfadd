"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Shingle sets are sets of 64-bit hashes of word runs. Documents with equal sets are one node. A node's hashes are
dealt into ``BINS`` bins of which each keeps its least hash; an empty bin takes the value of a full bin that a
fixed permutation of that bin picks (optimal densification). Runs of ``ROWS`` bins are bands; nodes that share a band
are candidates. In each bucket one hub is paired with the other members, and these star-shaped edges are confirmed on
the full sets, in rounds of a few bands: what earlier rounds have joined is not compared again, so a family of copies
costs about one edge a node. What all stars leave apart although buckets connect it is compared in full, block by
block, so no link between candidates is lost and no pairs are emitted but links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewright.llm import flat
from statewright.llm.shared import Scratch, whole_row

#: Two sets with a similarity of 0.8 miss a band of 6 with probability 0.74, and all 40 bands with 5e-6.
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: The bands of each round of star edges, as ends.
ROUNDS = (4, BANDS)
#: Nodes of a block, nodes of small families that share a task, and shingles of a matrix product.
BLOCK, PACK, SLICE = 256, 500, 4_096
#: Set sizes of a class differ by this factor at most.
CLASS = 1.05

_SKETCH = "row long, doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _picks() -> np.ndarray:
    """For each bin a fixed permutation of all bins."""
    return np.stack([np.random.default_rng(7919 + i).permutation(BINS) for i in range(BINS)])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted; a shorter document has its whole word sequence as one."""
    data = flat.lower(data)
    starts, ends, bounds = flat.words(data, offsets)
    names = flat.span_hashes(data, starts, ends)
    doc = flat.owner(bounds)
    runs = flat.window_hashes(names, size)
    whole = doc[: len(runs)] == doc[size - 1 :] if len(runs) else np.zeros(0, bool)
    docs, hashes = [doc[: len(runs)][whole]], [runs[whole]]
    n = np.diff(bounds)
    for d in np.flatnonzero((n > 0) & (n < size)):
        docs.append(np.array([d]))
        hashes.append(flat.window_hashes(names[bounds[d] : bounds[d + 1]], int(n[d])))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(doc: np.ndarray, value: np.ndarray, n_docs: int, picks: np.ndarray) -> np.ndarray:
    """An array of n_docs x BINS least hashes; all zero for a document without shingles."""
    least = np.zeros((n_docs, BINS), dtype=np.uint64)
    full = np.zeros((n_docs, BINS), dtype=bool)
    scrambled = flat.mixed(value ^ np.uint64(0xA5A5A5A5DEADBEEF))
    bin_ = ((scrambled >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = doc * BINS + bin_
    order = np.lexsort((scrambled, cell))
    cell, scrambled = cell[order], scrambled[order]
    head = np.ones(len(cell), dtype=bool)
    head[1:] = cell[1:] != cell[:-1]
    least.reshape(-1)[cell[head]] = scrambled[head]
    full.reshape(-1)[cell[head]] = True
    d, b = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(BINS):
        if not len(d):
            break
        take = picks[b, attempt]
        hit = full[d, take]
        least[d[hit], b[hit]] = least[d[hit], take[hit]]
        d, b = d[~hit], b[~hit]
    return least


def _sketches(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = _picks()
        for batch in batches:
            row, ids = batch.column("row"), batch.column("doc_id")
            for rows, data, offsets in flat.chunks(batch):
                n_docs = rows.stop - rows.start
                doc, value = shingle_sets(data, offsets, size)
                least = signatures(doc, value, n_docs, picks)
                bands = np.zeros((n_docs, BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    bands = flat.mixed(bands * np.uint64(flat.BASE) + least[:, r::ROWS])
                bounds = np.searchsorted(doc, np.arange(n_docs + 1))
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(flat.mixed(value * np.uint64(2) + np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
                flat_bands = pa.array(bands.view(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        row.slice(rows.start, n_docs),
                        ids.slice(rows.start, n_docs),
                        pa.array(np.diff(bounds)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1) * BANDS, pa.int32()), flat_bands),
                    ],
                    names=["row", "doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return task


def _set_rows(size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for rows, data, offsets in flat.chunks(batch):
                n_docs = rows.stop - rows.start
                doc, value = shingle_sets(data, offsets, size)
                bounds = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, n_docs), pa.ListArray.from_arrays(pa.array(bounds), pa.array(value.view(np.int64)))],
                    names=["row", "shingles"],
                )

    return task


def _with_sets(texts: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """row, shingles of the rows in ``ids``."""
    wanted = texts.join(ids.hint("merge"), "row", "left_semi").select("row", F.col("text").cast("binary").alias("text"))
    return wanted.mapInArrow(_set_rows(size), "row long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, more) with 100 * intersection >= threshold * union."""
    left = sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b"))
    n_a, n_b, same = F.size("of_a"), F.size("of_b"), F.size(F.array_intersect("of_a", "of_b"))
    near = (100 * F.least(n_a, n_b) >= threshold * F.greatest(n_a, n_b)) & (100 * same >= threshold * (n_a + n_b - same))
    return pairs.join(left, "a").join(right, "b").filter(near).drop("of_a", "of_b")


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) of every node that ``edges`` (a, b) join to another: the least node reachable.

    Each round points every node to the least of its neighbours and itself, then to where that one points, and contracts
    the edges to these, until none is left; a star takes one round, and what has been joined is not looked at again.
    Names of nodes are hashes, so a path shrinks by a constant share each round.
    """
    contracted = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, steps = scratch.table(contracted(edges), f"{tag}-edges-0"), []
    while not (steps and edges.isEmpty()):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
        step = scratch.table(_relabelled(near, near), f"{tag}-step-{len(steps)}")
        steps.append(step)
        of = lambda end, to: step.select(F.col("node").alias(end), F.col("label").alias(to))  # noqa: B023, E731
        met = edges.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = scratch.table(contracted(met), f"{tag}-edges-{len(steps)}")
    labels = steps[0]
    for step in steps[1:]:
        labels = _relabelled(labels, step)
    return scratch.table(labels, f"{tag}-labels")


def _relabelled(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """``labels`` (node, label) with the label that ``joined`` (node, label) has for theirs, where it has one."""
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return labels.join(new, "label", "left").select("node", F.coalesce("_new", "label").alias("label"))


def _of_ends(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose ends have different labels, with these as from and to."""
    of = lambda end, to: labels.select(F.col("node").alias(end), F.col("label").alias(to))
    return pairs.join(of("a", "from"), "a").join(of("b", "to"), "b").filter(F.col("from") != F.col("to"))


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of ``sets`` with ``others``, as products of 0/1 matrices over a slice of the shingles."""
    parts = [*sets, *others]
    value = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(others)), dtype=np.float32)
    for low in range(0, len(count), SLICE):
        lo, hi = np.searchsorted(column, (low, low + SLICE))
        if lo < hi:
            used, at = np.unique(column[lo:hi], return_inverse=True)
            cells = np.zeros((len(parts), len(used)), dtype=np.float32)
            cells[row[lo:hi], at] = 1
            total += cells[: len(sets)] @ cells[len(sets) :].T
    return total


def _linking(labels: list[int], sets: list[np.ndarray], left: list[int], right: list[int], threshold: int) -> list[tuple[int, int]]:
    """Pairs of labels that links between the members ``left`` and ``right`` (indices) join: as many as it takes."""
    if len({labels[k] for k in left} | {labels[k] for k in right}) < 2:
        return []
    same = _overlaps([sets[k] for k in left], [sets[k] for k in right])
    n_left, n_right = (np.array([len(sets[k]) for k in side]) for side in (left, right))
    near = 100 * same >= threshold * (n_left[:, None] + n_right[None, :] - same)
    near &= np.array([labels[k] for k in left])[:, None] != np.array([labels[k] for k in right])[None, :]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(near):
        a, b = left[i], right[j]
        x, y = top(labels[a]), top(labels[b])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((x, y))
    return out


def _compare(threshold: int):
    def task(table: pa.Table) -> pa.Table:
        labels, families, blocks = (table.column(c).to_pylist() for c in ("label", "family", "block"))
        shingles = table.column("shingles").combine_chunks()
        sets = [shingles[k].values.to_numpy() for k in range(len(labels))]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = []
        if i != j:
            left, right = ([k for k, x in enumerate(blocks) if x == side] for side in (i, j))
            if left and right:
                found = _linking(labels, sets, left, right, threshold)
        else:
            members: dict[int, list[int]] = {}
            for k, family in enumerate(families):
                members.setdefault(family, []).append(k)
            for own in members.values():
                found += _linking(labels, sets, own, own, threshold)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    return task


def _meetings(members: DataFrame, threshold: int) -> DataFrame:
    """``members`` (node, label, family, n) with part, i, j, block: a row for each task (part, i, j) that has the node.

    A family of up to BLOCK nodes is one block, and some such families share a part. A larger one is cut by set size into
    classes, and classes into blocks; two blocks meet where sets of their sizes can be linked at all. Nodes of the largest
    label are joined already, so where they fill a block they have blocks of their own, which do not meet each other.
    """
    by_label = members.groupBy("family", "label").agg(F.count("*").alias("n_label"))
    sizes = by_label.groupBy("family").agg(F.sum("n_label").alias("n_family"), F.max(F.struct("n_label", "label")).alias("big"))
    packs = max(1, members.count() // PACK)
    rows = members.join(sizes, "family")
    small = F.col("n_family") <= BLOCK
    whole = rows.filter(small).select("node", "label", "family", F.pmod(F.xxhash64("family"), F.lit(packs)).alias("part"), *[F.lit(-1).cast("long").alias(c) for c in ("i", "j", "block")])
    in_big = ((F.col("big.n_label") >= BLOCK) & (F.col("label") == F.col("big.label"))).cast("int")
    size_class = F.floor(F.log(F.col("n")) / math.log(CLASS))
    rows = rows.filter(~small).select("node", "label", "family", (2 * size_class + in_big).alias("kind"))
    kinds = rows.groupBy("family", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
    reach = math.ceil(math.log(100 / threshold) / math.log(CLASS))
    near = F.explode(F.expr(f"sequence(2 * ((kind div 2) - {reach}), 2 * ((kind div 2) + {reach}) + 1)"))
    others = kinds.select("family", F.col("kind").alias("other"), F.col("n_blocks").alias("n_other"))
    meets = kinds.select("family", "kind", "n_blocks", near.alias("other")).join(others, ["family", "other"]).filter("kind % 2 + other % 2 < 2")
    meets = meets.groupBy("family", "kind").agg(F.first("n_blocks").alias("n_blocks"), F.collect_list(F.struct("other", "n_other")).alias("others"))
    code = lambda kind, block: kind * F.lit(1 << 32) + block
    rows = rows.join(meets, ["family", "kind"]).withColumn("block", code(F.col("kind"), F.pmod(F.xxhash64("node", F.lit("block")), "n_blocks")))
    rows = rows.withColumn("o", F.explode("others")).withColumn("with", F.explode(F.expr("sequence(0L, o.n_other - 1)")))
    met = code(F.col("o.other"), F.col("with"))
    rows = rows.select("node", "label", "family", F.col("family").alias("part"), F.least("block", met).alias("i"), F.greatest("block", met).alias("j"), "block")
    return whole.unionByName(rows)


def _remaining(stars: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, threshold: int) -> DataFrame | None:
    """Pairs of labels (a, b) joined by links that the stars have not shown, within a family: labels that buckets connect.

    Each pair of blocks that _meetings lists is a task of its own. No pair becomes a row unless it is a link.
    """
    across = scratch.table(_of_ends(stars, labels).select(F.col("from").alias("a"), F.col("to").alias("b")).distinct(), "across")
    if across.isEmpty():
        return None
    families = components(across, scratch, "families").select(F.col("node").alias("label"), F.col("label").alias("family"))
    sized = sets.select(F.col("row").alias("node"), F.size("shingles").alias("n"))
    members = scratch.table(labels.join(families, "label").join(sized, "node").select("node", "label", "family", "n"), "members")
    rows = _meetings(members, threshold).join(sets.select(F.col("row").alias("node"), "shingles"), "node")
    return rows.groupBy("part", "i", "j").applyInArrow(_compare(threshold), "a long, b long").distinct()


def _identified(docs: DataFrame) -> DataFrame:
    """row (the identity of a doc_id, perhaps null, with a text), doc_id, text (null: empty)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def _row_groups(texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept of each different row of ``texts`` (row, doc_id, text).

    A node is a set under the identity of its first row, by doc_id with nulls last; the first row of a component is kept.
    """
    scratch = Scratch(texts.sparkSession, "minhash")
    binary = texts.select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    sketches = scratch.table(binary.mapInArrow(_sketches(size), _SKETCH), "sketches")
    key = ["n_shingles", "set_a", "set_b"]
    filled = sketches.filter("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes = filled.groupBy(*key).agg(F.min(place).alias("first"), F.min("bands").alias("bands"))
    nodes = scratch.table(nodes.select(*key, F.col("first.row").alias("node"), "first", "bands"), "nodes")
    rows = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    # Names of nodes are hashes, so the least is a hub at random, and mostly the same in a family's buckets.
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    stars = rows.join(hubs, "bucket").filter("node <> hub").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.min("band").alias("band"))
    stars = scratch.table(stars, "stars")
    ends = stars.select(F.col("a").alias("row")).union(stars.select("b")).distinct()
    sets = scratch.table(_with_sets(texts, ends, size).dropDuplicates(["row"]), "sets")
    labels = sets.select(F.col("row").alias("node"), F.col("row").alias("label"))
    for k, (low, high) in enumerate(zip((0, *ROUNDS[:-1]), ROUNDS, strict=True)):
        open_ = _of_ends(stars.filter(F.col("band").between(low, high - 1)).select("a", "b"), labels)
        links = scratch.table(_confirmed(open_, sets, threshold).select(F.col("from").alias("a"), F.col("to").alias("b")), f"links-{k}")
        if not links.isEmpty():
            labels = scratch.table(_relabelled(labels, components(links, scratch, f"joined-{k}")), f"labels-{k}")
    more = _remaining(stars, labels, sets, scratch, threshold)
    if more is not None:
        more = scratch.table(more, "more")
        if not more.isEmpty():
            labels = _relabelled(labels, components(more, scratch, "all"))
    of_set = nodes.select(*key, "node", "first").join(labels, "node", "left").select(*key, "first", F.coalesce("label", "node").alias("label"))
    heads = of_set.groupBy("label").agg(F.min("first").alias("head"))
    of_set = of_set.join(heads, "label").select(*key, "head")
    own = sketches.select("row", "doc_id", *key).distinct()
    return own.join(of_set, key, "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (F.coalesce(F.col("head.row"), F.col("row")) == F.col("row")).alias("kept"),
    )


def near_groups(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text, anything else).

    Words are runs without blanks, with A-Z lower-cased. A null, empty or blank text has no shingles and is linked
    with nothing. component_id is the least doc_id reachable over links, and the document with it is kept.
    Repeated rows are one row here; the same doc_id with different texts gives a row for each, judged by its own text,
    and of several that are linked one is kept. Rows without a doc_id are left out; an empty table gives an empty result.

    Bucket rows and star edges stay in proportion to the input: nodes are documents with different sets, each gives
    BANDS rows, and each row one edge at most; an edge is confirmed once, and only while its ends are not joined.
    """
    return _row_groups(_identified(docs.filter(F.col("doc_id").isNotNull())), size, threshold).drop("row")


def drop_near_copies(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns; repeated rows once.

    Rows without a doc_id are judged by their text like others, and come last in their group.
    """
    kept = _row_groups(_identified(docs), size, threshold).filter("kept").select(F.col("row").alias("_keep"))
    own = docs.select(whole_row(docs), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("_own"))
    once = Window.partitionBy("_own").orderBy("_own")
    found = own.join(kept, F.col("_own") == F.col("_keep"), "left_semi")
    return found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")

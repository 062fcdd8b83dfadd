"""Substring dedup with difference-cover anchors.

A difference cover of a period P is a set of residues such that any two positions i, j have a shift d < P that puts
i + d and j + d on the cover. So two equal word windows share an anchor, a shorter word run that starts on the cover,
at the same offset in both. A window without an anchor that occurs elsewhere is unique; the anchors that do occur
elsewhere are extended to the windows that hold them, which are compared in their full length by two 64-bit hashes of
all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewright.llm import flat
from statewright.llm.shared import Scratch, whole_text

#: Perfect difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Hashes a task holds before it merges those of its own that repeat.
HELD = 2_000_000
#: Names of a place: anchors have the first, windows both.
NAMES = ("h", "g")


def cover_of(window: int) -> tuple[int, np.ndarray]:
    """Period and cover mask for a window length: the largest period that leaves anchors of two fifths of a window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)
    mask = np.zeros(period, dtype=bool)
    mask[list(COVERS[period])] = True
    return period, mask


def _merged(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (names..., row, at, known) of the places a task has found; a place is named by one hash or by two.

    Places whose name the task has met twice are known to repeat; only the first of them still meets other tasks' rows
    under that name, the others travel under a name of their own. So a name gets a row for each HELD hashes of a task.
    """
    *names, row, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort(names) if len(names) > 1 else np.argsort(names[0], kind="stable")
    names, row, at = [n[order] for n in names], row[order], at[order]
    same = np.logical_and.reduce([n[1:] == n[:-1] for n in names])
    known = np.zeros(len(row), dtype=bool)
    known[1:] |= same
    known[:-1] |= same
    own = np.zeros(len(row), dtype=bool)
    own[1:] = same
    apart = flat.mixed(row[own].view(np.uint64) * np.uint64(flat.BASE) + at[own].astype(np.uint64))
    for k in range(len(names)):
        names[k][own] = apart if k == 0 else flat.mixed(apart + np.uint64(k))
    columns = [*(pa.array(n.view(np.int64)) for n in names), pa.array(row), pa.array(at.astype(np.int32)), pa.array(known)]
    return pa.RecordBatch.from_arrays(columns, names=[*NAMES[: len(names)], "row", "at", "known"])


def _sent(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield _merged(held)
            held, n = [], 0
    if n:
        yield _merged(held)


def _chunk(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each chunk: its rows, word starts and ends, words before each document, document and place of each word, bytes."""
    for rows, data, offsets in flat.chunks(batch):
        starts, ends, bounds = flat.words(data, offsets)
        doc = flat.owner(bounds)
        yield rows, data, starts, ends, bounds, doc, np.arange(len(starts)) - bounds[doc]


def _anchors(window: int):
    period, mask = cover_of(window)
    size = window - period + 1

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("row")).to_numpy()
            for rows, data, starts, ends, bounds, doc, place in _chunk(batch):
                h = flat.window_hashes(flat.span_hashes(data, starts, ends), size)
                n = np.diff(bounds)[doc[: len(h)]]
                at = place[: len(h)]
                use = mask[at % period] & (at <= n - size) & (n >= window)
                yield h[use], keys[rows][doc[: len(h)][use]], at[use]

    return lambda batches: _sent(parts(batches))


def _windows(window: int):
    period, _ = cover_of(window)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("row")).to_numpy()
            places = batch.column(batch.schema.get_field_index("places"))
            for rows, data, starts, ends, bounds, doc, place in _chunk(batch):
                found = places.slice(rows.start, rows.stop - rows.start)
                repeated = np.zeros(len(starts), dtype=np.int64)
                repeated[np.repeat(bounds[:-1], found.value_lengths().to_numpy()) + found.flatten().to_numpy()] = 1
                n = np.diff(bounds)[doc]
                before = np.concatenate([[0], np.cumsum(repeated)])
                words = flat.span_hashes(data, starts, ends)
                h, g = flat.window_hashes(words, window), flat.window_hashes(flat.mixed(words ^ np.uint64(flat.SHIFT)), window)
                at = np.arange(len(h))
                use = (place[: len(h)] <= n[: len(h)] - window) & (before[at + period] > before[at])
                yield h[use], g[use], keys[rows][doc[: len(h)][use]], place[: len(h)][use]

    return lambda batches: _sent(parts(batches))


def _repeating(found: DataFrame) -> DataFrame:
    """row, places of what occurs more than once."""
    total = F.count("*").over(Window.partitionBy(*[n for n in NAMES if n in found.columns]))
    return found.withColumn("n", total).filter("known OR n > 1").groupBy("row").agg(F.collect_set("at").alias("places"))


def _digests(window: int, with_text: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            places = batch.column(batch.schema.get_field_index("places"))
            for rows, data, starts, ends, bounds, doc, _ in _chunk(batch):
                n_docs = rows.stop - rows.start
                found = places.slice(rows.start, n_docs)
                first = np.repeat(bounds[:-1], found.value_lengths().fill_null(0).to_numpy()) + found.flatten().to_numpy()
                edge = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                n_words, n_kept = np.diff(bounds), kept[bounds[1:]] - kept[bounds[:-1]]
                raw, texts = data.tobytes(), []
                for d in range(n_docs):
                    lo, hi = bounds[d], bounds[d + 1]
                    if hi == lo:
                        texts.append(b"")
                    elif n_kept[d] == hi - lo:
                        texts.append(b" ".join(raw[starts[lo] : ends[hi - 1]].split()))
                    else:
                        own = np.flatnonzero(keep[lo:hi]) + lo
                        texts.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]))
                columns = {
                    "doc_id": ids.slice(rows.start, n_docs),
                    "n_words": pa.array(n_words),
                    "n_removed": pa.array(n_words - n_kept),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                }
                if with_text:
                    columns["kept_text"] = pa.array([t.decode("utf-8", "replace") for t in texts])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return task


def without_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept_text of every row of ``docs``.

    Removed is each word that lies in a run of ``window`` words which starts at another place too, in any row, the
    same one included; all copies go. Words are runs without blanks, unchanged; kept words are joined by one space.
    A null, empty or blank text has no words. Repeated rows are further documents, so what they share goes. Rows
    without a doc_id are left out; an empty table gives an empty result. Each row is one task's work: a single
    text, its words and hashes must fit in a task.

    Two shuffles carry hashes (anchors at 5 of 21 positions, then only windows that may repeat), two the texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    texts = whole_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    place = "row long, at int, known boolean"
    anchors = scratch.table(_repeating(texts.select("row", "text").mapInArrow(_anchors(window), f"h long, {place}")), "anchors")
    near = scratch.table(texts.join(anchors, "row").select("row", "text", "places"), "near")
    windows = scratch.table(_repeating(near.mapInArrow(_windows(window), f"h long, g long, {place}")), "windows")
    scratch.drop("near")
    scratch.drop("anchors")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return texts.join(windows, "row", "left").select("doc_id", "text", "places").mapInArrow(_digests(window, with_text), schema)

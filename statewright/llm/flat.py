"""Texts of many documents as one flat byte array, so that numpy handles words without a Python loop over them.

Used inside Spark tasks: each Arrow batch is cut into chunks of whole documents of about ``CHUNK`` bytes,
which bounds the memory; only a single longer document makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 21
#: Spans of up to so many times eight bytes are hashed together.
LANES = 4
U = np.uint64
BASE, SHIFT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Masks of the first 0 to 8 bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive runs of rows of a binary column without nulls."""
    values = batch.column(batch.schema.get_field_index(column))
    if len(values) == 0:
        return
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    _, offsets, data = values.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(values):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield slice(row, end), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[data]


def blanks(data: np.ndarray) -> np.ndarray:
    return _BLANK[data]


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (one entry more).

    ``parts`` says of each byte whether it stands between words.
    """
    inside = ~parts[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Spans of up to LANES times eight bytes are scrambled eight bytes at a time, all at once; equal lengths of up to eight
    bytes never collide. Longer ones go to xxHash one by one.
    """
    length = ends - starts
    out = mixed(length.astype(U) * U(SHIFT) + U(BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    for lane in range(LANES):
        use = np.flatnonzero((length > 8 * lane) & (length <= 8 * LANES))
        if not len(use):
            break
        left = np.minimum(length[use] - 8 * lane, 8)
        out[use] = mixed(out[use] ^ (eight[starts[use] + 8 * lane] & _FIRST[left]))
    for k in np.flatnonzero(length > 8 * LANES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * U(BASE) + right * U(SHIFT))


def window_hashes(names: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` consecutive names; runs across documents are the caller's to leave out.

    Runs of 1, 2, 4, ... names are hashed from their halves, and those that add up to ``size`` are joined.
    """
    n = len(names)
    if n < size:
        return np.zeros(0, dtype=U)
    run, length, out, done = names, 1, None, 0
    while True:
        if size & length:
            m = n - done - length + 1
            out = run[:m] if out is None else _joined(out[:m], run[done : done + m])
            done += length
        if 2 * length > size:
            return mixed(out + U(size))
        run, length = _joined(run[:-length], run[length:]), 2 * length


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item, the document that has it; ``bounds`` as from words()."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

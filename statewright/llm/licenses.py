"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates and texts are sets of runs of five words. A template of T shingles belongs to the least window length W (a
power of two) with T <= W - stride + 1, so that wherever it stands, one window holds all of it; a window with 80 % of
it then has a similarity with it of at least 0.8 T / (W + 0.2 T). Each band is one minimum, and a class has so many
bands that such a window misses all of them with a probability below MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewright.llm import flat
from statewright.llm.shared import whole_text

SHINGLE, CONTAINED, MISS = 5, 80, 1e-5

# Notices of common licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Letters, digits and all bytes beyond ASCII make words; everything else parts them.
_PARTS = np.ones(256, dtype=bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word the hash of the shingle that starts at it (_NONE where its document ends sooner), its document, and words before each document."""
    data = flat.lower(data)
    starts, ends, bounds = flat.words(data, offsets, _PARTS)
    doc = flat.owner(bounds)
    out = np.full(len(starts), _NONE)
    runs = flat.window_hashes(flat.span_hashes(data, starts, ends), SHINGLE)
    whole = doc[: len(runs)] == doc[SHINGLE - 1 :] if len(runs) else np.zeros(0, bool)
    out[: len(runs)][whole] = runs[whole]
    return out, doc, bounds


class Class:
    """The templates of one window length."""

    def __init__(self, width: int):
        self.width, self.stride = width, max(1, width // 4)
        self.span = width - self.stride + 1
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []

    def settle(self) -> None:
        sizes = [len(s) for s in self.sets]
        least = min(math.ceil(CONTAINED * t / 100) / (self.width + t - math.ceil(CONTAINED * t / 100)) for t in sizes)
        self.bands = math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1
        self.factors = flat.mixed(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(flat.BASE)) | np.uint64(1)
        self.minima = np.array([[(s * f).min() for s in self.sets] for f in self.factors])
        self.maybe = np.zeros((self.bands, 1 << 16), dtype=bool)
        for b in range(self.bands):
            self.maybe[b, (self.minima[b] >> np.uint64(48)).astype(np.int64)] = True

    def retrieved(self, shingles: np.ndarray) -> set[tuple[int, int]]:
        """(first position of a window, template) that share a band."""
        found = set()
        n = max(1, -(-max(0, len(shingles) - self.width) // self.stride) + 1)
        steps = self.width // self.stride
        padded = np.full((n - 1 + steps) * self.stride, 0, dtype=np.uint64)
        padded[: len(shingles)] = shingles
        none = np.ones(len(padded), dtype=bool)
        none[: len(shingles)] = shingles == _NONE
        for b, factor in enumerate(self.factors):
            value = padded * factor
            value[none] = _NONE
            block = value.reshape(-1, self.stride).min(axis=1) if self.stride > 1 else value
            least = block[:n].copy()
            for k in range(1, steps):
                np.minimum(least, block[k : k + n], out=least)
            for w in np.flatnonzero(self.maybe[b, (least >> np.uint64(48)).astype(np.int64)]):
                found.update((int(w) * self.stride, int(t)) for t in np.flatnonzero(self.minima[b] == least[w]))
        return found


def _one(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = np.unique(_shingles(data, np.array([0, len(data)]))[0])
    return found[found != _NONE]


def classes(templates: dict[str, str]) -> list[Class]:
    """Templates by window length; each needs five words at least."""
    out: dict[int, Class] = {}
    for name, text in sorted(templates.items()):
        own = _one(text)
        if not len(own):
            raise ValueError(f"the template {name} has fewer than {SHINGLE} words")
        width = 2
        while len(own) > width - max(1, width // 4) + 1:
            width *= 2
        kind = out.setdefault(width, Class(width))
        kind.names.append(name)
        kind.sets.append(own)
    for kind in out.values():
        kind.settle()
    return list(out.values())


def matches(shingles: np.ndarray, own: np.ndarray, span: int) -> list[tuple[int, int, float]]:
    """(first word, end word, containment) of the disjoint spans of a document, from the left, that hold 80 % of a template."""
    at = np.flatnonzero(np.isin(shingles, own))
    out, i = [], 0
    while i < len(at):
        last = int(np.searchsorted(at, at[i] + span))
        inside = len(np.unique(shingles[at[i:last]]))
        if 100 * inside >= CONTAINED * len(own):
            end = int(at[last - 1])
            out.append((int(at[i]), end + SHINGLE, inside / len(own)))
            i = last
        else:
            i += 1
    return out


def _scan(templates: dict[str, str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = classes(templates)
        for batch in batches:
            out = []
            for rows, data, offsets in flat.chunks(batch):
                shingles, doc, bounds = _shingles(data, offsets)
                if not len(shingles):
                    continue
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()
                for kind in kinds:
                    pairs = {(int(d), t) for at, t in kind.retrieved(shingles) for d in range(doc[min(at, len(doc) - 1)], doc[min(at + kind.width, len(doc)) - 1] + 1)}
                    for d, t in sorted(pairs):
                        found = matches(shingles[bounds[d] : bounds[d + 1]], kind.sets[t], kind.span)
                        if found:
                            out.append((ids[d], kind.names[t], len(found), max(f[2] for f in found), found[0][0], found[0][1]))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds_of = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True)], names=["doc_id", "license", "n_matches", "containment", "first_word", "end_word"])

    return task


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_matches, containment, first_word, end_word: a row for each document and license found in it.

    Words are runs of letters and digits, A-Z lower-cased. A match is a span of the template's window length that
    starts at one of its shingles and holds 80 % of them; matches are counted from the left without overlap,
    containment is the best, the words are those of the first. Null, empty and short texts match nothing. Repeated
    rows are scanned one by one; rows without a doc_id are left out; an empty table gives an empty result.
    """
    texts = whole_text(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, license string, n_matches long, containment double, first_word long, end_word long"
    return texts.mapInArrow(_scan(templates or TEMPLATES), schema)

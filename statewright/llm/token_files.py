"""Token ids as flat binary files with 64-bit offsets.

Layout of a folder: ``part-NNNNN-<attempt>.ids`` holds the ids of one partition's documents one after another, as
unsigned integers of 2 bytes (4 where the vocabulary needs them); ``.docs`` the doc_id of each document and ``.ends``
the number of ids up to its end, counted over all partitions, both as 64-bit little-endian integers. ``manifest.json``
lists the parts in order, with documents, base and bytes of an id; it is written last, so a folder that has it is whole.
Partitions follow doc_id, and the base of each is the prefix sum of the sizes before it, so part files in the order of
the manifest are one stream. Files on a local or mounted path are memory-mapped when they are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from statewright.llm.bpe import byte_characters
from statewright.llm.shared import partitions, shared_folder, whole_text

#: Different words, and pieces between spaces, that a Python worker remembers.
REMEMBERED = 500_000
#: The file that lists the parts.
MANIFEST = "manifest.json"
# Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where one of these stands, spaces meet other white space, and the text is cut as a whole.
_TOGETHER = ("  ", "\n \n", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")


class _Remembered(dict):
    """A dictionary that makes what it does not have."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


class WordCache:
    """The library's tokenizer behind a cache of words.

    A byte-level tokenizer encodes each word by itself, so a text's ids are those of its words, and each word is given
    to the library's model once. A space belongs to the word after it, so where no space meets other white space the
    pieces between spaces are cut into words one by one, and remembered too. Texts with characters whose class depends
    on the Unicode version, or with special tokens, are given to the library whole.
    """

    def __init__(self, spec: bytes):
        self.tokenizer = Tokenizer.from_str(spec.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.signs = {b: c for b, c in enumerate(byte_characters())}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(WORDS)
        self.rare = re.compile("[\u0300-\U0010ffff\x1c-\x1f]")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.words = _Remembered(self._word)
        self.pieces = _Remembered(lambda piece: self._text(" " + piece))

    def _word(self, word: str) -> bytes:
        signs = word.encode().decode("latin-1").translate(self.signs)
        return array(self.code, [t.id for t in self.model.tokenize(signs)]).tobytes()

    def _text(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _encoded(self, text: str) -> bytes:
        if self.rare.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if any(s in text for s in _TOGETHER) or text.endswith(" "):
            return self._text(text)
        first, *rest = text.split(" ")
        return self._text(first) + b"".join(map(self.pieces.__getitem__, rest))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as unsigned integers."""
        for text in texts:
            for cache in (self.words, self.pieces):
                if len(cache) > REMEMBERED:
                    cache.clear()
            yield self._encoded(text)


_caches: dict[bytes, WordCache] = {}


def cache_of(spec: bytes) -> WordCache:
    key = hashlib.md5(spec).digest()
    if key not in _caches:
        _caches.clear()
        _caches[key] = WordCache(spec)
    return _caches[key]


def _at(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (a path or an address such as file:///..., hdfs://... or s3://...) and the path in it."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def _each_part(spark: SparkSession, parts: list[dict], work: Callable[[dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` gives for each part, one task a part; the list of parts has a row a partition."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from work(parts[k])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(task, schema)


def write(docs: DataFrame, path: str, folder: str, end_id: int) -> None:
    """Writes the token files of ``docs`` in ascending doc_id: ids, docs and ends of each part, then the manifest.

    Each document's ids are followed by ``end_id``. A null or empty text has that id alone. Documents of equal doc_id
    (repeated rows) follow each other. Rows without a doc_id are left out. An empty table gives no part. A part that
    a repeated attempt writes has a name of its own; only the parts of the manifest count.
    """
    spark = docs.sparkSession
    with open(path, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    fs, at = _at(folder)
    fs.create_dir(at, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, cache = TaskContext.get(), cache_of(spec.value)
        end = np.array([end_id], dtype=cache.kind).tobytes()
        fs, at = _at(folder)
        name, n_docs, total, out = f"part-{context.partitionId():05d}-{uuid.uuid4().hex[:8]}", 0, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if not out:
                out = [fs.open_output_stream(f"{at}/{name}.{kind}") for kind in ("ids", "docs", "own")]
            lengths = []
            for found in cache.encode(batch.column("text").to_pylist()):
                out[0].write(found + end)
                lengths.append(len(found) // cache.kind.itemsize + 1)
            ends = total + np.cumsum(lengths)
            out[1].write(batch.column("doc_id").to_numpy().astype("<i8").tobytes())
            out[2].write(ends.astype("<i8").tobytes())
            n_docs, total = n_docs + len(lengths), int(ends[-1])
        if out:
            for stream in out:
                stream.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "docs": [n_docs], "size": [total], "wide": [cache.kind.itemsize]})

    ordered = whole_text(docs).repartitionByRange(max(partitions(spark), 8), "doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(ordered.mapInArrow(task, "part long, name string, docs long, size long, wide long").collect())
    bases = np.concatenate([[0], np.cumsum([p.size for p in found])]).tolist()
    parts = [{"name": p.name, "docs": p.docs, "base": int(base), "wide": p.wide} for p, base in zip(found, bases, strict=False)]

    def shift(part: dict) -> Iterator[pa.RecordBatch]:
        """The ends within the part, plus its base."""
        fs, at = _at(folder)
        file = f"{at}/{part['name']}"
        with fs.open_input_file(f"{file}.own") as own, fs.open_output_stream(f"{file}.ends") as out:
            while piece := own.read(1 << 20):
                out.write((np.frombuffer(piece, dtype="<i8") + part["base"]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"done": [part["docs"]]})

    if parts:
        _each_part(spark, parts, shift, "done long").collect()
        for part in parts:
            fs.delete_file(f"{at}/{part['name']}.own")
    with fs.open_output_stream(f"{at}/{MANIFEST}") as f:
        f.write(json.dumps({"parts": parts, "end_id": end_id}, indent=0).encode())


def manifest(folder: str) -> list[dict]:
    """The parts of a folder: name, docs, base, wide."""
    fs, at = _at(folder)
    with fs.open_input_file(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a folder, from its files."""
    schema, parts = "doc_id long, start long, n_tokens long, ids_crc32 long", manifest(folder)
    if not parts:
        return spark.createDataFrame([], schema)

    def work(part: dict) -> Iterator[pa.RecordBatch]:
        fs, at = _at(folder)
        file, base = f"{at}/{part['name']}", part["base"]
        kind = np.dtype(f"<u{part['wide']}")
        local = isinstance(fs, pafs.LocalFileSystem)

        def opened(name: str, dtype: np.dtype | str) -> np.ndarray:
            if local:
                return np.memmap(f"{file}.{name}", dtype=dtype, mode="r")
            with fs.open_input_file(f"{file}.{name}") as f:
                return np.frombuffer(f.read(), dtype=dtype)

        docs, ends, ids = opened("docs", "<i8"), opened("ends", "<i8"), opened("ids", kind)
        for low in range(0, len(docs), 10_000):
            high = np.array(ends[low : low + 10_000])
            starts = np.concatenate([[ends[low - 1] if low else base], high[:-1]])
            sums = [zlib.crc32(ids[s - base : e - base].astype("<u4").tobytes()) for s, e in zip(starts, high, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(docs[low : low + 10_000])), pa.array(starts), pa.array(high - starts), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return _each_part(spark, parts, work, schema)


def written_and_read(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """The documents' places and checksums as the files have them; the files stay in ``folder``, by default a new shared one."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write(docs, path, folder, end_id)
    return read(spark, folder)

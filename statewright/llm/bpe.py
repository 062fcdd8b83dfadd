"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round looks all adjacent pairs up by binary search in the
sorted pair keys, takes the lowest rank of each word, and merges its occurrences in all words at once. Words
without a known pair leave the array. Only words that a task has not met lately are encoded.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from statewright.llm.shared import whole_text

#: Different blank-separated pieces a task remembers, and characters of the texts it works on at a time.
REMEMBERED, AT_ONCE = 250_000, 2_000_000
#: Characters that are white space to the tokenizer.
SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    """A tokenizer file: BPE with word ends, NFC and lower case, white space dropped; decoding joins tokens by spaces."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        signs = byte_characters()
        self.inner = np.array([vocab[c] for c in signs])
        self.final = np.array([vocab[c + end] for c in signs])
        self.base = len(self.tokens)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs]) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs])
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        # All occurrences of a pair may merge in one round if what a merge makes is used by later merges only.
        last = np.full(self.base, -1)
        np.maximum.at(last, made, np.arange(len(made)))
        rank = np.arange(len(pairs))
        self.in_order = bool((last[left] < rank).all() and (last[right] < rank).all())
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.compose, self.lowercase = normalizers.NFC(), normalizers.Lowercase()
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.blank = regex.compile(f"[^{SPACE}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (non-empty) word, given as UTF-8."""
        lengths = np.array([len(w) for w in words])
        symbols = self.inner[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[np.frombuffer(b"".join(w[-1:] for w in words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        out: list[np.ndarray] = [symbols[:0]] * len(words)
        top = len(self.keys)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), top - 1)
            found = (self.keys[at] == key) & (owner[1:] == owner[:-1])
            rank = np.append(np.where(found, self.ranks[at], top), top)
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            open_ = lowest < top
            for k in np.flatnonzero(~open_):
                out[owner[starts[k]]] = symbols[starts[k] : starts[k] + sizes[k]]
            best = np.repeat(lowest, sizes)
            take = (rank == best) & (rank < top)
            if self.in_order:  # of an overlapping run, each second pair, from the left
                place = np.flatnonzero(take)
                if len(place):
                    first = np.concatenate([[True], place[1:] != place[:-1] + 1])
                    run = np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))
                    take[place[(np.arange(len(place)) - run) % 2 == 1]] = False
            else:  # only the leftmost of each word
                place = np.flatnonzero(take)
                _, first = np.unique(owner[place], return_index=True)
                take[:] = False
                take[place[first]] = True
            place = np.flatnonzero(take)
            symbols[place] = self.made[at[place]]
            stays = np.repeat(open_, sizes)
            stays[place + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return out

    def pieces(self, text: str) -> list[str]:
        """The parts of a text between white space."""
        return self.blank.findall(text) if self.odd.search(text) else text.split()

    def library_words(self, segment: str) -> list[str]:
        """The words of a segment beyond Latin letters: the library's own tables say what is a letter and how marks compose."""
        return [w for w, _ in self.splitter.pre_tokenize_str(self.lowercase.normalize_str(self.compose.normalize_str(segment)))]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces; afterwards ``known`` has their ids as little-endian unsigned 32-bit integers."""
        split: list[tuple[str, list]] = []
        index: dict[str, int] = {}
        for piece in pieces:
            parts: list = []
            for k, segment in enumerate(self.marks.split(piece) if self.marks and "<" in piece else [piece]):
                if k % 2:
                    parts.append(self.special[segment])
                elif segment:
                    simple = segment.isascii() or max(segment) < "\u0300"
                    found = self.words.findall(segment.lower()) if simple else self.library_words(segment)
                    parts += [index.setdefault(w, len(index)) + self.base for w in found]
            split.append((piece, parts))
        ids = [x.astype("<u4").tobytes() for x in self.merged([w.encode() for w in index])] if index else []
        marks = {i: int(i).to_bytes(4, "little") for i in self.special.values()}
        for piece, parts in split:
            self.known[piece] = b"".join([ids[p - self.base] if p >= self.base else marks[p] for p in parts])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        row = 0
        while row < len(texts):
            some, size = [], 0
            while row < len(texts) and (not some or size + len(texts[row]) <= AT_ONCE):
                some.append(self.pieces(texts[row]))
                size += len(texts[row])
                row += 1
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = set().union(*some).difference(self.known)
            if new:
                self.learn(new)
            get = self.known.__getitem__
            for pieces in some:
                yield b"".join(map(get, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_codecs: dict[bytes, Codec] = {}


def codec_of(spec: bytes) -> Codec:
    """One codec for each tokenizer and Python worker."""
    key = hashlib.md5(spec).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _spec(df: DataFrame, path: str):
    """The tokenizer file, read where the driver runs and sent to the tasks; its size is that of one vocabulary."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _sums(codec: Codec, ids: bytes) -> tuple[str, str]:
    """The digests of the ids and of the text decoded from them."""
    return hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def encoded_with_sums(docs: DataFrame, path: str) -> DataFrame:
    """As encoded(), with ids_sha256 and decoded_sha256 besides, and without the texts; for corpora kept as ids."""
    return _encoded(docs, path, sums=True).drop("text")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the tokens of ``text``; a null or empty text has none.

    All rows and other columns stay as they are; a column called ids is replaced.
    """
    return _encoded(docs, path, sums=False)


def _encoded(docs: DataFrame, path: str, sums: bool) -> DataFrame:
    spec = _spec(docs, path)
    added = ["ids"] + ["ids_sha256", "decoded_sha256"] * sums
    kept = docs.drop(*added)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            raw = list(codec.encode(_texts(batch.column("text"))))
            found = [np.frombuffer(b, dtype="<i4") for b in raw]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, "<i4")))
            digests = [pa.array(c, pa.string()) for c in zip(*(_sums(codec, b) for b in raw), strict=True)] if sums and raw else [pa.array([], pa.string())] * 2 * sums
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, *digests], names=[*batch.schema.names, *added])

    schema = kept.withColumns({c: F.array().cast("array<int>") if c == "ids" else F.lit("") for c in added}).schema
    return kept.mapInArrow(task, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with ``text``, decoded from ``ids``; null ids give a null text. A column called text is replaced."""
    spec = _spec(tokens, path)
    kept = tokens.drop("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, dtype="<u4").tobytes()).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return kept.mapInArrow(task, kept.withColumn("text", F.lit(None).cast("string")).schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``: encoded, then decoded from the ids.

    Null and empty texts have no tokens. Repeated rows are taken one by one; rows without a doc_id are left out; an
    empty table gives an empty result. Other columns are not read.
    """
    spec = _spec(docs, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for batch in batches:
            rows = [(len(b) // 4, *_sums(codec, b)) for b in codec.encode(_texts(batch.column("text")))]
            n, ids, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return whole_text(docs).mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

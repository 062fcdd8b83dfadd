"""Line-first quality rules: lines that fail are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statewright.llm import flat
from statewright.llm.shared import whole_text

#: Documents under these limits fail whatever their lines are like.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A line fails when over these shares of its words are separators, or it has more symbols a word, capitals a letter,
#: or fewer different words a word (lines of some words only).
SEPARATORS, SYMBOLS_A_WORD, CAPITALS, DIFFERENT = 0.2, 0.3, 0.7, 0.2
SOME_WORDS = 4
#: A phrase fails a line of so many words at most: in a longer one (a text without line ends is one line) it is a part of the text.
PHRASE_WORDS = 60
#: A document is rejected when its remaining lines hold less than this share of its words.
LEAST_LEFT = 0.5
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    b"cookie", b"all rights reserved", b"click here", b"privacy policy", b"terms of use", b"terms of service",
    b"javascript", b"lorem ipsum", b"subscribe to our", b"sign up for", b"skip to content",
)

RULES = ("punctuation", "navigation", "symbols", "capitals", "repetition", "boilerplate", "duplicate")


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(characters)] = True
    return found


_SYMBOL = _table(b"#*$%&|<>")
_UPPER, _SMALL = _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
#: What may end a sentence, and what stands alone between links: single bytes, and characters of several bytes.
_END, _LONG_ENDS = _table(b".!?;:)\"'"), ("»", "”", "’", "…", "。", "！", "？")
_SEPARATOR, _LONG_SEPARATORS = _table(b"|>/-=~_"), ("·", "»", "•", "›")
#: Of the characters that UTF-8 writes in two bytes: is it a capital, is it another letter with case.
_CAPITAL_OF_TWO = np.array([chr(c).isupper() for c in range(0x800)])
_SMALL_OF_TWO = np.array([chr(c).islower() for c in range(0x800)])


def _last_is(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, single: np.ndarray, several: tuple[str, ...]) -> np.ndarray:
    """Is the last character of each (non-empty) span one of ``single`` (a byte table) or of ``several``?"""
    found = single[data[ends - 1]]
    for character in several:
        code = character.encode()
        fits = ends - starts >= len(code)
        for k, byte in enumerate(reversed(code), 1):
            fits &= data[np.maximum(ends - k, 0)] == byte
        found |= fits
    return found


def _cases(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: does it end a capital letter, does it end a letter that has case. ASCII and characters of two bytes."""
    capital, small = _UPPER[data], _SMALL[data]
    if len(data) > 1:
        lead = data[:-1]
        at = np.flatnonzero((lead >= 0xC2) & (lead <= 0xDF))
        code = ((data[at].astype(np.int64) & 0x1F) << 6) | (data[at + 1] & 0x3F)
        capital[at + 1], small[at + 1] = _CAPITAL_OF_TWO[code], _SMALL_OF_TWO[code]
    return capital, capital | small


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[hi] - total[lo]


def _repeats(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: has its owner another of the same key; has its owner an earlier one."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    k, o = key[order], owner[order]
    same = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    again, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    later[order[1:][same]] = True
    return again, later


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all documents, and the document of each."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    doc = np.repeat(np.arange(len(offsets) - 1), _sums(data == 10, offsets[:-1], offsets[1:]) + 1)
    return starts, ends, doc


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns for the documents of a chunk, and under "lines" the starts, ends, document and rule of each line (-1: stays)."""
    starts, ends, bounds = flat.words(data, offsets)
    doc, n_words = flat.owner(bounds), np.diff(bounds)
    lead, blank = (data & 0xC0) != 0x80, flat.blanks(data)
    names = flat.span_hashes(data, starts, ends)
    out = {"n_words": n_words, "word_chars": _sums(lead & ~blank, offsets[:-1], offsets[1:]), "n_symbols": _sums(_SYMBOL[data], offsets[:-1], offsets[1:])}

    three = flat.window_hashes(names, 3)
    inside = np.flatnonzero(doc[: len(three)] == doc[2:]) if len(three) else np.zeros(0, np.int64)
    again = inside[_repeats(three[inside], doc[inside])[0]]
    covered = np.zeros(len(starts), dtype=bool)
    for shift in range(3):
        covered[again + shift] = True
    out["n_repeat_words"] = _sums(covered, bounds[:-1], bounds[1:])

    l_start, l_end, l_doc = _lines(data, offsets)
    first, last = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    l_words = last - first
    filled = l_words > 0
    line_of_word = np.repeat(np.arange(len(l_start)), l_words)
    _, later = _repeats(flat.span_hashes(data, l_start[filled], l_end[filled]), l_doc[filled])
    duplicate = np.zeros(len(l_start), dtype=bool)
    duplicate[np.flatnonzero(filled)[later]] = True
    out["n_dup_lines"] = np.bincount(l_doc[duplicate], minlength=len(n_words))

    small = flat.lower(data)
    text, boilerplate = small.tobytes(), np.zeros(len(l_start), dtype=bool)
    short = l_words <= PHRASE_WORDS
    for phrase in BOILERPLATE:
        at = text.find(phrase)
        while at >= 0:
            line = np.searchsorted(l_start, at, side="right") - 1
            boilerplate[line] |= short[line] and at + len(phrase) <= l_end[line]
            at = text.find(phrase, at + 1)
    closing = _last_is(data, starts, ends, _END, _LONG_ENDS) if len(starts) else np.zeros(0, bool)
    closed = np.bincount(line_of_word[closing], minlength=len(l_start))
    alone = _sums(lead, starts, ends) == 1
    lone = alone & _last_is(data, starts, ends, _SEPARATOR, _LONG_SEPARATORS) if len(starts) else np.zeros(0, bool)
    separators = np.bincount(line_of_word[lone], minlength=len(l_start))
    symbols = _sums(_SYMBOL[data], l_start, l_end)
    capital, letter = _cases(data)
    capitals, letters = _sums(capital, l_start, l_end), _sums(letter, l_start, l_end)
    _, seen = _repeats(names, line_of_word)
    different = l_words - np.bincount(line_of_word[seen], minlength=len(l_start))
    some = l_words >= SOME_WORDS
    tests = (
        closed == 0,
        separators > SEPARATORS * l_words,
        symbols > SYMBOLS_A_WORD * l_words,
        some & (capitals > CAPITALS * letters),
        some & (different < DIFFERENT * l_words),
        boilerplate,
        duplicate,
    )
    rule = np.full(len(l_start), -1)
    for k in reversed(range(len(tests))):
        rule[tests[k] & filled] = k
    out["n_failed_lines"] = np.bincount(l_doc[rule >= 0], minlength=len(n_words))
    out["n_kept_words"] = np.bincount(l_doc, weights=l_words * (rule < 0), minlength=len(n_words)).astype(np.int64)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & (out["n_kept_words"] >= LEAST_LEFT * n_words)
    out["lines"] = (l_start, l_end, l_doc, rule)
    return out


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_kept_words": "long", "n_failed_lines": "long"}


def _task(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in flat.chunks(batch):
                n_docs = rows.stop - rows.start
                found = judge(data, offsets)
                out = {"doc_id": batch.column(0).slice(rows.start, n_docs)} | {k: pa.array(found[k]) for k in _COLUMNS}
                if with_text:
                    raw, kept = data.tobytes(), [[] for _ in range(n_docs)]
                    for s, e, d, rule in zip(*(x.tolist() for x in found["lines"]), strict=True):
                        if rule < 0:
                            kept[d].append(raw[s:e])
                    out["clean_text"] = pa.array([b"\n".join(x).decode("utf-8", "replace") for x in kept])
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def cleaned(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, verdict and (with_text) the text without failed lines of every row of ``docs``.

    A line fails the first of RULES that applies: no word that ends a sentence, mostly separators, symbols, capitals, few
    different words, a boilerplate phrase, equal to an earlier line. kept is false for documents under the base limits
    and for those whose remaining lines have less than half of the words. Null, empty and blank texts have no words and
    fail. Repeated rows are judged one by one; rows without a doc_id are left out; an empty table gives an empty result.
    """
    schema = "doc_id long, " + ", ".join(f"{k} {v}" for k, v in _COLUMNS.items()) + ", clean_text string" * with_text
    texts = whole_text(docs)
    return texts.select("doc_id", texts["text"].cast("binary").alias("text")).mapInArrow(_task(with_text), schema)

"""Personal data: patterns find protected entities, corpus statistics find the terms that give them away.

A term discloses an entity when seeing the term makes the entity nearly certain: the pointwise mutual information of
the two, over documents, comes near the entity's own information -log2 p(entity). Terms that reach GENERALISE of it
are replaced by a class, those that reach REMOVE are taken out. A term and an entity occur together when a text
has both, wherever they stand, and count only if several different texts show it. All counts are over different texts
(blanks and case apart), so that copies of one text prove nothing, while a phrase that stands in many texts counts in
each of them. Terms are runs of letters and digits outside the matches of the patterns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statewright.llm.shared import Scratch, blanks_to_space, whole_text

KINDS = ("email", "ip", "card", "phone")
#: Different texts that a pair needs, disclosure thresholds.
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.97
#: Bits of the filter of searched words: its size is fixed, whatever the number of words; hits are confirmed by joins.
FILTER_BITS = 1 << 23

# The patterns of the four kinds; possessive where that changes no match but keeps the time linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"[0-9][0-9.\x20-]{6}")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TERM = re.compile(r"[^\W_]+")

_FOUND = "array<struct<start:int, rank:int, kind:string, end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        match = _PHONE.match(text, at)
        if match and 9 <= len(_DIGIT.findall(match.group())) <= 15:
            yield match.span()
        at = text.find("+", match.end() if match else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind by its place in KINDS, end) of the pattern matches that pass their checks, sorted; ends are exclusive."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _NUMBERS.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = "".join(_DIGIT.findall(m.group()))
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(s, 3, e) for s, e in _phones(text)]
    return sorted(out)


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The different entities that ``spans`` mention: kind and value, of cards and phones the digits only."""
    values = ((kind, text[start:end].lower() if kind < 2 else "".join(_DIGIT.findall(text[start:end]))) for start, kind, end in spans)
    return sorted({f"{KINDS[kind]}:{value}" for kind, value in values})


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """The different terms of a text, lower-cased, without those that overlap a match."""
    if not spans:
        return {word.lower() for word in set(_TERM.findall(text))}
    taken = bytearray(len(text))
    for start, _, end in spans:
        taken[start:end] = b"\1" * (end - start)
    return {m.group().lower() for m in _TERM.finditer(text) if not any(taken[m.start() : m.end()])}


_BASE = f"doc_id long, row long, same long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, found {_FOUND}, entities array<string>"


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    for batch in batches:
        counts, sums, found, entities = [[], [], [], []], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in spans))
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            sums.append(hashlib.sha256(joined.encode()).hexdigest())
            found.append([{"start": s, "rank": k, "kind": KINDS[k], "end": e} for s, k, e in spans])
            entities.append(entities_of(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), batch.column("same"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(found, kind), pa.array(entities, pa.list_(pa.string()))],
            names=["doc_id", "row", "same", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found", "entities"],
        )


def _bits(terms: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with two set for each term; what comes to the driver has that size at most."""
    place = F.crc32(F.col("term").cast("binary"))
    places = terms.select(F.explode(F.array(place % FILTER_BITS, F.shiftright(place, 9) % FILTER_BITS)).alias("at"))
    words = places.groupBy(F.expr("at div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 32)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in words.toLocalIterator():
        out[r.word] = r.bits & 0xFFFFFFFF
    return out


class _Searched:
    def __init__(self, bits: np.ndarray):
        self.bits, self.seen = bits, {}

    def __call__(self, word: str) -> bool:
        hit = self.seen.get(word)
        if hit is None:
            h = zlib.crc32(word.encode())
            hit = all(self.bits[p >> 5] >> np.uint32(p & 31) & 1 for p in (h % FILTER_BITS, (h >> 9) % FILTER_BITS))
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = hit
        return hit


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(terms_of(t, base_spans(t))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(terms, pa.list_(pa.string()))], names=["same", "terms"])


def _pairs(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term, both): different texts with both, where they are SUPPORT at least; mentions are (same, entity).

    Entities in fewer texts have no such pair and are left out before terms are listed. What crosses the network is a
    row for each pair of a task.
    """
    holders = mentions.groupBy("same").agg(F.collect_list("entity").alias("entities"))
    held = texts.join(holders.select("same"), "same", "left_semi").groupBy("same").agg(F.first("text").alias("text"))
    rows = held.mapInArrow(_term_rows, "same long, terms array<string>").join(holders, "same")
    rows = rows.select("terms", F.explode("entities").alias("entity")).select("entity", F.explode("terms").alias("term"))
    return rows.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= SUPPORT)


def _document_counts(texts: DataFrame, bits) -> DataFrame:
    """(term, docs): different texts with each word that passes the filter, summed within tasks first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched, counts = _Searched(bits.value), {}
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "docs"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for word in terms_of(text, base_spans(text)):
                    if searched(word):
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) > 200_000:
                    yield give()
                    counts.clear()
        if counts:
            yield give()

    once = texts.groupBy("same").agg(F.first("text").alias("text"))
    return once.select("text").mapInArrow(task, "term string, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _places(texts: DataFrame, bits) -> DataFrame:
    """(row, term, start, end) of each word that passes the filter."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = _Searched(bits.value)
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                terms = {word: low for word in set(_TERM.findall(text)) if searched(low := word.lower())}
                if terms:
                    out += [(row, terms[m.group()], m.start(), m.end()) for m in _TERM.finditer(text) if m.group() in terms]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["row", "term", "start", "end"])

    return texts.select("row", "text").mapInArrow(task, "row long, term string, start int, end int")


def disclosing_terms(base: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """term, disclosure (the highest share of an entity's information that it gives), fate; None where no pair has support."""
    sc = texts.sparkSession.sparkContext
    mentions = scratch.table(base.select("same", F.explode("entities").alias("entity")).distinct(), "mentions")
    entities = scratch.table(mentions.groupBy("entity").agg(F.count("*").alias("own")).filter(F.col("own") >= SUPPORT), "entities")
    pairs = scratch.table(_pairs(mentions.join(entities.select("entity"), "entity", "left_semi"), texts), "pairs")
    if pairs.isEmpty():
        return None
    n = base.select("same").distinct().count()
    counts = _document_counts(texts, sc.broadcast(_bits(pairs.select("term").distinct())))
    information = F.log2(F.lit(float(n)) / F.col("own"))
    shared = F.log2(F.lit(float(n)) * F.col("both") / (F.col("own") * F.col("docs")))
    found = pairs.join(entities, "entity").join(counts, "term").filter(F.col("own") < n)
    found = found.groupBy("term").agg(F.max(shared / information).alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)
    fate = F.when(F.col("disclosure") >= REMOVE, "removed").otherwise("generalised")
    return scratch.table(found.withColumn("fate", fate), "terms")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms and found (the spans as an array) of every row.

    spans holds kind:start:end of the pattern matches and of the disclosing terms (kinds generalised and removed), by
    start, then kind; positions are code points, ends exclusive. Words inside a pattern match add no span. Null and
    empty texts have none. Repeated rows are taken one by one, and equal texts count once for the terms; rows without a
    doc_id are left out; an empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    same = F.xxhash64(F.lower(F.trim(blanks_to_space(F.col("text")))))
    texts = whole_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), same.alias("same"), "text")
    base = scratch.table(texts.mapInArrow(_base, _BASE), "base")
    terms = disclosing_terms(base, texts, scratch)
    joined = base.withColumn("added", F.lit(None).cast(_FOUND))
    if terms is not None and not terms.isEmpty():
        bits = docs.sparkSession.sparkContext.broadcast(_bits(terms.select("term")))
        rank = F.when(F.col("fate") == "generalised", len(KINDS)).otherwise(len(KINDS) + 1)
        places = _places(texts, bits).distinct().join(terms, "term").select("row", F.struct("start", rank.alias("rank"), F.col("fate").alias("kind"), "end").alias("span"))
        joined = base.join(places.groupBy("row").agg(F.collect_list("span").alias("added")), "row", "left")
    outside = F.filter(F.coalesce("added", F.array().cast(_FOUND)), lambda a: ~F.exists("found", lambda b: (a.start < b.end) & (b.start < a.end)))
    joined = joined.withColumn("_outside", outside).withColumn("all", F.array_sort(F.concat("found", "_outside")))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return joined.select(
        "doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size("_outside").cast("long").alias("n_terms"), F.col("all").alias("found")
    )


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            out, done = [], 0
            for s in found or []:
                if s["start"] >= done:
                    label = {"generalised": "[TERM]", "removed": ""}.get(s["kind"], f"[{s['kind'].upper()}]")
                    out += [text[done : s["start"]], label]
                done = max(done, s["end"])
            texts.append("".join([*out, text[done:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text with each finding replaced by its class, or removed; overlapping findings count as the first of them."""
    found = findings(docs).select("row", "found")
    once = Window.partitionBy("row").orderBy(F.size("found"))
    found = found.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    texts = whole_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    return texts.join(found, "row").select("doc_id", "text", "found").mapInArrow(_replace, "doc_id long, text string")

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from statewright.llm import pii
from statewright.llm.pii import GENERALISE, KINDS, REMOVE, SUPPORT, base_spans, entities_of, findings, luhn, sanitised, terms_of
from statewright.llm.shared import Scratch, blanks_to_space, whole_text

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_spans_equal_the_plain_patterns(documents):
    texts = [r.text for r in documents.collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("a.@@-+1234567890 5555(é\n") for _ in range(rng.randrange(80))) for _ in range(20_000)]
    texts += ["a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111", "+1 (386) 555-3733", "+" * 50 + "123456789", "a@" * 300, "@b.c"]
    for t in texts:
        assert base_spans(t) == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("1" * 1_000_000, "1." * 500_000, "a" * 1_000_000 + "@", "+1" + " " * 1_000_000, "1 " * 500_000, "a." * 300_000 + "@x"):
        base_spans(t)


def test_digests(documents):
    for r in findings(documents).collect()[:200]:
        text = documents.filter(documents.doc_id == r.doc_id).first().text if r.n_email + r.n_ip + r.n_card + r.n_phone else None
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in brute(text))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_disclosing_terms(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfgklm") for _ in range(4))
    texts = {i: " ".join(word() for _ in range(40)) for i in range(400)}
    for i in range(8):  # the surname goes with the address nearly always, "agent" is everywhere
        texts[1000 + i] = f"{word()} agent Quimbleton {word()} zed.q@corp.example {word()} {word()}"
        texts[2000 + i] = f"{word()} agent {word()}"
    texts[3000] = "here is quimbleton alone"
    for i in range(50):  # copies prove nothing
        texts[4000 + i] = "Copycat writes from 10.1.2.3 again"
    got = {r.doc_id: r for r in findings(frame(texts)).collect()}
    assert got[3000].spans == "generalised:8:18" or got[3000].spans == "removed:8:18"
    assert got[1000].n_terms == 1 and got[1000].n_email == 1 and "agent" not in got[1000].spans
    assert all(got[4000 + i].n_terms == 0 and got[4000 + i].n_ip == 1 for i in range(50))
    assert all(got[i].spans == "" for i in range(400))
    clean = {r.doc_id: r.text for r in sanitised(frame(texts)).collect()}
    assert "uimbleton" not in clean[3000] and "[EMAIL]" in clean[1000] and clean[0] == texts[0] and len(clean) == len(texts)


def test_the_same_phrase_in_many_texts_discloses(frame):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfgklm") for _ in range(5))
    texts = {i: " ".join(word() for _ in range(30)) for i in range(400)}
    for i in range(20):
        texts[1000 + i] = " ".join(word() for _ in range(30)) + "\nWith kind regards, Janet Roequist, Acme Sales, jane@acme.example"
    texts[2000] = "what does roequist say"
    for i in range(30):  # copies, apart from blanks and case, are one text
        texts[3000 + i] = ("Copycat writes", "copycat  WRITES")[i % 2] + " from 10.1.2.3 again"
    got = {r.doc_id: r for r in findings(frame(texts)).collect()}
    assert got[2000].spans in ("generalised:10:18", "removed:10:18")
    assert all("removed" in got[1000 + i].spans for i in range(20))
    assert all(got[3000 + i].n_terms == 0 for i in range(30))


def test_terms_anywhere_in_the_document(frame):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfgklm") for _ in range(5))
    texts = {i: " ".join(word() for _ in range(30)) for i in range(400)}
    for i in range(20):  # the name stands 60 words before the address, the staff number and the short name far after it
        texts[1000 + i] = " ".join(["Dear Roequist", *(word() for _ in range(60)), "jane@acme.example", *(word() for _ in range(60)), "K7731 Xu"])
    texts |= {2000: "what does roequist say", 2001: "ask k7731 today", 2002: "and xu"}
    got = {r.doc_id: r for r in findings(frame(texts)).collect()}
    assert [got[2000 + i].spans.split(":")[1:] for i in range(3)] == [["10", "18"], ["4", "9"], ["4", "6"]]
    assert terms_of("\u0130nan x_y \u00e9a@b.cd ef", base_spans("\u0130nan x_y \u00e9a@b.cd ef")) == {"\u0130nan".lower(), "x", "y", "ef"}


def plain_terms(rows):
    """term -> (disclosure, fate), from the same counts in plain Python."""
    spaced = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ").lower(): t or "" for _, t in rows}
    terms = {k: terms_of(t, base_spans(t)) for k, t in spaced.items()}
    own, docs, both = {}, Counter(x for v in terms.values() for x in v), Counter()
    for k, t in spaced.items():
        for e in entities_of(t, base_spans(t)):
            own.setdefault(e, set()).add(k)
    for e, where in own.items():
        if len(where) >= SUPPORT:
            both.update((e, x) for k in where for x in terms[k])
    n, found = len(spaced), {}
    for (e, x), c in both.items():
        if c >= SUPPORT and len(own[e]) < n:
            share = math.log2(n * c / (len(own[e]) * docs[x])) / math.log2(n / len(own[e]))
            found[x] = max(share, found.get(x, -9.0))
    return {x: (round(v, 9), "removed" if v >= REMOVE else "generalised") for x, v in found.items() if v >= GENERALISE}


def test_terms_equal_a_plain_computation(documents, frame):
    rng = random.Random(31)
    word = lambda n=5: "".join(rng.choice("bcdfgklm") for _ in range(n))
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for i in range(12):  # long neighbours, words cut by nothing, a rare and a common companion
        rows.append((10**6 + i, f"Marchetti {word(150)} {word()} {'sometimes' if i % 3 else 'always'} m.q@corp.example {word(150)} desk{i % 2}"))
    rows += [(2 * 10**6 + i, f"{word()} sometimes {word()}") for i in range(4)]
    for repeats in (1, 3):  # repeated rows change nothing
        df = frame(rows * repeats)
        same = F.xxhash64(F.lower(F.trim(blanks_to_space(F.col("text")))))
        texts = whole_text(df).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), same.alias("same"), "text")
        scratch = Scratch(df.sparkSession, "test-pii")
        base = scratch.table(texts.mapInArrow(pii._base, pii._BASE), "base")
        got = {r.term: (round(r.disclosure, 9), r.fate) for r in pii.disclosing_terms(base, texts, scratch).collect()}
        assert got == plain_terms(rows) and got["marchetti"][1] == "removed" and "sometimes" in got


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, "a@b.cd"), (3, "a@b.cd"), (None, "a@b.cd")]
    clash = frame(rows).selectExpr("*", "1 AS spans", "2 AS row", "3 AS found")
    assert sorted((r.doc_id, r.n_email, r.spans) for r in findings(clash).collect()) == [(1, 0, ""), (2, 0, ""), (3, 1, "email:0:6"), (3, 1, "email:0:6")]
    assert findings(frame({})).count() == 0
    assert sorted((r.doc_id, r.text) for r in sanitised(clash).collect()) == [(1, ""), (2, ""), (3, "[EMAIL]"), (3, "[EMAIL]")]

import hashlib
import random
from collections import Counter

import pytest

from statewright.llm.substring_dedup import COVERS, without_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def result(df, window):
    return sorted(tuple(r) for r in without_repeats(df, window).collect())


@pytest.mark.parametrize("period", COVERS)
def test_covers(period):
    cover = COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_equals_brute_force_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(documents, 35) == brute(rows, 35)


def test_exact_lengths_and_odd_rows(frame):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}é"
    passage = [word() for _ in range(80)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "z " * 300), (5, "z " * 36), (6, "z " * 34)]
    for k, n in enumerate((20, 34, 35, 36, 37, 55, 56, 80) * 4):
        a = rng.randrange(81 - n)
        rows.append((100 + k, " ".join([word() for _ in range(rng.randrange(60))] + passage[a : a + n] + [word() for _ in range(rng.randrange(60))])))
    rows += [(500, "one row twice " * 20), (500, "one row twice " * 20), (501, "same id " + "other text " * 30), (501, "same id")]
    for window in (35, 5, 2):
        assert result(frame(rows), window) == brute(rows, window)
    assert without_repeats(frame([])).count() == 0
    clash = frame(rows).selectExpr("*", "1 AS row", "2 AS places", "3 AS at")
    assert sorted(tuple(r) for r in without_repeats(clash, 35).collect()) == brute(rows, 35)


@pytest.mark.parametrize("length", (1024, 4096))
def test_words_that_a_polynomial_confuses(frame, length):
    """Two texts of 35 words that differ in one Thue-Morse word share no window; with the same word they do."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = lambda w: " ".join([*(f"w{k}" for k in range(17)), w, *(f"v{k}" for k in range(17))])
    got = {r.doc_id: (r.n_words, r.n_removed) for r in without_repeats(frame({1: text(word), 2: text(other)})).collect()}
    assert got == {1: (35, 0), 2: (35, 0)}
    got = {r.doc_id: r.n_removed for r in without_repeats(frame({1: text(word), 2: text(other), 3: text(word)})).collect()}
    assert got == {1: 35, 2: 0, 3: 35}
    two = [" ".join("pq"[c == x] for c in word[:1024]) for x in "ab"]
    texts = {1: two[0], 2: two[1]}
    assert result(frame(texts), 700) == brute(list(texts.items()), 700)

import random
import re

import numpy as np
import pytest

from statewright.llm import flat, minhash
from statewright.llm.minhash import drop_near_copies, near_groups


def brute(texts, size, threshold=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def brute_matrix(texts, size, threshold=80):
    """As brute(), for one family of a few thousand: intersections from a matrix product."""
    ids = sorted(texts)
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (words_of(texts[i]) for i in ids)]
    place = {}
    rows = [[place.setdefault(x, len(place)) for x in s] for s in sets]
    same = np.zeros((len(ids), len(ids)), dtype=np.float32)
    for low in range(0, len(place), 4000):
        cells = np.zeros((len(ids), 4000), dtype=np.float32)
        for k, r in enumerate(rows):
            cells[k, [c - low for c in r if low <= c < low + 4000]] = 1
        same += cells @ cells.T
    n = np.array([len(s) for s in sets])
    near = 100 * same >= threshold * (n[:, None] + n[None, :] - same)
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(np.triu(near, 1)):
        x, y = sorted((top(i), top(j)))
        root[y] = x
    return {i: (int(n[k]), ids[top(k)], top(k) == k) for k, i in enumerate(ids)}


def result(df, size):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(df, size).collect()}


def test_equals_brute_force_on_documents(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for size in (4, 5):
        assert result(documents, size) == brute(texts, size)


def test_chain_of_variants(frame):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = {}
    for i in range(60):  # each is near its predecessor; the ends of the chain are not near each other
        base = base[:]
        for _ in range(6):
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
        texts[i * 7 + 3] = " ".join(base)
    assert result(frame(texts), 4) == brute(texts, 4)


def test_families_in_several_blocks(frame, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(11)
    texts = {}
    for family in range(4):
        base = [f"f{family}w{rng.randrange(9000)}" for _ in range(150)]
        for k in range(45):
            words = base[:]
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts[family * 1000 + k] = " ".join(words)
    assert result(frame(texts), 4) == brute(texts, 4)


def test_family_of_three_thousand(frame):
    """Copies with a few to many changed words: some are linked by stars, some only by others, some not at all."""
    rng = random.Random(3)
    base, texts = [f"b{k}" for k in range(120)], {}
    for k in range(3000):
        words = base[: 120 - rng.randrange(12)]
        for _ in range(rng.choice((1, 2, 3, 3, 4, 5, 8))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[k] = " ".join(words)
    assert result(frame(texts), 4) == brute_matrix(texts, 4)


@pytest.mark.parametrize("size", (3, 300))
def test_candidates_that_no_star_links(frame, size, monkeypatch):
    """Two groups that share a passage are candidates, but no link joins them; within each, links are few and far."""
    monkeypatch.setattr(minhash, "ROUNDS", (1, minhash.BANDS))
    rng = random.Random(size)
    shared, texts = [f"s{k}" for k in range(60)], {}
    for k in range(size):
        own = [f"{k % 3}-{k // 3 // 4}-{w}" for w in range(30)]
        texts[k] = " ".join(shared[rng.randrange(3) :] + own[rng.randrange(5) :])
    assert result(frame(texts), 4) == brute(texts, 4)


def test_words_that_a_polynomial_confuses(frame):
    word, texts = "a", {}
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for k, length in ((0, 1024), (10, 4096)):
        texts |= {k + 1: f"{word[:length]} b c d", k + 2: f"{other[:length]} b c d", k + 3: f"{word[:length]} b c d"}
    assert result(frame(texts), 4) == {k + i: (1, k + first, kept) for k in (0, 10) for i, first, kept in ((1, 1, True), (2, 2, True), (3, 1, False))}
    swapped = [w for c in word[:1024] for w in (("p", "q") if c == "a" else ("q", "p"))]
    turned = [w for c in other[:1024] for w in (("p", "q") if c == "a" else ("q", "p"))]
    names = flat.span_hashes(np.frombuffer(b"pq", np.uint8), np.array([0, 1]), np.array([1, 2]))
    runs = [flat.window_hashes(np.array([names[int(w == "q")] for w in x]), len(x))[0] for x in (swapped, turned)]
    assert runs[0] != runs[1]


def test_order_of_rows_changes_nothing(frame):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join([*base[: 50 - rng.randrange(8)], f"x{rng.randrange(99)}"])) for i in (1, 2, 2, 3, 3, 3, 9)]
    got = []
    for _ in range(2):
        rng.shuffle(rows)
        got.append(sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_groups(frame(rows), 4).collect()))
    assert got[0] == got[1]


def test_odd_rows(frame, spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "a b c", 7: "a  b\tc", 8: "x " * 50_000, 9: "x x x x x"}
    assert result(frame(texts), 4) == brute(texts, 4)
    assert near_groups(frame({})).count() == 0
    twice = frame([(4, "same words in both rows here"), (4, "same words in both rows here"), (None, "no id")])
    assert [(r.doc_id, r.component_id, r.kept) for r in near_groups(twice).collect()] == [(4, 4, True)]
    clash = frame({1: "a b c d e f", 2: "a b c d e f"}).selectExpr("*", "1 AS component_id", "'k' AS bucket", "2 AS node")
    assert [(r.doc_id, r.node) for r in drop_near_copies(clash).collect()] == [(1, 2)]


def test_one_doc_id_with_several_texts_and_rows_without(frame):
    rng = random.Random(21)
    text = lambda: [f"w{rng.randrange(9000)}" for _ in range(100)]
    near = lambda words: [*words[:-1], "other"]
    base, clean, alone, free = text(), text(), text(), text()
    rows = [(3, base), (5, [*near(base), "longer"]), (5, clean), (7, near(clean)), (None, near(base)), (None, alone), (None, near(alone)), (9, free), (9, near(free))]
    rows = [(i, " ".join(t)) for i, t in rows]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_groups(frame(rows)).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (9, 9, False), (9, 9, True)]
    kept = [(r.doc_id, r.text) for r in drop_near_copies(frame(rows + rows)).collect()]
    assert sorted(str(i) for i, _ in kept) == ["3", "5", "9", "None"]
    assert (3, rows[0][1]) in kept and (5, rows[2][1]) in kept and ((None, rows[5][1]) in kept or (None, rows[6][1]) in kept)

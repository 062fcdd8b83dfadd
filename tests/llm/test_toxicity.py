import random
import re
import zlib

import numpy as np

from statewright.llm import toxicity as T


def test_grammar_marks():
    lexicon = T.Lexicon({})

    def labels(text):
        got = T.features(text, lexicon)
        return [] if got is None else [T.LABELS[i] for i in np.flatnonzero(got[: len(T.LABELS)])]

    assert labels("a calm line.") == []
    assert labels("idiot.") == [(T.INSULT, T.OUTRIGHT, 0, 0, 0)]
    assert labels("what an idiot.") == labels("a complete idiot") == [(T.INSULT, T.DESCRIBED, 0, 0, 0)]
    assert labels("you are such an idiot") == labels("you stupid idiot") == [(T.INSULT, T.ATTRIBUTED, 0, 0, 1)]
    assert labels("you are not an idiot") == [(T.INSULT, T.ATTRIBUTED, 1, 0, 1)]
    assert labels("not an idiot") == [(T.INSULT, T.DESCRIBED, 1, 0, 0)]
    assert labels("not one of the many here is an idiot") == [(T.INSULT, T.DESCRIBED, 0, 0, 0)]
    assert labels("he said idiot") == [(T.INSULT, T.OUTRIGHT, 0, 1, 0)]  # who reports is no target
    assert labels("he said you are an idiot") == [(T.INSULT, T.ATTRIBUTED, 0, 1, 1)]
    assert labels('the word "idiot" here') == [(T.INSULT, T.OUTRIGHT, 0, 1, 0)]
    assert labels("you. an idiot") == [(T.INSULT, T.DESCRIBED, 0, 0, 0)]
    assert labels("will soon hurt the dog") == [(T.THREAT, T.INTENDED, 0, 0, 0)]
    assert labels("will hurt you") == [(T.THREAT, T.DIRECT, 0, 0, 1)]
    assert labels("hurt feelings") == [(T.THREAT, T.BARE, 0, 0, 0)]
    assert labels("idiot. idiot. you are a moron") == [(T.INSULT, T.OUTRIGHT, 0, 0, 0), (T.INSULT, T.ATTRIBUTED, 0, 0, 1)]


SIGNS = "oityn" + "rqcfw"


def enumerated(clause):
    """All matches of a clause by regular expressions over its symbols, without the machines; the best one."""
    text = "".join(SIGNS[s] for s, _ in clause)
    found = []

    def marks(p):
        inside, rest = text[:p].count("q") % 2, text[:p].rpartition("q")[2]
        return int("n" in text[max(0, p - 3) : p]), int(bool(inside or "r" in rest))

    for p, sign in enumerate(text):
        before = text[:p]
        if sign == "i":
            attributed = re.search(r"yn*(?:[cfi][fin]*)?$", before)
            strength = T.ATTRIBUTED if attributed else T.DESCRIBED if re.search(r"[fi][fin]*$", before) else T.OUTRIGHT
            found.append((clause[p][1], strength, T.INSULT, *marks(p), p))
        if sign == "t":
            found.append((clause[p][1], T.INTENDED if re.search(r"w[^wt]{0,3}$", before) else T.BARE, T.THREAT, *marks(p), p))
            direct = re.match(r"tf*y", text[p:])
            if direct:
                found.append((clause[p][1], T.DIRECT, T.THREAT, *marks(p), p))
    if not found:
        return None
    _, strength, kind, negated, reported, place = max(found)
    total = sum(w for s, w in clause if s in (T.INSULT, T.THREAT))
    return (kind, strength, negated, reported, int(bool(re.search(r"y(?!r)", text)))), total, place


def test_composed_machine_equals_an_enumeration_of_paths():
    rng = random.Random(2)
    hits = 0
    for _ in range(30_000):
        common = rng.choice((range(10), (0, 1, 3, 7, 8, 4), (0, 2, 3, 9, 8, 5)))
        clause = [(s := rng.choice(common), float(rng.randrange(1, 4)) if s in (T.INSULT, T.THREAT) else 0.0) for _ in range(rng.randrange(1, 12))]
        got = T.matched(clause)
        assert got == enumerated(clause)
        hits += got is not None
    assert hits > 10_000


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = T.scores(docs, T.train(docs, labels))
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.values())
    pairs = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    right = sum(p == t for p, t in pairs) / len(pairs)
    caught = sum(p for p, t in pairs if t) / sum(t for _, t in pairs)
    assert right > 0.96 and caught > 0.9


def test_odd_rows_and_no_labels(frame, spark):
    docs = frame([(1, None), (2, ""), (3, "  \n"), (4, "you idiot, you worthless idiot. trash, you are trash"), (5, "fine " * 30_000), (5, "fine"), (None, "idiot")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.predicted) for r in T.scores(docs, T.train(docs, none)).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (5, 0)]
    assert T.scores(frame({}), T.train(frame({}), none)).count() == 0
    clash = docs.selectExpr("*", "1 AS score", "2 AS toxic", "3 AS half")
    assert sorted(r.doc_id for r in T.drop_toxic(clash, none).collect() if r.doc_id) == [1, 2, 3, 5, 5]

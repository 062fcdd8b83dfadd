import hashlib
import re

from statewright.llm.exact_dedup import BLOCK, drop_copies, exact_groups


def brute(texts):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {
        i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g
    }


def result(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(df).collect()}


def test_equals_brute_force_on_documents(documents):
    assert result(documents) == brute({r.doc_id: r.text for r in documents.collect()})


def test_block_borders_and_odd_rows(frame):
    block = "ab cd é " * (BLOCK // 8)
    texts = {1: None, 2: "", 3: " ", 4: "\t\n", 5: block, 6: block + "x", 7: block * 3, 8: block * 3, 9: block * 2 + "y" + block[1:], 10: "x" + block}
    texts |= {20 + i: "q" * (BLOCK * i) for i in range(6)} | {30 + i: "q" * (BLOCK * i) for i in range(6)}
    assert result(frame(texts)) == brute(texts)


def test_repeated_rows_empty_table_and_clashing_names(frame):
    assert exact_groups(frame({})).count() == 0
    rows = frame([(1, "a b"), (1, "a b"), (2, "a\nb"), (None, "a b")])
    assert result(rows) == {1: (1, 3, True, hashlib.sha256(b"a b").hexdigest()), 2: (1, 3, False, hashlib.sha256(b"a b").hexdigest())}
    clash = rows.selectExpr("*", "5 AS keep_id", "'n' AS name", "7 AS k")
    assert [(r.doc_id, r.keep_id, r.name, r.k) for r in drop_copies(clash).collect()] == [(1, 5, "n", 7)]


def test_repeated_rows_of_every_length(frame):
    texts = {i: "z" * n for i, n in enumerate((0, 4000, BLOCK, BLOCK + 1, 5000, 3 * BLOCK, 5 * BLOCK + 7))}
    texts[7] = "ab" * BLOCK * 2 + "c"  # its two first pairs of blocks are equal
    rows = [(10 * i, t) for i, t in texts.items() for _ in range(2 + i)] + [(10 * i + 1, t) for i, t in texts.items()]
    got = exact_groups(frame(rows)).collect()
    assert len(got) == 2 * len(texts)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == sorted((10 * i + k, 10 * i, 3 + i, k == 0) for i in texts for k in (0, 1))
    assert sorted(r.doc_id for r in drop_copies(frame(rows)).collect()) == [10 * i for i in texts]


def test_rows_without_a_doc_id_are_judged_by_their_text(frame):
    rows = [(2, "a b"), (None, "a\nb"), (None, "new"), (None, "new"), (None, "long " * BLOCK), (2, "other")]
    assert sorted((str(r.doc_id), r.text[:5]) for r in drop_copies(frame(rows)).collect()) == [("2", "a b"), ("2", "other"), ("None", "long "), ("None", "new")]

import math
from collections import Counter

from statewright.llm import mixing
from statewright.llm.mixing import rates, replicated, unit


def test_rates_are_poisson(frame):
    docs = frame({i: "t" for i in range(300)}).selectExpr("doc_id", "text", "if(doc_id < 290, 'big', 'small') AS source")
    got = {r._source: r for r in rates(docs).collect()}
    for name, n in (("big", 290), ("small", 10)):
        lam = 300 * math.sqrt(n) / (math.sqrt(290) + math.sqrt(10)) / n
        assert math.isclose(got[name].lam, lam)
        for k, c in enumerate(got[name].cdf):
            assert math.isclose(c, sum(math.exp(-lam) * lam**j / math.factorial(j) for j in range(k + 1)), rel_tol=1e-9)


def test_weights_and_order(frame, spark):
    docs = frame({i: f"t{i}" for i in range(4000)}).selectExpr("doc_id", "text", "if(doc_id % 10 < 9, 'a', 'b') AS source", "1 AS copy", "'k' AS cdf", "2 AS lam")
    rows = replicated(docs, weights={"a": 1.0, "b": 3.0}).collect()
    keys = [r.shuffle_key for r in rows]
    assert keys == sorted(keys)
    share = Counter(r.source for r in rows)
    assert abs(share["b"] / len(rows) - 0.75) < 0.03 and abs(len(rows) - 4000) < 300
    assert {r.cdf for r in rows} == {"k"} and rows == replicated(docs, weights={"a": 1.0, "b": 3.0}).collect()
    per = Counter(r.doc_id for r in rows if r.source == "b")
    assert all({r.copy for r in rows if r.doc_id == i} == set(range(1, n + 1)) for i, n in list(per.items())[:20])
    assert replicated(docs, weights={"b": 1.0}).filter("source = 'a'").count() == 0
    u = [r.u for r in docs.select(unit("doc_id").alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.02


def test_large_rates_and_odd_rows(frame):
    docs = frame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "n")]).selectExpr("doc_id", "text", "if(doc_id = 1, null, 'z') AS source")
    rows = replicated(docs, rate=800.0).collect()
    assert abs(len(rows) - 4000) < 400 and any(r.source is None for r in rows)
    assert replicated(frame({})).count() == 0


def test_salted_join_gives_the_same_rows(frame, monkeypatch):
    docs = frame({i: f"t{i}" for i in range(2000)}).selectExpr("doc_id", "text", "concat('s', doc_id % 37) AS source")
    sent = replicated(docs, rate=2.5).collect()
    monkeypatch.setattr(mixing, "SENT_BYTES", 0)
    assert replicated(docs, rate=2.5).collect() == sent and len(sent) > 4000


def test_a_rare_source_has_a_short_list(frame):
    docs = frame({i: "t" for i in range(2000)}).selectExpr("doc_id", "text", "if(doc_id = 7, 'rare', 'big') AS source")
    given = {r._source: r for r in rates(docs, weights={"rare": 1.0, "big": 1.0}, rate=50.0).collect()}
    assert given["rare"].lam == 50_000 and given["rare"].low > 40_000 and len(given["rare"].cdf) < 6_000
    assert given["big"].low == 0 and 1 - given["rare"].cdf[-1] < 1e-9
    n = replicated(docs, weights={"rare": 1.0, "big": 1.0}, rate=50.0).filter("doc_id = 7").count()
    assert abs(n - 50_000) < 1_500

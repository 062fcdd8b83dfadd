import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import test_exact_dedup
import test_minhash
from tokenizers import Tokenizer

import corpus_pipeline
from statewright.llm import mixing, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_on_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = [f for _, f in corpus_pipeline.STAGES]
    judged = {r.doc_id: r.predicted for r in toxicity.scores(documents, toxicity.train(documents, labels)).collect()}

    clean = stage[0](spark, documents, SF).cache()
    assert clean.columns == documents.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, p in judged.items() if not p}

    single = stage[1](spark, clean, SF).cache()
    kept = {i for i, x in test_exact_dedup.brute({r.doc_id: r.text for r in clean.collect()}).items() if x[2]}
    assert single.columns == documents.columns and sorted(r.doc_id for r in single.collect()) == sorted(kept)

    apart = stage[2](spark, single, SF).cache()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, x in test_minhash.brute(texts, 5).items() if x[2])

    mixed = stage[3](spark, apart, SF).cache()
    n, rates = Counter(r.doc_id for r in mixed.collect()), {r._source: r.cdf for r in mixing.rates(apart).collect()}
    for r in apart.collect():
        u = int(hashlib.md5(f"{r.doc_id}:17".encode()).hexdigest()[:13], 16) / 2**52
        assert n[r.doc_id] == sum(c <= u for c in rates[r.source])

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = stage[4](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in tokens) == n
    for r in tokens:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(tokens)


def test_stages_on_odd_rows(spark, frame):
    """Rows without a doc_id, repeated rows, one doc_id with several texts, null texts, clashing columns, an empty table."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, long), (1, long), (2, f"{long} more"), (2, "another text"), (None, "no id"), (None, "no id"), (None, long), (3, None), (4, ""), (5, "you are an idiot. you idiot. what an idiot. you worthless trash")]
    docs = frame(rows).selectExpr("*", "'k' AS ids", "1 AS _n", "2 AS label", "3 AS band", "4 AS kept", "5 AS name")
    clean = toxicity.drop_toxic(docs, labels)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i != 5) and clean.columns == docs.columns
    single = corpus_pipeline.exact_dedup_stage(spark, clean, SF)
    texts = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [(1, long), (2, f"{long} more"), (2, "another text"), (None, "no id"), (3, None)])) and single.columns == docs.columns
    apart = corpus_pipeline.near_dedup_stage(spark, single, SF)
    texts = [(r.doc_id, r.text) for r in apart.collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [(1, long), (2, "another text"), (None, "no id"), (3, None)])) and apart.columns == docs.columns
    mixed = corpus_pipeline.mixing_stage(spark, apart, SF)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {t for _, t in texts}
    tokens = corpus_pipeline.bpe_stage(spark, mixed, SF)
    assert tokens.count() == mixed.count() and all(r.n_tokens == len(r.ids) for r in tokens.collect())
    none = docs.limit(0)
    for stage in (corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.mixing_stage, corpus_pipeline.bpe_stage):
        assert stage(spark, none, SF).count() == 0
    assert toxicity.drop_toxic(none, labels).count() == 0

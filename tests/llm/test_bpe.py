import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statewright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(texts, library):
    codec = bpe.Codec(open(PATH, "rb").read())
    for text, got in zip(texts, codec.encode(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, text[:200]
        assert codec.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_documents(documents, library):
    check([r.text for r in documents.collect()], library)


def test_equals_the_library_on_odd_texts(library):
    rng = random.Random(1)
    signs = "aAbBéÉßΣσİ'<|>sStT019 \t\n\x1c\x1f\x85\xa0 ́가漢字😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "don't WE'LL they're 'sx", "a" * 30_000, "ab" * 10_000, "é É", "1234", "ΑΣ ΑΣ."]
    texts += ["".join(chr(c) for c in range(lo, lo + 64) if unicodedata.category(chr(c)) not in ("Cn", "Cs")) for lo in range(0, 0xFFC0, 64)]
    check([*texts, "a\u0558b\u058b-'s9"], library)


def test_one_by_one_merges_give_the_same(library):
    codec = bpe.Codec(open(PATH, "rb").read())
    assert codec.in_order
    words = [w.encode() for w in ("thetherefore", "aaaaaaa", "x", "hahahaha")]
    batched = [x.tolist() for x in codec.merged(words)]
    codec.in_order = False
    assert [x.tolist() for x in codec.merged(words)] == batched


def test_frames(frame, library):
    docs = frame([(1, None), (2, ""), (3, "Some words"), (3, "Some words"), (None, "x")])
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    ids = library.encode("Some words", add_special_tokens=False).ids
    assert got[3].n_tokens == len(ids) and got[1].n_tokens == got[2].n_tokens == 0
    assert got[3].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(docs, PATH).count() == 4 and bpe.round_trip(frame({}), PATH).count() == 0
    clash = docs.selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    back = bpe.decoded(bpe.encoded(clash, PATH), PATH)
    assert [r.text for r in back.collect()] == ["", "", "some</w> words</w>", "some</w> words</w>", "x</w>"]

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statewright.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(rows, library):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_equals_the_library_on_documents(documents, library):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(tuple(r) for r in T.written_and_read(documents, PATH).collect()) == brute(rows, library)


def test_odd_rows(frame, library):
    rng = random.Random(2)
    signs = "abcÉéß'stre <|endoftext|>019 \n\t\r\x1c\x85\xa0 ́漢😀_-"
    rows = [(1, None), (2, ""), (3, " "), (7, "<|endoftext|> a<|endoftext|>"), (7, "b"), (7, "b"), (-4, "x" * 20_000), (9, "  \n\n  word\n \n")]
    rows += [(100 + k, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for k in range(2000)]
    clash = frame([*rows, (None, "no id")]).selectExpr("*", "1 AS start", "'p' AS part", "2 AS ids_crc32")
    assert sorted(tuple(r) for r in T.written_and_read(clash, PATH).collect()) == brute(rows, library)
    assert T.written_and_read(frame({}), PATH).count() == 0


def test_files_are_one_stream(frame, library, tmp_path):
    texts = {i: f"text number {i} " * (i % 7) for i in range(500)}
    T.write(frame(texts), PATH, str(tmp_path / "out"), 2)
    before = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if f.is_file()}
    manifest = T.manifest(str(tmp_path / "out"))
    assert {n.rpartition(".")[2] for n in before if not n.startswith(".")} == {"ids", "docs", "ends", "json"}
    read = lambda x, kind: np.concatenate([np.fromfile(tmp_path / "out" / f"{m['name']}.{x}", kind) for m in manifest])
    ids, docs, ends = read("ids", "<u2"), read("docs", "<i8"), read("ends", "<i8")
    assert docs.tolist() == sorted(texts) and ends[-1] == len(ids)
    for i in (0, 13, 499):
        start = ends[i - 1] if i else 0
        assert ids[start : ends[i]].tolist() == [*library.encode(texts[i], add_special_tokens=False).ids, 2]
    found = T.read(frame({}).sparkSession, str(tmp_path / "out"))
    assert found.count() == found.count() == 500  # a reader leaves the files as they are
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if f.is_file()} == before

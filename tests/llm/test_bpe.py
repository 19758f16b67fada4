"""Tokens and texts against the vocabulary's own library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagewright.llm import bpe

PARTS = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "the", " tion", "é", "ß", "日本", "1", "23", "<|endoftext|>", "<|endo", "'s", "'re", "\x1c", "\x85",
         "　", "!", "...", " x", "ZZ", "😀", "\r\n", "\x00", "aaaa", "aaaaaaaaaaa", "​", "ſ", "²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def model():
    return bpe.BytePairs(bpe.vocabulary_path())


def _texts():
    pick = random.Random(5)
    texts = ["".join(pick.choices(PARTS, k=pick.randint(0, 25))) for _ in range(3000)]
    return [*texts, "ab" * 3000, "a" * 4000, " " * 2000, "\n " * 50, "", None]


def test_tokens_are_the_librarys(model, library):
    texts = _texts()
    ids, counts = model.encode(texts)
    got = np.split(ids, np.cumsum(counts)[:-1])
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in got] == [w.ids for w in want]
    assert [model.decode(x) for x in got] == [t or "" for t in texts]


def test_proposals_that_fail_are_merged(model, library):
    pick = random.Random(7)
    words = ["".join(pick.choices("etaoinshrdlucmfwyg", k=pick.randint(1, 14))).encode() for _ in range(5000)]
    before = model.merged
    got = model.encode_words(words)
    assert model.merged > before
    assert got == [model.exact(w) for w in words] == [model._exact_long(w) for w in words]


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 20)
    model = bpe.BytePairs(bpe.vocabulary_path())
    for at in range(0, 60, 6):
        texts = [f"word{i} and thatish{i} {i}" for i in range(at, at + 6)]
        ids, counts = model.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, library):
    rows = [(1, "The entry, the end.", "x"), (1, "The entry, the end.", "x"), (None, "ünï", None), (3, None, "y"), (4, "", "z"), (5, "tion " * 30000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, (r[0] for r in rows)))
    for r in out:
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        assert r.decoded == (r.text or "")
    trip = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    assert trip[3].n_tokens == 0 and trip[3].ids_sha256 == trip[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    ids = np.array(library.encode(rows[0][1], add_special_tokens=False).ids, "<u4")
    assert trip[1].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
    assert bpe.round_trip(docs.limit(0)).count() == 0 and bpe.encode(docs.limit(0)).count() == 0

"""Token files: grammar round trips, order, starts, random access."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagewright.llm import tokenfile
from pagewright.llm.bpe import vocabulary_path


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    pick = np.random.default_rng(seed)
    docs = [pick.integers(0, [3, 50, 70_000][seed % 3], pick.integers(1, 400)).astype(np.uint32) for _ in range(60)]
    docs += [docs[0]] * 20 + [np.zeros(1000, np.uint32)]
    ids, starts = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    block = tokenfile.Block(tokenfile.pack(ids, starts))
    assert np.array_equal(block.all(), ids) and len(block.symbols) < len(ids)
    assert tokenfile.lengths_of(block.rules, block.base).tolist() == block.lengths.tolist() == [len(tokenfile.expand(np.array([block.base + i], np.uint32), block.rules, block.base)) for i in range(len(block.rules))]
    for i in range(0, len(docs), 7):
        assert np.array_equal(block.document(i), docs[i])
    for a, b in ((0, 1), (5, 700), (len(ids) - 3, len(ids)), (1234, 1234 + 99)):
        assert np.array_equal(block.stretch(a, b), ids[a:b])


def test_no_pair_worth_a_rule_is_left():
    passage = np.random.default_rng(1).integers(0, 50_000, 260).astype(np.uint32)
    ids = np.tile(passage, 4000)
    symbols, rules, starts, base = tokenfile.compress(ids, np.array([0, len(ids)]))
    assert len(symbols) < 200 and np.array_equal(tokenfile.expand(symbols, rules, base), ids)
    mixed = np.random.default_rng(2).integers(0, 40, 60_000).astype(np.uint32)
    symbols, rules, starts, base = tokenfile.compress(mixed, np.array([0, len(mixed)]))
    pairs = np.stack([symbols[:-1], symbols[1:]], axis=1)
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < tokenfile.LEAST and np.array_equal(tokenfile.expand(symbols, rules, base), mixed)


def test_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", 50)
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choices(["the", "  of", "thing\n", "<|endoftext|>", "日本", "x1"], k=pick.randint(0, 40))), 1) for i in pick.sample(range(500), 200)]
    rows += [(None, "null id", 2), (600, None, 3), (601, "", 3), (601, "", 3), (602, "long " * 20_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int").repartition(6)
    folder = tokenfile.write(docs)
    got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(vocabulary_path()), 0
    texts = {r[0]: r[1] or "" for r in rows}
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    for r in got:
        want = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, list(r.token_ids)) == (at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += r.n_tokens
    assert spark.read.parquet(folder).count() > 10


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenfile.read(spark, tokenfile.write(docs)).count() == 0


def test_the_library_gets_short_runs_of_pieces(monkeypatch):
    model, given = tokenfile.Library(vocabulary_path()), []
    plain = model.tokens

    class Seen:
        def __getattr__(self, name):
            return getattr(plain, name)

        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **kw)

    model.tokens = Seen()
    texts = [" ".join(f"w{i}.\nÄ{j}日" for i in range(700)) for j in range(3)] + [None, "", " a", "x  y \n z", "the <|endoftext|> of"]
    for _ in range(2):
        got = model.encode(texts)
        assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    # long texts take the library half as long again for the same pieces
    assert max(t.count(" ") for t in given) <= 64


def test_chosen_pairs_of_one_hash_are_told_apart():
    # two pairs that are frequent alike and have one hash
    width = 60_001
    pairs = np.arange(1, 60_000, dtype=np.uint32)
    marks = tokenfile._mark(np.uint32(7) * np.uint32(width) + pairs)
    by, first = {}, None
    for p, m in zip(pairs.tolist(), marks.tolist()):
        if m in by:
            first = (by[m], p)
            break
        by[m] = p
    assert first
    once = iter(range(60_000, 59_800, -1))
    ids = np.array([x for _ in range(40) for p in first for x in (7, p, next(once))], np.uint32)
    symbols, rules, _, base = tokenfile.compress(ids, np.array([0, len(ids)]))
    assert base == width and np.array_equal(tokenfile.expand(symbols, rules, base), ids) and len(symbols) == 160
    assert {(7, p) for p in first} == {tuple(r) for r in rules.tolist()}

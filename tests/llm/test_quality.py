"""Base counts against plain Python, measures against the libraries, and the verdict."""

import math
import random
import re
from collections import Counter

import pytest
import sentencepiece

from pagewright.llm import quality
from pagewright.llm.bpe import vocabulary_path

PARTS = ["the", "of", "é", "日本", "#", "a|b", "\n", "\n\n", " ", "line one\n", "x y z w v u t s ", "\x1c", " ", "1 2 3 4 5 6 7 8 9 ", "%"]


def _plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counts(spark):
    pick = random.Random(8)
    rows = [(i, " ".join(pick.choices(PARTS, k=pick.randint(0, 60))), True) for i in range(600)]
    rows += [(None, None, None), (700, "", None), (701, "a b c d e f g h i " * 10_000, None), (702, "w" * 200_000, None), (702, "w" * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean")
    got, texts = quality.rate(docs).collect(), {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _plain(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    assert quality.rate(docs.limit(0)).count() == 0


def test_measures():
    model = quality.vocabularies(vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_50k.tiktoken"))
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    texts = ["the quick brown fox", "日本語 ᚠᚢᚦ word", "", "а и б", "same same same"]
    m = quality.measures([t.encode() for t in texts], model)
    for i, t in enumerate(texts):
        ids = [p for w in t.split() for p in library.encode(w)]
        assert m["n_pieces"][i] == len(ids)
        if ids:
            assert m["chars_per_piece"][i] == pytest.approx(sum(map(len, t.split())) / len(ids))
            assert m["fallback_share"][i] == pytest.approx(sum(map(library.is_byte, ids)) / len(ids))
            assert m["token_entropy"][i] == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values()))
    assert [quality.SCRIPTS[s] for s in m["script"]] == ["latin", "latin", "none", "cyrillic", "latin"]


def test_slice_of_few_words():
    model = quality.vocabularies(vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_50k.tiktoken"))
    for k in range(10):
        m = quality.measures([" ".join("abcdefghi"[:k]).encode()], model)
        assert m["n_words"].tolist() == [k] and m["n_repeat_words"].tolist() == [0]


def test_verdict(spark):
    good = "The engine reads the table, counts what it finds there, and writes one short row for each of the documents that it was given today."
    rows = [(1, good), (2, " ".join(w + "%%%" for w in good.split())), (3, " ".join(["stutter"] * 7 + ["of"] * 7 + ["thing"] * 8)), (4, "ᚠᚢᚦᚨᚱᚲ " * 5 + " ".join(f"ᚠ{i}ᚢᚦ" for i in range(40))),
            (5, "Быстрая бурая лиса прыгает через ленивую собаку, а собака спит и видит во сне реку, лес, поле, дорогу, дом и старый сад у воды.")]
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5)] == [True, False, False, False, True]


def test_labelled_documents(spark):
    """Most documents with a good label stay, most others go."""
    folder = "/root/testdata/sf0.01"
    rated = quality.rate(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = rated.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept", "n_words").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.n_words >= 20]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)

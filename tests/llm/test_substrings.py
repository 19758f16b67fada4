"""Removed words against plain counting of windows, the index against plain search, and odd rows."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import substrings
from pagewright.llm.fmindex import FmIndex


def _brute(rows, window):
    places = Counter()
    texts = [(t or "").encode().split() for _, t in rows]
    for w in texts:
        places.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for (name, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if places[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((name, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def _rows(seed, words=60):
    pick = random.Random(seed)
    word = [f"w{i}" for i in range(words)]
    passages = [pick.choices(word, k=pick.choice([20, 34, 35, 36, 50, 90])) for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(pick.randint(0, 5)):
            text += pick.choices(word, k=pick.choice([0, 1, 5, 40])) if pick.random() < 0.6 else pick.choice(passages)
        if pick.random() < 0.1 and rows:
            text = list((rows[-1][1] or "").split())
            if text:
                text[pick.randrange(len(text))] = "edit"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("many, shard", [(8192, 400_000), (3, 400_000), (8192, 60)])
def test_removed_words(spark, monkeypatch, many, shard):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rows = _rows(many % 7 + shard % 11)
    rows += [(500, "a " * 300), (501, "a b " * 100), (502, "a " * 20), (None, None), (None, "null id " * 30), (503, ""), (504, rows[4][1]), (504, rows[4][1]), (505, "x" * 100_000)]
    line = " ".join(f"line{i}" for i in range(30))
    rows += [(600 + i, f"u{i} v{i} w{i} {line} x{i} y{i} z{i} t{i % 2} s{i}") for i in range(30)]  # a line in varied surroundings
    rows += [(700 + i, f"p{i // 2} q r {line} s t {i // 2} q{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(docs).collect()), key=str)
    want = _brute(rows, 35)
    assert any(0 < r[2] < r[1] for r in want)
    assert got == want


def test_index_counts_and_matches():
    draw = np.random.default_rng(3)
    texts = [draw.integers(1, 4, draw.integers(1, 40)) for _ in range(60)] + [np.full(30, 7)]
    flat = np.concatenate([np.append(t, 0) for t in texts]).astype(np.int64)
    index = FmIndex(flat, 12)
    data = flat.tolist()

    def often(pattern):
        return sum(data[i : i + len(pattern)] == pattern for i in range(len(data)))

    for _ in range(200):
        pattern = draw.integers(1, 5, draw.integers(1, 11)).tolist()
        low, high = np.array([0]), np.array([len(data)])
        for symbol in reversed(pattern):
            if symbol > 3:
                break
            low, high = index.step(np.array([symbol]), low, high)
        else:
            assert high[0] - low[0] == often(pattern)
    ends = np.flatnonzero(flat > 0)[::7] + 1
    for end, n in zip(ends.tolist(), index.matches(flat, ends, 10).tolist()):
        assert n == 0 or often(data[end - n : end]) >= 2
        assert n == 10 or end - n == 0 or data[end - n - 1] == 0 or often(data[end - n - 1 : end]) < 2


def test_empty(spark):
    assert substrings.digest(spark.createDataFrame([], "doc_id bigint, text string, spans int")).count() == 0


def test_many_equal_rows(spark):
    """20,000 rows of one text with null ids, and one row apart: the work follows the rows, not their square."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.lit("x").alias("kept"))
    rows = rows.union(spark.createDataFrame([(7, "alone " * 3, "y")], rows.schema)).repartition(8)
    began = time.time()
    got = substrings.deduplicate(rows).groupBy("doc_id", "n_words", "n_removed", "kept").count().collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept, r["count"]) for r in got) == [(0, 300, 300, "", 20_000), (7, 3, 0, "alone alone alone", 1)]
    assert time.time() - began < 120

"""Against plain counting: border failures and further passes, pieces, containment, odd rows, large products."""

import re
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import collocations

DOCS = "doc_id bigint, text string, lang string, rank string, n string"


def _brute(rows, longest=3, least=10, top=2000, contained=50):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + size])) for i in range(len(words) - size + 1))
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in total:
        kept = []
        for (x, words), a in found.items():
            if x != lang:
                continue
            score, k = min((1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words)))
            inside = any(y == lang and len(w) > len(words) and 100 * b >= contained * a and any(w[i:i + len(words)] == words for i in range(len(w)))
                         for (y, w), b in found.items())
            if not inside:
                kept.append((score, a, " ".join(words), counts[lang, words[:k]], counts[lang, words[k:]]))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, le, r, total[lang], s) for i, (s, a, p, le, r) in enumerate(kept[:top])]
    return sorted(out)


def _mine(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return sorted(tuple(r) for r in collocations.mine(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _rows(seed=4, n=1500):
    draw = np.random.default_rng(seed)
    words = np.array(["the", "Of", "river", "bank", "éa", "New", "york", "city", "x", "\U0001d11e"])
    gaps = np.array([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " "])
    rows = []
    for i in range(n):
        k = int(draw.integers(0, 14))
        text = "".join(w + g for w, g in zip(draw.choice(words, k, p=[0.2, 0.15, 0.1, 0.1, 0.1, 0.1, 0.1, 0.09, 0.05, 0.01]), draw.choice(gaps, k)))
        rows.append((i, text, ["en", "fr", None, "und"][i % 4], "r", "n"))
    return rows + [(None, None, None, None, None), (1, "", "en", None, None), (None, "new york city " * 40, "xx", None, None), *[(5, "a b", "yy", None, None)] * 12]


def test_brute_force(spark):
    rows = _rows()
    got = _mine(spark, rows)
    assert got == _brute(rows) and len(got) > 50
    assert _mine(spark, rows, longest=4, least=3, top=5, contained=30) == _brute(rows, 4, 3, 5, 30)


def test_failures_of_the_border(spark, monkeypatch):
    """A sample that holds next to nothing: further passes find what it missed."""
    rows = _rows(9, 400)
    real = collocations.counts
    passes = []

    def counted(docs, longest, least, bits=None, fresh=None):
        if bits is None:
            docs = docs.limit(0)
        else:
            passes.append(fresh is not None)
        return real(docs, longest, least, bits, fresh)

    monkeypatch.setattr(collocations, "counts", counted)
    assert _mine(spark, rows) == _brute(rows)
    assert passes == [False, True, True]


def test_full_map(spark, monkeypatch):
    """A map that says yes to everything makes a pass count more, and nothing else."""
    rows = _rows(2, 400)
    monkeypatch.setattr(collocations, "holds", lambda bits, keys: np.ones(len(keys), bool))
    assert _mine(spark, rows) == _brute(rows)


def test_long_text_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    rows = [(1, "one two three. " * 30_000, "en", None, None), (2, "two three one! " * 20, "en", None, None)]
    assert _mine(spark, rows) == _brute(rows)


def test_products_past_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", 0, "", 4 * big), ("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, size tinyint, phrase string, n bigint")).collect()
    assert [(r.score, r.a, r.l, r.r, r.n) for r in got] == [(1000000 * big * big // ((big + 7) * (big + 9)), big, big + 7, big + 9, 4 * big)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(1, " ., ", "en", None, None)]])
def test_nothing(spark, rows):
    assert _mine(spark, rows) == []

"""The join against all pairs of small tables, blocks, hot groups and odd rows."""

import random

import numpy as np
import pytest

from pagewright.llm import jaccard
from pagewright.llm.components import components


def _brute(rows, n=5, threshold=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().split()
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    top = 1 << 62
    label = [r[0] if r[0] is not None else top for r in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    return sorted(((r[0], None if x == top else x, len(k)) for r, x, k in zip(rows, label, links)), key=str)


def _rows(seed):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(40):
        base = pick.choices(words, k=pick.choice([1, 3, 5, 8, 40, 120, 300]))
        for _ in range(pick.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 6])):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            rows.append((at, pick.choice([" ", "  ", "\n"]).join(copy)))
            at += pick.choice([1, 2])
    return rows


def _got(spark, rows, **how):
    out = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), **how).collect()
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str)


@pytest.mark.parametrize("block", [256, 3])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    pick = random.Random(1)
    rows = _rows(block)
    hot = pick.choices([f"w{i}" for i in range(300)], k=150)
    for i in range(40):  # a large group of near copies, and one of copies
        copy = list(hot)
        copy[pick.randrange(150)] = f"x{i}"
        rows.append((5000 + i, " ".join(copy)))
    rows += [(6000 + i, "the very same words again and again in each one of these rows") for i in range(60)]
    rows += [(None, "the very same words again and again in each one of these rows"), (None, "a null id alone here now"), (7000, None), (7001, ""), (7002, " \n"), (7003, "\x85"), (7003, "\x85")]
    assert _got(spark, rows) == _brute(rows)


def test_one_of_each(spark):
    rows = [(i, t, n) for n, (i, t) in enumerate(_rows(9))] + [(7000, None, 1), (7000, None, 2), (7001, "twice the same row of words", 5), (7001, "twice the same row of words", 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _n int")
    got = jaccard.one_of_each(docs).collect()
    assert jaccard.one_of_each(docs).columns == docs.columns
    assert sorted(r.doc_id for r in got) == sorted([x for x in {c for _, c, _ in _brute([r[:2] for r in rows])} if x != 7000] + [7000, 7000])
    assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}


def test_all_shared_grams_count():
    for n in (1, 2, jaccard.COLUMNS, jaccard.COLUMNS + 1, 2 * jaccard.COLUMNS, 2 * jaccard.COLUMNS + 1):
        x = jaccard.mix(np.arange(n, dtype=np.uint64))
        # the pair is at the threshold, and below it without any one of its common n-grams
        good = jaccard.similar([x, np.append(x, np.arange(n // 4, dtype=np.uint64) + np.uint64(7))], n / (n + n // 4))
        assert good[0, 1] and good[1, 0], n


def test_repeated_word(spark):
    rows = [(1, " ".join(["again"] * 6)), (2, " ".join(["again"] * 7)), (3, " ".join(["other"] * 9)), (4, " ".join(["again"] * 30))]
    assert _got(spark, rows) == _brute(rows) == [(1, 1, 2), (2, 1, 2), (3, 3, 0), (4, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [1, 3]


def test_slice_of_few_words():
    seen = set()
    for k in range(1, 10):
        hashes, ends, counts = jaccard.shingles([" ".join("abcdefghi"[:k]).encode()])
        assert counts.tolist() == [k] and ends.tolist() == [len(hashes)] == [max(1, k - 4)]
        seen.add(int(hashes[0]))
        both = jaccard.shingles([" ".join("abcdefghi"[:k]).encode(), b"z z z z z z z z z"])[0]
        assert np.array_equal(both[: len(hashes)], hashes)
    assert len(seen) == 5


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, class_id int")
    assert jaccard.join(docs).count() == 0 and jaccard.one_of_each(docs).count() == 0


def test_recall_of_bands():
    bands = jaccard.bands_for()
    assert 1 - (1 - 0.8**jaccard.ROWS) ** bands >= jaccard.RECALL
    draw, met = np.random.default_rng(0), 0
    for _ in range(300):  # pairs of sets at the threshold
        x = draw.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = x[:170], np.concatenate([x[:150], x[170:]])  # 150 of 180 -> 0.83
        made = jaccard.band_hashes(jaccard.mix(np.concatenate([a, b])), np.array([len(a), len(a) + len(b)]), bands)
        met += bool((made[0] == made[1]).any())
    assert met == 300


def test_components(spark):
    pick = random.Random(6)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, 5000)] + [(2000, 2001 + i) for i in range(100)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

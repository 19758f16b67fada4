"""Recall against brute force, copies and ties, odd vectors, and the curve itself."""

import numpy as np
import pytest

from pagewright.llm import neighbours
from pagewright.llm.hilbert import hilbert_keys

FOLDER = "/root/testdata/sf0.1"


def _brute(rows, asks, k=10):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)})
    out = []
    for q, v in good:
        if asks(q):
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))
            out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_table_is_exact(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(130)] + [(900 + i, [1.0, 0, 0, 0, 0, 0]) for i in range(3)] + [(1000 + i, draw.normal(size=3).tolist()) for i in range(4)]
    rows += [(400, None), (500, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (700, [float("inf")] + [1.0] * 5), (800, [None] + [1.0] * 5), (1100, []), (None, [1.0] * 6), rows[100], rows[100], (2000, [1e30] * 6)]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int").repartition(5)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.digest(table).collect())
    want = _brute(rows, lambda i: i % 100 == 0)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-14)


def test_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    ids, all_of = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    got = {}
    for r in neighbours.digest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 100 == 0].tolist():
        far = np.sqrt(((all_of - all_of[ids == q][0]) ** 2).sum(axis=1))
        far[ids == q] = np.inf
        want = ids[np.lexsort((ids, far))[:10]].tolist()
        mine = sorted(got[q])
        assert len(mine) == 10 and [s for _, _, s in mine] == [far[ids == i][0] for _, i, _ in mine] == sorted(s for _, _, s in mine)
        hit, total = hit + len(set(want) & {i for _, i, _ in mine}), total + 10
    assert hit >= 0.9 * total


def test_blocks_and_structure(spark, monkeypatch):
    """Windows over several blocks, and vectors with structure, for which windows are narrow."""
    monkeypatch.setattr(neighbours, "BLOCK", (16, 16))
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=3) @ np.eye(3, 20)).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.digest(table).collect()}
    want = {(q, i) for q, _, i, _ in _brute(rows, lambda i: i % 100 == 0)}
    assert len(got & want) >= 0.9 * len(want)


def test_empty(spark):
    assert neighbours.digest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0

"""Against a full comparison: ties, copies, odd vectors, huge numbers, many shards; and that bounds spare work."""

import math

import numpy as np
import pytest

from pagewright.llm import topk

ROWS = "vec_id bigint, embedding array<float>, rank int, score string"


def _brute(rows, asks, k=5):
    whole = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and all(math.isfinite(x) for x in v)})
    out = {}
    for q, v in whole:
        if asks(q):
            scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole if i != q and len(w) == len(v)]
            out.setdefault(q, []).extend(scores)
    return sorted((q, n + 1, i, -s) for q, x in out.items() for n, (s, i) in enumerate(sorted(x)[:k]))


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS).repartition(4)


def _floats(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def _got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    out = [(i, draw.normal(size=6).tolist()) for i in range(300)]
    out += [(400 + i, out[0][1]) for i in range(60)] + [(600 + i, draw.integers(-1, 2, size=6).tolist()) for i in range(120)] + [(1000 + i, draw.normal(size=3).tolist()) for i in range(4)]
    out += [(450, None), (550, [0.0] * 6), (650, [float("nan")] + [1.0] * 5), (700, [float("inf")] + [1.0] * 5), (750, [None] + [1.0] * 5), (850, []), (851, []), (None, [1.0] * 6),
            out[100], out[100], (-50, out[7][1]), (100, draw.normal(size=6).tolist()), (2000, [3e9] * 6), (2001, [3.0001e9] * 6), (2050, [-3e9] + [3e9] * 5), (2100, [1e30] * 6)]
    return [(i, _floats(v)) for i, v in out]


def test_all_answers(spark, rows):
    got = _got(topk.digest(_table(spark, rows)))
    assert got == _brute(rows, lambda i: i % 50 == 0) and len({g[0] for g in got}) > 15


def test_many_shards_and_steps(spark, rows, monkeypatch):
    for name, value in (("SHARD", 7), ("STEP", 1), ("PAIRS", 40), ("PIVOTS", 5), ("SAMPLE", 30)):
        monkeypatch.setattr(topk, name, value)
    assert _got(topk.search(_table(spark, rows), _table(spark, rows).filter("vec_id % 50 = 0"), 3)) == _brute(rows, lambda i: i % 50 == 0, 3)


def test_no_pivots_for_a_width(spark, monkeypatch):
    """Widths that the sample has none of are compared without bounds."""
    monkeypatch.setattr(topk, "SAMPLE", 1)
    rows = [(i, [float(i % 7), 1.0][: 1 + i % 2] + [0.5]) for i in range(80)]
    assert _got(topk.digest(_table(spark, rows))) == _brute(rows, lambda i: i % 50 == 0)


def test_bounds_spare_work(spark):
    """Vectors in groups: whole cells are passed over, and in the others evaluation stops early."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(20, 16)) * 3
    rows = [(i, _floats((centres[i % 20] + draw.normal(size=16) * 0.02).tolist())) for i in range(2000)]
    found = topk.candidates(topk.integers(_table(spark, rows)), 5).cache()
    plan = topk.Plan(found, 5)
    of = topk.cells(topk.pivot_table(found, plan))
    queries = topk.asked(topk.integers(_table(spark, rows[::50])).withColumnRenamed("vec_id", "query_id"), plan)
    assert topk.reachable(queries, of).count() < 0.5 * len(rows[::50]) * of.count()
    assert _got(topk.digest(_table(spark, rows))) == _brute(rows, lambda i: i % 50 == 0)


def test_early_stop():
    draw = np.random.default_rng(1)
    rows = np.floor(draw.normal(size=(500, 8)) * 100)
    scores, seen = rows @ rows[0], []
    real = topk._inner
    try:
        topk._inner = lambda r, q: seen.append(len(r)) or real(r, q)
        got = topk._evaluate(-1, rows[0], scores + 1.0, -np.inf, rows, [[i] for i in range(500)], np.zeros(500, bool), 5)
    finally:
        topk._inner = real
    assert got == sorted(((int(s), i) for i, s in enumerate(scores)), key=lambda t: (-t[0], t[1]))[:5] and sum(seen) < 200


@pytest.mark.parametrize("rows", [[], [(50, None)], [(50, [1.0])]])
def test_nothing(spark, rows):
    assert topk.digest(_table(spark, rows)).count() == 0

"""Targets, rates and repetition of sources."""

import random

import pytest

from pagewright.llm import mixing

ROWS = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 5 else "a", 1.0) for i in range(300)] + [
    (None, "one two", None, None), (900, None, "empty", 1.0), (901, "", "empty", 1.0), (902, " \t\n", None, 2.0), (902, " \t\n", None, 2.0),
    (903, "x" * 200_000, "é", 0.0), (904, "no break", "Z", 0.0),
]


def _docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, rate double")


def _levels(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return fixed | got
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def test_targets_and_copies(spark):
    out = mixing.plan(_docs(spark)).collect()
    assert len(out) == len(ROWS)
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = _levels(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + (rate > int(rate))) and r.taken == r.copies * r["size"] <= 2 * r["size"]
    for s in "abc":
        assert sum(r.taken for r in out if r.source == s) == pytest.approx(want[s], rel=0.05)
    again = mixing.plan(_docs(spark).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


@pytest.mark.parametrize("seed", range(4))
def test_targets_of_many_sources(spark, seed):
    pick = random.Random(seed)
    sizes = {f"s{i:02d}": pick.choice([1, 5, 40, 1000, pick.randint(1, 5000)]) for i in range(pick.choice([2, 9, 40]))}
    out = mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")).collect()
    want = _levels(sizes)
    assert {r.source: pytest.approx(r.target) for r in out} == want
    assert sum(r.target for r in out) == pytest.approx(1.5 * sum(sizes.values()))


def test_rows_are_emitted_as_planned(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the shuffle join
    docs = _docs(spark)
    want = {}
    for r in mixing.plan(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got = {}
    made = mixing.mix(docs)
    assert made.schema == docs.schema
    for r in made.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("name", [None, 7])
def test_rows_without_ids_of_their_own(spark, name):
    rows = [(name, f"text number {i} of a source", "abc"[i % 3], 1.0) for i in range(900)]
    out = mixing.plan(_docs(spark, rows)).collect()
    for s in "abc":
        assert sum(r.taken for r in out if r.source == s) == pytest.approx(next(r.target for r in out if r.source == s), rel=0.05)
    assert mixing.mix(_docs(spark, rows)).count() == sum(r.copies for r in out)


def test_empty(spark):
    assert mixing.plan(_docs(spark, [])).count() == 0 and mixing.mix(_docs(spark, [])).count() == 0

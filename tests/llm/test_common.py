"""Words, hashes and runs."""

import numpy as np
import pyarrow as pa

from pagewright.llm import common


def test_words_and_hashes():
    texts = [b"", b"one  two\tone", b" \n ", b"two", "é one two one".encode(), b"x" * 100_000 + b" one two one"]
    words = common.Words(texts)
    got = [[words.joined[a:b] for a, b in zip(words.starts[i:j], words.ends[i:j])] for i, j in zip(words.first, words.last)]
    assert got == [t.split() for t in texts] and words.counts.tolist() == [len(t.split()) for t in texts]
    hashes = words.hashes()
    flat = [w for g in got for w in g]
    assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    threes = common.grams(hashes, 3)
    assert threes[0] == threes[5] == threes[9] != threes[4] and words.left().tolist() == [3, 2, 1, 1, 4, 3, 2, 1, 4, 3, 2, 1]
    assert len(common.Words([]).starts) == 0 and len(common.Words([b""]).hashes()) == 0


def test_grams_of_few_words():
    for n in (1, 2, 3, 5, 8):
        for k in range(10):
            hashes = common.Words([b"a b c d e f g h i"[: max(0, 2 * k - 1)]]).hashes()
            longer = np.concatenate([hashes, common.Words([b"z " * n]).hashes()])
            assert len(hashes) == k and np.array_equal(common.grams(hashes, n)[: max(0, k - n + 1)], common.grams(longer, n)[: max(0, k - n + 1)])
            assert len(common.grams(hashes, n)) == k


def test_slices_and_runs():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n else None for n in (0, 3, 9, 30, 1, 2)])], ["text"])
    assert [x.num_rows for x in common.slices(batch, "text", 10)] == [2, 1, 1, 2]
    keys = pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2, 2, None, None, 3], pa.int64())], ["k"])
    parts = [keys.slice(i, 3) for i in range(0, 8, 3)] + [keys.slice(7, 1)]
    assert [(t.column("k")[0].as_py(), t.num_rows) for t in common.runs(parts, ["k"])] == [(1, 2), (2, 3), (None, 2), (3, 2)]
    assert len(np.unique(common.mix(np.arange(1000, dtype=np.uint64)))) == 1000

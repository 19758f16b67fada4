"""Helpers that the operators of this subpackage share: row keys, batches, words and rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import shared_folder

#: Bytes of text that a Python worker looks at together; a longer text is looked at alone.
SLICE_BYTES = 1_000_000

#: Odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts hold `most` bytes together, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each 64-bit value; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


POWERS = Powers(BASE)

_BYTE = np.arange(256)
#: Bytes between the words `[^\x20\x09-\x0D]+`.
BLANK = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))


class Words:
    """Words of some texts: where they start and end in `data`, and where the words of each text end.

    Texts are joined by a line break, which is no part of a word.
    """

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK) -> None:
        self.joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.joined, np.uint8)
        self.blank = blank[self.data]
        gap = np.concatenate([[True], self.blank])
        turns = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = turns[0::2], turns[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(lengths)
        self.text_starts = self.text_ends - lengths
        self.last = np.searchsorted(self.starts, self.text_ends)
        self.first = np.concatenate([[0], self.last[:-1]]).astype(np.int64) if len(texts) else self.last
        self.counts = self.last - self.first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = POWERS(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def left(self) -> np.ndarray:
        """For each word, how many words of its text start with it."""
        return np.repeat(self.last, self.counts) - np.arange(len(self.starts))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions near the end hold what is no n-gram."""
    out = hashes.copy()
    times = 1
    for j in range(1, min(n, len(hashes))):
        times = times * STEP % (1 << 64)
        out[: len(out) - j] += hashes[j:] * np.uint64(times)
    return mix(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches that are sorted by key; holds one key's rows, and one batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k)
            if n > 1:
                change[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def stored(df: DataFrame) -> DataFrame:
    """A table as it is once written to the shared folder: what follows reads it, and what led to it is not done again."""
    folder = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_row_key(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`row_key` of a row beside some of its columns; the same when a part of the job runs again."""
    return docs.select(F.monotonically_increasing_id().alias("row_key"), *columns)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"):
    """For mapInArrow: `fn` over runs of rows of bounded size."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield fn(part)

    return run

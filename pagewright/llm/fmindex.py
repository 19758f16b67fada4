"""A full-text index in little space over a sequence of numbers, searched backwards.

The Burrows-Wheeler transform is kept as a wavelet matrix of packed bits with a count for each 64 of them. The suffixes are
sorted by their first `depth` symbols, which is all that patterns shorter than that can tell apart.
"""

from __future__ import annotations

import numpy as np


class _Bits:
    """Bits, and how many are set before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])
        self.zeros = n - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    """Index over symbols from 1 on; 0 separates texts and is in no pattern."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        n = len(symbols)
        top = int(symbols.max()) if n else 0
        rank, reach = symbols.astype(np.int64), 1
        while reach < depth and n:
            later = np.zeros(n, np.int64)
            later[: max(0, n - reach)] = rank[reach:] + 1
            each, rank = np.unique(rank * np.int64(max(n, top) + 2) + later, return_inverse=True)
            reach *= 2
            if len(each) == n:
                break
        order = np.argsort(rank, kind="stable")
        turned = symbols[order - 1]
        self.n, self.depth = n, depth
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))]).astype(np.int64)
        self.levels = []
        for level in range(max(1, top.bit_length()) - 1, -1, -1):
            bit = ((turned >> level) & 1).astype(bool)
            self.levels.append((level, _Bits(bit)))
            turned = np.concatenate([turned[~bit], turned[bit]])
        # where each symbol's run starts on the last level
        self.first = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of patterns, each with one symbol put before it."""
        base = self.before[symbol] - self.first[symbol]
        return base + self._down(symbol, low), base + self._down(symbol, high)

    def matches(self, symbols: np.ndarray, ends: np.ndarray, most: int, least: int = 2) -> np.ndarray:
        """For each end in `symbols`, the longest stretch (`most` at best) before it that is found `least` times.

        symbols: the texts whose stretches are searched, with 0 between them.
        """
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        for k in range(most):
            symbol = symbols[ends[live] - 1 - k]
            low, high = self.step(symbol, low, high)
            good = (high - low >= least) & (symbol > 0)
            live, low, high = live[good], low[good], high[good]
            if not len(live):
                break
            length[live] += 1
        return length

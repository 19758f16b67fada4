"""Byte-pair encoding by speculation: a greedy longest match proposes tokens, all pairs of neighbours are checked.

A row of tokens is what merging by rank would give if each token is what merging gives for its own bytes, and each pair of
neighbours stays apart when merged alone. Both follow from the merges: the pieces on either side of the border that stand
there at some time are the right edge of one token's tree and the left edge of the other's. The pair is at odds if two such
pieces have a merge that comes before either of them is merged inwards (with equal rank, the left one comes first).
Words that hold a pair at odds are merged exactly.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import slices

#: Fixed value: how byte-level encodings cut texts into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces and words that a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Pairs of tokens that a worker remembers before it starts anew.
REMEMBERED_PAIRS = 2_000_000

#: More than any rank.
LATER = np.int64(1) << 40
_LATER = int(LATER)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, which every machine has with its Python packages."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Numbers for keys, in the order in which they came; new ones are listed."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class BytePairs:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.ids: dict[bytes, int] = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        merged = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.size = max(self.bytes_of) + 1
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.made = np.full(self.size, LATER)  # rank of the merge that makes a token
        for rank, (a, b, t) in enumerate(merged):
            if self.made[t] == LATER:
                self.left[t], self.right[t], self.made[t] = a, b, rank
        self.rank_of = {a * self.size + b: rank for rank, (a, b, _) in enumerate(merged)}
        self.token_of = [t for _, _, t in merged]
        keys = np.fromiter(self.rank_of, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.own = self._stands_alone()
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile(r" (?=\S)")
        self.odd = regex.compile(r" (?!\S)")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()
        self.pairs, self.fits = np.empty(0, np.int64), np.empty(0, bool)
        self.checked = self.merged = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], LATER)

    def at_odds(self, a: np.ndarray, b: np.ndarray, whole: bool = False) -> np.ndarray:
        """Whether tokens a and b side by side would be merged across their border; whole: leave out the two themselves."""
        bad = np.zeros(len(a), bool)
        live = np.arange(len(a))
        x, until_x = a.copy(), np.full(len(a), LATER)
        top = True
        while len(live):
            y, until_y, inner = b[live], np.full(len(live), LATER), np.arange(len(live))
            while len(inner):
                m = self._rank(x[inner], y)
                hit = (m < until_x[inner]) & (m <= until_y) & (m < LATER)
                if not (whole and top):
                    bad[live[inner[hit]]] = True
                top = False
                until_y, y = self.made[y], self.left[y]
                keep = y >= 0
                inner, y, until_y = inner[keep], y[keep], until_y[keep]
            until_x, x = self.made[x], self.right[x]
            keep = (x >= 0) & ~bad[live]
            live, x, until_x = live[keep], x[keep], until_x[keep]
        return bad

    def _stands_alone(self) -> np.ndarray:
        """Whether merging the bytes of a token gives the token."""
        made = np.flatnonzero(self.made < LATER)
        own = np.ones(self.size, bool)
        own[made] = ~self.at_odds(self.left[made], self.right[made], whole=True)
        for t in made[np.argsort(self.made[made])].tolist():
            own[t] &= own[self.left[t]] and own[self.right[t]]
        return own

    def forget(self) -> None:
        """Drop what is remembered of pieces and words, as at the end of a part of the table."""
        self.pieces, self.known = Memo(), {}
        self.flat, self.offsets = array("I"), array("q", [0])
        for text, i in self.special.items():
            self.pieces[text] = len(self.pieces)
            self.flat.append(i)
            self.offsets.append(len(self.flat))

    def exact(self, word: bytes) -> tuple[int, ...]:
        """Merge by rank, the leftmost of equal ones first."""
        if len(word) > 100:
            return self._exact_long(word)
        rank, made, size = self.rank_of, self.token_of, self.size
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        ranks = [rank.get(a * size + b, _LATER) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == _LATER:
                break
            i = ranks.index(low)
            parts[i : i + 2] = (made[low],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] * size + parts[i], _LATER)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] * size + parts[i + 1], _LATER)
        return tuple(parts)

    def _exact_long(self, word: bytes) -> tuple[int, ...]:
        """The same with a heap, so that n bytes take n log n steps."""
        rank, made, size = self.rank_of, self.token_of, self.size
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = made[low], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := rank.get(parts[p] * size + parts[q])) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return tuple(x for x in parts if x >= 0)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            to = min(n, at + longest.get(word[at : at + 2], 1))
            while (found := ids.get(word[at:to])) is None:
                to -= 1
            out.append(found)
            at = to
        return out

    def _fit(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (one number) of neighbours fits; what was found before is remembered."""
        each, back = np.unique(pairs, return_inverse=True)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, each), len(self.pairs) - 1)
            fresh = each[self.pairs[at] != each]
        else:
            fresh = each
        if len(fresh):
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs, self.fits, fresh = np.empty(0, np.int64), np.empty(0, bool), each
            good = ~self.at_odds(fresh // self.size, fresh % self.size)
            where = np.searchsorted(self.pairs, fresh)
            self.pairs, self.fits = np.insert(self.pairs, where, fresh), np.insert(self.fits, where, good)
        return self.fits[np.searchsorted(self.pairs, each)][back]

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Tokens of each word: proposed, checked in one go, and merged exactly where they fail."""
        guesses = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(words)), counts)
        fails = np.zeros(len(words), bool)
        fails[of[~self.own[flat]]] = True
        inside = np.flatnonzero(of[1:] == of[:-1])
        if len(inside):
            fails[of[inside[~self._fit(flat[inside] * self.size + flat[inside + 1])]]] = True
        self.checked += len(words)
        self.merged += int(fails.sum())
        return [self.exact(w) if bad else tuple(g) for w, g, bad in zip(words, guesses, fails.tolist())]

    def _learn(self) -> None:
        """Tokens of the pieces that are new."""
        new, self.pieces.new = self.pieces.new, []
        # a piece stands after a space; one that starts with a space is the first of its text, without it
        cut = [self.words.findall(p[1:] if p[:1] == " " else " " + p) for p in new]
        fresh = list(dict.fromkeys(w for c in cut for w in c if w not in self.known))
        self.known.update(zip(fresh, self.encode_words([w.encode() for w in fresh])))
        for c in cut:
            for w in c:
                self.flat.extend(self.known[w])
            self.offsets.append(len(self.flat))

    def _split(self, text: str) -> list[str]:
        """Pieces that are cut into words independently: a space before what is no white space always starts a word."""
        parts = self.cut.split(text) if self.odd.search(text) else text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if self.specials is None or not any(s in text for s in self.special):
            return self._split(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part:
                out += [part] if part in self.special else self._split(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        if len(self.pieces) > REMEMBERED:
            self.forget()
        cut = [self._pieces(t or "") for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.pieces.new:
            self._learn()
        offsets, flat = np.frombuffer(self.offsets, np.int64), np.frombuffer(self.flat, np.uint32)
        first, counts = offsets[which], offsets[which + 1] - offsets[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])
        bounds = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> BytePairs:
    """One encoder for a worker; it lives as long as the worker."""
    return BytePairs(path)


def _replacing(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.drop(*names)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All columns of `docs`, with `token_ids` array<int> and `n_tokens` bigint.

    Null and empty texts have no tokens. Text that equals a special token is that token, as in the vocabulary's own
    library. Columns of these two names are replaced; repeated rows are encoded alike; an empty table stays empty.
    Rows stay where they are: nothing is shuffled, and a worker holds a few MB of text at a time.
    """
    path = path or vocabulary_path()
    docs = _replacing(docs, ["token_ids", "n_tokens"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in slices(batch, text):
                ids, counts = model.encode(part.column(text).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(counts)], [*names, "token_ids", "n_tokens"])
        model.forget()

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("array<int>").alias("token_ids"), F.lit(None).cast("bigint").alias("n_tokens")).schema)


def decode(docs: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """All columns of `docs`, with `decoded` string; no ids give an empty text, and bytes that are no UTF-8 U+FFFD."""
    path = path or vocabulary_path()
    docs = _replacing(docs, ["decoded"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("string").alias("decoded")).schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, and the SHA-256 of its ids (little-endian, 32 bits) and of what they decode to.

    Encodes and decodes in the same pass, so that ids are neither shuffled nor sent back to the JVM.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = model.encode(part.column("text").to_pylist())
                each = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(counts),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in each]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.forget()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

"""Phrase collocations by Toivonen's sampling: a sample proposes, full passes count the proposals and their negative border.

A part of a phrase occurs at least as often as the phrase. So of a sample's frequent phrases, the negative border are those
phrases that aren't among them while both their parts of one word less are (single words have no parts: all of them count).
1. A sample of the documents, at a lowered threshold, proposes phrases that may be parts of longer ones.
2. A full pass counts all phrases whose parts were proposed: the proposals and their border.
3. Phrases of the border that turn out frequent are failures: they are parts of phrases not counted yet. A further pass counts
   just those, and so on until nothing fails.

Proposals are kept in a bit map of fixed size. It may say yes too often, never no; then a pass counts more than it must. Passes
count hashes of (lang, words); what is frequent among these is a superset of what is frequent, and closed. A last pass counts the
phrases themselves, as strings, wherever their hash is in it, so results don't rest on hashes being unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Words, grams, mix, slices, stored

#: Words of a phrase, occurrences that it needs, and phrases of a language that are returned.
LONGEST = 3
LEAST = 10
TOP = 2000
#: A longer phrase with this share of a phrase's occurrences stands for it, in hundredths.
CONTAINED = 50
#: Documents of the sample are one in so many; the threshold in it is a little below its share of LEAST.
SAMPLE = 4
#: The bit map's size (16 MB) and parts, and bits for a phrase: each is named by 19 bits of one 64-bit hash.
BITS = 1 << 27
PARTS = 256
PROBES = 3
WIDTH = 19
#: Hashes that a task counts together, and bytes of text that it looks at together.
HELD = 1 << 20
SLICE = 500_000
#: Rows that a task hands over together.
ROWS = 1 << 16

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_BLANK = _SEPARATOR.copy()
_BLANK[list(b"\x20\x09")] = True
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


class Phrases:
    """Hashes of all phrases of some texts, by number of words; a phrase's words lie in one piece of one text."""

    def __init__(self, texts: list[bytes], langs: list[str], longest: int) -> None:
        self.words = Words([self.spaced(t.translate(_LOWER)) for t in texts], _BLANK)
        w = self.words
        known = {x: mix(np.frombuffer((hash_of(x)).to_bytes(8, "little"), np.uint64))[0] for x in set(langs)}
        own = np.repeat(np.array([known[x] for x in langs], np.uint64), w.counts)
        base = w.hashes() ^ own
        marks = np.concatenate([[0], np.cumsum(_SEPARATOR[w.data])])
        n = len(base)
        # texts are joined by a line break, which parts pieces too
        joined = marks[w.starts[1:]] == marks[w.ends[:-1]] if n else np.zeros(0, bool)
        self.keys, self.valid = [], []
        whole = np.ones(n, bool)
        for size in range(1, longest + 1):
            if size > 1:
                whole = whole.copy()
                whole[max(0, n - size + 1):] = False
                if n >= size:
                    whole[: n - size + 1] &= joined[size - 2:]
            self.keys.append(grams(base, size) if n else base)
            self.valid.append(whole)

    @staticmethod
    def spaced(text: bytes) -> bytes:
        """One space between words, so that a phrase is a stretch of the text."""
        text = text.replace(b"\t", b" ")
        while b"  " in text:
            text = text.replace(b"  ", b" ")
        return text

    def texts(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, one behind the other, and lengths of the phrases from some words on."""
        a, b = self.words.starts[at], self.words.ends[at + size - 1]
        lengths = b - a
        before = np.cumsum(lengths) - lengths
        return self.words.data[np.arange(lengths.sum()) + np.repeat(a - before, lengths)], lengths


def hash_of(name: str) -> int:
    """A 64-bit number for a name."""
    out = 0xCBF29CE484222325
    for byte in name.encode("utf-8", "surrogatepass"):
        out = (out ^ byte) * 0x100000001B3 % (1 << 64)
    return out


def _probes(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Bits of each key, all within the key's part of the map."""
    part = (keys >> np.uint64(56)) << np.uint64(WIDTH)
    again = mix(keys + np.uint64(0x9E3779B97F4A7C15))
    for j in range(PROBES):
        yield part + (again >> np.uint64(j * WIDTH) & np.uint64((1 << WIDTH) - 1))


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _probes(keys):
        found &= (bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).view(bool)
        if not found.any():
            break
    return found


def bit_map(keys: DataFrame) -> np.ndarray:
    """The map of a column `key`. Keys of a part meet in one task; the driver gets the parts, 16 MB in all at most."""
    size = BITS // PARTS // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column("key").to_numpy().view(np.uint64)
            for at in _probes(x):
                parts = at >> np.uint64(WIDTH)
                for part in np.unique(parts).tolist():
                    inside = at[parts == part] & np.uint64((1 << WIDTH) - 1)
                    bits = held.setdefault(part, np.zeros(size, np.uint8))
                    np.bitwise_or.at(bits, (inside >> np.uint64(3)).astype(np.int64), np.left_shift(1, inside & np.uint64(7)).astype(np.uint8))
        for part, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in keys.repartition(F.shiftrightunsigned("key", 56)).mapInArrow(fill, "part int, bits binary").collect():
        out[r["part"] * size:(r["part"] + 1) * size] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _counted(pieces: Phrases, bits: np.ndarray | None, fresh: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, hashes) that a pass counts: phrases whose parts are in `bits` and, if given, at least one in `fresh`.

    bits None: all. fresh None: nothing was counted before, so single words are counted, too.
    """
    inside = new = None
    for size, (keys, valid) in enumerate(zip(pieces.keys, pieces.valid), 1):
        if size == 1:
            take = np.flatnonzero(valid) if fresh is None else np.zeros(0, np.int64)
        else:
            at = np.flatnonzero(valid)
            if fresh is not None:
                at = at[new[at] | new[at + 1]]
            take = at if bits is None else at[inside[at] & inside[at + 1]]
        yield size, keys[take]
        if size == len(pieces.keys):
            return
        new = holds(fresh, keys) if fresh is not None else None
        if bits is not None:
            need = np.ones(len(keys), bool)
            if fresh is not None:  # only neighbours of what is new
                need = new.copy()
                need[:-1] |= new[1:]
                need[1:] |= new[:-1]
            inside = np.zeros(len(keys), bool)
            inside[need] = holds(bits, keys[need])


def counts(docs: DataFrame, longest: int, least: int, bits=None, fresh=None) -> DataFrame:
    """size, key, n: phrases found `least` times or more of those that a pass counts. bits, fresh: broadcast maps or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for size in list(held):
                found, n = np.unique(np.concatenate(held.pop(size)), return_counts=True)
                for a in range(0, len(found), ROWS):
                    keys, times = found[a:a + ROWS], n[a:a + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int8)), pa.array(keys.view(np.int64)), pa.array(times)], ["size", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts, langs = part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist()
                pieces = Phrases(texts, langs, longest)
                for size, keys in _counted(pieces, bits and bits.value, fresh and fresh.value):
                    if len(keys):
                        held.setdefault(size, []).append(keys)
                        many += len(keys)
                if many >= HELD:
                    yield from flush()
                    many = 0
        yield from flush()

    found = docs.mapInArrow(run, "size tinyint, key bigint, n bigint")
    return found.groupBy("size", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def missing(keys: DataFrame, bits) -> DataFrame:
    """The keys that are not in a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~holds(bits.value, batch.column("key").to_numpy().view(np.uint64))))

    return keys.select("key").mapInArrow(run, "key bigint")


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SAMPLE) -> list[DataFrame]:
    """Stored tables (size, key, n), one for each full pass: together all phrases (by hash) found `least` times or more."""
    sc = docs.sparkSession.sparkContext
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    proposed = counts(sample, longest - 1, max(1, least // share)) if longest > 1 else None
    bits, new = bit_map(proposed.select("key")) if proposed is not None else np.zeros(BITS // 8, np.uint8), None
    passes = []
    while True:
        now, fresh = sc.broadcast(bits), None if new is None else sc.broadcast(new)
        passes.append(stored(counts(docs, longest, least, now, fresh)))
        failed = stored(missing(passes[-1].filter(F.col("size") < longest), now))
        for x in (now, fresh):
            if x is not None:
                x.unpersist()
        if failed.isEmpty():
            return passes
        new = bit_map(failed)
        bits = bits | new


def exact(docs: DataFrame, passes: list[DataFrame], longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, n: frequent phrases, counted as strings; size 0 has the number of words of each lang."""
    all_keys = passes[0].select("key")
    for x in passes[1:]:
        all_keys = all_keys.union(x.select("key"))
    known = docs.sparkSession.sparkContext.broadcast(bit_map(all_keys))

    names = ["lang", "size", "phrase", "n"]

    def totals(pieces: Phrases, langs: list[str]) -> pa.RecordBatch:
        n = len(langs)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.zeros(n, np.int8)), pa.array([""] * n, pa.string()), pa.array(pieces.words.counts)], names)

    def rows(held: list[tuple], size: int) -> Iterator[pa.RecordBatch]:
        """Each phrase once for what is held, with its text from where it was found first."""
        keys, starts = [keys for _, _, keys, _ in held], np.cumsum([0] + [len(keys) for _, _, keys, _ in held])
        _, first, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
        for (pieces, langs, _, at), a, b in zip(held, starts, starts[1:]):
            mine = np.flatnonzero((first >= a) & (first < b))
            at = at[first[mine] - a]
            data, lengths = pieces.texts(at, size)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            phrase = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
            of = np.searchsorted(pieces.words.last, at, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(of)), pa.array(np.full(len(at), size, np.int8)), phrase, pa.array(n[mine])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in range(longest)]
        many = 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                langs = part.column("lang").to_pylist()
                pieces = Phrases(part.column("text").cast(pa.binary()).to_pylist(), langs, longest)
                yield totals(pieces, langs)
                for size, (keys, valid) in enumerate(zip(pieces.keys, pieces.valid), 1):
                    at = np.flatnonzero(valid)
                    at = at[holds(known.value, keys[at])]
                    held[size - 1].append((pieces, langs, keys[at], at))
                    many += len(at)
                pieces.keys = pieces.valid = None
                if many >= HELD:
                    for size, x in enumerate(held, 1):
                        yield from rows(x, size)
                        x.clear()
                    many = 0
        for size, x in enumerate(held, 1):
            if x:
                yield from rows(x, size)

    found = docs.mapInArrow(run, "lang string, size tinyint, phrase string, n bigint")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("size") == 0))


def scored(counted: DataFrame, longest: int = LONGEST, contained: int = CONTAINED) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words or more that no longer one stands for."""
    phrases = counted.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    part = lambda x, size: F.array_join(F.slice(words, x, size), " ")
    # every part of a cut is looked up by one join
    cuts = phrases.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "size", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("size").cast("int") - F.col("k")).alias("part")))).alias("s")).select("lang", "phrase", "size", "a", "k", "s.*")
    known = counted.filter(F.col("size").between(1, longest - 1)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("of"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("of")))
    both = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "size", "a", "k").agg(of("l").alias("l"), of("r").alias("r"))
    score = F.expr("(1000000bd * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = phrases.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size").cast("int") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size").cast("int") - n + 1), lambda i: part(i, n))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = lowest.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * contained))
    # one row for each language
    totals = counted.filter("size = 0").select("lang", "n")
    return free.join(F.broadcast(totals), "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", F.col("c.score").cast("bigint").alias("score"))


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, contained: int = CONTAINED) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the best phrases of each lang.

    docs: text, lang and doc_id; a null text is empty, a null lang is `und`, other columns are not read. Highest score first, then
    the more frequent, then the phrase in byte order. Repeated rows count as often as they are there.
    """
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counted = stored(exact(narrow, frequent(narrow, longest, least), longest, least))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counted, longest, contained).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

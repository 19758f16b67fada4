"""Passages that are found more than once, word by word, in a corpus; and texts without them.

1. The windows of a text are cut into stretches: neighbouring windows whose smallest hash of GRAM words is the same. Equal
   windows have the same smallest hash, wherever they stand, so it is enough to compare stretches with the same one.
2. Stretches are hashed. Those that are found twice, as wholes, hold nothing but repeated windows. Those whose smallest hash
   is found once hold none. That settles most.
3. The rest meet by their smallest hash. A task cuts what it gets into shards, builds a compressed full-text index over each
   shard, and searches it backwards from the end of each window: matching statistics tell how far a stretch before a word is
   found at least twice, and windows that reach their full length are reported.
4. Where one smallest hash belongs to very many different stretches, as around a line that is in a third of all texts, no task
   could hold them. Their windows are then hashed and counted one by one, which is exact, too, and spreads evenly.

Reported spans go back to their texts, which are moved once, for steps 3 and 4 and for the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import STEP, Powers, Words, grams, mix, runs, slices, stored, texts_of
from pagewright.llm.fmindex import FmIndex
from pagewright.llm.jaccard import NO_ID, keyed  # noqa: F401

#: Words of a window, and of the hashes that stretches are found by.
WINDOW = 35
GRAM = 7
#: Words of a shard; a smallest hash with more stretches than MANY is counted window by window.
SHARD_WORDS = 250_000
MANY = 8_192

_POWERS = Powers(STEP)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of `width` values from each place on, by doubling; the last width - 1 places are cut off."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _hash(hashes: np.ndarray, start: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the words from each start on."""
    up, down = _POWERS(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(salt)) * up[: len(hashes)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))


def stretches(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """text, start, size (words), key (smallest hash), content (hash), multiple of each stretch.

    multiple: the smallest hash stands in the stretch more than once, so that windows of it may be alike.
    """
    hashes = words.hashes()
    if len(hashes) < window:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    each = grams(hashes, gram)
    width = window - gram + 1
    low = _smallest(each[: len(each) - gram + 1], width)
    full = words.left()[: len(low)] >= window
    of = np.repeat(np.arange(len(words.counts)), words.counts)[: len(low)]
    at = np.flatnonzero(full)
    if not len(at):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    new = np.concatenate([[True], (low[at][1:] != low[at][:-1]) | (of[at][1:] != of[at][:-1])])
    start = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    key, size = low[start], count + window - 1
    places = count + width - 1
    ends = np.cumsum(places)
    inside = np.repeat(start - ends + places, places) + np.arange(ends[-1])
    times = np.add.reduceat((each[inside] == np.repeat(key, places)).astype(np.int64), ends - places)
    return of[start], start - words.first[of[start]], size, key, _hash(hashes, start, size), times > 1


FOUND = "id bigint, text_hash bigint, start int, size int, key bigint, content bigint, multiple boolean"


def _find(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                of, start, size, key, content, multiple = stretches(Words(texts_of(part, "text")), window, gram)
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("text_hash").take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                                                  pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(multiple)], ["id", "text_hash", "start", "size", "key", "content", "multiple"])

    return run


FETCHED = "key bigint, many boolean, copies bigint, id bigint, text_hash bigint, start int, words binary"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the stretches that each text must give."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Words(texts_of(part, "text"))
            hashes = texts.hashes()
            wanted = part.column("wanted")
            flat, of = wanted.flatten(), np.repeat(np.arange(part.num_rows), np.diff(wanted.offsets.to_numpy()))
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            begin = (texts.first[of] + start).tolist()
            words = [hashes[a : a + n].tobytes() for a, n in zip(begin, size.tolist())]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("many"), flat.field("copies"), part.column("id").take(take), part.column("text_hash").take(take),
                                              flat.field("start"), pa.array(words, pa.binary())], ["key", "many", "copies", "id", "text_hash", "start", "words"])


SPANS = "id bigint, text_hash bigint, start int, stop int"


def repeated_spans(contents: list[np.ndarray], copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contents that are found once: which one, and from where to where its windows are found in another place."""
    sizes = np.array([len(c) for c in contents])
    flat = np.zeros(int(sizes.sum()) + len(contents), np.int64)
    stop = np.cumsum(sizes + 1) - 1  # of each content, where its separator stands
    inner = np.ones(len(flat), bool)
    inner[stop] = False
    flat[inner] = np.unique(np.concatenate(contents), return_inverse=True)[1] + 1
    index = FmIndex(flat, window + 1)
    asked = np.flatnonzero(copies == 1)
    counts = sizes[asked] - window + 1
    of = np.repeat(asked, counts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    ends = (stop - sizes)[of] + number + window
    good = index.matches(flat, ends, window) >= window
    of, number = of[good], number[good]
    if not len(of):
        return of, number, number
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (number[1:] != number[:-1] + 1)])
    last = np.append(np.flatnonzero(new)[1:], len(of)) - 1
    return of[new], number[new], number[last] + window


def _search(window: int):
    """For mapInArrow over stretches sorted by key: shards of whole keys, an index over each, and repeated spans."""

    def shard(groups: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(groups)
        contents = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        of, start, stop = repeated_spans(contents, table.column("copies").to_numpy(), window)
        table = table.take(pa.array(of))
        begin = table.column("start").to_numpy().astype(np.int64)
        columns = [table.column("id").combine_chunks(), table.column("text_hash").combine_chunks(), pa.array((begin + start).astype(np.int32)), pa.array((begin + stop).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for group in runs(batches, ["key"]):
            held.append(group)
            size += group.column("words").nbytes // 8
            if size >= SHARD_WORDS:
                yield shard(held)
                held, size = [], 0
        if held:
            yield shard(held)

    return run


def _windows(window: int):
    """Each window of stretches, as two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                contents = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
                sizes = np.array([len(c) for c in contents])
                hashes, counts = np.concatenate(contents), sizes - window + 1
                of = np.repeat(np.arange(len(sizes)), counts)
                number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                place, take = (np.cumsum(sizes) - sizes)[of] + number, pa.array(of)
                width = np.full(len(of), window)
                start = part.column("start").to_numpy()[of] + number
                yield pa.RecordBatch.from_arrays([
                    pa.array(_hash(hashes, place, width).view(np.int64)), pa.array(_hash(hashes, place, width, 77).view(np.int64)), part.column("copies").take(take),
                    part.column("id").take(take), part.column("text_hash").take(take), pa.array(start.astype(np.int32)), pa.array((start + window).astype(np.int32))],
                    ["hash1", "hash2", "copies", "id", "text_hash", "start", "stop"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for text, spans in zip(texts_of(part, "text"), part.column("spans").to_pylist()):
                words = text.split()
                n = len(words)
                if spans:
                    keep = np.zeros(n + 1, np.int64)
                    np.add.at(keep, [s["start"] for s in spans], 1)
                    np.add.at(keep, [s["stop"] for s in spans], -1)
                    words = list(compress(words, (np.cumsum(keep[:n]) == 0).tolist()))
                rows.append((n, n - len(words), b" ".join(words)))
            n, gone, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, text_hash, start, stop of spans of words whose windows start in more than one place; rows() names id and hash.

    docs: rows of keyed(). What is repeated at all is written to the shared folder, and read from there. Spans of a text may overlap. Rows that are repeated whole count as places of their own.
    """
    found = docs.mapInArrow(_find(window, gram), FOUND)
    several = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.max("multiple").alias("multiple"))
    several = several.filter("n > 1 or multiple").select("key", (F.col("multiple") | (F.col("low") != F.col("high"))).alias("search"))
    open_ = stored(found.drop("multiple").join(several, "key"))
    contents = open_.groupBy("key", "content").agg(F.count("*").alias("copies"), F.max("search").alias("search"), F.min(F.struct("id", "text_hash", "start", "size")).alias("one"))
    contents = stored(contents)
    # stretches that are found twice as wholes
    whole = contents.filter("copies > 1").select("key", "content")
    spans = open_.join(whole, ["key", "content"]).select("id", "text_hash", "start", (F.col("start") + F.col("size")).alias("stop"))
    # the others, with all that have the same key
    asked = contents.filter("search")
    keys = asked.groupBy("key").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest")).filter("fewest = 1").select("key", (F.col("kinds") > MANY).alias("many"))
    asked = asked.join(keys, "key").select("key", "many", "copies", "one.*")
    wanted = asked.groupBy("id", "text_hash").agg(F.collect_list(F.struct("key", "many", "copies", "start", "size")).alias("wanted"))
    # repeated rows are the same text: one of them is enough
    texts = docs.join(wanted, ["id", "text_hash"]).select("id", "text_hash", "text", "wanted").dropDuplicates(["id", "text_hash"])
    fetched = texts.mapInArrow(_fetch, FETCHED)
    few = fetched.filter("not many").select("key", "copies", "id", "text_hash", "start", "words")
    searched = few.repartition("key").sortWithinPartitions("key").mapInArrow(_search(window), SPANS)
    single = fetched.filter("many").select("copies", "id", "text_hash", "start", "words").mapInArrow(_windows(window), f"hash1 bigint, hash2 bigint, copies bigint, {SPANS}")
    often = single.groupBy("hash1", "hash2").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    counted = single.filter("copies = 1").join(often, ["hash1", "hash2"]).select("id", "text_hash", "start", "stop")
    return spans.union(searched).union(counted)


def rows(docs: DataFrame) -> DataFrame:
    return keyed(docs)


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of each row of `docs`.

    A word goes if a window that covers it starts in another place, too, in the same text or another; windows are judged on
    the input. Null and empty texts have no words; texts shorter than a window stay whole. Repeated rows and ids are places
    of their own, and null ids are allowed. Other columns are not read. An empty table gives an empty result.
    """
    named = rows(docs)
    # rows that are repeated whole have equal spans; each is kept once, before anything moves
    spans = repeats(named, window, gram).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = named.join(spans, ["id", "text_hash"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(_remove, "id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of what stays."""
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

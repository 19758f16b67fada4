"""All pairs of texts whose sets of word n-grams are alike, by MinHash banding and exact checks.

1. Texts with the same words are one class; only one text of a class goes on.
2. A class has as many bands of minimum hashes as the wanted recall asks for. Classes that share a band are hung together,
   in stars; the components of that graph are candidates for checking.
3. In each component all pairs are checked on full n-gram sets, by the product of the matrices that say which text holds which
   n-gram. A large component is cut into blocks, and a task checks a pair of blocks: no task holds more than two blocks,
   and no row is written for a pair. What comes out is the number of links of each class, and edges that keep together what
   is linked.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import Words, grams, mix, runs, slices, texts_of
from pagewright.llm.components import components
from pagewright.session import cut_lineage

#: Words of an n-gram, and the least similarity of a pair.
N = 5
THRESHOLD = 0.8
#: Hashes of a band, and the share of pairs at the threshold that must meet in some band.
ROWS = 8
RECALL = 0.99999
#: Classes and words of a block.
BLOCK = 256
BLOCK_WORDS = 400_000
#: Columns of a matrix that are multiplied at once.
COLUMNS = 8192
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Bands with which a pair at the threshold shares one with the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of all texts, where those of each text end, and the texts' numbers of words.

    A text of fewer than n words has one n-gram, of all its words; one without words has none.
    """
    words = Words(texts)
    hashes = words.hashes()
    left = words.left()
    whole = grams(hashes, n)
    keep = left >= n
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    first = words.first[short]
    for size in range(1, n):
        at = first[words.counts[short] == size]
        if len(at):
            whole[at] = mix(grams(hashes, size)[at] + np.uint64(size))
    keep[first] = True
    return whole[keep], np.cumsum(np.where(words.counts >= n, words.counts - n + 1, np.minimum(words.counts, 1))), words.counts


@functools.lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(0, 1 << 32, n, np.uint64).astype(np.uint32), (draw.integers(0, 1 << 32, n, np.uint64) | 1).astype(np.uint32)


def band_hashes(hashes: np.ndarray, ends: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each text and band; texts without n-grams have zeros."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = np.flatnonzero(ends > starts)
    out = np.zeros((len(ends), bands), np.uint64)
    if not len(full):
        return out
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    salt, times = _functions(bands * rows)
    value = np.empty_like(small)
    for b in range(bands):
        total = np.full(len(full), b, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            np.bitwise_xor(small, salt[r], out=value)
            np.multiply(value, times[r], out=value)
            total = mix(total * np.uint64(0x100000001B3) + np.minimum.reduceat(value, starts[full]))
        out[full, b] = total
    return out


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """id (null as NO_ID), text_hash, class1, class2, n_words, bands of each row of `docs`."""
    bands = bands_for(threshold, rows, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                hashes, ends, counts = shingles(texts, n)
                made = band_hashes(hashes, ends, bands, rows)
                same = np.frombuffer(b"".join(hashlib.md5(b" ".join(t.split()), usedforsecurity=False).digest() for t in texts), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, bands, dtype=np.int32)), pa.array(made.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(same[:, 0]), pa.array(same[:, 1]), pa.array(counts), lists],
                                                 ["id", "text_hash", "class1", "class2", "n_words", "bands"])

    return keyed(docs).select("id", "text_hash", "text").mapInArrow(run, "id bigint, text_hash bigint, class1 bigint, class2 bigint, n_words bigint, bands array<bigint>")


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with what names them: the id, and a hash of the text."""
    return docs.select(*(c.alias(name) for c, name in zip(_keys(), ("id", "text_hash"))), "text")


def _keys() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets of hashes have a Jaccard similarity of the threshold or more; a matrix."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    shared = ~(new & np.append(new[1:], True))  # n-grams that another set holds too
    column = np.cumsum(new)[shared]
    of = of[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros((n, n), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 1 + COLUMNS, COLUMNS))  # the last cut lies past all columns
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        has = np.zeros((n, min(COLUMNS, column[b - 1] - column[a] + 1)), np.float32)
        has[of[a:b], column[a:b] - column[a]] = 1
        both += has @ has.T
    common = both.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - common
    return (common / np.maximum(union, 1) >= threshold) & (common > 0)


def _local(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each node is linked with, over any number of links."""
    label = nodes.copy()
    pairs = np.nonzero(linked)
    while True:
        low = label.copy()
        np.minimum.at(low, pairs[0], label[pairs[1]])
        if np.array_equal(low, label):
            return label
        label = low


CHECKED = "node bigint, links bigint, other bigint"


def _check(threshold: float, n: int):
    """For mapInArrow: the links of the classes of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        held = 0
        for group in runs(batches, ["component", "block_a", "block_b"]):
            nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
            group = group.take(pa.array(first))
            texts = [t or b"" for t in group.column("text").cast(pa.binary()).to_pylist()]
            hashes, ends, _ = shingles(texts, n)
            sets = [np.unique(x) for x in np.split(hashes, ends[:-1])]
            good = similar(sets, threshold)
            block, a, b = group.column("block").to_numpy(), group.column("block_a")[0].as_py(), group.column("block_b")[0].as_py()
            if a != b:
                good &= block[:, None] != block[None, :]
            np.fill_diagonal(good, False)
            out[0].append(nodes)
            out[1].append((good * group.column("copies").to_numpy()[None, :]).sum(axis=1))
            out[2].append(_local(good, nodes))
            held += len(nodes)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "links", "other"])
                out, held = [[], [], []], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "links", "other"])

    return run


def _pairs_of_blocks(blocks: Column, block: Column) -> Column:
    """Pairs of blocks (a <= b) that a block takes part in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, block).alias("block_a"), F.greatest(x, block).alias("block_b")))


def _linked(docs: DataFrame, n: int, threshold: float, rows: int, recall: float) -> DataFrame:
    """id, text_hash, class_id, n_links, copy_of, n_copies, n_words, first of each row of `docs`.

    first: whether the row is the one of its class with the smallest id (and hash of the text); repeated rows are alike.
    """
    signed = cut_lineage(signatures(docs, n, threshold, rows, recall))
    full = signed.filter("n_words > 0")
    # the text of one row stands for its class; copies are counted where they are, before anything moves
    classes = cut_lineage(full.groupBy("class1", "class2").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "text_hash")).alias("row"), F.max("n_words").alias("n_words"), F.first("bands").alias("bands")))
    banded = classes.select(F.col("class1").alias("node"), F.explode("bands").alias("band"))
    meet = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    edges = banded.join(meet, "band").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    grouped = cut_lineage(components(edges))
    # components are cut into blocks by their size
    member = grouped.join(classes.select(F.col("class1").alias("node"), "copies", "row.*", "n_words"), "node")
    size = member.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS), F.lit(1)).cast("int").alias("blocks"))
    placed = member.join(size, "component").withColumn("block", F.pmod(F.xxhash64("node", "id"), F.col("blocks")).cast("int"))
    found = keyed(docs).join(placed, ["id", "text_hash"])
    dealt = found.select("component", F.explode(_pairs_of_blocks(F.col("blocks"), F.col("block"))).alias("pair"), "block", "node", "copies", "text")
    dealt = dealt.select("component", "pair.block_a", "pair.block_b", "block", "node", "copies", "text").repartition("component", "block_a", "block_b")
    checked = dealt.sortWithinPartitions("component", "block_a", "block_b", "node").mapInArrow(_check(threshold, n), CHECKED)
    checked = cut_lineage(checked)
    linked = components(checked.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links")).join(linked, "node")
    known = classes.select("class1", "class2", "copies", "row").join(links, F.col("class1") == F.col("node"), "left")
    known = cut_lineage(known.select("class1", "class2", "copies", "row", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class1").alias("component")))
    lowest = known.groupBy("component").agg(F.min("row").alias("lowest"))
    known = known.join(lowest, "component").select("class1", "class2", "copies", "row", "links", "lowest")
    rows_of = signed.select("id", "text_hash", "class1", "class2", "n_words")
    with_words = rows_of.filter("n_words > 0").join(known, ["class1", "class2"]).select(
        "id", "text_hash", F.col("lowest.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("row.id").alias("copy_of"),
        F.col("copies").alias("n_copies"), "n_words", (F.struct("id", "text_hash") == F.col("lowest")).alias("first"))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    without = rows_of.filter("n_words = 0").select(
        "id", "text_hash", F.col("id").alias("class_id"), none.alias("n_links"), F.col("id").alias("copy_of"), one.alias("n_copies"), "n_words", F.lit(True).alias("first"))
    return with_words.union(without)


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, n_copies for each row of `docs`.

    n_links counts the other rows whose n-gram sets are alike, copies of the text included; class_id is the smallest id of all
    rows that links hold together, and copy_of that of the rows with the same words. Null and empty texts have no n-grams and
    no links, and are classes of their own. Ids may repeat, and null ids come last. Other columns are not read. An empty
    table gives an empty result. Texts are read whole; they move once to meet the list of candidates, and those of candidates
    once more for each block of their component: n different texts of one component move n * ceil(n / BLOCK) times, or more
    often where BLOCK_WORDS makes more blocks, which grows with the square of a component's size.
    """
    found = _linked(docs, n, threshold, rows, recall)
    names = [F.when(F.col(c) != NO_ID, F.col(c)).alias(d) for c, d in (("id", "doc_id"), ("class_id", "class_id"), ("copy_of", "copy_of"))]
    return found.select(*names[:2], "n_links", names[2], "n_copies")


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """The rows of `docs`, with their columns, that are the first of their class; one of rows with the same id and text.

    Of such repeated rows the one with the smallest hash of all columns stays. Rows without words all stay.
    """
    keep = _linked(docs, n, threshold, rows, recall).filter("first").groupBy("id", "text_hash").agg(F.max("n_words").alias("n_words"))
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    row = row.select("_row", *(c.alias(f"_{name}") for c, name in zip(_keys(), ("id", "text_hash"))))
    keep = keep.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), "n_words")
    order = Window.partitionBy("_id", "_text_hash").orderBy(F.xxhash64("_row"))
    return row.join(keep, ["_id", "_text_hash"]).withColumn("_n", F.row_number().over(order)).filter("_n = 1 or n_words = 0").select("_row.*")

"""Files of token ids, compressed by a grammar of pairs.

Documents are dealt out by id into ranges. A task encodes its documents in order of id and writes blocks. A block holds whole
documents; a longer document fills a block alone. In a block frequent pairs of neighbouring ids are replaced by new symbols,
again and again: a round takes all pairs that are about as frequent as the most frequent one, and replaces their
occurrences from left to right. The rules, the length of what each symbol stands for, and where each document starts among
the symbols are kept with them, so that one document, or a stretch of ids, is read without expanding the rest.

On disk a block is a row of a Parquet table in the shared folder, written and committed by Spark, so that lost executors
leave no half-written blocks behind:

    shard, block   int     range of ids, and place in it
    n_docs         bigint  documents of the block
    n_tokens       bigint  their ids
    local_start    bigint  ids of the shard before the block
    doc_ids        binary  ids of documents, 64 bits each; null as the smallest number
    payload        binary  see pack()
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.bpe import Memo, vocabulary_path
from pagewright.llm.common import slices
from pagewright.session import cut_lineage, shared_folder

#: Ids of a block, beside a longer document.
BLOCK_TOKENS = 1 << 20
#: Occurrences that make a pair worth a rule.
LEAST = 8
#: New pieces that go through the library as one text, and texts of a call; with 1,000 pieces it takes half as long again.
GROUP = 64
MAGIC = b"RPB1"
NO_ID = -(1 << 63)


# ------------------------------------------------------------------ grammar


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules (pairs of symbols), first symbol of each document, and the first number of a rule.

    starts: first id of each document, and the number of ids. Pairs across documents are never replaced. Rounds go on
    until no pair is found `least` times; each leaves fewer symbols.
    """
    base = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, sizes, recent = ids.astype(np.uint32), [], 0, 0
    starts = starts.astype(np.int64)
    while len(symbols) >= 2 * least:
        width = base + sizes
        # a pair is one number, of 32 bits where that is enough
        wide = np.uint32 if width <= 1 << 16 else np.uint64
        border = np.zeros(len(symbols) + 1, bool)
        border[starts] = True
        inner = ~border[1:-1]
        if recent:
            # all pairs found `least` times were replaced, so only those with a symbol of the last round can be frequent
            new = symbols >= recent
            inner &= new[1:] | new[:-1]
        places = np.flatnonzero(inner)
        pairs = symbols[places] * wide(width) + symbols[places + 1]
        # a pair is counted only if its hash is frequent enough; the most frequent pair of the fullest hash tells how frequent that is
        hashes = _mark(pairs).astype(np.intp)
        filled = np.bincount(hashes, minlength=1 << 18)
        fullest = np.sort(pairs[hashes == filled.argmax()])
        ends = np.append(np.flatnonzero(fullest[1:] != fullest[:-1]) + 1, len(fullest))
        some = int(np.diff(ends, prepend=0).max()) if len(fullest) else 0
        order = np.sort(pairs[(filled >= max(least, some // 16))[hashes]])
        first = np.concatenate([[0], np.flatnonzero(order[1:] != order[:-1]) + 1]) if len(order) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(order)))
        if not len(counts) or (most := counts.max()) < least:
            break
        enough = max(least, most // 16)
        chosen = order[first[counts >= enough]]
        recent = width if enough == least else 0
        # few pairs are chosen: a table by hash leaves out most others and tells which pair it is, but for two with one hash
        slots = np.full(1 << 18, -1, np.int32)
        slots[_mark(chosen)] = np.arange(len(chosen), dtype=np.int32)
        at = slots[hashes]
        where = np.flatnonzero(at >= 0)
        at, hit, where = at[where], pairs[where], places[where]
        other = np.flatnonzero(chosen[at] != hit)
        at[other] = np.minimum(np.searchsorted(chosen, hit[other]), len(chosen) - 1)
        exact = chosen[at] == hit
        where, at = where[exact], at[exact]
        # in a run of hits side by side, every second one from its left end
        fresh = np.concatenate([[True], np.diff(where) > 1])
        begin = np.repeat(where[fresh], np.diff(np.append(np.flatnonzero(fresh), len(where))))
        odd = (where - begin) % 2 == 0
        where, at = where[odd], at[odd]
        found = np.bincount(at, minlength=len(chosen)) > 0
        used = np.flatnonzero(found)
        symbols[where] = (width - 1 + np.cumsum(found)[at]).astype(np.uint32)
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        starts = starts - np.searchsorted(where + 1, starts)
        symbols = symbols[keep]
        rules.append(np.stack(np.divmod(chosen[used].astype(np.int64), width), axis=1))
        sizes += len(used)
    return symbols, np.concatenate(rules) if rules else np.empty((0, 2), np.int64), starts, base


def _mark(pairs: np.ndarray) -> np.ndarray:
    if pairs.dtype == np.uint32:
        return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for; a rule uses ids and earlier rules only."""
    known = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        known[base + i] = known[a] + known[b]
    return known[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: all rules in them are opened at once, until none is left."""
    out = symbols
    while len(at := np.flatnonzero(out >= base)):
        opened = rules[out[at] - base]
        shift = np.arange(len(at)) + at
        wide = np.empty(len(out) + len(at), out.dtype)
        plain = np.ones(len(wide), bool)
        plain[shift] = plain[shift + 1] = False
        wide[shift], wide[shift + 1] = opened[:, 0], opened[:, 1]
        keep = np.ones(len(out), bool)
        keep[at] = False
        wide[plain] = out[keep]
        out = wide
    return out


def pack(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """One block as bytes: a header, rules, expansion lengths, first symbol and first id of each document, and symbols."""
    symbols, rules, at, base = compress(ids, starts)
    lengths = lengths_of(rules, base)
    wide = base + len(rules) > 1 << 16
    kind = "<u4" if wide else "<u2"
    parts = [rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), at.astype("<u4").tobytes(), starts.astype("<u4").tobytes()]
    head = MAGIC + struct.pack("<IIIIIB", base, len(rules), len(starts) - 1, len(symbols), len(ids), wide)
    return head + b"".join(parts) + symbols.astype(kind).tobytes()


class Block:
    """A block as it was read: whole documents, or any stretch of ids."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        self.base, rules, docs, symbols, self.n_tokens, wide = struct.unpack_from("<IIIIIB", payload, 4)
        kind, at = ("<u4" if wide else "<u2"), 4 + struct.calcsize("<IIIIIB")

        def take(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = take(2 * rules, kind).reshape(-1, 2).astype(np.uint32)
        self.lengths = take(rules, "<u4")
        self.at, self.starts = take(docs + 1, "<u4"), take(docs + 1, "<u4")
        self.symbols = take(symbols, kind).astype(np.uint32)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the block; other documents are not expanded."""
        return expand(self.symbols[self.at[i] : self.at[i + 1]], self.rules, self.base)

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """Ids from start up to stop; lengths tell which symbols hold them."""
        size = np.ones(len(self.symbols), np.int64)
        rule = self.symbols >= self.base
        size[rule] = self.lengths[self.symbols[rule] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.base)[start - before : stop - before]


# ------------------------------------------------------------------ encoding


class Library:
    """The vocabulary's own library, fed with pieces that it cuts and encodes independently; equal pieces are encoded once.

    A space before what is no white space always starts a word of the vocabulary, so a text may be cut there. Texts that
    hold a special token go through the library whole.
    """

    def __init__(self, path: str, remembered: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given out the cores
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        self.special = [t.content for t in self.tokens.get_added_tokens_decoder().values()]
        self.remembered = remembered
        # a first look, several times faster in `re`, whose white space holds all of that of `regex` and more
        self.cut, self.odd = regex.compile(r" (?=\S)"), re.compile(r" (?!\S)")
        # byte-level tokens: one character for each byte
        vocabulary = self.tokens.get_vocab(with_added_tokens=False)
        self.length = np.zeros(max(self.tokens.get_vocab().values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.pieces, self.flat, self.first, self.counts = Memo(), array("I"), array("q"), array("q")

    def _learn(self) -> None:
        """Encodes new pieces, many in one text: token lengths tell where each piece ends."""
        new, self.pieces.new = self.pieces.new, []
        at, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        # a piece stands after a space; one that starts with a space is the first of its text, without it, and stays alone
        alone, later = [i for i, p in enumerate(new) if p[:1] == " "], [i for i, p in enumerate(new) if p[:1] != " "]
        begin = len(self.flat)
        counts[alone] = self._append([new[i][1:] for i in alone])
        at[alone] = begin + np.cumsum(counts[alone]) - counts[alone]
        if later:
            begin = len(self.flat)
            self._append(["".join(" " + new[i] for i in later[k : k + GROUP]) for k in range(0, len(later), GROUP)])
            ends = np.cumsum(np.fromiter((len(new[i].encode()) + 1 for i in later), np.int64, len(later)))
            upto = np.searchsorted(np.cumsum(self.length[np.frombuffer(self.flat, np.uint32)[begin:]]), ends, side="right")
            before = np.concatenate([[0], upto[:-1]])
            at[later], counts[later] = begin + before, upto - before
        self.first.frombytes(at.tobytes())
        self.counts.frombytes(counts.tobytes())

    def _append(self, texts: list[str]) -> list[int]:
        """Encodes texts, and tells how many ids each has."""
        sizes = []
        for start in range(0, len(texts), GROUP):
            for e in self.tokens.encode_batch_fast(texts[start : start + GROUP], add_special_tokens=False):
                sizes.append(len(ids := e.ids))
                self.flat.extend(ids)
        return sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.pieces) > self.remembered:
            self._forget()
        whole = {i: np.array(self.tokens.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        cut: list[list[str]] = []
        for i, t in enumerate(texts):
            if not t or i in whole:
                cut.append([])
                continue
            parts = self.cut.split(t) if self.odd.search(t) else t.split(" ")
            parts[0] = " " + parts[0]
            cut.append(parts)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        if self.pieces.new:
            self._learn()
        if not len(which):
            return [whole.get(i, np.empty(0, np.uint32)) for i in range(len(texts))]
        first, counts = np.frombuffer(self.first, np.int64)[which], np.frombuffer(self.counts, np.int64)[which]
        ends = np.cumsum(counts)
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(first - ends + counts, counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return [whole.get(i, x) for i, x in enumerate(np.split(ids, bounds[:-1]))]


@functools.lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


# ------------------------------------------------------------------ files

BLOCKS = "shard int, block int, n_docs bigint, n_tokens bigint, local_start bigint, doc_ids binary, payload binary"


def blocks(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Blocks of token ids in ascending order of doc_id (null first; equal ids by a hash of the text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stop = library(path), np.array([end], np.uint32)
        held, names, size, before, number, shard = [], [], 0, 0, 0, 0

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            ids = np.concatenate(held)
            row = [[shard], [number], [len(held)], [len(ids)], [before], [np.array(names, "<i8").tobytes()], [pack(ids, starts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["shard", "block", "n_docs", "n_tokens", "local_start", "doc_ids", "payload"])

        for batch in batches:
            for part in slices(batch, "text"):
                shard = part.column("shard")[0].as_py()
                for name, ids in zip(part.column("doc_id").to_pylist(), model.encode(part.column("text").to_pylist())):
                    if held and size + len(ids) + 1 > BLOCK_TOKENS:
                        yield block()
                        held, names, size, before, number = [], [], 0, before + size, number + 1
                    held.append(np.concatenate([ids, stop]))
                    names.append(NO_ID if name is None else name)
                    size += len(ids) + 1
        if held:
            yield block()

    return dealt.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = 2) -> str:
    """Writes the token ids of all documents, each with `end` after it, and returns the folder.

    Texts are moved once, to their range of ids. Null and empty texts hold the end id alone. Repeated rows and ids stay
    rows of their own. An empty table gives a folder without blocks. Other columns are not read.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    blocks(docs, path or vocabulary_path(), end).write.option("compression", "zstd").parquet(folder)
    return folder


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """shard, shard_start: ids of all shards before. One row for each range, of which there are as many as tasks."""
    sizes = spark.read.schema(BLOCKS).parquet(folder).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, token_ids of each document, from the files alone.

    Shard starts are broadcast: their number is that of the writer's tasks, whatever they hold.
    """
    found = spark.read.schema(BLOCKS).parquet(folder).join(F.broadcast(cut_lineage(starts(spark, folder))), "shard")
    found = found.select((F.col("shard_start") + F.col("local_start")).alias("start"), "doc_ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block = Block(payload)
                tokens = block.all().astype("<u4")
                at = block.starts.astype(np.int64)
                named = np.frombuffer(names, "<i8")
                columns = [
                    pa.array(named, mask=named == NO_ID), pa.array(start + at[:-1]), pa.array(np.diff(at)),
                    pa.array([zlib.crc32(tokens[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(tokens.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"][: len(columns)])

    return found.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * ids)

"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token under a sentence-piece vocabulary with byte fallback and under a
byte-level one, the share of pieces that fall back to bytes, and the entropy of a text's pieces. Each script has bands
outside which a text is rejected. Words are tokenised once and remembered; all counting is in arrays.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.bpe import Memo, vocabulary_path
from pagewright.llm.common import Words, grams, mix, slices, texts_of

# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk")
#: Lead bytes of UTF-8 and the script that their letters mostly belong to; ASCII letters are Latin.
LEADS = ((0xC3, 0xCA, 1), (0xCE, 0xCF, 2), (0xD0, 0xD4, 3), (0xD6, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 1), (0xE3, 0xED, 7))

#: Bands per script: characters per piece (least, most), characters per byte-level token (least, most), most share of byte
#: fallback, least entropy of pieces as a share of the most that so many pieces could have, most share of symbols in words.
BANDS = {
    "none": ((0.3, 8.0), (0.3, 8.0), 0.5, 0.4, 0.3),
    "latin": ((1.3, 9.0), (1.2, 9.0), 0.2, 0.6, 0.1),
    "greek": ((0.8, 9.0), (0.4, 9.0), 0.3, 0.55, 0.1),
    "cyrillic": ((0.9, 9.0), (0.4, 9.0), 0.3, 0.55, 0.1),
    "hebrew": ((0.6, 9.0), (0.4, 9.0), 0.4, 0.5, 0.1),
    "arabic": ((0.6, 9.0), (0.4, 9.0), 0.4, 0.5, 0.1),
    "indic": ((0.5, 9.0), (0.2, 9.0), 0.6, 0.5, 0.1),
    "cjk": ((0.3, 9.0), (0.2, 9.0), 0.7, 0.5, 0.1),
}

#: Words that a worker remembers before it starts anew.
REMEMBERED = 600_000


class Vocabularies:
    """Pieces of words under both vocabularies."""

    def __init__(self, pieces: str, tokens: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size = self.pieces.vocab_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(self.size)])
        with open(tokens, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.offsets, self.token_counts = Memo(), array("i"), array("q", [0]), array("i")

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words: number of pieces, their ids one after another, number of byte-level tokens; and of fallback pieces."""
        if len(self.known) > REMEMBERED:
            self._forget()
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            new, self.known.new = self.known.new, []
            for ids in self.pieces.encode(new, num_threads=1):
                self.flat.extend(ids)
                self.offsets.append(len(self.flat))
            encode = self.tokens.encode_ordinary
            self.token_counts.extend([len(encode(" " + w)) for w in new])
        offsets = np.frombuffer(self.offsets, np.int64)
        flat = np.frombuffer(self.flat, np.int32) if len(self.flat) else np.empty(0, np.int32)
        tokens = np.frombuffer(self.token_counts, np.int32)[which] if len(which) else np.empty(0, np.int32)
        first, counts = offsets[which], offsets[which + 1] - offsets[which]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return counts, ids, tokens, self.fallback[ids]


@functools.lru_cache(maxsize=2)
def vocabularies(pieces: str, tokens: str) -> Vocabularies:
    return Vocabularies(pieces, tokens)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, one for each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_START = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point
_SCRIPT = np.zeros(256, np.int8)
_SCRIPT[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
for _a, _b, _s in LEADS:
    _SCRIPT[_a : _b + 1] = _s


def repeated_words(words: Words) -> np.ndarray:
    """For each text: words in windows of eight that its text holds twice or more, the first ones included."""
    at = np.flatnonzero(words.left() >= WINDOW)
    of = np.repeat(np.arange(len(words.counts)), words.counts)
    # the text is part of the key, so that equal windows of other texts don't meet
    keys = mix(grams(words.hashes(), WINDOW)[at] + mix(of[at].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    twice = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(of) + WINDOW + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return _per_text((np.cumsum(cover)[: len(of)] > 0).astype(np.int64), np.append(words.first, len(of)))


def duplicate_lines(texts: list[bytes]) -> list[int]:
    """For each text: lines with a word that are equal to an earlier line."""
    out = []
    for t in texts:
        if t.count(b"\n"):
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            out.append(len(lines) - len(set(lines)))
        else:
            out.append(0)
    return out


def measures(texts: list[bytes], model: Vocabularies) -> dict[str, np.ndarray]:
    """All measures of some texts."""
    words = Words(texts)
    n, bounds = words.counts, np.append(words.text_starts, len(words.data))
    inside = ~words.blank
    chars = _per_text(_START[words.data] & inside, bounds)
    symbols = _per_text(_SYMBOL[words.data], bounds)
    script = _SCRIPT[words.data]
    by_script = np.stack([_per_text(script == s, bounds) for s in range(1, len(SCRIPTS))])
    main = np.where(by_script.sum(axis=0) > 0, by_script.argmax(axis=0) + 1, 0)
    counts, ids, tokens, fallback = model.look_up([w.decode() for t in texts for w in t.split()])
    at = np.append(words.first, len(words.starts))
    pieces, byte_tokens = _per_text(counts, at), _per_text(tokens, at)
    piece_at = np.concatenate([[0], np.cumsum(pieces)])
    fell = _per_text(fallback, piece_at)
    # entropy of each text's pieces: equal pieces of a text stand together once sorted
    keys = np.sort(np.repeat(np.arange(len(texts)), pieces) * np.int64(model.size) + ids)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(keys))).astype(float)
    terms = np.bincount(keys[first] // model.size, times * np.log2(times), len(texts)) if len(keys) else np.zeros(len(texts))
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(pieces > 0, np.log2(pieces) - terms / pieces, 0.0)
        return {
            "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array(duplicate_lines(texts), np.int64), "n_repeat_words": repeated_words(words),
            "script": main, "chars_per_piece": np.where(pieces > 0, chars / pieces, 0.0), "chars_per_token": np.where(byte_tokens > 0, chars / byte_tokens, 0.0),
            "fallback_share": np.where(pieces > 0, fell / pieces, 0.0), "token_entropy": entropy, "n_pieces": pieces,
        }


def verdict(m: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text lies within the bands of its script."""
    table = [BANDS[s] for s in SCRIPTS]
    low, high, low_t, high_t, fall, even, sym = (np.array(x)[m["script"]] for x in zip(*((b[0][0], b[0][1], b[1][0], b[1][1], b[2], b[3], b[4]) for b in table)))
    evenness = m["token_entropy"] / np.log2(np.maximum(np.minimum(m["n_pieces"], 1024), 2))
    good = (m["chars_per_piece"] >= low) & (m["chars_per_piece"] <= high) & (m["chars_per_token"] >= low_t) & (m["chars_per_token"] <= high_t)
    return good & (m["fallback_share"] <= fall) & (evenness >= even) & (m["n_symbols"] <= sym * np.maximum(m["word_chars"], 1))


OUTPUT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
          "script string, chars_per_piece double, chars_per_token double, fallback_share double, token_entropy double")


def rate(docs: DataFrame, pieces: str | None = None, tokens: str | None = None) -> DataFrame:
    """The counts of the base rules, what the vocabularies measure, and the verdict for each row of `docs`.

    Null and empty texts have no words and fail. Repeated rows are rated alike; other columns are not read; an empty table
    gives an empty result. Nothing is shuffled; a worker holds a few MB of text, and a bounded memory of words.
    """
    pieces, tokens = pieces or vocabulary_path("piece_bpe_32k.model"), tokens or vocabulary_path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabularies(pieces, tokens)
        for batch in batches:
            for part in slices(batch, "text"):
                m = measures(texts_of(part, "text"), model)
                failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
                names = pa.array(SCRIPTS).take(pa.array(m["script"]))
                columns = [part.column("doc_id"), *(pa.array(m[c]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                           pa.array(failed), pa.array(~failed & verdict(m)), names, *(pa.array(m[c]) for c in ("chars_per_piece", "chars_per_token", "fallback_share", "token_entropy"))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUTPUT.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, OUTPUT)

"""Language identification with error-correcting output codes.

Each language has a codeword. A binary classifier on hashed byte n-grams predicts each bit of it, so that some wrong bits still
lead to the right language. Decoding adds up the loss of each codeword over the bits, weighted by how right each classifier
is on documents that it was not fitted to, and takes the least; where the second is nearly as good, the text is ambiguous.

The classifiers are regularised least squares, solved together on a bounded sample; what each would say of a sample document
without having seen it follows from the same solution, and gives its weight.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import mix, slices, texts_of

#: Documents that the classifiers are fitted to, over all languages together. The only bound on what is looked at.
SAMPLE = 2048
#: Buckets of the hashed n-grams.
BUCKETS = 4096
#: Texts that are turned to features together, whose counts take 32 KB each.
ROWS = 500
#: Bits of a codeword, at least.
BITS = 15
#: Rows of the sample that are multiplied at once, in double precision.
BLOCK = 256
RIDGE = 0.05
#: Gap between the two best losses, per unit of weight, below which a text is ambiguous.
GAP = 0.02
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Letters lower case (ASCII), all else below 0x80 one blank.
_FOLD = bytes(c if c >= 0x80 else (c | 0x20 if chr(c).isalpha() else 0x20) for c in range(256))


def features(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """A row of unit length for each text: square roots of the counts of its two- and three-byte runs, by bucket."""
    folded = [b" " + b" ".join(t.translate(_FOLD).split()) + b"  " for t in texts]
    data = np.frombuffer(b"".join(folded), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, folded), np.int64, len(folded))) if texts else np.empty(0, np.int64)
    out = np.zeros(len(texts) * buckets, np.int64)
    for n, salt in ((2, 1 << 40), (3, 2 << 40)):
        if len(data) < n:
            continue
        code = data[: len(data) - n + 1].copy()
        for j in range(1, n):
            code = (code << np.uint64(8)) | data[j : len(data) - n + 1 + j]
        inside = of[: len(code)] == of[n - 1 :]
        bucket = (mix(code + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64)
        out += np.bincount((of[: len(code)] * buckets + bucket)[inside], minlength=len(out))
    rows = np.sqrt(out.reshape(len(texts), buckets).astype(np.float32))
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-9)


def parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of bounded bytes and rows."""
    for part in slices(batch, text):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def codewords(languages: int, bits: int = BITS) -> np.ndarray:
    """Rows of +1 and -1, one for each language: of several drawn tables, the one whose rows are furthest apart."""
    bits = max(bits, 4 * int(np.ceil(np.log2(max(languages, 2)))))
    draw, best, gap = np.random.default_rng(1), None, -1
    for _ in range(200):
        table = np.where(draw.random((languages, bits)) < 0.5, -1.0, 1.0)
        apart = (bits - table @ table.T) / 2 + 2 * bits * np.eye(languages)
        # a bit that is alike for all languages says nothing
        dull = int((np.abs(table.sum(axis=0)) == languages).sum()) if languages > 1 else 0
        if (score := apart.min() - dull) > gap:
            best, gap = table, score
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    bit_weight: np.ndarray

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """Weighted loss of each language for each text: squared hinge of the bits' margins, 0 at best."""
        margins = features(texts, len(self.weights)) @ self.weights + self.bias
        out = np.empty((len(texts), len(self.languages)))
        for i, code in enumerate(self.codes):
            out[:, i] = (np.maximum(0, 1 - margins * code) ** 2) @ self.bit_weight
        return out / self.bit_weight.sum()

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, and whether it is ambiguous, for each text."""
        known = [bool(_LETTER.search(t.decode())) for t in texts]
        if not self.languages:
            known = [False] * len(texts)
            loss = np.zeros((len(texts), 1))
        else:
            loss = self.losses(texts)
        best = loss.argmin(axis=1)
        least = loss.min(axis=1)
        likely = np.exp(-4 * (loss - least[:, None]))
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(texts), np.inf)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)]
        return names, np.where(known, 1 / likely.sum(axis=1), 0.0), np.where(known, second - least < GAP, False)


def _kernel(rows: np.ndarray) -> np.ndarray:
    """Products of all pairs of rows; a block of them at a time is in double precision."""
    out = np.empty((len(rows), len(rows)))
    for i in range(0, len(rows), BLOCK):
        some = rows[i : i + BLOCK].astype(np.float64)
        for j in range(0, i + 1, BLOCK):
            out[i : i + BLOCK, j : j + BLOCK] = some @ rows[j : j + BLOCK].astype(np.float64).T
            out[j : j + BLOCK, i : i + BLOCK] = out[i : i + BLOCK, j : j + BLOCK].T
    return out


def _solve(kernel: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse times `right`, and the diagonal of the inverse; by halves, so that no second matrix of this size is made."""
    h = len(kernel) // 2
    first = np.linalg.inv(kernel[:h, :h])
    across = first @ kernel[:h, h:]
    second = np.linalg.inv(kernel[h:, h:] - kernel[h:, :h] @ across)
    low = second @ (right[h:] - across.T @ right[:h])
    diagonal = np.concatenate([np.diag(first) + ((across @ second) * across).sum(axis=1), np.diag(second)])
    return np.concatenate([first @ right[:h] - across @ low, low]), diagonal


def fit(rows: np.ndarray, langs: list[str]) -> Model:
    """Classifiers for all bits from feature rows and their languages. Beside the rows, one matrix of all pairs is held."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty((0, BITS)), np.zeros((BUCKETS, BITS), np.float32), np.zeros(BITS, np.float32), np.ones(BITS))
    codes = codewords(len(languages))
    target = codes[[languages.index(x) for x in langs]]
    # the sample counts each language alike
    share = np.array([1 / langs.count(x) for x in languages])[[languages.index(x) for x in langs]]
    bias = (target * share[:, None]).sum(axis=0) / share.sum()
    kernel = _kernel(rows)
    kernel[np.diag_indices(len(rows))] += RIDGE / (share / share.mean())
    alpha, diagonal = _solve(kernel, target - bias)
    left_out = target - alpha / diagonal[:, None]
    right = ((left_out * target > 0) * share[:, None]).sum(axis=0) / share.sum()
    right = np.clip(right, 0.01, 0.99)
    weight = np.maximum(np.log(right / (1 - right)), 0.01)
    weights = sum(rows[i : i + BLOCK].astype(np.float64).T @ alpha[i : i + BLOCK] for i in range(0, len(rows), BLOCK))
    return Model(languages, codes, weights.astype(np.float32), bias.astype(np.float32), weight)


def held_out(key: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model from the labelled documents that are not held out; without any, it knows no language.

    Of each language the documents with the smallest hashes of their ids are the sample, in equal shares of SAMPLE. Counting
    reads ids and labels only; the texts of the sample are looked at whole, and turned to features where they are. The driver
    sees neither texts nor features.
    """
    usable = ~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    counts = docs.select("doc_id", "lang", "text").filter(usable).groupBy("lang").count()
    # languages are few; each needs some documents of the sample, so no more than SAMPLE can be told apart
    per_lang = {r["lang"]: r["count"] for r in counts.orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()}
    if not per_lang:
        return _fitted([], 0)
    each = max(1, SAMPLE // len(per_lang))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.create_map(*(x for lang, n in per_lang.items() for x in (F.lit(lang), F.lit(min(1.0, (each + 4 * each**0.5 + 4) / n)))))
    rows = docs.select("doc_id", "lang", "text").filter(usable).select("lang", "text", place.alias("place")).filter(F.col("place") < wanted[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                part = part.filter(pa.array([bool(_LETTER.search(t)) for t in part.column("text").to_pylist()], pa.bool_()))
                made = features(texts_of(part, "text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array([x.tobytes() for x in made], pa.binary())], ["lang", "place", "row"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(_fitted(list(batches), each)))], pa.binary())], ["model"])

    # the sample is bounded, so one task fits; the driver gets the model alone
    made = rows.mapInArrow(run, "lang string, place double, row binary").repartition(1).mapInArrow(learn, "model binary").first()
    return Model(**pickle.loads(made["model"])) if made else _fitted([], each)


def _fitted(batches: list[pa.RecordBatch], each: int) -> Model:
    """A model from feature rows (lang, place, row); of each language the `each` with the smallest places count."""
    if not sum(b.num_rows for b in batches):
        return fit(np.empty((0, BUCKETS), np.float32), [])
    got = pa.Table.from_batches(batches)
    got = got.take(pc.sort_indices(got, sort_keys=[("lang", "ascending"), ("place", "ascending"), ("row", "ascending")]))
    langs = got.column("lang").to_pylist()
    firsts = {lang: i for i, lang in reversed(list(enumerate(langs)))}
    got = got.filter(pa.array([i - firsts[lang] < each for i, lang in enumerate(langs)], pa.bool_()))
    langs = got.column("lang").to_pylist()
    sample = np.concatenate([np.frombuffer(x.as_buffer(), np.float16) for x in got.column("row")])
    return fit(sample.reshape(len(langs), BUCKETS), langs)


def identify(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """All columns of `docs`, with lang_pred, lang_score (0 to 1) and lang_ambiguous.

    Null texts and those without a letter are `und` with score 0, and teach nothing. Without a model, one is trained on `docs`. Columns of these
    names are replaced; rows are neither moved nor dropped, and each text is read whole.
    """
    model = model or train(docs)
    docs = docs.drop("lang_pred", "lang_score", "lang_ambiguous")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, text):
                lang, score, ambiguous = model.predict(texts_of(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)], [*names, "lang_pred", "lang_score", "lang_ambiguous"])

    made = docs.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("lang_score"), F.lit(None).cast("boolean").alias("lang_ambiguous"))
    return docs.mapInArrow(run, made.schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document, learned from those that are not held out."""
    model = train(docs)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))

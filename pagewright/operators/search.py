"""Search of a batch of queries: keyword, vector and hybrid ranking inside each query's document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.functions import vectors as X
from pagewright.operators.index import TextIndex, chunk_counts, index_of, matching_words, postings_of

LARGEST_POOL = max(S.POOL_FACTOR * S.MAX_SEARCH_LIMIT, S.POOL_MIN)
PAGES_PER_BUCKET = 256
# parts of a document that its chunks are dealt to
SCAN_PARTS = 8
# characters whose trigrams a worker looks at together; a longer chunk is looked at alone
PIECE_CHARS = 200_000
# bits of a code point
POINT_BITS = 21
# parts that the trigrams of a document are dealt to
TRIGRAM_PARTS = 8


def validate_search(queries: DataFrame) -> DataFrame:
    """Trimmed query, clamped limit, and a reject code for blank queries and unknown modes."""
    text = T.strip(F.coalesce("query", F.lit("")))
    limit = F.when(F.coalesce("limit", F.lit(0)) == 0, S.DEFAULT_SEARCH_LIMIT).otherwise(
        F.greatest(F.lit(1), F.least(F.col("limit"), F.lit(S.MAX_SEARCH_LIMIT)))
    )
    return queries.withColumns(
        {
            "query": text, "limit": limit.cast("bigint"),
            "reject": F.when(text == "", "blank_query").when(~F.coalesce(F.col("mode").isin(*S.SEARCH_MODES), F.lit(False)), "unknown_mode"),
        }
    )


def _with_terms(queries: DataFrame) -> DataFrame:
    terms = F.filter(F.split(F.lower("query"), rf"[{T.SPACE}]+", -1), lambda t: t != "")
    df = queries.withColumn("terms", terms)
    return df.withColumn("short", F.exists("terms", lambda t: F.length(t) < S.TRIGRAM_MIN_CHARS))


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per term; a term is always a literal."""
    return _with_terms(queries).select("query_id", "document_id", F.posexplode("terms").alias("pos", "term"))


def _pool_size():
    return F.greatest(F.col("limit") * S.POOL_FACTOR, F.lit(S.POOL_MIN))


def _best(hits: DataFrame, size) -> DataFrame:
    """Best rows of every query (lower score first).  The literal bound lets Spark cut each task's
    rows before the shuffle; the exact bound follows."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_index"))
    return hits.withColumn("place", place).filter(F.col("place") <= LARGEST_POOL).filter(F.col("place") <= size)


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold PIECE_CHARS together, or one longer row."""
    ends, start = np.cumsum(lengths), 0
    while start < len(ends):
        stop = int(np.searchsorted(ends, PIECE_CHARS + (ends[start - 1] if start else 0), "right"))
        yield start, max(stop, start + 1)
        start = max(stop, start + 1)


def _spelled(codes: np.ndarray) -> pa.Array:
    mask = (1 << POINT_BITS) - 1
    points = np.stack([codes & mask, codes >> POINT_BITS & mask, codes >> 2 * POINT_BITS], 1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _distinct_trigrams(texts: list[str], titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of some chunks as numbers; then each chunk's distinct ones, as the places of chunk and trigram, in the order of chunks."""
    parts = [s for pair in zip(texts, titles) for s in pair]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
    part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
    inside = part[:-2] == part[2:]
    coded = pa.array((points[:-2] | points[1:-1] << POINT_BITS | points[2:] << 2 * POINT_BITS)[inside]).dictionary_encode()
    known, n = coded.dictionary.to_numpy(), max(len(coded.dictionary), 1)
    found = (part[:-2][inside] >> 1) * n + coded.indices.to_numpy()
    found = np.sort(found.astype(np.int32) if len(texts) * n < 1 << 31 else found)
    found = found[np.diff(found, prepend=-1) != 0]
    return known, found // n, found % n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        lengths = pc.add(pc.utf8_length(batch["text"]), pc.utf8_length(batch["title"])).to_numpy()
        for start, stop in _runs(lengths):
            cut = batch.slice(start, stop - start)
            yield cut, *_distinct_trigrams(cut["text"].to_pylist(), cut["title"].to_pylist())


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cut, known, chunk, which in _pieces(batches):
        rows = [_spelled(known).take(pa.array(which)), *(cut[c].take(pa.array(chunk)) for c in ("document_id", "chunk_id"))]
        yield from pa.Table.from_arrays(rows, ["trigram", "document_id", "chunk_id"]).to_batches(100_000)


def _starts(ids: pa.Array) -> np.ndarray:
    """Rows whose id is not that of the row before."""
    return np.diff(ids.dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1) != 0


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of a document's chunks and part of the trigrams: the trigrams, and how many chunks hold each."""
    for cut, known, chunk, which in _pieces(batches):
        part = known % TRIGRAM_PARTS
        order = np.argsort(part, kind="stable")
        place, starts, n = np.argsort(order), _starts(cut["document_id"]), max(len(known), 1)
        pairs, times = np.unique((np.cumsum(starts) - 1)[chunk] * n + place[which], return_counts=True)
        run, codes = pairs // n, order[pairs % n]
        first = np.flatnonzero(np.diff(run * TRIGRAM_PARTS + part[codes], prepend=-1))
        ends = pa.array(np.append(first, len(pairs)), pa.int32())
        yield pa.RecordBatch.from_arrays([
            cut["document_id"].take(pa.array(np.flatnonzero(starts)[run[first]])), pa.array(part[codes[first]], pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(known[codes])), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
        ], ["document_id", "part", "codes", "times"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks and documents of the trigrams of some rows, which lie in the order of documents and parts; an unknown document is none."""
    last, seen = None, np.empty(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, parts = batch["document_id"], batch["part"].to_numpy()
        starts = _starts(ids) | (np.diff(parts, prepend=-1) != 0)
        row = np.repeat(np.arange(len(parts)), pc.list_value_length(batch["codes"]).to_numpy())
        coded = batch["codes"].flatten().dictionary_encode()
        known, which, n = coded.dictionary.to_numpy(), coded.indices.to_numpy(), max(len(coded.dictionary), 1)
        chunks = np.bincount(which, batch["times"].flatten().to_numpy(), len(known)).astype(np.int64)
        group = np.cumsum(starts) - 1
        # the last document of a batch may go on in the next; only one that goes on can have a trigram twice
        ongoing = last == (ids[0], parts[0])
        alone = (np.bincount(group) == 1)[group] & ~(ongoing & (group == 0))
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        again = np.unique((group[row] * n + which)[(~alone & valid)[row]])
        if ongoing:
            again = again[(again >= n) | ~np.isin(known[again % n], seen)]
        documents = np.bincount(which[(alone & valid)[row]], minlength=len(known)) + np.bincount(again % n, minlength=len(known))
        own = known[which[(group == group[-1])[row]]]
        seen = np.union1d(seen, own) if ongoing and group[-1] == 0 else own
        last = ids[-1], parts[-1]
        yield pa.RecordBatch.from_arrays([_spelled(known), pa.array(chunks), pa.array(documents)], ["trigram", "chunks", "documents"])


def _lowered(chunks: DataFrame, *columns: str) -> DataFrame:
    return chunks.filter("normalized_text is not null").select(
        *columns, F.lower("normalized_text").alias("text"), F.lower(F.coalesce("section_title", F.lit(""))).alias("title"))


def build_trigram_index(chunks: DataFrame) -> DataFrame:
    """Distinct three-character pieces of text and title, as rows (trigram, document_id, chunk_id)."""
    kinds = StructType([StructField("trigram", StringType()), chunks.schema["document_id"], chunks.schema["chunk_id"]])
    return _lowered(chunks, "document_id", "chunk_id").mapInArrow(_index_rows, kinds)


def count_trigram_index(chunks: DataFrame) -> DataFrame:
    """Size of the index: chunks and documents of every trigram.

    Counted where the rows of the index are made. What moves is a document's trigrams, as a few arrays; the parts of a
    large document, and of one that comes again, are dealt to several tasks.
    """
    kind = chunks.schema["document_id"].dataType.simpleString()
    rows = _lowered(chunks, "document_id").mapInArrow(_counted_rows, f"document_id {kind}, part int, codes array<bigint>, times array<int>")
    rows = rows.repartition("document_id", "part").sortWithinPartitions("document_id", "part")
    sums = rows.mapInArrow(_sums, "trigram string, chunks bigint, documents bigint")
    return sums.groupBy("trigram").agg(F.sum("chunks").alias("chunks"), F.sum("documents").alias("documents"))


def _exploded(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "document_id", "limit", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("pos", "term"))


def _met(index: TextIndex, terms: DataFrame) -> DataFrame:
    """Postings of a query's document whose word holds a term of the query.

    The chunks of a document are dealt to several parts, so that a large one isn't looked at by one task. Chunks are moved once, by
    document and part, each as one row, and every search over them moves them in the same way. Words are parted only where the
    chunk holds the term.
    """
    spread = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SCAN_PARTS - 1))))
    chunks = index.rows.filter("words is not null").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(SCAN_PARTS)).cast("int"))
    found = chunks.join(spread, ["document_id", "part"]).filter(F.col("words").contains(F.col("term")))
    return postings_of(found, "document_id", "chunk_id", *[c for c in terms.columns if c != "document_id"]).filter(F.col("word").contains(F.col("term")))


def keyword_bm25(queries: DataFrame, index: TextIndex, match_all: bool = True) -> DataFrame:
    """BM25 hits of queries whose terms all have three characters or more; lower is better.

    Statistics are over the whole index, by the lexicon; hits are limited to the query's document, and found among its postings. So what
    other documents hold of a term is counted, but never meets a query. No text is read.
    """
    terms = _exploded(_with_terms(queries).filter(~F.col("short") & (F.size("terms") > 0)))
    words = matching_words(terms, index)
    key = ["query_id", "document_id", "chunk_id", "limit", "n_terms"]
    near = _met(index, terms)
    freq = F.sum(T.overlapping_occurrences("word", "term") * (F.col("in_body") * S.BODY_BM25_WEIGHT + F.col("in_head") * S.TITLE_BM25_WEIGHT))
    hits = near.groupBy(*key, "pos", "term").agg(freq.alias("freq"))
    whole = index.stats.agg(F.struct(F.count(F.lit(1)).alias("rows"), F.avg("tokens").alias("avgdl")).alias("s")).scalar()
    idf = F.log((F.col("s.rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    k1, b = S.BM25_K1, S.BM25_B
    part = F.col("idf") * F.col("freq") * (k1 + 1) / (F.col("freq") + k1 * (1 - b + b * F.col("tokens") / F.col("s.avgdl")))
    scored = (
        hits.join(chunk_counts(words, index), "term").join(index.stats, ["document_id", "chunk_id"]).withColumn("s", whole)
        .withColumn("idf", F.when(idf <= 0, S.BM25_IDF_FLOOR).otherwise(idf)).withColumn("part", part)
        .groupBy(*key, "chunk_index").agg(F.round(-F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("matched"))
    )
    if match_all:
        scored = scored.filter("matched = n_terms")
    return scored.select("query_id", "document_id", "chunk_id", "chunk_index", "limit", "score")


def keyword_scan(queries: DataFrame, index: TextIndex, match_all: bool = True) -> DataFrame:
    """Fallback when a term is shorter than a trigram: the words of the query's document are tested one by one."""
    found = _met(index, _exploded(_with_terms(queries).filter("short")))
    key = ["query_id", "document_id", "chunk_id", "limit", "n_terms"]
    each = found.groupBy(*key, "pos").agg(F.sum(T.occurrences("word", "term") * (F.col("in_body") + F.col("in_head"))).alias("n"))
    hits = each.groupBy(*key).agg((-F.sum("n")).cast("double").alias("score"), F.count(F.lit(1)).alias("matched"))
    if match_all:
        hits = hits.filter("matched = n_terms")
    return hits.join(index.stats, ["document_id", "chunk_id"]).select("query_id", "document_id", "chunk_id", "chunk_index", "limit", "score")


def keyword_hits(queries: DataFrame, index: TextIndex, match_all: bool = True) -> DataFrame:
    """Both keyword legs; each query takes exactly one of them."""
    return keyword_bm25(queries, index, match_all).unionByName(keyword_scan(queries, index, match_all))


def validate_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", X.is_valid_vector("vector", F.col("embedding_dimension")))


def cosine_scores(query_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """Cosine of every query with the chunks of its document, model and dimension; 0 for zero vectors."""
    keys = ["document_id", "embedding_model", "embedding_dimension"]

    def side(df, id_name, prefix):
        ok = df.filter(X.is_valid_vector("vector", F.col("embedding_dimension")))
        return ok.select(*keys, id_name, F.col("vector").alias(prefix + "v"), X.norm("vector").alias(prefix + "n"))

    j = side(query_vectors, "query_id", "q").join(side(chunk_vectors, "chunk_id", "c"), keys)
    scale = F.col("qn") * F.col("cn")
    return j.select(
        "query_id", "document_id", "chunk_id", F.when(scale == 0, F.lit(0.0)).otherwise(X.dot("qv", "cv") / scale).alias("cosine")
    )


def minmax_normalize(hits: DataFrame, invert: bool) -> DataFrame:
    """Scores of every query mapped to 0..1; equal scores become 1."""
    query = Window.partitionBy("query_id")
    low, high = F.min("score").over(query), F.max("score").over(query)
    df = hits.withColumns({"low": low, "high": high})
    part = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    scaled = F.when(F.col("high") == F.col("low"), 1.0).otherwise(1.0 - part if invert else part)
    return df.withColumn("scaled", scaled).drop("low", "high")


def page_proximity_bonus(candidates: DataFrame) -> DataFrame:
    """Bonus for candidates whose pages overlap, or else touch, those of another candidate.

    In order of the first page, an earlier candidate overlaps exactly when the furthest end so far
    reaches this start, a later one exactly when the next start lies within this range: no pairs are
    formed.  Queries are cut into page buckets, and the bucket borders are carried over.
    """
    df = candidates.withColumn("bucket", F.floor(F.col("page_start") / PAGES_PER_BUCKET))
    inside = Window.partitionBy("query_id", "bucket").orderBy("page_start", "page_end", "chunk_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"end_in": F.max("page_end").over(before), "start_in": F.lead("page_start").over(inside)})
    across = Window.partitionBy("query_id").orderBy("bucket")
    borders = (
        candidates.groupBy("query_id", F.floor(F.col("page_start") / PAGES_PER_BUCKET).alias("bucket"))
        .agg(F.max("page_end").alias("e"), F.min("page_start").alias("s"))
        .select(
            "query_id", "bucket", F.max("e").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("end_out"),
            F.lead("s").over(across).alias("start_out"),
        )
    )
    df = df.join(borders, ["query_id", "bucket"])
    end, start = F.greatest("end_in", "end_out"), F.coalesce("start_in", "start_out")
    never = F.lit(False)
    same = F.coalesce(end >= F.col("page_start"), never) | F.coalesce(start <= F.col("page_end"), never)
    touch = F.coalesce(end == F.col("page_start") - 1, never) | F.coalesce(start == F.col("page_end") + 1, never)
    bonus = F.when(same, S.SAME_PAGE_BONUS).when(touch, S.ADJACENT_PAGE_BONUS).otherwise(0.0)
    return df.withColumn("bonus", bonus).drop("bucket", "end_in", "start_in", "end_out", "start_out")


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, embed=X.deterministic_embedding,
                      model: str = S.EMBEDDING_MODEL, dimension: int = S.EMBEDDING_DIMENSION, index: TextIndex | None = None) -> DataFrame:
    """Scored candidates of every query.  `embed` turns a text column into a vector column (None: no
    embeddings, so vector queries find nothing).  `index` is the stored one of the chunks (None: made from them)."""
    hits = keyword_hits(queries.filter("mode in ('keyword', 'hybrid')"), index or index_of(chunks))
    kw = minmax_normalize(_best(hits, _pool_size()), invert=True).select("query_id", "document_id", "chunk_id", F.col("scaled").alias("kw"))
    if embed is None:
        vec = kw.select("query_id", "document_id", "chunk_id", F.col("kw").alias("vec")).limit(0)
    else:
        tags = (F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dimension"))
        qv = queries.filter("mode in ('vector', 'hybrid')").select("query_id", "document_id", *tags, embed("query", dimension).alias("vector"))
        wanted = chunks.join(qv.select("document_id").distinct(), "document_id", "left_semi")
        cv = wanted.select("chunk_id", "document_id", *tags, embed("normalized_text", dimension).alias("vector"))
        vec = cosine_scores(qv, cv).select("query_id", "document_id", "chunk_id", ((F.col("cosine") + 1.0) / 2.0).alias("vec"))
    both = kw.join(vec, ["query_id", "document_id", "chunk_id"], "full_outer").join(queries.select("query_id", "mode", "limit"), "query_id")
    k, v = F.coalesce("kw", F.lit(0.0)), F.coalesce("vec", F.lit(0.0))
    mode = F.col("mode")
    return both.withColumns(
        {
            "base": F.when(mode == "keyword", k).when(mode == "vector", v).otherwise(k * S.KEYWORD_WEIGHT + v * S.VECTOR_WEIGHT),
            "match_type": F.when(mode != "hybrid", mode)
            .when(F.col("kw").isNotNull() & F.col("vec").isNotNull(), "hybrid")
            .when(F.col("kw").isNotNull(), "keyword").otherwise("vector"),
        }
    )


def search_topk(candidates: DataFrame, most: int = S.MAX_SEARCH_LIMIT) -> DataFrame:
    """First `limit` candidates of every query by score; raw scores are not part of the result.

    `most` is a bound that limits keep (`validate_search` sees to it); a larger limit is an error. As a number in the plan it lets
    Spark cut each task's rows before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "chunk_index")
    limit = F.when(F.col("limit") <= most, F.col("limit")).otherwise(F.raise_error(F.lit(f"a limit is above {most}")))
    df = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).filter(F.col("rank") <= limit)
    return df.select("query_id", "document_id", F.col("rank").cast("bigint"), "chunk_id", "match_type")


def hybrid_search(queries: DataFrame, chunks: DataFrame, embed=X.deterministic_embedding, index: TextIndex | None = None, **kw) -> DataFrame:
    """Ranked results with preview, section and pages (ids join `chunk_refs` for the locations)."""
    q = validate_search(queries).filter("reject is null").drop("reject")
    found = hybrid_candidates(q, chunks, embed, index=index, **kw)
    placed = found.join(chunks.select("chunk_id", "chunk_index", "page_start", "page_end"), "chunk_id")
    final = page_proximity_bonus(placed).withColumn("final", F.round(F.col("base") + F.col("bonus"), 9))
    shown = chunks.select("chunk_id", T.text_preview("normalized_text").alias("preview"), "section_title", "page_start", "page_end")
    return search_topk(final).join(shown, "chunk_id")

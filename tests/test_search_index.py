"""The stored text index: against plain substring search, over replacements, failed writes and repeated words."""

import collections
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.operators import index as I
from pagewright.operators import search as R

CHUNKS = "document_id long, chunk_id string, chunk_index long, normalized_text string, section_title string"
QUERIES = "query_id long, document_id long, query string, mode string, limit long"


def _overlapping(text, term):
    return sum(text.startswith(term, i) for i in range(len(text)))


def _brute(chunks, queries, match_all=True):
    """(query, chunk) to BM25 score, or negative occurrences where a term has fewer than three characters."""
    low = [(d, c, t.lower(), (h or "").lower(), max(len(t) - 2, 0) + max(len(h or "") - 2, 0)) for d, c, _, t, h in chunks]
    mean, out = sum(x[4] for x in low) / len(low), {}
    for q, doc, text, _, _ in queries:
        terms = text.lower().split()
        for d, c, body, head, tokens in low:
            if d != doc:
                continue
            there = [t for t in terms if t in body or t in head]
            if not there or match_all and len(there) < len(terms):
                continue
            if min(map(len, terms)) < 3:
                out[q, c] = -float(sum(body.count(t) + head.count(t) for t in there))
                continue
            score = 0.0
            for t in there:
                n = sum(t in b or t in h for _, _, b, h, _ in low)
                idf = math.log((len(low) - n + 0.5) / (n + 0.5))
                freq = _overlapping(body, t) * S.BODY_BM25_WEIGHT + _overlapping(head, t) * S.TITLE_BM25_WEIGHT
                score += (S.BM25_IDF_FLOOR if idf <= 0 else idf) * freq * (S.BM25_K1 + 1) / (freq + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * tokens / mean))
            out[q, c] = -score
    return out


def _table(seed=1, docs=6):
    rnd = random.Random(seed)
    words = ["aaaa", "Banana", "ananas", "the", "there", "ÉTÉ", "x", "ab", "abab", "심장질환", "un til", "a.b", "c++", "%_%"]
    return [(d, f"{d}:{i}", i, " ".join(rnd.choices(words, k=rnd.randint(0, 9))), rnd.choice([None, "", "The Banana", "aaa"])) for d in range(docs) for i in range(12)]


ASKED = ["anan", "aaa", "the", "ban aaa", "ab", "x anan", "été", "심장", "심장질", "a.b", "c++", "%_%", "nothing", "the the", "a"]


def _queries(docs=6):
    return [(100 * d + i, d, text, "keyword", 20) for d in range(docs) for i, text in enumerate(ASKED)]


def _found(spark, queries, index, match_all=True):
    df = R.keyword_hits(spark.createDataFrame(queries, QUERIES), index, match_all)
    return {(r.query_id, r.chunk_id): r.score for r in df.collect()}


@pytest.mark.parametrize("match_all", [True, False])
def test_search_equals_substring_search(spark, match_all):
    chunks = _table()
    got = _found(spark, _queries(), I.index_of(spark.createDataFrame(chunks, CHUNKS)), match_all)
    want = _brute(chunks, _queries(), match_all)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_index_follows_documents(spark, tmp_path, monkeypatch):
    """Chunks are replaced, removed and added; one write dies before its commit and is repeated."""
    path, chunks = str(tmp_path / "index"), _table()
    df = spark.createDataFrame(chunks, CHUNKS)
    I.write_index(df, path)
    assert _found(spark, _queries(), I.read_index(spark, path)).keys() == _brute(chunks, _queries()).keys()
    new = [(1, "1:0", 0, "wholly new Text anan", None)] + [c for c in _table(7, 8) if c[0] >= 6]
    told = spark.createDataFrame([(1,), (2,), (6,), (7,)], "document_id long")
    real = I.replace_document_rows
    monkeypatch.setattr(I, "replace_document_rows", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        I.write_index(spark.createDataFrame(new, CHUNKS), path, told)
    assert _found(spark, _queries(), I.read_index(spark, path)).keys() == _brute(chunks, _queries()).keys()
    monkeypatch.setattr(I, "replace_document_rows", real)
    I.write_index(spark.createDataFrame(new, CHUNKS), path, told)
    index = I.read_index(spark, path)
    now = [c for c in chunks if c[0] not in (1, 2)] + new
    asked = _queries(8) + [(999, 1, "wholly text", "keyword", 5)]
    got, want = _found(spark, asked, index), _brute(now, asked)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)
    assert index.lexicon.count() == index.lexicon.distinct().count()


def test_postings_are_made_without_a_shuffle(spark, tmp_path):
    rows = [(1, "1:0", 0, "b a b\n a c a", "a d"), (1, "1:1", 1, "", None), (2, "2:0", 0, " \t", ""), (None, "3:0", 0, "b", "b")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    words = I.chunk_words(chunks)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString()
    assert words.count() == 5
    assert {tuple(r) for r in words.select("word", "chunk_id", "in_body", "in_head").collect()} == {("a", "1:0", 3, 1), ("b", "1:0", 2, 0), ("c", "1:0", 1, 0), ("d", "1:0", 0, 1), ("b", "3:0", 1, 1)}
    # one write is read without its ledger; rows without a document are not part of it
    I.write_index(chunks, str(tmp_path / "index"))
    index = I.read_index(spark, str(tmp_path / "index"))
    assert "Join" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.chunk_id for r in index.stats.collect()) == ["1:0", "1:1", "2:0"]
    assert {r.word for r in index.postings.collect()} == {"a", "b", "c", "d"}


def test_a_chunk_is_one_row_and_its_id_counts_once(spark):
    """Rows of one id, and of the unknown id, are one chunk; a word in text and title is one word."""
    rows = [(1, "a", 0, "banana x", "Banana"), (1, "a", 0, "ananas", None), (2, "a", 3, "x", "y"), (2, None, 1, "anan", None), (3, None, 1, "anan", None), (3, "c", 1, "none", ""),
            (None, "d", 1, "anana", None), (4, "", 0, "anan", None), (5, "e", 0, None, "banana")]
    index = I.index_of(spark.createDataFrame(rows, CHUNKS))
    assert index.rows.count() == len(rows)
    words = I.matching_words(spark.createDataFrame([("anan",), ("none",), ("zzz",)], "term string"), index)
    assert {tuple(r) for r in words.collect()} == {("anan", "banana"), ("anan", "ananas"), ("anan", "anan"), ("anan", "anana"), ("none", "none")}
    # a pair that comes twice changes nothing
    found = I.chunk_counts(words.unionAll(words), index)
    assert {r.term: r.n for r in found.collect()} == {"anan": 4, "none": 1}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_places_of_chunks_are_counted_once_over_blocks_and_batches(monkeypatch, size):
    monkeypatch.setattr(I, "MERGED_ROWS", 70)
    draw = random.Random(3)
    rows = [(draw.choice("abcd"), draw.choice([1, 2, 1 << 33]), draw.sample(range(1 << 16), draw.randint(1, 4)) + [7]) for _ in range(300)]
    want = collections.Counter(term for term, *_ in {(t, b, n) for t, b, places in rows for n in places})

    def batches(rows, size):
        kinds = pa.string(), pa.int64(), pa.binary()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["term", "block", "chunks"]).to_batches(size)

    given = [(t, b, b"".join(n.to_bytes(2, "little") for n in places)) for t, b, places in rows]
    merged = pa.Table.from_batches(I._merged_lists(iter(batches(given, 13))))
    assert merged.num_rows < 100
    found = collections.Counter()
    for r in pa.Table.from_batches(I._list_counts(iter(batches(sorted(tuple(r.values()) for r in merged.to_pylist()), size)))).to_pylist():
        found[r["term"]] += r["n"]
    assert found == want


def test_blocks_end_between_ids(monkeypatch):
    monkeypatch.setattr(I, "BLOCK_CHUNKS", 2)
    rows = [("", "a b"), ("", "b c"), ("=1", "a"), ("=1", "d"), ("=1", "d"), ("=2", "e"), ("=3", "f"), ("=3", "g")]
    for size in (1, 3, 8):
        found = list(I._blocks(pa.table([pa.array(c) for c in zip(*rows)], ["id", "words"]).to_batches(size)))
        assert [[set(t.split()) for t in block] for block in found] == [[{"a", "b", "c"}, {"a", "d"}], [{"e"}, {"f", "g"}]]


def test_one_plan_and_no_job_for_it(spark, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(spark.createDataFrame(_table(), CHUNKS), path)
    chunks = spark.createDataFrame(_table(), CHUNKS).withColumns({"page_start": F.col("chunk_index"), "page_end": F.col("chunk_index")})
    index, queries = I.read_index(spark, path), spark.createDataFrame(_queries(), QUERIES)
    spark.sparkContext.setJobGroup("plan only", "")
    df = R.hybrid_search(queries, chunks, index=index)
    keyword = R.keyword_hits(queries, index)._jdf.queryExecution().optimizedPlan().toString()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan only")) == []
    spark.sparkContext.setJobGroup("rest", "")
    assert "normalized_text" not in keyword and df.count() > 0


def test_empty(spark, tmp_path):
    path = str(tmp_path / "index")
    I.write_index(spark.createDataFrame([], CHUNKS), path)
    assert _found(spark, _queries(), I.read_index(spark, path)) == {}


def test_a_limit_beyond_the_bound_is_an_error(spark):
    row = [(1, 1, "c", 0, 0.5, "keyword", 51)]
    df = spark.createDataFrame(row, "query_id long, document_id long, chunk_id string, chunk_index long, final double, match_type string, limit long")
    with pytest.raises(Exception, match="above 50"):
        R.search_topk(df).collect()
    assert R.search_topk(df, 60).count() == 1


def _plain_trigrams(chunks):
    """(trigram, document_id, row of the chunk) of plain texts."""
    return {(s[i : i + 3], d, n) for n, (d, _, t, h) in enumerate(chunks) if t is not None for s in (t.lower(), (h or "").lower()) for i in range(len(s) - 2)}


def _trigram_chunks():
    draw = random.Random(5)
    words = ["abab", "aba", "x", "\U0001f600ab", "é\0é", "심장 질환", "", "ABAB"]
    ids = [*draw.choices([1, 2, 3, 4, 5, None], k=120), *[6] * 60]
    return [(d, f"c{i}", draw.choice([" ".join(draw.choices(words, k=draw.randrange(9))), None]), draw.choice([*words, None])) for i, d in enumerate(ids)]


def test_trigrams_are_counted_where_they_are_made(spark):
    chunks = _trigram_chunks()
    want = _plain_trigrams(chunks)
    df = spark.createDataFrame(chunks, "document_id long, chunk_id string, normalized_text string, section_title string")
    index = R.build_trigram_index(df).collect()
    assert sorted((r.trigram, r.chunk_id) for r in index) == sorted((t, f"c{n}") for t, _, n in want)
    assert all(chunks[int(r.chunk_id[1:])][0] == r.document_id for r in index)
    counted = R.count_trigram_index(df)
    documents = collections.Counter(t for t, _ in {(t, d) for t, d, _ in want if d is not None})
    assert {r.trigram: (r.chunks, r.documents) for r in counted.collect()} == {t: (n, documents[t]) for t, n in collections.Counter(t for t, _, _ in want).items()}
    # no row for a trigram of a chunk
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_documents_that_go_on_in_the_next_batch_count_once(monkeypatch, size):
    monkeypatch.setattr(R, "PIECE_CHARS", 40)
    chunks = _trigram_chunks()
    want = _plain_trigrams(chunks)
    kept = [(d, t.lower(), (h or "").lower()) for d, _, t, h in chunks if t is not None]
    given = pa.table([pa.array(c, k) for c, k in zip(zip(*kept), (pa.int64(), pa.string(), pa.string()))], ["document_id", "text", "title"])
    rows = pa.Table.from_batches(R._counted_rows(given.to_batches(7))).sort_by([("document_id", "ascending"), ("part", "ascending")])
    found = collections.defaultdict(lambda: [0, 0])
    for r in pa.Table.from_batches(R._sums(rows.combine_chunks().to_batches(size))).to_pylist():
        found[r["trigram"]][0] += r["chunks"]
        found[r["trigram"]][1] += r["documents"]
    documents = collections.Counter(t for t, _ in {(t, d) for t, d, _ in want if d is not None})
    assert found == {t: [n, documents[t]] for t, n in collections.Counter(t for t, _, _ in want).items()}

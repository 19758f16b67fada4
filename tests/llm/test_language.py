"""Held-out accuracy, codes, and odd rows."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from pagewright.llm import language

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 200 and sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert sum(r.ambiguous for r in rows) < 0.02 * len(rows)


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows = [(i, "die katze und der hund" if i % 2 else "the cat and the dog", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else ("de" if i % 2 else "en")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.train(docs).languages == ["de", "en"]
    assert {(r.doc_id % 2, r.lang_pred) for r in language.digest(docs).collect()} == {(0, "en"), (1, "de")}


def test_many_tiny_texts_are_taken_in_bounded_runs():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab"] * 2300)], ["text"])
    got = [p.num_rows for p in language.parts(batch, "text")]
    assert sum(got) == 2300 and max(got) == language.ROWS


def test_the_driver_gets_no_features(spark, monkeypatch):
    rows = [(i, "die katze und der hund" if i % 2 else "the cat and the dog", "de" if i % 2 else "en") for i in range(40)]

    def forbidden(self):
        raise AssertionError("the sample was gathered on the driver")

    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(type(docs), "toArrow", forbidden)
    assert language.train(docs).languages == ["de", "en"]


def test_codewords():
    for n in (1, 2, 4, 30, 200):
        codes = language.codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n
    four = language.codewords(4)
    assert min((a != b).sum() for i, a in enumerate(four) for b in four[:i]) >= 7  # three wrong bits are mended


def test_wrong_bits_are_mended():
    model = language.fit(np.eye(4096, dtype=np.float32)[:8], ["a", "b", "c", "d"] * 2)
    for i in range(4):
        code = model.codes[i].copy()
        code[:3] *= -1
        loss = ((np.maximum(0, 1 - code * model.codes)) ** 2).sum(axis=1)
        assert loss.argmin() == i


def test_fitting_holds_little_beside_the_sample():
    draw = np.random.default_rng(0)
    rows = (draw.random((language.SAMPLE, language.BUCKETS), np.float32) / 100).astype(np.float16)
    tracemalloc.start()
    language.fit(rows, ["a", "b", "c", "d"] * (language.SAMPLE // 4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6  # 168 MB when the whole sample and its transpose were in double precision at once


def test_fitting_by_halves_and_blocks_is_the_plain_solution():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, language.BLOCK + 1, 2 * language.BLOCK + 5):
        rows = draw.random((n, 50)).astype(np.float16)
        kernel, wide = language._kernel(rows), rows.astype(np.float64)
        assert np.allclose(kernel, wide @ wide.T)
        kernel[np.diag_indices(n)] += 0.5
        right = draw.random((n, 3))
        found, diagonal = language._solve(kernel, right)
        assert np.allclose(found, np.linalg.inv(kernel) @ right) and np.allclose(diagonal, np.diag(np.linalg.inv(kernel)))


def test_odd_rows(spark):
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "123 --- …", "de", "x"), (4, "日本語の文", None, "x"), (None, "the cat", "en", "x"), (6, "the " * 100_000, "en", None), (6, "the " * 100_000, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    got = language.identify(docs)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "lang_score", "lang_ambiguous"]
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by[1].lang_score == 0 and by[6].lang_pred == "en" and by[6].lang_score == 1
    assert not [r for r in language.digest(docs).collect() if r.doc_id is None and r.held_out]
    none = docs.filter("false")
    assert language.digest(none).count() == 0
    unlabelled = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.digest(unlabelled).collect()} == {"und"}

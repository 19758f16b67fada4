"""The pipeline's stages on a small table, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import bpe, jaccard, mixing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The input of each stage, and the last one's output; each is cached."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "12 34 -- 56", "en", "src1", 11), (9004, "one of a kind, with password = Zq81LmP0xW2r in it", "en", None, 50)], docs.schema)
    out = [docs.union(more).cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return [(x.columns, x.collect()) for x in out]


def test_columns(steps):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [c for c, _ in steps] == [names] * 5 + [[*names, "token_ids", "n_tokens"]]


def test_language(steps):
    (_, before), (_, after) = steps[0], steps[1]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if not re.search(r"[^\W\d_]", r.text or "")} >= {9001, 9002, 9003}
    assert set(after) <= set(before)


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12 34", None, "a", 5), (3, None, None, "a", None), (4, "日本", None, "a", 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.known_language(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == [1, 4] and got.columns == docs.columns


def test_near_copies(steps, spark):
    def grams(text):
        words = text.encode().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    (_, before), (_, after) = steps[1], steps[2]
    sets = {r.doc_id: grams(r.text) for r in before}
    label = {i: i for i in sets}
    alike = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    for _ in range(20):
        for i, j in alike:
            label[i] = label[j] = min(label[i], label[j])
    assert alike and sorted(r.doc_id for r in after) == sorted(set(label.values()))


def test_secrets(steps):
    (_, before), (_, after) = steps[2], steps[3]
    old, new = {r.doc_id: r for r in before}, {r.doc_id: r for r in after}
    assert old.keys() == new.keys()
    assert new[9004].text == "one of a kind, with [secret] in it" and new[9004].n_chars == len(new[9004].text)
    changed = [i for i in old if old[i].text != new[i].text]
    assert 9004 in changed and all("[secret]" in new[i].text for i in changed)
    assert all(old[i] == new[i] for i in old if i not in changed)
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text) for r in after)


def test_mixture(steps, spark):
    (_, before), (_, after) = steps[3], steps[4]
    plan = mixing.plan(spark.createDataFrame(before, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    want = {r.doc_id: r.copies for r in plan.collect() if r.copies}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want and set(after) <= set(before)


def test_tokens(steps):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in steps[5][1]:
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids


def test_run(spark, steps):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == steps[5][0] and out.filter(F.size("token_ids") != F.col("n_tokens")).count() == 0


def test_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert jaccard.bands_for() > 0

"""What the plans of long jobs move, and results where rows are moved in another way."""

from contextlib import contextmanager

from pagewright.operators import folds
from pagewright.operators import summary as U


@contextmanager
def joins_shuffle(spark):
    """Tables of a test are small; a join must move them as it would move large ones."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fold_joins_no_whole_rows_with_entry_states(spark):
    rows = [(d, i // 5, i, 40, folds.PLAIN, None, 1, f"text {i}") for d in (1, 2, None) for i in range(23)]
    df = spark.createDataFrame(rows, "document_id long, shard long, n long, item_size long, item_kind int, item_tag string, item_weight long, text string")
    with joins_shuffle(spark):
        out = folds.fold(df, ["n"], folds.PackChunks(100), "g")
        assert "LeftOuter" not in plan(out)
        got = out.collect()
    assert len(got) == len(rows) and all(r.text == f"text {r.n}" for r in got)
    # rows without a document have no entry states: each of their shards starts anew
    assert all(r.g == (r.n // 2 if r.document_id else r.n % 5 // 2) for r in got)


def test_nodes_are_moved_once_a_level(spark):
    chunks = [(d, f"{d}:{i}", i, i // 2, "t", f"text {i}") for d in (1, 2) for i in range(40)]
    grouped = spark.createDataFrame(chunks, "document_id long, chunk_id string, chunk_index long, position long, section_title string, normalized_text string")
    keys = spark.createDataFrame([(1, "a", 40), (2, "b", 40)], "document_id long, context_key string, n_chunks long")
    with joins_shuffle(spark):
        level0 = U.map_nodes(grouped, keys)
        assert plan(level0).count("Exchange hashpartitioning") == 2  # texts, and keys
        without = U.map_nodes(grouped, keys.drop("n_chunks"))
        assert sorted(without.collect()) == sorted(level0.collect())
        tree = U.summary_tree(level0).collect()
    assert sorted((r.document_id, r.level, r.position) for r in tree) == [(d, v, p) for d in (1, 2) for v, n in ((0, 20), (1, 3)) for p in range(n)]
    assert {r.input_hash for r in tree if r.level == 0} == {r.input_hash for r in level0.collect()}


def test_node_hash_is_of_sorted_lines(spark):
    import hashlib

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    grouped = spark.createDataFrame([(1, "b", 1, 0, "t", "two"), (1, "a", 0, 0, "t", "one"), (1, "c", 2, 0, "t", None)],
                                    "document_id long, chunk_id string, chunk_index long, position long, section_title string, normalized_text string")
    keys = spark.createDataFrame([(1, "k")], "document_id long, context_key string")
    lines = f"a:{sha('one')}\nb:{sha('two')}"
    assert U.map_nodes(grouped, keys).first()["input_hash"] == sha(f"k\u001fL0\u001f{lines}")


def test_ocr_lines_are_split_once_and_odd_numbers_cast_to_nothing(spark):
    from pagewright.sources import files as I

    def line(level="5", word="3", conf="90", text="w", more=""):
        return "\t".join([level, "1", "2", "0", "0", word, "10", "20", "18", "10", conf, text]) + more

    good = [line(), line(" +5 "), line("05\x7f"), line(conf=" 9e1 "), line(word="\n7\r"), line(more="\tmore"), line(text="é a")]
    bad = [line("x"), line("5.0"), line("4"), line(""), line("+"), line("٥"), line("5 5"), line(word="2147483648"), line(conf="high"), line(conf="-1"), line(text=" "), "5\t1", "", line()[:-2], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], "n long, value string")
    out = I.parse_ocr_tsv(df, 300)
    assert sorted(r.n for r in out.collect()) == list(range(len(good)))
    assert [(r.word_index, r.text) for r in out.orderBy("n").collect()][4:] == [(7, "w"), (3, "w"), (3, "é a")]
    assert plan(out).count("split(") == 1


def test_bands_leave_the_sheet_where_it_is(spark):
    import re

    from pagewright.operators import layout as L

    rows = [(d, p // 4, p, b, "text", "block", f"Head {p}" if b == 0 and d != 3 else chr(97 + p) * (b + 1), 20.0 + 100 * b, 40.0 + 100 * b, 792.0)
            for d in (1, 2, 3, None) for p in range(9) for b in range(3)]
    names = "document_id long, page_shard long, page_number long, block_index long, block_type string, role string, text string, y0 double, y1 double, page_height double"
    df = spark.createDataFrame(rows, names).repartition("document_id", "page_shard")
    with joins_shuffle(spark):
        out = L.detect_bands(df)
        assert not re.search(r"hashpartitioning\(document_id#\w+, page_shard#\w+, zone", plan(out))
        found = out.filter("is_header or is_footer").select("document_id", "page_number", "block_index").collect()
    # document 3 has a head of its own on each page; rows without a document are not counted together
    assert sorted((r.document_id, r.page_number, r.block_index) for r in found) == [(d, p, 0) for d in (1, 2) for p in range(9)]


def test_refs_put_texts_together_once(spark):
    from pagewright.operators import chunks as K

    parts = spark.createDataFrame(
        [(1, i, 0, i, 0, f"{d}-{i}", 0.0, 0.0, 1.0, 1.0, 0, "digital", "t", None, False, 1) for i, d in enumerate("abac")],
        "document_id long, chunk_index long, part_no int, draft_no long, k int, block_id string, x0 double, y0 double, x1 double, y1 double, reading_order long, "
        "source_method string, part_text string, section_title string, is_table boolean, page_number long")
    parts = parts.withColumn("part_text", parts["block_id"].substr(1, 1))
    out = K.chunk_refs(parts, K.assemble_chunks(parts))
    assert "ArrowEvalPython" not in plan(out)
    assert sorted((r.chunk_index, r.block_id) for r in out.collect()) == [(0, "a-0"), (0, "a-2"), (1, "b-1"), (3, "c-3")]


def test_lines_of_a_model_are_parsed_once(spark):
    import json

    from pagewright.sources import files as I

    def frame(text):
        return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})

    event = json.dumps({"type": "claim", "text": "é", "sourceChunkIds": ["a"]}) + "\n"
    values = [frame(event[:9]), ": keep-alive", "{broken", "", None, "[1]", frame(""), frame(event[9:]), frame('{"type":"final","answerStatus":"answered"}\n'), "data: [DONE]", frame(event)]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line_no long, value string")
    out = I.parse_model_stream(lines)
    assert [(r.seq, r.type, r.text, r.answerStatus) for r in out.orderBy("seq").collect()] == [(1, "claim", "é", None), (2, "final", None, "answered")]
    assert plan(out).count("from_json(") == 2
    alone = I.parse_model_lines(spark.createDataFrame([(1, event), (2, "data: " + event), (3, "[1]"), (4, ": x"), (5, "{broken"), (6, None)], "n long, value string"))
    assert sorted((r.n, r.text, r.sourceChunkIds) for r in alone.collect()) == [(1, "é", ["a"]), (2, "é", ["a"])]
    assert plan(alone).count("from_json(") == 1


def test_rare_pairs_of_ids_are_not_sorted(monkeypatch):
    import numpy as np

    from pagewright.llm import tokenfile as K

    rng = np.random.default_rng(2)
    ids = rng.integers(0, 40000, 50000).astype(np.uint32)
    ids[::10] = 7
    ids[1::10] = 9
    sizes, sort = [], np.sort
    monkeypatch.setattr(K.np, "sort", lambda x: sizes.append(len(x)) or sort(x))
    symbols, rules, starts, base = K.compress(ids, np.array([0, 20000, len(ids)]))
    assert max(sizes) < len(ids) // 2
    assert (7, 9) in {tuple(r) for r in rules.tolist()} and len(symbols) <= len(ids) - 5000
    assert np.array_equal(K.expand(symbols, rules, base), ids)
    assert np.array_equal(K.expand(symbols[: starts[1]], rules, base), ids[:20000])


def test_odd_white_space_is_cut_as_the_vocabulary_cuts_it():
    from pagewright.llm import tokenfile as K

    model = K.library(K.vocabulary_path())
    texts = ["a \x1cb c", "a  b", "a \nb", "end ", " start", "a  b", "a \x85b", "a   b", "plain words only"]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == model.tokens.encode(text, add_special_tokens=False).ids

"""Hand-written cases for text, layout and folds."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import chunks as K
from pagewright.operators import folds
from pagewright.operators import layout as L
from pagewright.operators import ocr as O
from pagewright.operators import summary as U


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("r")).first()["r"]


def test_normalize_keeps_numbers_and_joins_hyphens(spark):
    assert one(spark, T.normalize_text("t"), t="co-\noperate 5 ± 2  mg /dL\r\n\n\n\nA-\nB \x07") == "cooperate 5 ± 2 mg /dL\n\nA-\nB"
    assert one(spark, T.normalize_text("t"), t="é 　\n x") == "é\nx"


def test_number_boundaries(spark):
    def found(hay, num, mode):
        return one(spark, T.number_in_text("h", "n", mode), h=hay, n=num)

    assert not found("150 mg", "50", "claim") and not found("500 people", "50%", "claim")
    assert found("1,000 units", "1000", "claim") and found("8.5", "8", "claim")
    assert not found("8.5", "8", "eval") and not found("50", "50%", "eval") and found("50%", "50%", "eval")


def test_korean_markers(spark):
    assert one(spark, T.has_negation("t"), t="효과가 없다")
    assert not one(spark, T.has_negation("t"), t="효과가 있다")
    assert one(spark, T.population_sentences("t"), t="대상 환자 30명. 끝.") == ["대상 환자 30명."]


def test_measurements_keep_alternative_order(spark):
    assert one(spark, T.measurement_candidates("t"), t="5 mg/dL, 10-20, N = 30, 12.5 %, 65세") == ["5 mg", "10-20", "N = 30", "12.5 %", "65세"]


def test_split_long_text_slices_parts_one_over_the_limit(spark):
    parts = one(spark, T.split_long_text("t", 10), t="aaaa. bbbbb. cccc")
    assert all(len(p) <= 10 for p in parts) and "".join(parts).replace(" ", "") == "aaaa.bbbbb.cccc"


def test_scan_verdicts(spark):
    rows = [
        (5, 1, True, 0.9, True, True, 0.1, "scanned", True, 0.9), (5, 1, True, 0.1, False, True, 0.1, "scanned", True, 0.6),
        (5, 1, True, 0.0, False, False, 0.1, "unknown", False, 0.5), (100, 20, True, 0.1, False, True, 0.01, "scanned", True, 0.7),
        (50, 20, True, 0.5, False, True, 0.2, "mixed", True, 0.8), (500, 90, True, 0.5, False, True, 0.2, "mixed", False, 0.8),
        (500, 90, True, 0.0, False, False, 0.01, "digital", False, 0.95),
    ]
    names = "char_count word_count has_text_blocks image_area_ratio full_page_image has_images text_area_ratio v o c".split()
    df = spark.createDataFrame(rows, names).withColumn("valid_ratio", F.lit(1.0))
    for r in L.classify_pages(df).collect():
        assert (r.scan_verdict, r.requires_ocr, r.extraction_confidence) == (r.v, r.o, r.c)


def block(i, x0, y0, x1, y1, text="body text", page=1, doc=1):
    return (doc, page // S.PAGES_PER_SHARD, page, i, float(x0), float(y0), float(x1), float(y1), "text", text, 612.0, 792.0)


BLOCK = "document_id long, page_shard long, page_number long, block_index long, x0 double, y0 double, x1 double, y1 double, block_type string, text string, page_width double, page_height double"


def test_separator_closes_the_columns_above_it(spark):
    rows = [block(0, 72, 400, 540, 430), block(1, 316, 100, 540, 140), block(2, 72, 100, 296, 140), block(3, 72, 500, 296, 540), block(4, 316, 500, 540, 540)]
    got = L.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("reading_order").collect()
    assert [r.block_index for r in got] == [2, 1, 0, 3, 4] and all(r.two_column for r in got)


def brute_pack(rows, target):
    """Reference packing: (size, kind) in order to group numbers."""
    out, open_, group = [], None, -1
    for size, kind in rows:
        if kind == folds.PLAIN and open_ is not None and open_ + size <= target:
            open_ += size
        else:
            group += 1
            open_ = None if kind == folds.ALONE else size
        out.append(group)
    return out


def test_fold_over_shards_equals_one_pass(spark):
    import random

    rnd = random.Random(3)
    rows, want = [], {}
    for doc in range(6):
        items = [(rnd.randint(1, 60), rnd.choices([folds.PLAIN, folds.TITLE, folds.ALONE], [12, 1, 1])[0]) for _ in range(300)]
        want[doc] = brute_pack(items, 100)
        rows += [(doc, i // 7, i, s, k, f"t{i}" if k == folds.TITLE else None, 1) for i, (s, k) in enumerate(items)]
    df = spark.createDataFrame(rows, "document_id long, shard long, n long, item_size long, item_kind int, item_tag string, item_weight long").repartition(5)
    got = folds.fold(df, ["n"], folds.PackChunks(100), "g", "title").collect()
    for doc in range(6):
        mine = sorted((r for r in got if r.document_id == doc), key=lambda r: r.n)
        assert [r.g for r in mine] == want[doc]
        last = None
        kinds = {r[2]: r[5] for r in rows if r[0] == doc}
        for r in mine:
            last = kinds[r.n] or last
            assert r.title == last


def test_merge_and_group_folds_over_shards(spark):
    import random

    rnd = random.Random(5)
    data = [(1, i // 5, i, rnd.randint(1, 130), folds.PLAIN, f"s{i // 9 % 3}", 1) for i in range(400)]
    df = spark.createDataFrame(data, "document_id long, shard long, n long, item_size long, item_kind int, item_tag string, item_weight long")
    for rule in (folds.MergeShort(120), folds.GroupChunks(600, 500)):
        got = {r.n: r.g for r in folds.fold(df, ["n"], rule, "g").collect()}
        state, group, want = folds.NOTHING, -1, {}
        for _, _, n, size, kind, tag, _ in data:
            if rule.joins(state, size, kind, tag):
                state = (state[0] + size, state[1])
            else:
                group, state = group + 1, rule.fresh(size, kind, tag)
            want[n] = group
        assert got == want


def test_packing_at_scale_keeps_every_chunk(spark):
    n = 7965
    df = spark.range(n).select(
        F.lit(1).cast("bigint").alias("document_id"), F.col("id").alias("chunk_index"), F.concat(F.lit("s"), (F.col("id") % 97).cast("string")).alias("section_title"),
        F.repeat(F.lit("x"), 536).alias("normalized_text"),
    )
    got = U.group_chunks(df).groupBy("position").agg(F.count(F.lit(1)).alias("c")).collect()
    assert len(got) < 900 and sum(r.c for r in got) == n


def test_plan_levels(spark):
    df = spark.createDataFrame([(1, 711), (2, 8), (3, 0)], "document_id long, n long")
    assert {r.document_id: r.sizes for r in U.plan_levels(df).collect()} == {1: [711, 89, 12, 2], 2: [8], 3: []}


def test_bands_are_found_across_shards(spark):
    rows = [block(0, 72, 24, 540, 44, f"Running head {p}", page=p) for p in (1, 300, 600)] + [block(1, 72, 300, 540, 340, f"unique {p}", page=p) for p in (1, 300, 600)]
    df = L.detect_bands(L.sheet(spark.createDataFrame(rows, BLOCK)))
    assert {(r.page_number, r.block_index) for r in df.filter("is_header").collect()} == {(1, 0), (300, 0), (600, 0)}


def test_chunks_do_not_depend_on_the_shard_width(spark, monkeypatch):
    """Documents cut into shards of two pages give the chunks of documents in one shard."""
    from pagewright.plans.layout_queries import laid_out
    from pagewright.sources import corpus as C

    sheet = laid_out(spark, "/root/testdata/sf0.001")
    cols = ["document_id", "chunk_index", "content_hash"]
    a = K.dedupe_chunks(K.assemble_chunks(K.draft_chunks(sheet))).select(*cols).collect()
    monkeypatch.setattr(C.S, "PAGES_PER_SHARD", 2)
    narrow = sheet.withColumn("page_shard", C.page_shard())
    b = K.dedupe_chunks(K.assemble_chunks(K.draft_chunks(narrow))).select(*cols).collect()
    assert sorted(a) == sorted(b) and len(a) > 100


def _plain_normalized(t):
    t = unicodedata.normalize("NFC", t)
    t = re.sub(r"\r\n?", "\n", re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", t) if re.search(r"[\x00-\x08\x0B-\x1F\x7F]", t) else t)
    t = re.sub(r"[ \t\xa0]{2,}|[\t\xa0]", " ", re.sub(r"([a-z])-\n([a-z])", r"\1\2", t))
    t = "\n".join(line.strip(T.SPACE_CHARS) for line in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", t).strip(T.SPACE_CHARS)


def test_normalize_guards_leave_nothing_out(spark):
    draw = random.Random(3)
    parts = ["a", "b-", "é", "e\u0301", "\u2019", "\U0001f600", " ", "\t", "\xa0", "\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x7f", "\x85", "\u2003", "\u3000", "한"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text("t").alias("n"))
    assert [(r.t, r.n) for r in df.collect() if r.n != _plain_normalized(r.t)] == []
    # no test of every character where a search for a text tells as much
    assert r"[ \t\x{A0}]{2}|" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_words_meet_every_box_of_a_page(spark):
    draw = random.Random(4)

    def box():
        x, y = draw.choice([0.0, 5.0, 30.0]), draw.choice([0.0, 7.0, None])
        return x, y, draw.choice([x, x + 10, x + 25, None, float("nan")]), draw.choice([9.0, 20.0, None])

    words = [(draw.choice([1, None]), 0, draw.randrange(4), 0, i, "w", *box()) for i in range(300)]
    # page 1 holds fewer boxes than are looked at first, pages 2 and 3 more
    boxes = [(draw.choice([1, None]), 0, p, n, "text", "digital", "x", *box()) for p, k in ((1, 3), (2, 20), (3, 40)) for n in range(k)]
    edges = "x0 double, y0 double, x1 double, y1 double"
    w = spark.createDataFrame(words, f"document_id long, page_shard long, page_number long, block_index long, word_index long, text string, {edges}")
    b = spark.createDataFrame(boxes, f"document_id long, page_shard long, page_number long, block_index long, block_type string, source_method string, text string, {edges}")
    kept = O.dedupe_ocr_words(w, b)
    pairs = w.join(b.select(*[F.col(c).alias(f"b_{c}") for c in ("document_id", "page_number", "x0", "y0", "x1", "y1")]),
                   F.col("document_id").eqNullSafe(F.col("b_document_id")) & (F.col("page_number") == F.col("b_page_number")))
    hit = {r.word_index for r in pairs.filter(G.overlap_ratio(G.box(), G.box("b_")) >= S.OCR_DEDUPE_OVERLAP).collect()}
    assert 20 < len(hit) < 280
    assert sorted(r.word_index for r in kept.collect()) == [i for i in range(300) if i not in hit]
    # the first boxes are not left to a lambda
    assert re.search(rf"boxes#\d+\[{O.FIRST_BOXES - 1}\]", kept._jdf.queryExecution().optimizedPlan().toString())


def test_clamped_edges_round_as_decimals_do(spark):
    values = [0.0, 1.0, 2.5, 7.005, 7.015, 611.996, 611.995, 612.0, 700.0, -3.0, None, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    box = G.clamp_bbox((F.col("v"), F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.lit(612.0), F.lit(792.0))
    plain = F.bround(F.greatest(F.lit(0.0), F.least("v", F.lit(612.0))), 2)
    assert [str(r.a) for r in df.select(box["x1"].alias("a")).collect()] == [str(r.a) for r in df.select(F.coalesce(plain, F.lit(0.0)).alias("a")).collect()]

"""Queries for page measures and layout reconstruction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import layout as L
from pagewright.plans import oracle_views as V
from pagewright.plans.registry import query
from pagewright.session import per_folder, shared_folder
from pagewright.sources import corpus as C
from pagewright.sources import files as I

VIEWS = V.VIEWS
KEY = ["document_id", "page_number", "block_index"]
TEXT_OK = f"(block_type = 'text' AND NOT ({V.blank('text')}))"

VIEWS["o_coverage"] = f"""
SELECT p.*, least(1.0, coalesce(i.a/(612.0*792.0), 0.0)) AS image_area_ratio, coalesce(i.m/(612.0*792.0) >= {S.FULL_PAGE_IMAGE_RATIO}, false) AS full_page_image,
  i.n IS NOT NULL AS has_images, least(1.0, coalesce(b.a/(612.0*792.0), 0.0)) AS text_area_ratio
FROM v_pages p
LEFT JOIN (SELECT document_id, page_number, sum({V.box_area('')}) a, max({V.box_area('')}) m, count(*) n FROM v_images GROUP BY ALL) i USING (document_id, page_number)
LEFT JOIN (SELECT document_id, page_number, sum({V.box_area('')}) a FROM v_blocks GROUP BY ALL) b USING (document_id, page_number)"""

VIEWS["o_scan"] = f"""
SELECT *, CASE WHEN few AND has_images THEN 'scanned' WHEN few THEN 'unknown' WHEN valid < {S.SCAN_VALID_CHAR_RATIO} THEN 'unknown'
  WHEN sparse AND char_count < {S.SCAN_DIGITAL_MIN_CHARS} THEN 'scanned' WHEN image_area_ratio >= {S.SCAN_IMAGE_RATIO_MIXED} THEN 'mixed' ELSE 'digital' END AS scan_verdict,
  CASE WHEN few THEN has_images WHEN valid < {S.SCAN_VALID_CHAR_RATIO} THEN true WHEN sparse AND char_count < {S.SCAN_DIGITAL_MIN_CHARS} THEN true
  WHEN image_area_ratio >= {S.SCAN_IMAGE_RATIO_MIXED} THEN char_count <= {S.OCR_MIXED_MAX_CHARS} ELSE false END AS requires_ocr,
  (CASE WHEN few AND has_images THEN CASE WHEN full_page_image OR image_area_ratio >= {S.SCAN_IMAGE_RATIO_SCANNED} THEN 0.9 ELSE 0.6 END WHEN few THEN 0.5
  WHEN valid < {S.SCAN_VALID_CHAR_RATIO} THEN 0.5 WHEN sparse AND char_count < {S.SCAN_DIGITAL_MIN_CHARS} THEN 0.7 WHEN image_area_ratio >= {S.SCAN_IMAGE_RATIO_MIXED} THEN 0.8 ELSE 0.95 END)::DOUBLE AS extraction_confidence
FROM (SELECT *, char_count < {S.SCAN_MIN_CHARS} OR word_count < {S.SCAN_MIN_WORDS} OR NOT has_text_blocks AS few,
    has_images AND (full_page_image OR text_area_ratio < {S.SCAN_MIN_TEXT_AREA_RATIO}) AS sparse,
    CASE WHEN char_count = 0 THEN 1.0 ELSE length(regexp_replace({V.collapse('raw_text', '')}, '[\\p{{C}}\\p{{Z}}\\x{{FFFD}}]', '', 'g'))/char_count::DOUBLE END AS valid
  FROM (SELECT c.*, length({V.collapse('raw_text', '')}) AS char_count, coalesce(w.n, 0) AS word_count, t.has_text_blocks FROM o_coverage c
    LEFT JOIN (SELECT document_id, page_number, count(*) n FROM v_words GROUP BY ALL) w USING (document_id, page_number)
    LEFT JOIN (SELECT document_id, page_number, bool_or({TEXT_OK}) has_text_blocks FROM v_blocks GROUP BY ALL) t USING (document_id, page_number)))"""

VIEWS["o_kinds"] = f"""
SELECT *, CASE WHEN NOT is_text THEN NULL WHEN y0 >= 792.0*{S.FOOTNOTE_ZONE} THEN 'footnote' WHEN x1-x0 >= cw*{S.FULL_WIDTH_RATIO} THEN 'separator'
  WHEN x1 <= cx+cw/2+612.0*{S.STRADDLE_TOLERANCE} THEN 'left' WHEN x0 >= cx+cw/2-612.0*{S.STRADDLE_TOLERANCE} THEN 'right' ELSE 'straddler' END AS column_kind
FROM (SELECT *, min(CASE WHEN is_text THEN x0 END) OVER w AS cx, greatest(max(CASE WHEN is_text THEN x1 END) OVER w - min(CASE WHEN is_text THEN x0 END) OVER w, 1.0) AS cw
  FROM (SELECT *, {TEXT_OK} AS is_text FROM v_blocks) WINDOW w AS (PARTITION BY document_id, page_number))"""

VIEWS["o_cols"] = f"""
SELECT *, n_left >= 1 AND n_right >= 1 AND n_left+n_right >= {S.TWO_COLUMN_MIN_BLOCKS} AND n_straddlers <= greatest(1, (n_left+n_right)//3) AS two_column
FROM (SELECT *, count(*) FILTER (column_kind='left') OVER w AS n_left, count(*) FILTER (column_kind='right') OVER w AS n_right,
  count(*) FILTER (column_kind='straddler') OVER w AS n_straddlers FROM o_kinds WINDOW w AS (PARTITION BY document_id, page_number))"""

VIEWS["o_order"] = f"""
SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY NOT is_text, is_text AND column_kind='footnote', band, side,
    CASE WHEN NOT is_text THEN 0 WHEN two_column THEN y0 ELSE round_even(y0, 1) END, CASE WHEN is_text THEN x0 ELSE 0 END, block_index) - 1 AS reading_order,
  (CASE WHEN n_straddlers > 0 THEN {S.CONFIDENCE_STRADDLE} WHEN two_column THEN {S.CONFIDENCE_TWO_COLUMN} ELSE 1.0 END)::DOUBLE AS order_confidence
FROM (SELECT c.*, CASE WHEN two_column AND is_text THEN (SELECT count(*) FROM o_cols s WHERE s.document_id=c.document_id AND s.page_number=c.page_number
     AND s.column_kind IN ('separator','straddler') AND s.y1 <= c.y0+{S.BAND_EPSILON}) ELSE 0 END AS band,
   CASE WHEN two_column AND is_text THEN CASE WHEN column_kind='right' THEN 1 WHEN column_kind IN ('separator','straddler') THEN 2 ELSE 0 END ELSE 0 END AS side FROM o_cols c)"""

VIEWS["o_tablemark"] = f"""
SELECT b.*, EXISTS (SELECT 1 FROM v_tables t WHERE t.document_id=b.document_id AND t.page_number=b.page_number AND {V.overlap('b.', 't.')} >= {S.TABLE_BLOCK_OVERLAP}) AS is_table
FROM v_blocks b"""

CAPTION_SQL = T.CAPTION.replace(T.SPACE, T.SPACE_RE2)
VIEWS["o_captions"] = f"""
SELECT b.*, regexp_matches(text, '{CAPTION_SQL}') AND EXISTS (SELECT 1 FROM (SELECT document_id, page_number, x0, y0, x1, y1 FROM v_tables UNION ALL
    SELECT document_id, page_number, x0, y0, x1, y1 FROM v_images) t
  WHERE t.document_id=b.document_id AND t.page_number=b.page_number AND {V.vertical('b.', 't.')} <= {S.CAPTION_MAX_DISTANCE}) AS is_caption
FROM (SELECT * REPLACE (CASE WHEN block_index % 4 = 1 THEN 'Figure '||block_index||'. '||text WHEN block_index % 4 = 2 THEN 'tableau '||text ELSE text END AS text) FROM v_blocks) b"""

VIEWS["o_zones"] = f"""
SELECT *, CASE WHEN bt = '' THEN NULL WHEN y1 <= 792.0*{S.HEADER_ZONE}*{S.HEADER_ZONE_BOTTOM_FACTOR} AND y0 <= 792.0*{S.HEADER_ZONE} THEN 'header'
   WHEN y0 >= 792.0*{S.FOOTER_ZONE} THEN 'footer' END AS zone, {V.fingerprint('bt')} AS fp
FROM (SELECT *, {V.strip('text')} AS bt FROM v_blocks)"""
VIEWS["o_bands"] = f"""
SELECT z.*, coalesce(zone='header' AND (r.fp IS NOT NULL OR lone), false) AS is_header, coalesce(zone='footer' AND (r.fp IS NOT NULL OR lone), false) AS is_footer
FROM (SELECT *, length(bt) <= {S.PAGE_NUMBER_MAX_CHARS} AND regexp_matches(bt, '{T.PAGE_NUMBER.replace(T.SPACE, T.SPACE_RE2)}') AS lone FROM o_zones) z
LEFT JOIN (SELECT document_id, zone AS rz, fp FROM (SELECT document_id, zone, fp, count(DISTINCT page_number) n FROM o_zones
    WHERE zone IS NOT NULL AND length(bt) <= {S.BAND_MAX_CHARS} GROUP BY ALL)
  JOIN (SELECT document_id, count(DISTINCT page_number) t FROM v_blocks GROUP BY ALL) USING (document_id)
  WHERE n >= greatest({S.REPEAT_MIN_PAGES}, floor(t*{S.REPEAT_MIN_FRACTION}))) r ON r.document_id=z.document_id AND r.rz=z.zone AND r.fp=z.fp"""
VIEWS["o_layout"] = """
SELECT o.*, t.is_table, b.is_header, b.is_footer FROM o_order o JOIN o_tablemark t USING (document_id, page_number, block_index)
JOIN o_bands b USING (document_id, page_number, block_index)"""


@per_folder
def measured(spark, folder):
    return L.measure_pages(C.v_pages(spark, folder), C.v_images(spark, folder), C.v_blocks(spark, folder), C.v_words(spark, folder))


@per_folder
def laid_out(spark, folder):
    return L.lay_out(C.v_blocks(spark, folder), C.v_tables(spark, folder), C.v_images(spark, folder))


@query("page_coverage", """SELECT document_id, page_number, round(image_area_ratio, 6) AS image_area_ratio, full_page_image, has_images,
  round(text_area_ratio, 6) AS text_area_ratio FROM o_coverage""")
def _page_coverage(spark, folder):
    return L.page_coverage(C.v_pages(spark, folder), C.v_images(spark, folder), C.v_blocks(spark, folder)).select(
        "document_id", "page_number", F.round("image_area_ratio", 6).alias("image_area_ratio"), "full_page_image",
        "has_images", F.round("text_area_ratio", 6).alias("text_area_ratio"),
    )


@query("classify_pages", """SELECT document_id, page_number, char_count::BIGINT AS char_count, word_count::BIGINT AS word_count,
  scan_verdict, requires_ocr, extraction_confidence FROM o_scan""")
def _classify_pages(spark, folder):
    return L.classify_pages(measured(spark, folder)).select(
        "document_id", "page_number", "char_count", "word_count", "scan_verdict", "requires_ocr", "extraction_confidence"
    )


@query("classify_columns", "SELECT document_id, page_number, block_index, column_kind FROM o_kinds")
def _classify_columns(spark, folder):
    return L.classify_columns(C.v_blocks(spark, folder)).select(*KEY, "column_kind")


@query("detect_two_column", "SELECT document_id, page_number, block_index, n_left, n_right, n_straddlers, two_column FROM o_cols")
def _detect_two_column(spark, folder):
    kinds = L.classify_columns(C.v_blocks(spark, folder))
    return L.detect_two_column(kinds).select(*KEY, "n_left", "n_right", "n_straddlers", "two_column")


@query("reading_order", "SELECT document_id, page_number, block_index, reading_order FROM o_order")
def _reading_order(spark, folder):
    return L.reading_order(C.v_blocks(spark, folder)).select(*KEY, "reading_order")


@query("reading_order_confidence", "SELECT DISTINCT document_id, page_number, two_column, order_confidence FROM o_order")
def _reading_order_confidence(spark, folder):
    df = L.detect_two_column(L.classify_columns(C.v_blocks(spark, folder)))
    return df.select("document_id", "page_number", "two_column", L.reading_order_confidence().alias("order_confidence")).distinct()


@query("mark_table_blocks", "SELECT document_id, page_number, block_index, is_table FROM o_tablemark")
def _mark_table_blocks(spark, folder):
    return L.only_blocks(L.mark_table_blocks(L.sheet(C.v_blocks(spark, folder), C.v_tables(spark, folder)))).select(*KEY, "is_table")


@query("mark_captions", "SELECT document_id, page_number, block_index, is_caption FROM o_captions")
def _mark_captions(spark, folder):
    slot = F.col("block_index")
    b = C.v_blocks(spark, folder).withColumn(
        "text",
        F.when(slot % 4 == 1, F.concat(F.lit("Figure "), slot.cast("string"), F.lit(". "), "text"))
        .when(slot % 4 == 2, F.concat(F.lit("tableau "), "text")).otherwise(F.col("text")),
    )
    return L.only_blocks(L.mark_captions(L.sheet(b, C.v_tables(spark, folder), C.v_images(spark, folder)))).select(*KEY, "is_caption")


@query("detect_bands", "SELECT document_id, page_number, block_index, is_header, is_footer FROM o_bands")
def _detect_bands(spark, folder):
    return L.detect_bands(L.sheet(C.v_blocks(spark, folder))).select(*KEY, "is_header", "is_footer")


@query("page_text", f"""SELECT document_id, page_number, coalesce(string_agg(clean, chr(10)||chr(10) ORDER BY reading_order), '') AS normalized_text
FROM (SELECT document_id, page_number, reading_order, CASE WHEN NOT (is_table OR is_header OR is_footer) AND NOT ({V.blank('text')}) THEN nullif({V.normalize('text')}, '') END AS clean FROM o_layout)
GROUP BY ALL""")
def _page_text(spark, folder):
    return L.page_text(L.only_blocks(laid_out(spark, folder))).select("document_id", "page_number", "normalized_text")


ROLL_SQL = """
SELECT document_id, extracted, ocr_required, failed, CASE WHEN extracted+ocr_required+failed=0 THEN 'extraction_failed' WHEN failed=0 AND ocr_required=0 THEN 'extracted'
  WHEN extracted=0 AND ocr_required>0 AND failed=0 THEN 'ocr_required' WHEN extracted=0 AND ocr_required=0 THEN 'extraction_failed' ELSE 'partially_extracted' END AS processing_status
FROM (SELECT document_id, count(*) FILTER (s='extracted') AS extracted, count(*) FILTER (s='ocr_required') AS ocr_required, count(*) FILTER (s='failed') AS failed
  FROM (SELECT document_id, CASE WHEN (document_id+page_number)%13=0 THEN 'failed' WHEN requires_ocr THEN 'ocr_required' ELSE 'extracted' END AS s FROM o_scan) GROUP BY ALL)"""


@query("extraction_rollup", ROLL_SQL)
def _extraction_rollup(spark, folder):
    p = L.classify_pages(measured(spark, folder)).select(
        "document_id",
        F.when((F.col("document_id") + F.col("page_number")) % 13 == 0, "failed")
        .when(F.col("requires_ocr"), "ocr_required").otherwise("extracted").alias("extraction_status"),
    )
    return L.extraction_rollup(p)


@query("isolate_bad_pages", """
SELECT document_id, CASE WHEN k=3 THEN NULL WHEN k=4 THEN 0 ELSE page_number END AS page_number, CASE WHEN k IN (1,2,3,4,5) THEN 0.0 ELSE 612.0 END::DOUBLE AS width,
  CASE WHEN k IN (1,2,3,4,5) THEN 0.0 ELSE 792.0 END::DOUBLE AS height, CASE WHEN k IN (1,2,3,4,5) THEN '' ELSE raw_text END AS raw_text,
  CASE WHEN k IN (1,2,3,4,5) THEN 'failed' ELSE 'pending' END AS extraction_status, CASE WHEN k IN (1,2,3,4,5) THEN 'none' ELSE 'digital' END AS extraction_method,
  CASE WHEN k IN (3,4) THEN 'bad_page_number' WHEN k IN (1,2) THEN 'bad_geometry' WHEN k=5 THEN 'missing_text' END AS error_code
FROM (SELECT *, (document_id+page_number) % 19 AS k FROM v_pages)""")
def _isolate_bad_pages(spark, folder):
    k = (F.col("document_id") + F.col("page_number")) % 19
    raw = C.v_pages(spark, folder).select(
        "document_id",
        F.when(k == 3, "one").when(k == 4, "0").otherwise(F.col("page_number").cast("string")).alias("page_number"),
        F.when(k == 1, "wide").otherwise(F.col("width").cast("string")).alias("width"),
        F.when(k == 2, "-1").otherwise(F.col("height").cast("string")).alias("height"),
        F.when(k != 5, F.col("raw_text")).alias("raw_text"),
    )
    return L.isolate_bad_pages(raw)


@query("read_layout", """SELECT document_id, page_shard, count(*) AS blocks, count(DISTINCT page_number) AS pages, sum(length(text))::BIGINT AS chars,
  count(*) FILTER (source_method='ocr') AS ocr_blocks, round(sum(x1-x0), 3) AS widths FROM v_blocks GROUP BY ALL""")
def _read_layout(spark, folder):
    return parser_output(spark, folder).blocks.groupBy("document_id", "page_shard").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("page_number").alias("pages"), F.sum(F.length("text")).alias("chars"),
        F.count(F.when(F.col("source_method") == "ocr", 1)).alias("ocr_blocks"), F.round(F.sum(F.col("x1") - F.col("x0")), 3).alias("widths"),
    )


@per_folder
def parser_output(spark, folder):
    """All pages as a parser writes them, in files of JSON lines, and read again.

    Beside its good line, every third page has a second one with a fault, which must not reach any table.
    """
    at = ["document_id", "page_number"]

    def gathered(df, name, *fields):
        box = F.array("x0", "y0", "x1", "y1").alias("bbox")
        return df.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(*fields, box))).alias(name))

    # blocks are moved once and cut into words where their page is gathered, as words with their boxes take several times the room
    blocks = C.v_blocks(spark, folder).repartition(*at)
    line = F.array(F.struct(F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", F.lit(0).alias("line_index"))).alias("lines")
    tables = C.tables_of(blocks).select("*", F.col("markdown_text").alias("markdown"))
    pages = C.v_pages(spark, folder).join(gathered(blocks, "blocks", "block_index", "text", "block_type", "source_method", line), at)
    pages = pages.join(gathered(C.words_of(blocks), "words", "block_index", F.lit(0).alias("line_index"), "word_index", "text"), at, "left")
    pages = pages.join(gathered(tables, "tables", "table_index", "markdown"), at, "left")
    images = C.v_images(spark, folder).select(*at, F.array(F.array("x0", "y0", "x1", "y1")).alias("image_bboxes"))
    pages = pages.join(images, at, "left").drop("page_shard")
    good = F.to_json(F.struct(*pages.columns))
    k = (F.col("document_id") + F.col("page_number")) % 15

    def but(**changed):
        return F.to_json(F.struct(*[changed[c].alias(c) if c in changed else F.col(c) for c in pages.columns]))

    first = F.get("blocks", F.lit(0))
    faulty = (
        F.when(k == 0, F.substring(good, 1, 40)).when(k == 3, but(page_number=F.lit(0))).when(k == 6, but(width=F.lit(-1.0)))
        .when(k == 9, but(blocks=F.array(first.withField("bbox", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))))).when(k == 12, but(blocks=F.array(first, first)))
    )
    files = f"{shared_folder(spark)}/layout-{uuid.uuid4().hex}"
    pages.select(F.explode(F.array_compact(F.array(good, faulty))).alias("value")).write.text(files, compression="gzip")
    return I.read_layout(spark, files)


@query("layout_quarantine", """SELECT ['malformed','no_page','bad_size','bad_box','bad_block'][k//3+1] AS reason, CASE WHEN k > 0 THEN document_id END AS document_id,
  count(*) AS lines, min(CASE k WHEN 0 THEN NULL WHEN 3 THEN 0 ELSE page_number END) AS first_page
FROM (SELECT document_id, page_number, (document_id + page_number) % 15 AS k FROM v_pages) WHERE k % 3 = 0 GROUP BY ALL""")
def _layout_quarantine(spark, folder):
    return parser_output(spark, folder).rejected.groupBy("reason", "document_id").agg(F.count(F.lit(1)).alias("lines"), F.min("page_number").alias("first_page"))


@query("layout_parts", """SELECT part, document_id, page_shard, count(*) AS n, sum(length(text))::BIGINT AS chars, round(sum(x1-x0), 2) AS widths, round(sum(y1-y0), 2) AS heights FROM (
  SELECT 'line' AS part, document_id, page_shard, text, x0, y0, x1, y1 FROM v_blocks
  UNION ALL SELECT 'word', document_id, page_shard, text, x0, y0, x1, y1 FROM v_words
  UNION ALL SELECT 'table', document_id, page_shard, markdown_text, x0, y0, x1, y1 FROM v_tables
  UNION ALL SELECT 'image', document_id, page_shard, '', x0, y0, x1, y1 FROM v_images) GROUP BY ALL""")
def _layout_parts(spark, folder):
    found = parser_output(spark, folder)

    def part(name, df, text):
        return df.select(F.lit(name).alias("part"), "document_id", "page_shard", text.alias("text"), "x0", "y0", "x1", "y1")

    rows = part("line", found.lines, F.col("text")).unionByName(part("word", found.words, F.col("text")))
    rows = rows.unionByName(part("table", found.tables, F.col("markdown"))).unionByName(part("image", found.images, F.lit("")))
    return rows.groupBy("part", "document_id", "page_shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"),
        F.round(F.sum(F.col("x1") - F.col("x0")), 2).alias("widths"), F.round(F.sum(F.col("y1") - F.col("y0")), 2).alias("heights"))

"""Layout reconstruction: columns, reading order, tables, captions, repeated bands, page text.

Blocks, tables and images of a page meet as rows of one *sheet*, clustered by SHARD =
(document_id, page_shard), a fixed run of pages.  Every page-level step is a window over
PAGE = (document_id, page_shard, page_number), which that one shuffle already satisfies, so a whole
layout pass shuffles once and joins nothing.  A page holds a physically bounded number of blocks and
a shard a fixed number of pages, so no task depends on how long a document is; document-level
counts are combined from shard counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T

SHARD = ["document_id", "page_shard"]
PAGE = [*SHARD, "page_number"]


def _is_text():
    return (F.col("block_type") == "text") & ~T.is_blank("text")


# --- page measures -----------------------------------------------------------------------

def _measures(pages: DataFrame, images: DataFrame, blocks: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Page measures from one grouping over pages, images, blocks and words together."""
    names = {
        "width": "double", "height": "double", "char_count": "bigint", "valid_ratio": "double",
        "image_area": "double", "text_area": "double", "text_block": "boolean", "word": "bigint",
    }

    def rows(df, **values):
        cols = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
        return df.select(*PAGE, *cols)

    parts = rows(
        pages, width=F.col("width"), height=F.col("height"),
        char_count=T.nonspace_char_count("raw_text"), valid_ratio=T.valid_char_ratio("raw_text"),
    )
    parts = parts.unionByName(rows(images, image_area=G.bbox_area(G.box())))
    is_block = F.col("block_type") == "text"
    parts = parts.unionByName(rows(blocks, text_area=F.when(is_block, G.bbox_area(G.box())), text_block=_is_text()))
    if words is not None:
        parts = parts.unionByName(rows(words, word=F.lit(1)))
    area = F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    sums = parts.groupBy(*PAGE).agg(
        *[F.max(n).alias(n) for n in ("width", "height", "char_count", "valid_ratio")],
        F.coalesce(F.sum("image_area"), F.lit(0.0)).alias("image_area"),
        F.coalesce(F.max("image_area"), F.lit(0.0)).alias("largest_image"),
        F.count("image_area").alias("images"),
        F.coalesce(F.sum("text_area"), F.lit(0.0)).alias("text_area"),
        F.coalesce(F.bool_or("text_block"), F.lit(False)).alias("has_text_blocks"),
        F.count("word").alias("word_count"),
    )
    return sums.filter("width is not null").withColumns(
        {
            "image_area_ratio": F.least(F.lit(1.0), F.col("image_area") / area),
            "full_page_image": F.col("largest_image") / area >= S.FULL_PAGE_IMAGE_RATIO,
            "has_images": F.col("images") > 0,
            "text_area_ratio": F.least(F.lit(1.0), F.col("text_area") / area),
        }
    ).drop("image_area", "largest_image", "images", "text_area")


def page_coverage(pages: DataFrame, images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Share of every page under images and under text."""
    return _measures(pages, images, blocks).drop("word_count")


def measure_pages(pages: DataFrame, images: DataFrame, blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Everything `classify_pages` needs."""
    return _measures(pages, images, blocks, words)


def classify_pages(pages: DataFrame) -> DataFrame:
    """Scan verdict, OCR need and confidence from the page measures, as one decision table."""
    chars, words = F.col("char_count"), F.col("word_count")
    no_text = (chars < S.SCAN_MIN_CHARS) | (words < S.SCAN_MIN_WORDS) | ~F.col("has_text_blocks")
    sure = F.col("full_page_image") | (F.col("image_area_ratio") >= S.SCAN_IMAGE_RATIO_SCANNED)
    sparse = F.col("has_images") & (
        F.col("full_page_image") | (F.col("text_area_ratio") < S.SCAN_MIN_TEXT_AREA_RATIO)
    )

    def result(verdict, ocr, confidence):
        conf = confidence if not isinstance(confidence, float) else F.lit(confidence)
        need = ocr if not isinstance(ocr, bool) else F.lit(ocr)
        return F.struct(F.lit(verdict).alias("verdict"), need.alias("requires_ocr"), conf.alias("confidence"))

    verdict = (
        F.when(no_text & F.col("has_images"), result("scanned", True, F.when(sure, 0.9).otherwise(0.6)))
        .when(no_text, result("unknown", False, 0.5))
        .when(F.col("valid_ratio") < S.SCAN_VALID_CHAR_RATIO, result("unknown", True, 0.5))
        .when(sparse & (chars < S.SCAN_DIGITAL_MIN_CHARS), result("scanned", True, 0.7))
        .when(F.col("image_area_ratio") >= S.SCAN_IMAGE_RATIO_MIXED, result("mixed", chars <= S.OCR_MIXED_MAX_CHARS, 0.8))
        .otherwise(result("digital", False, 0.95))
    )
    return pages.withColumn("scan", verdict).select(
        "*", F.col("scan.verdict").alias("scan_verdict"), F.col("scan.requires_ocr").alias("requires_ocr"),
        F.col("scan.confidence").alias("extraction_confidence"),
    ).drop("scan")


# --- reading order -------------------------------------------------------------------------

def classify_columns(blocks: DataFrame) -> DataFrame:
    """Column kind of every text block, from the extent of the text on its page."""
    page = Window.partitionBy(*PAGE)
    df = blocks.withColumn("is_text", F.coalesce(_is_text(), F.lit(False)))
    df = df.withColumn("content_x0", F.min(F.when(F.col("is_text"), F.col("x0"))).over(page)).withColumn(
        "content_x1", F.max(F.when(F.col("is_text"), F.col("x1"))).over(page)
    )
    content = F.greatest(F.col("content_x1") - F.col("content_x0"), F.lit(1.0))
    middle = F.col("content_x0") + content / 2
    slack = F.col("page_width") * S.STRADDLE_TOLERANCE
    kind = (
        F.when(~F.col("is_text"), F.lit(None).cast("string"))
        .when(F.col("y0") >= F.col("page_height") * S.FOOTNOTE_ZONE, "footnote")
        .when(F.col("x1") - F.col("x0") >= content * S.FULL_WIDTH_RATIO, "separator")
        .when(F.col("x1") <= middle + slack, "left")
        .when(F.col("x0") >= middle - slack, "right")
        .otherwise("straddler")
    )
    return df.withColumn("column_kind", kind).drop("content_x0", "content_x1")


def detect_two_column(kinds: DataFrame) -> DataFrame:
    """Page-wide column counts and the two-column decision, on every row."""
    page = Window.partitionBy(*PAGE)

    def n(*names):
        return F.count(F.when(F.col("column_kind").isin(*names), 1)).over(page)

    df = kinds.withColumns({"n_left": n("left"), "n_right": n("right"), "n_straddlers": n("straddler")})
    body = F.col("n_left") + F.col("n_right")
    return df.withColumn(
        "two_column",
        (F.col("n_left") >= 1) & (F.col("n_right") >= 1) & (body >= S.TWO_COLUMN_MIN_BLOCKS)
        & (F.col("n_straddlers") <= F.greatest(F.lit(1), F.floor(body / 3))),
    )


def reading_order(blocks: DataFrame) -> DataFrame:
    """Zero-based visual order of the blocks of every page, with its confidence."""
    page = Window.partitionBy(*PAGE)
    df = detect_two_column(classify_columns(blocks))
    divides = F.col("column_kind").isin("separator", "straddler")
    df = df.withColumn("bottoms", F.collect_list(F.when(divides, F.col("y1"))).over(page))
    band = F.size(F.filter("bottoms", lambda y: y <= F.col("y0") + S.BAND_EPSILON))
    side = F.when(F.col("column_kind") == "right", 1).when(divides, 2).otherwise(0)
    two = F.col("two_column")
    ordered = df.withColumns(
        {
            "band": F.when(two & F.col("is_text"), band).otherwise(0),
            "side": F.when(two & F.col("is_text"), side).otherwise(0),
        }
    )
    order = page.orderBy(
        ~F.col("is_text"),
        F.col("is_text") & (F.col("column_kind") == "footnote"),
        "band", "side",
        F.when(~F.col("is_text"), F.lit(0.0)).when(two, F.col("y0")).otherwise(F.bround("y0", 1)),
        F.when(F.col("is_text"), F.col("x0")).otherwise(0.0),
        "block_index",
    )
    return ordered.withColumns(
        {"reading_order": (F.row_number().over(order) - 1).cast("bigint"), "order_confidence": reading_order_confidence()}
    ).drop("bottoms", "side")


def reading_order_confidence():
    """1.0 for plain pages, lower for two columns, lowest when blocks straddle the middle."""
    return (
        F.when(F.col("n_straddlers") > 0, S.CONFIDENCE_STRADDLE)
        .when(F.col("two_column"), S.CONFIDENCE_TWO_COLUMN)
        .otherwise(1.0)
    )


# --- tables and captions ------------------------------------------------------------------------

def sheet(blocks: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Rows of blocks, tables and images together, clustered by shard; `role` tells them apart."""
    df = blocks.withColumn("role", F.lit("block"))
    for role, boxes in (("table", tables), ("image", images)):
        if boxes is not None:
            df = df.unionByName(boxes.withColumn("role", F.lit(role)), allowMissingColumns=True)
    return df.repartition(*SHARD)


def only_blocks(df: DataFrame) -> DataFrame:
    extra = [c for c in ("role", "table_index", "markdown_text") if c in df.columns]
    return df.filter("role = 'block'").drop(*extra)


def _page_boxes(*roles: str):
    """All boxes of the given roles on the page of a row, in one array (bounded by the page)."""
    box = F.struct("x0", "y0", "x1", "y1")
    return F.collect_list(F.when(F.col("role").isin(*roles), box)).over(Window.partitionBy(*PAGE))


def _fields(b):
    return b["x0"], b["y0"], b["x1"], b["y1"]


def mark_table_blocks(page_sheet: DataFrame) -> DataFrame:
    """Flag text blocks that lie inside a table of their page."""
    df = page_sheet.withColumn("boxes", _page_boxes("table"))
    inside = F.exists("boxes", lambda b: G.overlap_ratio(G.box(), _fields(b)) >= S.TABLE_BLOCK_OVERLAP)
    return df.withColumn("is_table", F.coalesce((F.col("block_type") == "text") & inside, F.lit(False))).drop("boxes")


def mark_captions(page_sheet: DataFrame) -> DataFrame:
    """Flag numbered figure and table captions close to an image or table of their page."""
    df = page_sheet.withColumn("boxes", _page_boxes("table", "image"))
    near = F.exists("boxes", lambda b: G.vertical_distance(G.box(), _fields(b)) <= S.CAPTION_MAX_DISTANCE)
    flag = (F.col("block_type") == "text") & F.col("text").rlike(T.CAPTION) & near
    return df.withColumn("is_caption", F.coalesce(flag, F.lit(False))).drop("boxes")


# --- repeated headers and footers ------------------------------------------------------------------

def band_zone(y0="y0", y1="y1", height="page_height"):
    y0, y1, h = T.col(y0), T.col(y1), T.col(height)
    top = h * S.HEADER_ZONE
    return F.when((y1 <= top * S.HEADER_ZONE_BOTTOM_FACTOR) & (y0 <= top), "header").when(
        y0 >= h * S.FOOTER_ZONE, "footer"
    )


def detect_bands(blocks: DataFrame) -> DataFrame:
    """Flag repeated headers and footers, and lone page numbers in those zones.

    `blocks` are clustered by shard.  Pages and keys are counted inside each shard, the shard counts are
    summed per document and key, and both are looked up again per shard, so a single huge document is neither
    counted nor joined in one task.
    """
    real = F.coalesce((F.col("block_type") != "image") & (F.col("role") == "block"), F.lit(False))
    body = T.strip(F.coalesce("text", F.lit("")))
    df = blocks.withColumn("band_text", body)
    df = df.withColumn("zone", F.when(real & (F.col("band_text") != "") & (F.col("page_height") > 0), band_zone()))
    df = df.withColumn("fp", F.when(F.col("zone").isNotNull(), T.band_fingerprint("band_text")))

    # the length limit applies to counting only; longer texts are still marked by their truncated key
    counted = F.col("zone").isNotNull() & (F.length("band_text") <= S.BAND_MAX_CHARS)
    key_page = Window.partitionBy(*SHARD, "zone", "fp", "page_number").orderBy((~counted).cast("int"))
    df = df.withColumn("key_page", (F.row_number().over(key_page) == 1) & counted)
    df = df.withColumn("key_pages", F.count(F.when(F.col("key_page"), 1)).over(Window.partitionBy(*SHARD, "zone", "fp")))
    first = Window.partitionBy(*PAGE).orderBy((~real).cast("int"))
    df = df.withColumn("page_mark", (F.row_number().over(first) == 1) & real)
    df = df.withColumn("total_pages", F.count(F.when(F.col("page_mark"), 1)).over(Window.partitionBy(*SHARD)))
    keys = df.filter("zone is not null").groupBy(*SHARD, "zone", "fp").agg(F.max("key_pages").alias("n"))
    shards = df.groupBy(*SHARD).agg(F.max("total_pages").alias("n"))
    # only the shards of a document, not its keys, meet its total
    totals = shards.drop("n").join(shards.groupBy("document_id").agg(F.sum("n").alias("doc_pages")), "document_id")
    sums = keys.groupBy("document_id", "zone", "fp").agg(F.sum("n").alias("doc_key_pages"))
    needed = F.greatest(F.lit(S.REPEAT_MIN_PAGES), F.floor(F.col("doc_pages") * S.REPEAT_MIN_FRACTION))
    # few keys of a document are repeated on so many of its pages; they come to its shards as one short array, so that the sheet stays where it is
    repeated = sums.join(totals.select("document_id", "doc_pages").distinct(), "document_id").filter(F.col("doc_key_pages") >= needed)
    repeated = repeated.groupBy("document_id").agg(F.collect_list(F.struct("zone", "fp")).alias("repeated"))
    df = df.join(totals.select(*SHARD).join(repeated, "document_id"), SHARD, "left")
    lone = (F.length("band_text") <= S.PAGE_NUMBER_MAX_CHARS) & T.is_page_number_line("band_text")
    known = F.coalesce(F.exists("repeated", lambda k: (k["zone"] == F.col("zone")) & (k["fp"] == F.col("fp"))), F.lit(False))
    is_band = F.col("zone").isNotNull() & (known | lone)
    return df.withColumns(
        {
            "is_header": F.coalesce(is_band & (F.col("zone") == "header"), F.lit(False)),
            "is_footer": F.coalesce(is_band & (F.col("zone") == "footer"), F.lit(False)),
        }
    ).drop("band_text", "zone", "fp", "key_page", "key_pages", "page_mark", "total_pages", "repeated")


# --- page text and document status --------------------------------------------------------------------

def page_text(blocks: DataFrame) -> DataFrame:
    """Body text of every page in reading order, without headers, footers and table text."""
    kept = ~(F.col("is_header") | F.col("is_footer") | F.col("is_table")) & ~T.is_blank("text")
    rows = blocks.withColumn("clean", F.when(kept, T.normalize_text("text")))
    part = F.when(F.col("clean") != "", F.struct("reading_order", "clean"))
    return rows.groupBy(*PAGE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["clean"]), "\n\n").alias("normalized_text")
    )


def isolate_bad_pages(pages: DataFrame) -> DataFrame:
    """A page whose values cannot be read becomes a failed row with zeroed geometry; the document goes on."""
    w, h, n = F.expr("try_cast(width AS double)"), F.expr("try_cast(height AS double)"), F.expr("try_cast(page_number AS bigint)")
    error = (
        F.when(n.isNull() | (n < 1), "bad_page_number")
        .when(w.isNull() | h.isNull() | (w <= 0) | (h <= 0), "bad_geometry")
        .when(F.col("raw_text").isNull(), "missing_text")
    )
    failed = error.isNotNull()
    return pages.select(
        "document_id", n.alias("page_number"),
        F.when(failed, 0.0).otherwise(w).alias("width"), F.when(failed, 0.0).otherwise(h).alias("height"),
        F.when(failed, "").otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(failed, "failed").otherwise("pending").alias("extraction_status"),
        F.when(failed, "none").otherwise("digital").alias("extraction_method"), error.alias("error_code"),
    )


def extraction_rollup(pages: DataFrame) -> DataFrame:
    """Document status from the statuses of its pages."""

    def n(status):
        return F.sum(F.when(F.col("extraction_status") == status, 1).otherwise(0)).cast("bigint")

    counts = pages.groupBy("document_id").agg(
        n("extracted").alias("extracted"), n("ocr_required").alias("ocr_required"), n("failed").alias("failed")
    )
    e, o, f = F.col("extracted"), F.col("ocr_required"), F.col("failed")
    status = (
        F.when(e + o + f == 0, "extraction_failed")
        .when((f == 0) & (o == 0), "extracted")
        .when((e == 0) & (o > 0) & (f == 0), "ocr_required")
        .when((e == 0) & (o == 0), "extraction_failed")
        .otherwise("partially_extracted")
    )
    return counts.withColumn("processing_status", status)


def lay_out(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """All block-level marks, on a sheet that still holds the table rows."""
    df = mark_captions(mark_table_blocks(sheet(blocks, tables, images)))
    df = reading_order(df).drop("is_text", "band", "n_left", "n_right", "n_straddlers")
    return detect_bands(df)

"""Merging recognised words with digital text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators.catalog import latest_jobs
from pagewright.operators.layout import PAGE, SHARD

# boxes of a page that words are held against in generated code; all others follow in a lambda
FIRST_BOXES = 8


def select_ocr_targets(pages: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pages to recognise: those that need it, or the requested ones.  Requests for unknown pages are
    returned apart, as rejected."""
    if requested is None:
        return pages.filter("requires_ocr"), None
    keys = ["document_id", "page_number"]
    wanted = requested.select(*keys).distinct()
    return pages.join(wanted, keys, "left_semi"), wanted.join(pages, keys, "left_anti")


def retry_targets(pages: DataFrame) -> DataFrame:
    """Pages worth another try: failed, empty, low confidence or cancelled."""
    return pages.filter(F.col("ocr_status").isin(*S.OCR_RETRY_STATUSES))


def dedupe_ocr_words(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Digital text wins: drop recognised words that overlap a digital block of their page by half.

    Words and blocks meet as rows clustered by shard; the boxes of one page are a short array.
    """
    digital = blocks.filter((F.col("source_method") != "ocr") & (F.col("block_type") != "image") & ~T.is_blank("text"))
    rows = words.withColumn("role", F.lit("word")).unionByName(
        digital.select(*PAGE, "x0", "y0", "x1", "y1", F.lit("box").alias("role")), allowMissingColumns=True
    ).repartition(*SHARD)
    box = F.when(F.col("role") == "box", F.struct("x0", "y0", "x1", "y1"))
    df = rows.withColumn("boxes", F.collect_list(box).over(Window.partitionBy(*PAGE))).filter("role = 'word'")

    def over(b):
        return G.overlap_ratio(G.box(), (b["x0"], b["y0"], b["x1"], b["y1"])) >= S.OCR_DEDUPE_OVERLAP

    # a lambda is interpreted for every word and box, so the first boxes are looked at outside of it; a word without an area is under none
    n, covered = F.size("boxes"), F.lit(False)
    for i in range(FIRST_BOXES):
        covered |= (n > i) & over(F.get("boxes", F.lit(i)))
    covered |= (n > FIRST_BOXES) & F.exists(F.slice("boxes", FIRST_BOXES + 1, F.greatest(n, F.lit(1))), over)
    return df.filter((G.bbox_area(G.box()) <= 0) | ~covered).drop("role", "boxes")


def assemble_ocr_lines(words: DataFrame, blocks: DataFrame) -> DataFrame:
    """Recognised words to blocks: lines in (paragraph, line, word) order, boxes around them, and an order
    after the last block of the page."""
    edge = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    spoken = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"]), " ")
    lines = words.groupBy(*PAGE, "block_index", "paragraph_index", "line_index").agg(spoken.alias("text"), F.count(F.lit(1)).alias("n_words"), *edge)
    stacked = F.array_sort(F.collect_list(F.struct("paragraph_index", "line_index", "text")))
    found = lines.groupBy(*PAGE, "block_index").agg(
        F.array_join(F.transform(stacked, lambda ln: ln["text"]), "\n").alias("text"), F.sum("n_words").alias("n_words"), *edge
    )
    last = blocks.groupBy(*PAGE).agg(F.max("reading_order").alias("last_order"), F.max("block_index").alias("last_block"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_index"))
    zero = F.lit(0).cast("bigint")
    return found.join(last, PAGE, "left").select(
        *PAGE, (F.coalesce("last_block", zero) + F.col("block_index") + 1).alias("block_index"),
        (F.coalesce("last_order", zero) + place).cast("bigint").alias("reading_order"), "text", "n_words", "x0", "y0", "x1", "y1",
    )


def ocr_quality(words: DataFrame) -> DataFrame:
    """Class and confidence figures of every page, over all recognised words."""
    c = F.col("confidence")
    stats = words.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("words"), F.avg(c).alias("mean_confidence"), F.percentile(c, 0.5).alias("median"),
        F.avg((c < S.OCR_LOW_WORD_CONFIDENCE).cast("double")).alias("low"),
    )
    few = F.col("words") < S.OCR_EMPTY_MIN_WORDS
    status = F.when(few, "ocr_empty").when(F.col("low") > S.OCR_LOW_RATIO_WARN, "ocr_low_confidence").otherwise("ocr_completed")
    return stats.select(
        *PAGE, "words", "mean_confidence", status.alias("ocr_status"),
        F.bround(F.when(few, 0.0).otherwise(F.col("median")), 4).alias("median_confidence"),
        F.bround(F.when(few, 1.0).otherwise(F.col("low")), 4).alias("low_confidence_ratio"),
    )


def merge_page_text(digital: DataFrame, recognised: DataFrame) -> DataFrame:
    """Page text from the digital base and the recognised text; rebuilt every time, so re-runs do not add up."""
    df = digital.join(recognised, PAGE, "full_outer")
    d, o = F.coalesce("digital_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    method = F.when((o != "") & ~T.is_blank(d), "hybrid").when(o != "", "ocr").otherwise("digital")
    return df.select(
        *PAGE, method.alias("extraction_method"),
        F.when(method == "hybrid", F.concat(d, F.lit("\n\n"), o)).when(method == "ocr", o).otherwise(d).alias("normalized_text"),
    )


def ocr_rollup(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Better document status once pages have been recognised (only from the two waiting states)."""
    bad = (F.col("extraction_status") == "failed") | F.coalesce(F.col("ocr_status").isin("ocr_failed", "ocr_empty"), F.lit(False))
    counts = pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("requires_ocr"), 1)).alias("remaining"), F.count(F.when(bad, 1)).alias("unresolved")
    )
    s, open_ = F.col("processing_status"), F.col("remaining") + F.col("unresolved")
    new = (
        F.when(~s.isin("ocr_required", "partially_extracted") | F.col("pages").isNull(), s)
        .when(open_ == 0, "extracted")
        .when((s == "ocr_required") & (open_ < F.col("pages")), "partially_extracted").otherwise(s)
    )
    return documents.join(counts, "document_id", "left").withColumn("new_status", new)


def ocr_progress(documents: DataFrame, runs: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Progress of every document's latest OCR job: only runs since that job count."""
    job = latest_jobs(jobs.filter("job_type = 'ocr_document'")).select("document_id", F.col("created_at").alias("job_at"), F.col("status").alias("job_status"))
    done = (
        runs.filter("status <> 'running'").join(job.select("document_id", "job_at"), "document_id").filter("created_at >= job_at")
        .groupBy("document_id").agg(F.count_distinct("page_number").alias("done"))
    )

    def n(cond):
        return F.count(F.when(cond, 1))

    state = pages.groupBy("document_id").agg(
        n(F.col("ocr_status").isin("pending", "running")).alias("in_progress"), n(F.col("ocr_status") == "ocr_failed").alias("failed"),
        n(F.col("ocr_status") == "ocr_low_confidence").alias("low_confidence"), n(F.col("requires_ocr")).alias("remaining"),
    )
    df = documents.select("document_id").join(job, "document_id", "left").join(done, "document_id", "left").join(state, "document_id", "left")
    zero = F.lit(0).cast("bigint")
    finished, going = F.coalesce("done", zero), F.coalesce("in_progress", zero)
    return df.select(
        "document_id", F.coalesce(F.col("job_status").isin("queued", "running") & (going > 0), F.lit(False)).alias("running"),
        (going + finished).alias("total_targets"), finished.alias("done"),
        *[F.coalesce(c, zero).alias(c) for c in ("failed", "low_confidence", "remaining")],
    )


def ocr_page_notice(pages: DataFrame) -> DataFrame:
    """Page text with a notice for pages that were hard to read."""
    return pages.select("document_id", "page_number", "ocr_status", F.col("normalized_text").alias("text"),
                        F.coalesce(F.col("ocr_status").isin("ocr_low_confidence", "ocr_empty"), F.lit(False)).alias("quality_notice"))

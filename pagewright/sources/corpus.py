"""Engine tables derived from the Parquet tables of a data folder.

Documents are read as laid-out pages: one block per text line, eight lines to a page.  Layout
rows carry `page_shard`, a fixed run of pages, so that page- and document-ordered work is
clustered by (document_id, page_shard) and one very large document spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.session import per_folder

LINES_PER_PAGE = 8
PAGE_WIDTH = 612.0
PAGE_HEIGHT = 792.0
# Marker and hint words for this data (it holds no Korean text).
DATA_MARKERS = (" the ", " la ", " und ", " et ")
DATA_HINTS = ("tion", "der", "que")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Document rows, as the files are split."""
    return read(spark, folder, "documents").select(*columns)


def micros(c) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), T.col(c))


def pick(index: Column, values) -> Column:
    """Value at a zero-based position of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def page_shard(page_number="page_number") -> Column:
    return F.floor(T.col(page_number) / S.PAGES_PER_SHARD).cast("bigint")


def lines_of(docs: DataFrame) -> DataFrame:
    """Text lines of documents (document_id, text)."""
    return docs.select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def _texts(spark, folder) -> DataFrame:
    return documents(spark, folder, "doc_id", "text").withColumnRenamed("doc_id", "document_id")


@per_folder
def line_rows(spark, folder) -> DataFrame:
    return lines_of(_texts(spark, folder))


def blocks_of(docs: DataFrame) -> DataFrame:
    slot = F.col("block_index")
    two = F.col("document_id") % 2 == 1
    df = lines_of(docs).select(
        "document_id",
        F.col("line_no").cast("bigint").alias("line_no"),
        (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("bigint").alias("page_number"),
        (F.col("line_no") % LINES_PER_PAGE).cast("bigint").alias("block_index"),
        "text",
    )
    y0 = (
        F.when(slot == 0, 24.0).when(slot == 7, 740.0)
        .when(two & slot.isin(2, 4), 150.0).when(two & slot.isin(3, 5), 250.0)
        .otherwise(90.0 + 80.0 * (slot - 1))
    )
    ocr = (F.col("document_id") % 5 == 0) & ((F.col("page_number") % 2 == 0) | (slot % 3 == 2))
    return (
        df.withColumn("page_shard", page_shard())
        .withColumn("block_id", F.concat_ws("-", "document_id", "page_number", "block_index"))
        .withColumn("x0", F.when(two & slot.isin(4, 5), 316.0).otherwise(72.0))
        .withColumn("x1", F.when(two & slot.isin(2, 3), 296.0).otherwise(540.0))
        .withColumn("y0", y0)
        .withColumn("y1", F.col("y0") + F.when(slot.isin(0, 7), 20.0).otherwise(40.0))
        .withColumn("block_type", F.lit("text"))
        .withColumn("page_width", F.lit(PAGE_WIDTH))
        .withColumn("page_height", F.lit(PAGE_HEIGHT))
        .withColumn("source_method", F.when(ocr, "ocr").otherwise("digital"))
    )


@per_folder
def v_blocks(spark, folder) -> DataFrame:
    return blocks_of(_texts(spark, folder))


def tables_of(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("text").contains(" | ")).select(
        "document_id", "page_shard", "page_number", F.col("block_index").alias("table_index"),
        (F.col("x0") - 2).alias("x0"), (F.col("y0") - 2).alias("y0"),
        (F.col("x1") + 2).alias("x1"), (F.col("y1") + 2).alias("y1"),
        F.concat(F.lit("|"), "text", F.lit("|")).alias("markdown_text"),
    )


@per_folder
def v_tables(spark, folder) -> DataFrame:
    return tables_of(v_blocks(spark, folder))


def pages_of(docs: DataFrame) -> DataFrame:
    pages = docs.select("document_id", F.split("text", "\n", -1).alias("lines")).select(
        "document_id", "lines",
        F.explode(F.sequence(F.lit(1), F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int"))).alias("p"),
    )
    return pages.select(
        "document_id",
        F.col("p").cast("bigint").alias("page_number"),
        page_shard(F.col("p")).alias("page_shard"),
        F.lit(PAGE_WIDTH).alias("width"), F.lit(PAGE_HEIGHT).alias("height"), F.lit(0).alias("rotation"),
        F.array_join(
            F.slice("lines", (F.col("p") - 1) * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"
        ).alias("raw_text"),
    )


@per_folder
def v_pages(spark, folder) -> DataFrame:
    return pages_of(_texts(spark, folder))


def images_of(pages: DataFrame) -> DataFrame:
    """Scanned originals: documents whose id is a multiple of seven carry one image per page."""
    odd = F.col("page_number") % 2 == 1
    return pages.filter(F.col("document_id") % 7 == 0).select(
        "document_id", "page_shard", "page_number",
        F.when(odd, 0.0).otherwise(100.0).alias("x0"), F.when(odd, 0.0).otherwise(200.0).alias("y0"),
        F.when(odd, 612.0).otherwise(300.0).alias("x1"), F.when(odd, 720.0).otherwise(300.0).alias("y1"),
    )


@per_folder
def v_images(spark, folder) -> DataFrame:
    return images_of(v_pages(spark, folder))


def words_of(blocks: DataFrame) -> DataFrame:
    words = blocks.select(
        "document_id", "page_shard", "page_number", "block_index", "line_no", "source_method",
        F.col("x0").alias("bx"), "y0", "y1",
        F.posexplode(F.filter(F.split("text", " ", -1), lambda w: ~T.is_blank(w))).alias("k", "text"),
    ).withColumn("k", F.col("k").cast("bigint"))
    left = F.col("bx") + 20.0 * F.col("k")
    bbox = G.clamp_bbox((left, F.col("y0"), left + 18.0, F.col("y1")), F.lit(PAGE_WIDTH), F.lit(PAGE_HEIGHT))
    return words.select(
        "document_id", "page_shard", "page_number", "block_index", F.col("k").alias("word_index"), "text",
        "source_method", bbox["x0"].alias("x0"), bbox["y0"].alias("y0"), bbox["x1"].alias("x1"),
        bbox["y1"].alias("y1"),
        (((F.col("document_id") * 31 + F.col("line_no") * 7 + F.col("k") * 13) % 100) / 100).alias("confidence"),
    )


@per_folder
def v_words(spark, folder) -> DataFrame:
    return words_of(v_blocks(spark, folder))


@per_folder
def v_ocr_words(spark, folder) -> DataFrame:
    """Recognised words of every page, over OCR blocks and digital blocks alike."""
    return v_words(spark, folder).drop("source_method")


@per_folder
def v_documents(spark, folder) -> DataFrame:
    d = F.col("document_id")
    docs = documents(spark, folder, "doc_id", "lang", "source", "text").withColumnRenamed("doc_id", "document_id")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(document_id as int), 0)")
    return (
        docs.select(
            "document_id", "lang", "source",
            (d % 3).alias("user_id"),
            F.concat_ws(" ", F.lit("Report"), "source", d.cast("string")).alias("title"),
            F.concat(F.col("lang"), F.lit("_"), d.cast("string"), F.lit(".pdf")).alias("original_filename"),
            F.sha2("text", 256).alias("sha256"),
            F.octet_length("text").cast("bigint").alias("file_size"),
            created.alias("created_at"),
            pick(d % 6, ("extracted", "partially_extracted", "ocr_required", "failed", "extracting", "uploaded"))
            .alias("processing_status"),
            (d % 3 + 1).alias("content_revision"),
            F.when(d % 11 == 0, created).alias("deleted_at"),
            F.when(d % 9 != 0, F.concat(F.lit("k/"), d.cast("string"))).alias("storage_key"),
            (d % 2 == 0).alias("external_allowed"),
            F.when(d % 4 != 0, F.lit("layout")).alias("extraction_engine"),
            pick(d % 3, ("1.0", "1.1", "1.1")).alias("engine_version"),
            F.lit(1).cast("bigint").alias("schema_version"),
        )
        .withColumn(
            "chunk_revision",
            F.when(d % 4 == 0, F.lit(None).cast("bigint")).when(d % 4 == 3, F.col("content_revision") - 1)
            .otherwise(F.col("content_revision")),
        )
    )


@per_folder
def v_users(spark, folder) -> DataFrame:
    """One row per owner of documents; owner 1 has not allowed external models."""
    return v_documents(spark, folder).select("user_id").distinct().withColumn("external_ai_allowed", F.col("user_id") != 1)


@per_folder
def v_jobs(spark, folder) -> DataFrame:
    e = F.col("event_id")
    status = pick(e % 4, ("queued", "running", "succeeded", "failed"))
    kind = (
        F.when(F.col("event_type") == "view", "chunk_rebuild").when(F.col("event_type") == "click", "extract_document")
        .when(F.col("event_type") == "signup", "ocr_document").when(F.col("event_type") == "purchase", "summarize")
        .otherwise("validate_file")
    )
    return read(spark, folder, "events").select(
        e.alias("job_id"), F.col("user_id").alias("document_id"), kind.alias("job_type"), status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(e % 4 >= 2, micros("ts") + F.floor(F.col("value") * 1000).cast("bigint")).alias("completed_us"),
        (e % 5).alias("attempt_count"), F.lit(S.MAX_JOB_ATTEMPTS).cast("bigint").alias("max_attempts"),
        F.when(e % 4 == 3, F.concat(F.lit("E_"), F.upper("event_type"))).alias("failure_code"),
    )


@per_folder
def v_lifecycle_events(spark, folder) -> DataFrame:
    t = F.col("event_type")
    new = (
        F.when(t == "view", "queued").when(t == "click", "validating").when(t == "signup", "ready")
        .when(t == "purchase", "extracting").otherwise("failed")
    )
    return read(spark, folder, "events").select(
        F.col("user_id").alias("document_id"), "event_id", "ts", new.alias("new_status")
    )


@per_folder
def v_chunks(spark, folder) -> DataFrame:
    """One search chunk per non-blank line, titled by the first line of its page."""
    docs = documents(spark, folder, "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.split("text", "\n", -1).alias("lines"))
    titled = F.transform("lines", lambda x, i: F.struct(
        i.cast("bigint").alias("line_no"), x.alias("text"),
        F.substring(F.get(F.col("lines"), i - i % LINES_PER_PAGE), 1, S.TITLE_MAX_CHARS).alias("title"),
    ))
    rows = docs.select("document_id", F.explode(titled).alias("r")).select("document_id", "r.*").filter(~T.is_blank("text"))
    page = (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("bigint")
    return rows.select(
        "document_id", F.concat_ws(":", "document_id", "line_no").alias("chunk_id"),
        F.col("line_no").alias("chunk_index"), F.col("title").alias("section_title"), F.col("text").alias("normalized_text"),
        page.alias("page_start"), (page + F.when(F.col("line_no") % 7 == 3, 1).otherwise(0)).alias("page_end"),
        F.sha2("text", 256).alias("content_hash"),
    )


@per_folder
def v_queries(spark, folder) -> DataFrame:
    """Two queries per document: its first two longer words, and its first two-letter word."""
    d = F.col("document_id")
    docs = documents(spark, folder, "doc_id", "text").select(
        F.col("doc_id").alias("document_id"), F.split(F.substring_index("text", "\n", 1), " ", -1).alias("w")
    )
    long_words = docs.select(
        d.alias("query_id"), "document_id",
        F.array_join(F.slice(F.filter("w", lambda x: F.length(x) >= 3), 1, 2), " ").alias("query"),
    )
    short_word = docs.select(
        (d + 10_000_000).alias("query_id"), "document_id",
        F.coalesce(F.get(F.filter("w", lambda x: F.length(x) == 2), F.lit(0)), F.lit("")).alias("query"),
    )
    mode = pick(d % 3, ("hybrid", "keyword", "vector"))
    return long_words.unionByName(short_word).filter("query <> ''").withColumn("mode", mode).withColumn("limit", d % 12 + 4)


@per_folder
def v_chunk_vectors(spark, folder) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("bigint").alias("document_id"),
        F.lit("m").alias("embedding_model"), F.lit(64).alias("embedding_dimension"), F.col("embedding").alias("vector"),
    )


@per_folder
def v_query_vectors(spark, folder) -> DataFrame:
    """One query vector per document (label): its first vector."""
    return v_chunk_vectors(spark, folder).groupBy("document_id").agg(
        F.min(F.struct(F.col("chunk_id").cast("bigint"), "vector")).getField("vector").alias("vector")
    ).select(F.col("document_id").alias("query_id"), "document_id", F.lit("m").alias("embedding_model"),
             F.lit(64).alias("embedding_dimension"), "vector")


@per_folder
def v_messages(spark, folder) -> DataFrame:
    c = F.col("conv_id")
    return read(spark, folder, "conversations").filter("role <> 'system'").select(
        c.alias("thread_id"), (F.col("turn") + 1).alias("sequence_number"), "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", "completed")
        .otherwise(pick((c * 3 + F.col("turn")) % 7, (
            "completed", "conflicting_evidence", "failed", "revision_changed", "pending", "not_found", "streaming",
        ))).alias("status"),
        c.alias("document_id"),
    )


# --- answers over documents: one answer (message) per page ------------------------------

def message_id(document_id="document_id", page_number="page_number") -> Column:
    return T.col(document_id) * 1_000_000 + T.col(page_number)


@per_folder
def v_context(spark, folder) -> DataFrame:
    """Chunks retrieved for each answer: the non-blank lines of its page, in order."""
    return v_blocks(spark, folder).filter(~T.is_blank("text")).select(
        message_id().alias("message_id"), "document_id", F.col("block_id").alias("chunk_id"),
        F.col("block_index").alias("rank"), F.substring("text", 1, S.TITLE_MAX_CHARS).alias("section_title"),
        "text", F.sha2("text", 256).alias("content_hash"), "source_method",
    )


@per_folder
def v_claims(spark, folder) -> DataFrame:
    """Six raw claims per line: exact, with an unknown number, without a known source, with
    foreign words, with an added negation, repeated under two sources."""
    b = v_blocks(spark, folder).filter(~T.is_blank("text"))
    c = b.select(
        "document_id", "page_number", "block_index", "block_id", "text",
        F.posexplode(F.array(*[F.lit(v) for v in ("exact", "number", "source", "words", "negated", "twice")]))
        .alias("v", "variant"),
    )
    v = F.col("variant")
    first = T.strip(F.regexp_extract("text", r"^([^.!?]*[.!?]?)", 1))
    return c.select(
        message_id().alias("message_id"), "document_id",
        (F.col("v") * 8 + F.col("block_index")).cast("bigint").alias("claim_no"),
        F.when(v == "number", F.concat(first, F.lit(" 4711")))
        .when(v == "words", F.reverse(first))
        .when(v == "negated", F.concat(first, F.lit(" the one")))
        .otherwise(first).alias("text"),
        F.when(v == "source", F.array(F.concat(F.lit("none-"), "block_id")))
        .when(v == "twice", F.array("block_id", F.concat_ws("-", "document_id", "page_number", F.lit("0")), "block_id"))
        .otherwise(F.array("block_id")).alias("source_chunk_ids"),
    )


@per_folder
def v_claim_events(spark, folder) -> DataFrame:
    """Ordered events of every answer; one answer in five ends without a final event."""
    claims = v_claims(spark, folder).select(
        "message_id", "document_id", (F.col("claim_no") + 1).alias("seq"), F.lit("claim").alias("type"), "text",
        "source_chunk_ids", F.lit(None).cast("string").alias("answer_status"),
    )
    finals = v_pages(spark, folder).select(message_id().alias("message_id"), "document_id").filter(
        F.col("message_id") % 5 != 0
    ).select(
        "message_id", "document_id", F.lit(1000).cast("bigint").alias("seq"), F.lit("final").alias("type"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("source_chunk_ids"),
        pick(F.col("message_id") % 4, ("answered", "conflicting_evidence", "answered", "not_found")).alias("answer_status"),
    )
    return claims.unionByName(finals)

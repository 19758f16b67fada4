"""Document catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.layout import PAGE


def duplicate_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """For every new file the document it repeats: one already stored, or an earlier file of the batch.

    The first file of a group comes from an aggregation (reduced before the shuffle) and is joined
    back, so a group of copies of any size is never gathered in one task.
    """
    usable = catalog.filter(
        "deleted_at is null and processing_status <> 'deleted' "
        "and not (processing_status = 'failed' and storage_key is null)"
    )
    stored = usable.groupBy("user_id", "sha256").agg(F.min("document_id").alias("existing_id"))
    first = files.groupBy("user_id", "sha256").agg(F.min(F.struct("created_at", "file_id")).alias("first"))
    known = first.join(stored, ["user_id", "sha256"], "left")
    return (
        files.join(known, ["user_id", "sha256"])
        .withColumn("first_in_batch", F.col("first.file_id"))
        .withColumn("duplicate", F.col("existing_id").isNotNull() | (F.col("file_id") != F.col("first_in_batch")))
        .drop("first")
    )


def list_documents(documents: DataFrame, user_id, status=None, search=None, after=None, limit: int = 20) -> DataFrame:
    """One page of a user's documents, newest first; one row more than `limit` tells that more exist.

    `after` is the (created_at, document_id) of the last row seen.  `%` and `_` in the search text
    act as wildcards.
    """
    df = documents.filter((F.col("user_id") == user_id) & F.col("deleted_at").isNull())
    if status is not None:
        df = df.filter(F.col("processing_status") == status)
    if search:
        df = df.filter(F.col("title").ilike(f"%{search}%") | F.col("original_filename").ilike(f"%{search}%"))
    if after is not None:
        at, last = after
        df = df.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("document_id") < last)))
    return df.orderBy(F.desc("created_at"), F.desc("document_id")).limit(limit + 1)


def owned_documents(documents: DataFrame, user_id, include_deleted: bool = False) -> DataFrame:
    df = documents.filter(F.col("user_id") == user_id)
    if include_deleted:
        return df
    return df.filter(F.col("deleted_at").isNull() & (F.col("processing_status") != "deleted"))


def extraction_status(pages: DataFrame) -> DataFrame:
    """Pages done, waiting for OCR and failed per document."""

    def n(status):
        return F.count(F.when(F.col("extraction_status") == status, 1))

    return pages.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages_done"), n("ocr_required").alias("pages_ocr_required"), n("failed").alias("pages_failed")
    )


def page_listing(pages: DataFrame, tables: DataFrame) -> DataFrame:
    counts = tables.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("table_count"))
    return pages.join(counts, PAGE, "left").withColumn("table_count", F.coalesce("table_count", F.lit(0).cast("bigint")))


def page_blocks(blocks: DataFrame, include_bands: bool = True, limit: int = 1000) -> DataFrame:
    """Blocks of every page in reading order; the limit counts before bands are removed."""
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("reading_order"))
    df = blocks.withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    return df if include_bands else df.filter(~(F.col("is_header") | F.col("is_footer")))


def table_listing(tables: DataFrame, limit: int = 200) -> DataFrame:
    """First tables of every document by page and index (the row-number limit runs before the shuffle)."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "table_index"))
    return tables.withColumn("place", place).filter(F.col("place") <= limit)


def job_history(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first per document; a range sort, so a document with many jobs spreads out."""
    return jobs.orderBy("document_id", F.desc("created_at"), F.desc("job_id"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """Newest job of every document and type."""
    rest = [c for c in jobs.columns if c not in ("document_id", "job_type", "created_at", "job_id")]
    newest = jobs.groupBy("document_id", "job_type").agg(F.max(F.struct("created_at", "job_id", *rest)).alias("j"))
    return newest.select("document_id", "job_type", "j.*")


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


def recent_failures(jobs: DataFrame, limit: int = 20) -> DataFrame:
    failed = jobs.filter("failure_code is not null")
    return failed.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def operations_report(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts by status, and the last failure codes, as rows of (section, name, value)."""
    counts = status_counts(documents).select(F.lit("status").alias("section"), F.col("processing_status").alias("name"), F.col("n").alias("value"))
    failures = recent_failures(jobs).select(F.lit("failure").alias("section"), F.col("failure_code").alias("name"), F.col("completed_us").alias("value"))
    return counts.unionByName(failures)


def cascade_delete(deleted: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Derived tables without the rows of deleted documents (the document rows themselves stay)."""
    ids = deleted.select("document_id").distinct()
    return {name: df.join(ids, "document_id", "left_anti") for name, df in tables.items()}


def chunk_status(documents: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Chunk count, last rebuild time and last rebuild status per document."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    last = latest_jobs(jobs.filter("job_type = 'chunk_rebuild'")).select(
        "document_id", F.col("status").alias("job_status"),
        F.when(F.col("status") == "succeeded", F.col("completed_us")).alias("last_rebuilt_us"),
    )
    return (
        documents.select("document_id").join(counts, "document_id", "left").join(last, "document_id", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("bigint")))
    )

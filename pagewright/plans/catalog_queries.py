"""Queries for the catalogue and the lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.operators import catalog as A
from pagewright.operators import layout as L
from pagewright.operators import lifecycle as Y
from pagewright.plans import oracle_views as V
from pagewright.plans.layout_queries import laid_out, measured
from pagewright.plans.registry import query
from pagewright.sources import corpus as C

VIEWS = V.VIEWS
VIEWS["o_uploads"] = """
SELECT doc_id + 5000000 AS file_id, doc_id % 2 AS user_id, sha256(text) AS sha256, TIMESTAMP '2024-06-01 00:00:00' + to_minutes(1000000 - doc_id) AS created_at FROM documents"""


def uploads(spark, folder):
    """A batch of new files: every document again, in reverse order, for two owners."""
    d = F.col("doc_id")
    at = F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 0, cast(1000000 - doc_id as int), 0)")
    return C.documents(spark, folder, "doc_id", "text").select(
        (d + 5_000_000).alias("file_id"), (d % 2).alias("user_id"), F.sha2("text", 256).alias("sha256"), at.alias("created_at")
    )


@query("duplicate_files", """
SELECT f.file_id, f.user_id, s.existing_id, b.first_in_batch, s.existing_id IS NOT NULL OR f.file_id <> b.first_in_batch AS duplicate FROM o_uploads f
LEFT JOIN (SELECT user_id, sha256, min(document_id) AS existing_id FROM v_documents WHERE deleted_at IS NULL AND processing_status <> 'deleted'
  AND NOT (processing_status='failed' AND storage_key IS NULL) GROUP BY ALL) s USING (user_id, sha256)
JOIN (SELECT user_id, sha256, arg_min(file_id, (created_at, file_id)) AS first_in_batch FROM o_uploads GROUP BY ALL) b USING (user_id, sha256)""")
def _duplicate_files(spark, folder):
    return A.duplicate_files(uploads(spark, folder), C.v_documents(spark, folder)).select(
        "file_id", "user_id", "existing_id", "first_in_batch", "duplicate")


@query("list_documents", """SELECT document_id, title, epoch_us(created_at) AS created_us FROM v_documents WHERE user_id=0 AND deleted_at IS NULL AND processing_status='failed'
 AND (title ILIKE '%SRC1%' OR original_filename ILIKE '%SRC1%') AND (created_at < TIMESTAMP '2024-01-01 02:30:00' OR (created_at = TIMESTAMP '2024-01-01 02:30:00' AND document_id < 150))
 ORDER BY created_at DESC, document_id DESC LIMIT 21""")
def _list_documents(spark, folder):
    after = (F.expr("timestamp_ntz'2024-01-01 02:30:00'"), 150)
    return A.list_documents(C.v_documents(spark, folder), 0, "failed", "SRC1", after, 20).select(
        "document_id", "title", C.micros("created_at").alias("created_us"))


@query("owned_documents", "SELECT document_id, processing_status FROM v_documents WHERE user_id=2 AND deleted_at IS NULL AND processing_status <> 'deleted'")
def _owned_documents(spark, folder):
    return A.owned_documents(C.v_documents(spark, folder), 2).select("document_id", "processing_status")


STATUS_SQL = "CASE WHEN (document_id+page_number)%13=0 THEN 'failed' WHEN requires_ocr THEN 'ocr_required' ELSE 'extracted' END"


@query("extraction_status", f"""SELECT document_id, count(*) AS pages_done, count(*) FILTER (s='ocr_required') AS pages_ocr_required, count(*) FILTER (s='failed') AS pages_failed
FROM (SELECT document_id, {STATUS_SQL} AS s FROM o_scan) GROUP BY ALL""")
def _extraction_status(spark, folder):
    p = L.classify_pages(measured(spark, folder)).select(
        "document_id", F.when((F.col("document_id") + F.col("page_number")) % 13 == 0, "failed")
        .when(F.col("requires_ocr"), "ocr_required").otherwise("extracted").alias("extraction_status"))
    return A.extraction_status(p)


@query("page_listing", """SELECT p.document_id, p.page_number, coalesce(t.n, 0) AS table_count FROM v_pages p
LEFT JOIN (SELECT document_id, page_number, count(*) n FROM v_tables GROUP BY ALL) t USING (document_id, page_number)""")
def _page_listing(spark, folder):
    return A.page_listing(C.v_pages(spark, folder), C.v_tables(spark, folder)).select("document_id", "page_number", "table_count")


@query("page_blocks", "SELECT document_id, page_number, block_index, reading_order FROM o_layout WHERE reading_order < 5 AND NOT (is_header OR is_footer)")
def _page_blocks(spark, folder):
    return A.page_blocks(L.only_blocks(laid_out(spark, folder)), False, 5).select("document_id", "page_number", "block_index", "reading_order")


@query("table_listing", """SELECT document_id, page_number, table_index, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, table_index) AS place FROM v_tables) WHERE place <= 3""")
def _table_listing(spark, folder):
    return A.table_listing(C.v_tables(spark, folder), 3).select("document_id", "page_number", "table_index", F.col("place").cast("bigint"))


@query("job_history", "SELECT document_id, job_id, job_type, status, epoch_us(created_at) AS created_us FROM v_jobs ORDER BY document_id, created_at DESC, job_id DESC")
def _job_history(spark, folder):
    return A.job_history(C.v_jobs(spark, folder)).select("document_id", "job_id", "job_type", "status", C.micros("created_at").alias("created_us"))


@query("latest_jobs", "SELECT document_id, job_type, arg_max(job_id, (created_at, job_id)) AS job_id, arg_max(status, (created_at, job_id)) AS status FROM v_jobs GROUP BY ALL")
def _latest_jobs(spark, folder):
    return A.latest_jobs(C.v_jobs(spark, folder)).select("document_id", "job_type", "job_id", "status")


@query("operations_report", """SELECT 'status' AS section, processing_status AS name, count(*) AS value FROM v_documents GROUP BY ALL
UNION ALL SELECT 'failure', failure_code, completed_us FROM (SELECT * FROM v_jobs WHERE failure_code IS NOT NULL ORDER BY created_at DESC, job_id DESC LIMIT 20)""")
def _operations_report(spark, folder):
    return A.operations_report(C.v_documents(spark, folder), C.v_jobs(spark, folder))


@query("cascade_delete", """
SELECT 'blocks' AS tbl, document_id, count(*) AS n FROM v_blocks WHERE document_id NOT IN (SELECT document_id FROM v_documents WHERE deleted_at IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'pages', document_id, count(*) FROM v_pages WHERE document_id NOT IN (SELECT document_id FROM v_documents WHERE deleted_at IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'chunks', document_id, count(*) FROM v_chunks WHERE document_id NOT IN (SELECT document_id FROM v_documents WHERE deleted_at IS NOT NULL) GROUP BY ALL
UNION ALL SELECT 'messages', document_id, count(*) FROM v_messages WHERE document_id NOT IN (SELECT document_id FROM v_documents WHERE deleted_at IS NOT NULL) GROUP BY ALL""")
def _cascade_delete(spark, folder):
    gone = C.v_documents(spark, folder).filter("deleted_at is not null")
    kept = A.cascade_delete(gone, blocks=C.v_blocks(spark, folder), pages=C.v_pages(spark, folder), chunks=C.v_chunks(spark, folder),
                            messages=C.v_messages(spark, folder))
    out = None
    for name, df in kept.items():
        part = df.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("chunk_status", """SELECT d.document_id, coalesce(c.n, 0) AS chunk_count, j.status AS job_status, CASE WHEN j.status='succeeded' THEN j.completed_us END AS last_rebuilt_us
FROM v_documents d LEFT JOIN (SELECT document_id, count(*) n FROM v_chunks GROUP BY ALL) c USING (document_id)
LEFT JOIN (SELECT * FROM v_jobs WHERE job_type='chunk_rebuild' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC)=1) j USING (document_id)""")
def _chunk_status(spark, folder):
    return A.chunk_status(C.v_documents(spark, folder), C.v_chunks(spark, folder), C.v_jobs(spark, folder))


# --- lifecycle ------------------------------------------------------------------------------

ALLOWED_SQL = "(VALUES " + ", ".join(f"('{a}','{b}')" for a, bs in S.ALLOWED_TRANSITIONS.items() for b in bs) + ") t(a, b)"


@query("check_transitions", f"""SELECT document_id, event_id, old_status, new_status, old_status IS NULL OR EXISTS (SELECT 1 FROM {ALLOWED_SQL} WHERE t.a=old_status AND t.b=new_status) AS allowed
FROM (SELECT *, lag(new_status) OVER (PARTITION BY document_id ORDER BY ts, event_id) AS old_status FROM v_lifecycle_events)""")
def _check_transitions(spark, folder):
    return Y.check_transitions(C.v_lifecycle_events(spark, folder)).select("document_id", "event_id", "old_status", "new_status", "allowed")


VIEWS["o_ev"] = "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ts, event_id) AS rn FROM v_lifecycle_events"
VIEWS["o_replay"] = f"""RECURSIVE SELECT DISTINCT document_id, 0::BIGINT AS rn, 'uploaded' AS status FROM o_ev
UNION ALL SELECT e.document_id, e.rn, CASE WHEN EXISTS (SELECT 1 FROM {ALLOWED_SQL} WHERE t.a=r.status AND t.b=e.new_status) THEN e.new_status ELSE r.status END
FROM o_replay r JOIN o_ev e ON e.document_id=r.document_id AND e.rn=r.rn+1"""


@query("replay_status", "SELECT document_id, max(rn) AS events, arg_max(status, rn) AS status FROM o_replay GROUP BY document_id")
def _replay_status(spark, folder):
    return Y.replay_status(C.v_lifecycle_events(spark, folder))


@query("dedupe_active_jobs", """SELECT document_id, job_id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'SUPERSEDED' ELSE failure_code END AS failure_code
FROM (SELECT *, status IN ('queued','running') AND row_number() OVER (PARTITION BY document_id, job_type, status IN ('queued','running') ORDER BY created_at DESC, job_id DESC) > 1 AS old FROM v_jobs)""")
def _dedupe_active_jobs(spark, folder):
    return Y.dedupe_active_jobs(C.v_jobs(spark, folder)).select("document_id", "job_id", "status", "failure_code")


def waiting_pages(spark, folder):
    p = C.v_pages(spark, folder)
    k = (F.col("document_id") * 3 + F.col("page_number")) % 5
    return p.withColumn("ocr_status", F.when(k == 0, "pending").when(k == 1, "running").otherwise("ocr_completed"))


RECOVER_SQL = """
WITH wp AS (SELECT DISTINCT p.document_id, p.page_number FROM v_pages p JOIN v_documents d USING (document_id) WHERE d.deleted_at IS NULL AND (p.document_id*3+p.page_number)%5 < 2),
ex AS (SELECT document_id, attempt_count >= max_attempts AS exhausted FROM v_jobs WHERE job_type='extract_document' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC)=1)
SELECT 'document' AS kind, document_id AS id, CASE WHEN s IN ('created','uploading') THEN 'failed' WHEN s IN ('uploaded','queued','validating') THEN 'queued' WHEN s='extracting' AND e THEN 'extraction_failed' ELSE s END AS status,
  CASE WHEN s IN ('uploaded','queued','validating') THEN 'validate' WHEN s='extracting' AND NOT e THEN 'extract' END AS restart,
  CASE WHEN s IN ('created','uploading') THEN 'VALIDATION_FAILED' WHEN s='extracting' AND e THEN 'EXTRACTION_ATTEMPTS_EXHAUSTED' END AS failure_code
FROM (SELECT d.document_id, processing_status AS s, coalesce(exhausted, false) AS e FROM v_documents d LEFT JOIN ex USING (document_id) WHERE deleted_at IS NULL)
UNION ALL SELECT 'page', document_id*1000000+page_number, 'pending', NULL, NULL FROM wp
UNION ALL SELECT 'job', job_id, CASE WHEN stale THEN 'failed' ELSE status END, NULL, CASE WHEN stale THEN 'INTERRUPTED' ELSE failure_code END FROM (SELECT *, status IN ('queued','running') AND
   (job_type IN ('chunk_rebuild','summarize') OR (job_type='ocr_document' AND document_id NOT IN (SELECT document_id FROM wp))) AS stale FROM v_jobs)
UNION ALL SELECT 'answer', thread_id*1000000+sequence_number, CASE WHEN role='assistant' AND status IN ('pending','streaming','finalizing') THEN 'interrupted' ELSE status END, NULL,
  CASE WHEN role='assistant' AND status IN ('pending','streaming','finalizing') THEN 'APP_RESTARTED' END FROM v_messages"""


@query("recover_interrupted", RECOVER_SQL)
def _recover_interrupted(spark, folder):
    found = Y.recover_interrupted(C.v_documents(spark, folder), C.v_jobs(spark, folder), waiting_pages(spark, folder), C.v_messages(spark, folder))
    at = [F.get("key", F.lit(i)) for i in range(2)]
    return found.select("kind", F.when(at[1].isNull(), at[0]).otherwise(at[0] * 1_000_000 + at[1]).alias("id"), "status", "restart", "failure_code")


@query("needs_extraction", """SELECT document_id FROM v_documents WHERE processing_status IN ('ready','extracted','partially_extracted','ocr_required','extraction_failed')
 AND NOT (processing_status='extracted' AND extraction_engine IS NOT DISTINCT FROM 'layout' AND engine_version='1.1' AND schema_version=1)""")
def _needs_extraction(spark, folder):
    return Y.needs_extraction(C.v_documents(spark, folder), "layout", "1.1", 1).select("document_id")


@query("bump_revisions", """SELECT document_id, content_revision + coalesce(g, 0) AS content_revision, chunk_revision IS DISTINCT FROM content_revision + coalesce(g, 0) AS stale
FROM v_documents LEFT JOIN (SELECT document_id, sum(CASE WHEN job_type='extract_document' THEN CASE WHEN status<>'failed' THEN 1 ELSE 0 END ELSE CASE WHEN attempt_count>0 THEN 1 ELSE 0 END END)::BIGINT AS g
  FROM v_jobs WHERE job_type IN ('extract_document','ocr_document') GROUP BY ALL) USING (document_id)""")
def _bump_revisions(spark, folder):
    outcomes = C.v_jobs(spark, folder).filter(F.col("job_type").isin("extract_document", "ocr_document")).select(
        "document_id", F.when(F.col("job_type") == "extract_document", "extract").otherwise("ocr").alias("kind"),
        F.when(F.col("status") == "failed", "extraction_failed").otherwise("extracted").alias("result"), F.col("attempt_count").alias("processed_pages"))
    return Y.bump_revisions(C.v_documents(spark, folder), outcomes).select("document_id", "content_revision", "stale")


@query("retry_documents", """SELECT document_id, CASE WHEN processing_status <> 'failed' THEN 'not_failed' WHEN storage_key IS NULL THEN 'no_stored_file' END AS reject_reason,
 CASE WHEN processing_status='failed' AND storage_key IS NOT NULL THEN 'queued' ELSE processing_status END AS new_status, CASE WHEN processing_status='failed' AND storage_key IS NOT NULL THEN 'file_validation' END AS processing_stage FROM v_documents""")
def _retry_documents(spark, folder):
    return Y.retry_documents(C.v_documents(spark, folder)).select("document_id", "reject_reason", "new_status", "processing_stage")

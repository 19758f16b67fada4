"""Queries for streamed answers and ingestion."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.plans import oracle_views as V
from pagewright.plans.qa_queries import answers, classified, context
from pagewright.plans.registry import query
from pagewright.session import per_folder, shared_folder
from pagewright.sources import corpus as C
from pagewright.sources.sinks import ledger, read_document_rows, replace_document_rows
from pagewright.streaming import answers as W
from pagewright.streaming import ingest as N

VIEWS = V.VIEWS
M = C.DATA_MARKERS

VIEWS["o_taken"] = f"""SELECT c.*, seq AS claim_no FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS claim_rank FROM v_claim_events WHERE type='claim') c
 LEFT JOIN (SELECT message_id, min(seq) AS final_seq FROM v_claim_events WHERE type='final' GROUP BY ALL) f USING (message_id) WHERE claim_rank <= {S.MAX_CLAIMS} AND (final_seq IS NULL OR seq < final_seq)"""
VIEWS["o_final"] = f"""SELECT message_id, any_value(f.answer_status) AS hint FROM v_claim_events f WHERE type='final' AND (SELECT count(*) FROM v_claim_events c WHERE c.message_id=f.message_id AND c.type='claim' AND c.seq < f.seq) <= {S.MAX_CLAIMS} GROUP BY message_id"""
VIEWS["o_sjudged"] = classified("o_taken")
VIEWS["o_shown"] = "SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY claim_no) AS out_seq FROM o_sjudged WHERE reason IS NULL"
VIEWS["o_sconflict"] = f"""
SELECT DISTINCT a.message_id FROM (SELECT message_id, len({V.markers_in('claim_text')}) > 0 AS neg, {V.subject('claim_text')} AS subj FROM o_shown) a
JOIN (SELECT message_id, len({V.markers_in('claim_text')}) > 0 AS neg, {V.subject('claim_text')} AS subj FROM o_shown) b ON a.message_id=b.message_id AND a.neg AND NOT b.neg AND len(list_intersect(a.subj, b.subj)) >= {S.CONFLICT_MIN_SHARED}"""


@per_folder
def shown(spark, folder):
    return W.stream_claims(C.v_claim_events(spark, folder), context(spark, folder), M)


@query("stream_claims", "SELECT message_id, out_seq AS seq, out_seq-1 AS claim_index, claim_text FROM o_shown")
def _stream_claims(spark, folder):
    return shown(spark, folder)[0].select("message_id", F.col("seq").cast("bigint"), F.col("claim_index").cast("bigint"), "claim_text")


@query("rejected_claims", "SELECT message_id, reason, count(*) AS rejected FROM o_sjudged WHERE reason IS NOT NULL GROUP BY ALL")
def _rejected_claims(spark, folder):
    return shown(spark, folder)[1]


@query("draft_checkpoints", "SELECT message_id, out_seq AS seq, string_agg(claim_text, chr(10)) OVER (PARTITION BY message_id ORDER BY out_seq) AS draft FROM o_shown")
def _draft_checkpoints(spark, folder):
    return W.draft_checkpoints(shown(spark, folder)[0]).withColumn("seq", F.col("seq").cast("bigint"))


@query("finalize_answers", f"""SELECT message_id, status, CASE status WHEN 'not_found' THEN '{S.NOT_FOUND_TEXT}' WHEN 'insufficient_evidence' THEN '{S.INSUFFICIENT_TEXT}' ELSE content END AS content FROM (
 SELECT a.message_id, content, CASE WHEN coalesce(n,0)=0 AND x.message_id IS NULL THEN 'not_found' WHEN coalesce(n,0)=0 THEN 'insufficient_evidence' WHEN n >= 2 AND (hint='conflicting_evidence' OR k.message_id IS NOT NULL) THEN 'conflicting_evidence' ELSE 'completed' END AS status
 FROM o_answers a LEFT JOIN (SELECT message_id, count(*) AS n, string_agg(claim_text, chr(10) ORDER BY out_seq) AS content FROM o_shown GROUP BY ALL) s USING (message_id) LEFT JOIN o_sconflict k USING (message_id) LEFT JOIN o_final f USING (message_id)
 LEFT JOIN (SELECT DISTINCT message_id FROM o_ctx) x USING (message_id))""")
def _finalize_answers(spark, folder):
    finals = W.accepted_events(C.v_claim_events(spark, folder))[1]
    return W.finalize_answers(answers(spark, folder), shown(spark, folder)[0], finals, context(spark, folder), M)


def timed(spark, folder):
    """Events in runs of eight as the events of one answer."""
    t = F.col("event_type")
    kind = F.when(t == "error", "cancel").when(t == "purchase", "lost").when(t == "signup", "final").otherwise("claim")
    return C.read(spark, folder, "events").select(F.floor(F.col("event_id") / 8).alias("message_id"), "event_id", "ts", kind.alias("kind"))


@query("first_terminal", """SELECT message_id, arg_min(status, (ts, event_id)) AS status, count(*)-1 AS ignored FROM (SELECT event_id // 8 AS message_id, event_id, ts,
 CASE event_type WHEN 'error' THEN 'cancelled' WHEN 'purchase' THEN 'interrupted' WHEN 'signup' THEN 'completed' END AS status FROM events) WHERE status IS NOT NULL GROUP BY ALL""")
def _first_terminal(spark, folder):
    k = F.col("kind")
    ends = timed(spark, folder).withColumn("status", F.when(k == "cancel", "cancelled").when(k == "lost", "interrupted").when(k == "final", "completed"))
    return W.first_terminal(ends.filter("status is not null"))


@query("answer_timeouts", """SELECT message_id, coalesce(arg_min(e, (ts, event_id)) FILTER (e IS NOT NULL), 'failed') AS status, count(*) AS events FROM (SELECT *, CASE WHEN epoch_us(ts)-epoch_us(b) > 30000000 OR epoch_us(ts)-epoch_us(s) > 180000000 THEN 'failed'
  WHEN event_type='error' THEN 'cancelled' WHEN event_type='purchase' THEN 'interrupted' WHEN event_type='signup' THEN 'completed' END AS e
 FROM (SELECT event_id // 8 AS message_id, *, lag(ts) OVER (PARTITION BY event_id // 8 ORDER BY ts, event_id) AS b, min(ts) OVER (PARTITION BY event_id // 8) AS s FROM events)) GROUP BY ALL""")
def _answer_timeouts(spark, folder):
    return W.answer_timeouts(timed(spark, folder))


@query("periodic_recheck", """SELECT message_id, min(claim_rank) AS ended_at, 'revision_changed' AS status FROM o_taken WHERE claim_rank % 3 = 0 AND message_id % 4 = 1 AND seq >= 8 GROUP BY ALL""")
def _periodic_recheck(spark, folder):
    changes = answers(spark, folder).filter(F.col("message_id") % 4 == 1).select("message_id", F.lit(8).alias("change_seq"))
    return W.periodic_recheck(W.accepted_events(C.v_claim_events(spark, folder))[0], changes)


@query("stream_answers")
def _stream_answers(spark, folder):
    """The live twin: stored events are streamed file by file through keyed state (rows-only check)."""
    root = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") % 100)
    events = C.v_claim_events(spark, folder).select("message_id", F.col("seq").alias("event_seq"), at.alias("event_time"), "type", "text", "source_chunk_ids")
    events.write.parquet(f"{root}/events")
    source = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    found = W.stream_answers(source, context(spark, folder), M)
    run = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


# changes while answers stream: of the revision and of the consent, some so late that only the last look can see them
VIEWS["v_changes"] = """
SELECT message_id, CASE message_id % 8 WHEN 1 THEN 8 WHEN 2 THEN 17 WHEN 3 THEN 900 WHEN 4 THEN 900 ELSE 9 END AS change_seq,
  CASE WHEN message_id % 8 IN (1, 3, 5) THEN 'revision_changed' ELSE 'consent_revoked' END AS status FROM o_answers WHERE message_id % 8 BETWEEN 1 AND 5
UNION ALL SELECT message_id, 9, 'consent_revoked' FROM o_answers WHERE message_id % 8 = 5"""
VIEWS["o_ends"] = f"""
SELECT message_id, coalesce(least(final_seq, beyond_seq), 1001) AS end_seq FROM o_answers LEFT JOIN (SELECT message_id, min(seq) AS final_seq FROM v_claim_events WHERE type='final' GROUP BY ALL) USING (message_id)
LEFT JOIN (SELECT message_id, seq AS beyond_seq FROM (SELECT message_id, seq, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS n FROM v_claim_events WHERE type='claim') WHERE n = {S.MAX_CLAIMS + 1}) USING (message_id)"""
VIEWS["o_looks"] = f"""
SELECT message_id, arg_min(status, (claim_rank, status = 'consent_revoked')) AS early, min(claim_rank) AS ended_at FROM (SELECT t.message_id, claim_rank, c.status FROM o_taken t JOIN v_changes c ON c.message_id=t.message_id AND c.change_seq <= t.seq
 WHERE claim_rank % {S.RECHECK_EVERY_CLAIMS} = 0) GROUP BY ALL"""
VIEWS["o_late"] = "SELECT e.message_id, arg_min(status, status = 'consent_revoked') AS late FROM o_ends e JOIN v_changes c ON c.message_id=e.message_id AND c.change_seq <= e.end_seq GROUP BY ALL"
VIEWS["o_outcomes"] = f"""
SELECT message_id, claims, CASE WHEN found IS NOT NULL THEN found WHEN n=0 AND NOT had THEN 'not_found' WHEN n=0 THEN 'insufficient_evidence' WHEN n >= 2 AND clash THEN 'conflicting_evidence' ELSE 'completed' END AS status,
 CASE found WHEN 'revision_changed' THEN '{S.REVISION_CHANGED_TEXT}' WHEN 'consent_revoked' THEN '{S.CONSENT_REVOKED_TEXT}' ELSE CASE WHEN n=0 AND NOT had THEN '{S.NOT_FOUND_TEXT}' WHEN n=0 THEN '{S.INSUFFICIENT_TEXT}' ELSE content END END AS content
FROM (SELECT a.message_id, coalesce(early, late) AS found, coalesce(n, 0) AS n, content, x.message_id IS NOT NULL AS had, coalesce(hint='conflicting_evidence', false) OR k.message_id IS NOT NULL AS clash,
  (SELECT count(*) FROM o_shown s WHERE s.message_id=a.message_id AND (ended_at IS NULL OR claim_rank < ended_at)) AS claims
 FROM o_answers a LEFT JOIN (SELECT message_id, count(*) AS n, string_agg(claim_text, chr(10) ORDER BY out_seq) AS content FROM o_shown GROUP BY ALL) s USING (message_id) LEFT JOIN o_sconflict k USING (message_id)
 LEFT JOIN o_final f USING (message_id) LEFT JOIN (SELECT DISTINCT message_id FROM o_ctx) x USING (message_id) LEFT JOIN o_looks USING (message_id) LEFT JOIN o_late USING (message_id))"""


def changes(spark, folder):
    m = F.col("message_id") % 8
    a = answers(spark, folder).select("message_id")
    first = a.filter(m.between(1, 5)).select("message_id", F.when(m == 1, 8).when(m == 2, 17).when(m.isin(3, 4), 900).otherwise(9).cast("bigint").alias("change_seq"),
                                             F.when(m.isin(1, 3, 5), "revision_changed").otherwise("consent_revoked").alias("status"))
    return first.unionByName(a.filter(m == 5).select("message_id", F.lit(9).cast("bigint").alias("change_seq"), F.lit("consent_revoked").alias("status")))


def ended_events(spark, folder):
    """Events of every answer; one without a final event ends with `done`."""
    e = C.v_claim_events(spark, folder)
    done = answers(spark, folder).filter(F.col("message_id") % 5 == 0).select(
        "message_id", "document_id", F.lit(1001).cast("bigint").alias("seq"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("source_chunk_ids"), F.lit(None).cast("string").alias("answer_status"))
    return e.unionByName(done)


@query("answer_outcomes", "SELECT message_id, status, content, claims FROM o_outcomes")
def _answer_outcomes(spark, folder):
    """The batch twin of the live answers."""
    return W.answer_outcomes(answers(spark, folder), ended_events(spark, folder), changes(spark, folder), context(spark, folder), M)


@query("live_answers", "SELECT message_id, status, content, claims FROM o_outcomes")
def _live_answers(spark, folder):
    """Stored events and changes as two streams through keyed state; the terminal rows, and the claims that were shown."""
    root = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.least(F.col("seq"), F.lit(60)) / 3)
    ended_events(spark, folder).select("message_id", F.col("seq").alias("event_seq"), at.alias("event_time"), "type", "text", "source_chunk_ids", "answer_status").write.parquet(f"{root}/events")
    changes(spark, folder).select("message_id", "change_seq", F.timestamp_seconds(F.lit(1_700_000_000)).alias("event_time"), "status").write.parquet(f"{root}/changes")
    streams = [spark.readStream.schema(spark.read.parquet(f"{root}/{x}").schema).parquet(f"{root}/{x}") for x in ("events", "changes")]
    with W.list_state(spark):
        run = W.live_answers(*streams, context(spark, folder), M).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    terminal = out.filter("kind = 'terminal'").select("message_id", "status", F.col("text").alias("content"))
    shown = out.filter("kind = 'claim'").groupBy("message_id").agg(F.count(F.lit(1)).alias("claims"))
    return terminal.join(shown, "message_id", "left").withColumn("claims", F.coalesce("claims", F.lit(0).cast("bigint")))


@query("incremental_ingest", "SELECT document_id, count(*) AS chunks, sum(n_refs)::BIGINT AS refs, min(content_hash) AS low_hash, max(content_hash) AS high_hash FROM o_chunks GROUP BY ALL")
def _incremental_ingest(spark, folder):
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    N.incremental_ingest(spark, folder, f"{root}/chunks", f"{root}/state", "documents.parquet").awaitTermination()
    return read_document_rows(spark, f"{root}/chunks").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("n_refs").alias("refs"), F.min("content_hash").alias("low_hash"), F.max("content_hash").alias("high_hash"))


def chain(spark, folder):
    """The ingestion chain with a recogniser that reads every page, and the index; where its tables are."""
    root = f"{shared_folder(spark)}/chain-{uuid.uuid4().hex}"
    N.incremental_ingest(spark, folder, f"{root}/chunks", f"{root}/state", "documents.parquet", recognise=lambda docs, sheet: words_of(docs), index=True).awaitTermination()
    return f"{root}/chunks"


def words_of(docs):
    w = C.words_of(C.blocks_of(docs)).drop("source_method")
    return w.withColumns({"paragraph_index": F.floor(F.col("word_index") / 20), "line_index": F.floor(F.col("word_index") / 7) % 5})


@query("ingest_recognised_blocks", """SELECT f.document_id, f.page_number, m.b + f.block_index + 1 AS block_index, m.o + row_number() OVER (PARTITION BY f.document_id, f.page_number ORDER BY f.block_index) AS reading_order, f.text, f.x0, f.y1
FROM o_found f JOIN (SELECT document_id, page_number, max(reading_order) AS o, max(block_index) AS b FROM o_order GROUP BY ALL) m USING (document_id, page_number)""")
def _ingest_recognised_blocks(spark, folder):
    """Blocks that the OCR step of the chain has stored."""
    return read_document_rows(spark, N.place(chain(spark, folder), "ocr")).select("document_id", "page_number", "block_index", "reading_order", "text", "x0", "y1")


@query("ingest_ledgers", """SELECT step, verdict, count(*) AS documents, sum(doc_id)::BIGINT AS ids, sum(doc_id % 3 + 1)::BIGINT AS revisions FROM (SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ') = '' THEN 'EMPTY' ELSE 'ok' END AS verdict FROM documents)
CROSS JOIN (VALUES ('validate'), ('extract'), ('ocr'), ('chunk'), ('index')) s(step) GROUP BY ALL""")
def _ingest_ledgers(spark, folder):
    """What each step of the chain has noted, after a second run that has nothing to do."""
    out = chain(spark, folder)
    if N.advance(spark, out, index=True):
        raise AssertionError("a second run did something")
    verdicts = ledger(spark, N.place(out, "validate")).select("document_id", "verdict")
    found = [ledger(spark, N.place(out, step)).select(F.lit(step).alias("step"), "document_id", "content_revision") for step in N.STEPS]
    rows = functools.reduce(lambda a, b: a.unionByName(b), found).join(verdicts, "document_id")
    return rows.groupBy("step", "verdict").agg(F.count(F.lit(1)).alias("documents"), F.sum("document_id").alias("ids"), F.sum("content_revision").alias("revisions"))


@query("replace_document_rows", """SELECT document_id, count(*) AS chunks, min(content_hash) AS low_hash, max(content_hash) AS high_hash FROM v_chunks
WHERE document_id % 5 <> 0 AND (document_id % 5 <> 1 OR chunk_index = 0) GROUP BY ALL""")
def _replace_document_rows(spark, folder):
    """All chunks; then new ones for some documents and none for others, twice."""
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    chunks = C.v_chunks(spark, folder).select("document_id", "chunk_index", "content_hash")
    replace_document_rows(chunks, path, chunks.select("document_id"))
    d = F.col("document_id")
    for _ in range(2):
        replace_document_rows(chunks.filter((d % 5 == 1) & (F.col("chunk_index") == 0)), path, chunks.filter(d % 5 < 2).select("document_id"))
    return read_document_rows(spark, path).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("content_hash").alias("low_hash"), F.max("content_hash").alias("high_hash"))

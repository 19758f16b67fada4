"""Document and job lifecycle as batch data.

Event logs are clustered by (document_id, time shard): a document with a third of all events is
worked on by as many tasks as it has time shards, and the shards are then combined in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.operators.catalog import latest_jobs


def _allowed(current: Column, new: Column) -> Column:
    """Whether a step is in the transition table."""
    steps = F.create_map(*[x for s in S.DOCUMENT_STATES for x in (
        F.lit(s), F.array(*[F.lit(t) for t in S.ALLOWED_TRANSITIONS[s]]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.element_at(steps, current), new), F.lit(False))


def time_shard(ts="ts", seconds: int = S.EVENT_SHARD_SECONDS) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(ts)) / seconds)


def check_transitions(events: DataFrame) -> DataFrame:
    """Every event with the status before it and whether the step is allowed.

    The status before the first event of a shard is the last status of the nearest earlier shard.
    """
    df = events.withColumn("shard", time_shard())
    order = Window.partitionBy("document_id", "shard").orderBy("ts", "event_id")
    last = df.groupBy("document_id", "shard").agg(F.max_by("new_status", F.struct("ts", "event_id")).alias("shard_last"))
    before = last.withColumn(
        "shard_before", F.lag("shard_last").over(Window.partitionBy("document_id").orderBy("shard"))
    ).drop("shard_last")
    return (
        df.withColumn("inside", F.lag("new_status").over(order))
        .join(before, ["document_id", "shard"])
        .withColumn("old_status", F.coalesce("inside", "shard_before"))
        .withColumn("allowed", F.when(F.col("old_status").isNull(), F.lit(True)).otherwise(_allowed(F.col("old_status"), F.col("new_status"))))
        .drop("inside", "shard_before", "shard")
    )


#: Where each step leads from each state; the last row, for a step that is no state, leads nowhere.
_STEPS = np.array(
    [[t if S.DOCUMENT_STATES[t] in S.ALLOWED_TRANSITIONS[s] else i for i, s in enumerate(S.DOCUMENT_STATES)] for t in range(len(S.DOCUMENT_STATES))]
    + [list(range(len(S.DOCUMENT_STATES)))], np.int8)


def _composed(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One map for each run of rows: all maps of the run one after the other, by halving the rows again and again.

    first: whether a row starts a run.
    """
    run = np.cumsum(first) - 1
    while len(maps) > run[-1] + 1:
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        even = (np.arange(len(run)) - starts[run]) % 2 == 0
        left = np.flatnonzero(even)
        paired = left[(left + 1 < len(run)) & ~even[np.minimum(left + 1, len(run) - 1)]]
        maps[paired] = np.take_along_axis(maps[paired + 1], maps[paired].astype(np.intp), axis=1)
        maps, run = maps[even], run[even]
    return maps


def _maps_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """document_id, part, n, ends of each document's events in sorted rows; the last document of a batch is carried on."""
    part, held = TaskContext.get().partitionId(), None

    def out(ids, counts, ends):
        flat = pa.array(ends.reshape(-1).astype(np.int32))
        lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, ends.shape[1], dtype=np.int32), flat)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), part, np.int32)), pa.array(counts), lists], ["document_id", "part", "n", "ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("document_id")
        codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
        first = np.diff(codes, prepend=-1) != 0
        at = np.flatnonzero(first)
        steps = pc.fill_null(pc.index_in(batch.column("new_status"), value_set=pa.array(S.DOCUMENT_STATES)), len(S.DOCUMENT_STATES))
        ends = _composed(_STEPS[steps.to_numpy()], first)
        counts = np.diff(np.append(at, len(codes))).astype(np.int64)
        ids = ids.take(pa.array(at))
        if held is not None:
            if held[0][0].as_py() == ids[0].as_py():
                ends[0] = ends[0][held[2][0]]
                counts[0] += held[1][0]
            else:
                yield out(*held)
        if len(ids) > 1:
            yield out(ids[:-1], counts[:-1], ends[:-1])
        held = ids[-1:], counts[-1:], ends[-1:]
    if held is not None:
        yield out(*held)


def replay_status(events: DataFrame, start: str = "uploaded") -> DataFrame:
    """Present status of every document: events applied in order, rejected steps ignored.

    A run of events maps each state to one state, and such maps can be put together in any grouping. Events are sorted over
    the whole cluster by document and time, so that a document with a third of all events, or all of them in one hour, lies
    in many parts. Each part gives one map for each of its documents; a document's few maps, one for each part at most, are
    applied one after the other. A status that is no state changes nothing; null ids are one document; an empty log gives no
    row. Events of equal time go by event_id, then by status.
    """
    order = ["document_id", "ts", "event_id", "new_status"]
    rows = events.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = events.schema["document_id"].dataType.simpleString()
    maps = rows.select("document_id", "new_status").mapInArrow(_maps_of_runs, f"document_id {kind}, part int, n bigint, ends array<int>")
    chained = maps.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("part", "ends"))).alias("maps"), F.sum("n").alias("events"))
    states = F.array(*[F.lit(s) for s in S.DOCUMENT_STATES])
    last = F.aggregate("maps", F.lit(S.DOCUMENT_STATES.index(start)), lambda now, m: F.element_at(m["ends"], now + 1))
    return chained.select("document_id", "events", F.element_at(states, last + 1).alias("status"))


def dedupe_active_jobs(jobs: DataFrame) -> DataFrame:
    """At most one active job per document and type: the newest stays, the others are superseded."""
    active = F.col("status").isin("queued", "running")
    newest = jobs.filter(active).groupBy("document_id", "job_type").agg(
        F.max(F.struct("created_at", "job_id")).getField("job_id").alias("keep_id")
    )
    df = jobs.join(newest, ["document_id", "job_type"], "left")
    old = active & (F.col("job_id") != F.col("keep_id"))
    return df.withColumns(
        {
            "status": F.when(old, "failed").otherwise(F.col("status")),
            "failure_code": F.when(old, "SUPERSEDED").otherwise(F.col("failure_code")),
        }
    ).drop("keep_id")


def recover_documents(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """What happens to every document after a restart: status, and the step to start again."""
    s = F.col("processing_status")
    extract = latest_jobs(jobs.filter("job_type = 'extract_document'")).select(
        "document_id", (F.col("attempt_count") >= F.col("max_attempts")).alias("exhausted")
    )
    df = documents.filter("deleted_at is null").join(extract, "document_id", "left")
    exhausted = F.coalesce("exhausted", F.lit(False))
    broken = s.isin("created", "uploading")
    again = s.isin("uploaded", "queued", "validating")
    return df.withColumns(
        {
            "new_status": F.when(broken, "failed").when(again, "queued")
            .when((s == "extracting") & exhausted, "extraction_failed").otherwise(s),
            "restart": F.when(again, "validate").when((s == "extracting") & ~exhausted, "extract"),
            "failure_code": F.when(broken, "VALIDATION_FAILED")
            .when((s == "extracting") & exhausted, "EXTRACTION_ATTEMPTS_EXHAUSTED"),
        }
    ).drop("exhausted")


def recover_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages whose OCR was running wait again (documents that are not deleted)."""
    alive = documents.filter("deleted_at is null").select("document_id")
    waiting = pages.filter(F.col("ocr_status").isin("pending", "running")).join(alive, "document_id", "left_semi")
    return waiting.withColumn("ocr_status", F.lit("pending"))


def recover_jobs(jobs: DataFrame, waiting_pages: DataFrame) -> DataFrame:
    """Active OCR jobs without waiting pages, and active chunk and summary jobs, end as interrupted."""
    active = F.col("status").isin("queued", "running")
    waiting = waiting_pages.select("document_id").distinct().withColumn("has_waiting", F.lit(True))
    df = jobs.join(waiting, "document_id", "left")
    stale = active & (
        F.col("job_type").isin("chunk_rebuild", "summarize")
        | ((F.col("job_type") == "ocr_document") & F.col("has_waiting").isNull())
    )
    return df.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "failure_code": F.when(stale, "INTERRUPTED").otherwise(F.col("failure_code")),
        }
    ).drop("has_waiting")


def recover_answers(messages: DataFrame) -> DataFrame:
    """Answers that were being written end as interrupted; questions stay."""
    cut = (F.col("role") == "assistant") & F.col("status").isin(*S.ACTIVE_ANSWER_STATUSES)
    return messages.withColumn("error_code", F.when(cut, "APP_RESTARTED")).withColumn(
        "status", F.when(cut, "interrupted").otherwise(F.col("status"))
    )


def recover_interrupted(documents: DataFrame, jobs: DataFrame, pages: DataFrame, messages: DataFrame) -> DataFrame:
    """All that a restart settles, in one table: kind (document, page, job, answer), key, status, restart, failure_code.

    `key` is the document, the document and page, the job, or the thread and sequence number.  Jobs are judged by the pages that
    still wait, so that an OCR job with work left goes on.  Rows of deleted documents and of pages that don't wait are left out;
    jobs and answers that nothing interrupted stay, with their status as it was.
    """
    none = F.lit(None).cast("string")
    waiting = recover_pages(pages, documents)

    def part(kind, df, key, status="status", restart=none, failure=none):
        columns = F.array(*[F.col(k).cast("bigint") for k in key])
        return df.select(F.lit(kind).alias("kind"), columns.alias("key"), F.col(status).alias("status"), restart.alias("restart"), failure.alias("failure_code"))

    found = part("document", recover_documents(documents, jobs), ["document_id"], "new_status", F.col("restart"), F.col("failure_code"))
    found = found.unionByName(part("page", waiting, ["document_id", "page_number"], "ocr_status"))
    found = found.unionByName(part("job", recover_jobs(jobs, waiting), ["job_id"], failure=F.col("failure_code")))
    return found.unionByName(part("answer", recover_answers(messages), ["thread_id", "sequence_number"], failure=F.col("error_code")))


def needs_extraction(documents: DataFrame, engine: str, version: str, schema_version: int, force: bool = False) -> DataFrame:
    """Documents to extract: not yet done with this engine, version and schema (all with `force`)."""
    current = (
        (F.col("processing_status") == "extracted")
        & F.col("extraction_engine").eqNullSafe(F.lit(engine))
        & F.col("engine_version").eqNullSafe(F.lit(version))
        & F.col("schema_version").eqNullSafe(F.lit(schema_version))
    )
    ready = F.col("processing_status").isin("ready", "extracted", "partially_extracted", "ocr_required", "extraction_failed")
    return documents.filter(ready if force else ready & ~current)


def bump_revisions(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add 1 to the content revision for a successful extraction or OCR of at least one page."""
    gained = outcomes.groupBy("document_id").agg(
        F.sum(F.when(F.col("kind") == "extract", (F.col("result") != "extraction_failed").cast("int"))
              .otherwise((F.col("processed_pages") > 0).cast("int"))).alias("gained")
    )
    return (
        documents.join(gained, "document_id", "left")
        .withColumn("content_revision", F.coalesce("content_revision", F.lit(1)) + F.coalesce("gained", F.lit(0)))
        .withColumn("stale", ~F.col("chunk_revision").eqNullSafe(F.col("content_revision")))
        .drop("gained")
    )


def retry_documents(documents: DataFrame) -> DataFrame:
    """Failed documents with a stored file are queued again; every other request gets a reason."""
    failed = F.col("processing_status") == "failed"
    reason = F.when(~failed, "not_failed").when(F.col("storage_key").isNull(), "no_stored_file")
    ok = reason.isNull()
    return documents.withColumns(
        {
            "reject_reason": reason,
            "new_status": F.when(ok, "queued").otherwise(F.col("processing_status")),
            "processing_stage": F.when(ok, "file_validation"),
        }
    )

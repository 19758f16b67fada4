"""Question answering: retrieval context, claim verification and answer bookkeeping.

An answer has at most eight context chunks and forty raw claims (fixed limits), so everything that
is kept per answer is bounded; across answers the work is joins on message_id.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import search as R
from pagewright.operators.index import TextIndex, index_of


# --- retrieval context -------------------------------------------------------------------------

def retrieve_context(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context of every question from its ranked hits (query_id, chunk_id, rank).

    First chunk per content hash, 3000 characters each, and in rank order while the sum stays within
    12 000 (sums only grow, so a running sum gives the same cut as stopping early).
    """
    hits = ranked.filter(F.col("rank") <= S.QA_SEARCH_LIMIT)
    df = hits.join(chunks.select("chunk_id", "content_hash", "section_title", "normalized_text"), "chunk_id")
    df = df.withColumn("text", F.substring("normalized_text", 1, S.CONTEXT_CHUNK_MAX_CHARS)).filter(~T.is_blank("text"))
    copy = F.row_number().over(Window.partitionBy("query_id", "content_hash").orderBy("rank"))
    df = df.withColumn("copy", copy).filter("copy = 1")
    order = Window.partitionBy("query_id").orderBy("rank")
    df = df.withColumns({"place": F.row_number().over(order), "total": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return df.filter((F.col("total") <= S.CONTEXT_MAX_CHARS) | (F.col("place") == 1)).select(
        "query_id", "rank", "chunk_id", "section_title", "text", "content_hash", F.col("total").cast("bigint")
    )


def retrieve(questions: DataFrame, chunks: DataFrame, embed=None, index: TextIndex | None = None) -> DataFrame:
    """Context of questions (query_id, document_id, query): hybrid search where there is an embedder, else any-word keywords.

    `index` is the stored one of the chunks (None: made from them)."""
    if embed is not None:
        asked = questions.withColumns({"mode": F.lit("hybrid"), "limit": F.lit(S.QA_SEARCH_LIMIT)})
        return retrieve_context(R.hybrid_search(asked, chunks, embed, index).select("query_id", "chunk_id", "rank"), chunks)
    best = R._best(R.keyword_hits(questions, index or index_of(chunks), match_all=False), F.lit(S.QA_SEARCH_LIMIT))
    return retrieve_context(best.select("query_id", "chunk_id", F.col("place").cast("bigint").alias("rank")), chunks)


def recent_history(messages: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Last eight usable turns of every thread before a sequence number (thread_id, before_seq)."""
    usable = messages.filter((F.col("role") == "user") | F.col("status").isin("completed", "conflicting_evidence"))
    if before is not None:
        usable = usable.join(before, "thread_id").filter("sequence_number < before_seq")
    newest = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("sequence_number")))
    kept = usable.withColumn("age", newest).filter(F.col("age") <= S.HISTORY_MESSAGES)
    return kept.select("thread_id", "sequence_number", "role", F.substring("content", 1, S.HISTORY_MAX_CHARS).alias("content"))


# --- claims against context ------------------------------------------------------------------------

def context_per_answer(context: DataFrame, markers=S.NEGATION_MARKERS) -> DataFrame:
    """The few context chunks of every answer in one array, with what the checks need of each text."""
    one = F.struct(
        "rank", "chunk_id", F.regexp_replace("text", ",", "").alias("digits"),
        T.word_tokens("text").alias("tokens"), T.negation_markers("text", markers).alias("markers"),
    )
    return context.groupBy("message_id").agg(F.sort_array(F.collect_list(one)).alias("context"))


def with_context(claims: DataFrame, context: DataFrame, markers=S.NEGATION_MARKERS) -> DataFrame:
    """Claims with their trimmed text, the context of their answer and the cited part of it."""
    df = claims.join(context_per_answer(context, markers), "message_id", "left")
    df = df.withColumn("claim_text", F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, S.CLAIM_MAX_CHARS))
    df = df.withColumn("valid_ids", valid_sources(F.coalesce("source_chunk_ids", F.array().cast("array<string>")), F.col("context.chunk_id")))
    return df.withColumn("cited", F.filter("context", lambda c: F.array_contains("valid_ids", c["chunk_id"])))


def valid_sources(ids: Column, known: Column) -> Column:
    """Claimed chunk ids that were retrieved, in claimed order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(ids, lambda i: F.array_contains(F.coalesce(known, none), i)))


def numbers_grounded() -> Column:
    """Every number of the claim occurs in a cited text (no numbers: grounded)."""
    return F.forall(
        T.extract_numbers("claim_text"),
        lambda n: F.exists("cited", lambda c: F.regexp_like(c["digits"], T.number_pattern(n, "claim"))),
    )


def lexically_grounded(markers=S.NEGATION_MARKERS) -> Column:
    """At least a third of the claim's words (and one) occur in the cited texts, without new negation."""
    known = F.flatten(F.transform("cited", lambda c: c["tokens"]))

    def enough(words):
        return (F.size(words) > 0) & (F.size(F.array_intersect(words, known)) >= F.greatest(F.lit(1), F.ceil(F.size(words) / 3)))

    return T.bound(T.word_tokens("claim_text"), enough) & polarity_consistent(markers)


def polarity_consistent(markers=S.NEGATION_MARKERS) -> Column:
    """No negation marker of the claim is missing from the cited texts."""
    known = F.flatten(F.transform("cited", lambda c: c["markers"]))
    return F.size(F.array_except(T.negation_markers("claim_text", markers), known)) == 0


def classify_claims(claims: DataFrame, context: DataFrame, markers=S.NEGATION_MARKERS) -> DataFrame:
    """First failing rule of every claim; null reason means supported. `had_context`: the answer has any context."""
    df = with_context(claims, context, markers)
    reason = (
        F.when(F.col("claim_text") == "", "empty_text")
        .when(F.size("valid_ids") == 0, "no_valid_source")
        .when(~numbers_grounded(), "number_not_in_source")
        .when(~lexically_grounded(markers), "not_lexically_grounded")
    )
    return df.withColumns({"reason": reason, "had_context": F.col("context").isNotNull()}).drop("context", "cited")


def rebuild_source_refs(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations of every claim from the stored locations of its valid chunks, one per place.

    `claims` have valid_ids; `refs` are (message_id, chunk_id, ref_pos, page_number, block_id, bbox).
    """
    ids = claims.select("message_id", "claim_no", F.posexplode("valid_ids").alias("id_pos", "chunk_id"))
    place = ["page_number", "block_id", "bbox"]
    first = F.min(F.struct("id_pos", "ref_pos")).alias("order")
    return ids.join(refs, ["message_id", "chunk_id"]).groupBy("message_id", "claim_no", *place).agg(first)


def claims_conflict(claims: DataFrame, markers=S.NEGATION_MARKERS) -> DataFrame:
    """Answers in which two claims share three subject words and only one of them is negated.

    Input are supported claims of an answer (at most twenty), so the comparison stays inside one
    short array per answer.
    """
    answers = claims.groupBy("message_id").agg(F.collect_list(_polar(markers)).alias("c"))
    return answers.select("message_id", _clash("c").alias("conflict"))


def _polar(markers) -> Column:
    return F.struct(T.has_negation("claim_text", markers).alias("negated"), T.subject_tokens("claim_text", markers).alias("subject"))


def _clash(polar: str) -> Column:
    negated, plain = F.filter(polar, lambda x: x["negated"]), F.filter(polar, lambda x: ~x["negated"])
    return F.exists(
        negated,
        lambda a: F.exists(plain, lambda b: F.size(F.array_intersect(a["subject"], b["subject"])) >= S.CONFLICT_MIN_SHARED),
    )


def usable_claims(claims: DataFrame) -> DataFrame:
    """The claims an answer may keep: of the first forty raw ones, blank and repeated texts dropped, twenty."""
    answer = Window.partitionBy("message_id").orderBy("claim_no")
    raw = claims.withColumn("raw_no", F.row_number().over(answer)).filter(F.col("raw_no") <= S.MAX_RAW_CLAIMS)
    raw = raw.withColumn("text", F.substring(T.strip(F.coalesce("text", F.lit(""))), 1, S.CLAIM_MAX_CHARS)).filter("text <> ''")
    same = Window.partitionBy("message_id", "text").orderBy("claim_no")
    once = raw.withColumn("copy", F.row_number().over(same)).filter("copy = 1")
    kept = once.withColumn("claim_index", F.row_number().over(answer) - 1).filter(F.col("claim_index") < S.MAX_CLAIMS)
    return kept.drop("raw_no", "copy")


def verify_answers(answers: DataFrame, claims: DataFrame, context: DataFrame, markers=S.NEGATION_MARKERS) -> tuple[DataFrame, DataFrame]:
    """Final status of every answer, and its kept claims with their verification."""
    judged = classify_claims(usable_claims(claims), context, markers)
    # one pass over the judged claims, as judging them is most of the work
    counts = judged.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count(F.when(F.col("reason").isNull(), 1)).alias("n_supported"),
        F.collect_list(F.when(F.col("reason").isNull(), _polar(markers))).alias("supported"),
    ).withColumn("conflict", _clash("supported")).drop("supported")
    had = context.select("message_id").distinct().withColumn("had_results", F.lit(True))
    df = answers.join(counts, "message_id", "left").join(had, "message_id", "left")
    zero = F.lit(0).cast("bigint")
    n = F.coalesce("n_supported", zero)
    clash = (F.col("answer_status") == "conflicting_evidence") | F.coalesce("conflict", F.lit(False))
    status = (
        F.when(F.col("had_results").isNull(), "not_found")
        .when(n == 0, "insufficient_evidence")
        .when((n >= 2) & F.coalesce(clash, F.lit(False)), "conflicting_evidence")
        .otherwise("completed")
    )
    result = df.select(
        "message_id", status.alias("status"), n.alias("n_supported"), F.coalesce("n_claims", zero).alias("n_claims"),
        F.substring(T.strip(F.coalesce("answer", F.lit(""))), 1, S.ANSWER_MAX_CHARS).alias("answer"),
        F.slice(F.filter(F.transform("follow_ups", T.strip), lambda f: f != ""), 1, S.MAX_FOLLOWUPS).alias("follow_ups"),
    )
    ok = F.col("reason").isNull()
    rows = judged.join(result.select("message_id", "status"), "message_id").withColumn(
        "verification",
        F.when(ok & (F.col("status") == "conflicting_evidence"), "conflicting").when(ok, "supported").otherwise("unsupported"),
    )
    rows = rows.filter(ok | ~F.col("status").isin("not_found", "insufficient_evidence"))
    return result, rows


def deterministic_answers(context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test provider: the first three context chunks become claims of 200 characters."""
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("rank"))
    top = context.withColumn("place", first).filter("place <= 3").filter(~T.is_blank("text"))
    head = T.strip(F.substring("text", 1, 200))
    claims = top.select(
        "message_id", (F.col("place") - 1).alias("claim_no"),
        F.when(head != "", head).otherwise(F.coalesce("section_title", F.lit(""))).alias("text"),
        F.array("chunk_id").alias("source_chunk_ids"),
    )
    parts = F.array_sort(F.collect_list(F.struct("claim_no", "text")))
    answers = claims.groupBy("message_id").agg(
        F.substring(F.array_join(F.transform(parts, lambda p: p["text"]), " "), 1, S.ANSWER_MAX_CHARS).alias("answer"),
        F.count(F.lit(1)).alias("n_claims"),
    )
    ids = context.select("message_id").distinct()
    answers = ids.join(answers, "message_id", "left").select(
        "message_id",
        F.when(F.coalesce("answer", F.lit("")) == "", S.NOT_FOUND_TEXT).otherwise(F.col("answer")).alias("answer"),
        F.when(F.coalesce("n_claims", F.lit(0)) > 0, "answered").otherwise("not_found").alias("answer_status"),
    )
    return answers, claims


def public_citation(refs: DataFrame) -> DataFrame:
    """Only the five public fields of a location (no internal ids)."""
    return refs.select("page_number", "bbox", "block_id", "section_title", "source_method")


# --- revisions ------------------------------------------------------------------------------------------

def chunk_set_hash(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Fingerprint of the chunks of every key: SHA-256 of the `id:hash` lines, sorted by id, then hash.

    One hash at every size: the sorted lines of a key stream through one digest, and nothing of them is kept.
    """
    rows = chunks.select(
        key, F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("line_id"), F.coalesce("content_hash", F.lit("")).alias("line_hash")
    )
    kind = rows.schema[key].dataType

    def run(batches):
        open_key, digest, count = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([open_key], to_arrow_type(kind)), pa.array([digest.hexdigest()]), pa.array([count], pa.int64())], [key, "set_hash", "n_chunks"]
            )

        for batch in batches:
            keys, ids, hashes = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                lines = "\n".join(f"{i}:{h}" for i, h in zip(ids[at:to], hashes[at:to])).encode()
                if digest is not None and keys[at] == open_key:
                    digest.update(b"\n" + lines)
                    count += to - at
                else:
                    if digest is not None:
                        yield row()
                    open_key, digest, count = keys[at], hashlib.sha256(lines), to - at
                at = to
        if digest is not None:
            yield row()

    # a hash of the key: Spark would leave out a shuffle on the column itself after a join on it
    ordered = rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, "line_id", "line_hash")
    return ordered.mapInArrow(run, f"`{key}` {kind.simpleString()}, set_hash string, n_chunks bigint")


def revision_guard(results: DataFrame, documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Keep a result only if document revisions and chunk set are the ones it started from."""
    now = documents.select(
        "document_id", F.col("content_revision").alias("content_now"), F.col("chunk_revision").alias("chunk_now"),
        F.col("deleted_at").isNotNull().alias("gone"),
    )
    df = results.join(now, "document_id", "left").join(hashes.select("document_id", F.col("set_hash").alias("hash_now")), "document_id", "left")
    same = (
        ~F.coalesce("gone", F.lit(True)) & F.col("start_content_revision").eqNullSafe(F.col("content_now"))
        & F.col("start_chunk_revision").eqNullSafe(F.col("chunk_now")) & F.col("start_hash").eqNullSafe(F.col("hash_now"))
    )
    return df.withColumn("final_status", F.when(same, F.col("status")).otherwise("revision_changed")).drop("content_now", "chunk_now", "gone", "hash_now")


# --- threads -------------------------------------------------------------------------------------------------

def thread_transcript(messages: DataFrame, claims: DataFrame) -> DataFrame:
    """Messages with their ordered claims (an answer keeps at most twenty)."""
    own = claims.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", "claim_text", "verification"))).alias("claims"))
    return messages.join(own, "message_id", "left")


def next_sequence(messages: DataFrame, threads: DataFrame) -> DataFrame:
    last = messages.groupBy("thread_id").agg(F.max("sequence_number").alias("last"))
    return threads.join(last, "thread_id", "left").select("thread_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_sequence"))


def retryable_answers(messages: DataFrame) -> DataFrame:
    """Threads whose last answer failed or was overtaken, with the question before it."""
    last = (
        messages.filter("role = 'assistant'").groupBy("thread_id")
        .agg(F.max(F.struct("sequence_number", "status")).alias("m"))
        .select("thread_id", F.col("m.sequence_number").alias("answer_seq"), F.col("m.status").alias("status"))
        .filter(F.col("status").isin("failed", "revision_changed"))
    )
    asked = messages.filter("role = 'user'").select("thread_id", "sequence_number", "content").join(last, "thread_id").filter("sequence_number < answer_seq")
    return asked.groupBy("thread_id", "answer_seq", "status").agg(F.max(F.struct("sequence_number", "content")).alias("q")).select(
        "thread_id", "answer_seq", "status", F.col("q.sequence_number").alias("question_seq"), F.col("q.content").alias("question")
    )


def public_answer_text(status="status", answer="answer") -> Column:
    """Model prose only for verified answers; fixed texts otherwise."""
    s, a = T.col(status), T.col(answer)
    shown = F.when(F.coalesce(a, F.lit("")) == "", S.NOT_FOUND_TEXT).otherwise(a)
    return F.when(s == "not_found", S.NOT_FOUND_TEXT).when(s == "insufficient_evidence", S.INSUFFICIENT_TEXT).otherwise(shown)


def streamed_answer_text(claims: DataFrame) -> DataFrame:
    """Text of a streamed answer: its supported claims in order, one per line."""
    parts = F.array_sort(F.collect_list(F.struct("claim_index", "claim_text")))
    return claims.groupBy("message_id").agg(F.array_join(F.transform(parts, lambda p: p["claim_text"]), "\n").alias("content"))


def consent_filter(rows: DataFrame, documents: DataFrame, users: DataFrame, provider: str, is_local: bool = False) -> DataFrame:
    """Rows that may go to a provider: external ones need the consent of document and owner."""
    if provider != "openai_compatible" or is_local:
        return rows
    owners = documents.filter("external_allowed").join(users.filter("external_ai_allowed"), "user_id").select("document_id")
    return rows.join(owners, "document_id", "left_semi")


def single_active_answer(messages: DataFrame) -> DataFrame:
    """Threads with more than one answer in progress."""
    active = messages.filter((F.col("role") == "assistant") & F.col("status").isin(*S.ACTIVE_ANSWER_STATUSES))
    return active.groupBy("thread_id").agg(F.count(F.lit(1)).alias("active"), F.min("sequence_number").alias("first_active")).withColumn(
        "rejected", F.col("active") - 1
    )

"""Queries for question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import vectors as X
from pagewright.operators import qa as Q
from pagewright.operators import search as R
from pagewright.plans import oracle_views as V
from pagewright.plans import search_queries as SQ
from pagewright.plans.registry import query
from pagewright.session import per_folder
from pagewright.sources import corpus as C

VIEWS = V.VIEWS
M = C.DATA_MARKERS


@per_folder
def answers(spark, folder):
    """One model answer per page."""
    m = C.message_id()
    return C.v_pages(spark, folder).select(
        m.alias("message_id"), "document_id", F.col("raw_text").alias("answer"),
        C.pick(m % 4, ("answered", "conflicting_evidence", "answered", "not_found")).alias("answer_status"),
        F.array(F.lit(" "), F.concat(F.lit(" a"), m.cast("string")), F.lit("b"), F.lit("c "), F.lit("d")).alias("follow_ups"),
    )


@per_folder
def context(spark, folder):
    """Digital text only: an answer over a page that is all OCR has found nothing."""
    return C.v_context(spark, folder).filter("source_method = 'digital'")


@per_folder
def judged(spark, folder):
    return Q.classify_claims(C.v_claims(spark, folder), context(spark, folder), M)


@per_folder
def verified(spark, folder):
    return Q.verify_answers(answers(spark, folder), C.v_claims(spark, folder), context(spark, folder), M)


VIEWS["o_ctx"] = "SELECT * FROM v_context WHERE source_method = 'digital'"


def classified(src):
    t = f"substr({V.strip('c.text')}, 1, {S.CLAIM_MAX_CHARS})"
    hay = "coalesce(hay, '')"
    num_ok = f"len(list_filter({V.numbers('claim_text')}, lambda nm: NOT ({V.number_found(hay, 'nm', 'claim')}))) = 0"
    toks = V.words("claim_text")
    shared = f"len(list_intersect({toks}, {V.words(hay)}))"
    pol = f"len(list_filter({V.markers_in('claim_text')}, lambda mk: NOT contains({V.padded(hay)}, mk))) = 0"
    return f"""
SELECT *, num_ok, lex_ok, pol_ok, CASE WHEN claim_text = '' THEN 'empty_text' WHEN len(valid_ids) = 0 THEN 'no_valid_source' WHEN NOT num_ok THEN 'number_not_in_source' WHEN NOT (lex_ok AND pol_ok) THEN 'not_lexically_grounded' END AS reason
FROM (SELECT *, {num_ok} AS num_ok, len({toks}) > 0 AND {shared} >= greatest(1, ceil(len({toks})/3.0)) AS lex_ok, {pol} AS pol_ok FROM (
  SELECT c.*, {t} AS claim_text, list_filter(source_chunk_ids, lambda i: list_contains(coalesce(x.ids, []), i)) AS raw_ids,
    list_filter(list_transform(range(len(source_chunk_ids)), lambda k: CASE WHEN list_contains(coalesce(x.ids, []), source_chunk_ids[k+1]) AND NOT list_contains(source_chunk_ids[1:k], source_chunk_ids[k+1]) THEN source_chunk_ids[k+1] END), lambda z: z IS NOT NULL) AS valid_ids,
    array_to_string(list_transform(list_filter(coalesce(x.items, []), lambda it: list_contains(source_chunk_ids, it.chunk_id)), lambda it: it.text), chr(10)) AS hay
  FROM {src} c LEFT JOIN (SELECT message_id, list(chunk_id) AS ids, list({{'chunk_id': chunk_id, 'text': text}}) AS items FROM o_ctx GROUP BY message_id) x USING (message_id)))"""


VIEWS["o_judged"] = classified("v_claims")
VIEWS["o_usable"] = f"""
SELECT * REPLACE (t AS text), row_number() OVER (PARTITION BY message_id ORDER BY claim_no) - 1 AS claim_index FROM (
  SELECT *, row_number() OVER (PARTITION BY message_id, t ORDER BY claim_no) AS copy FROM (
    SELECT *, substr({V.strip("coalesce(text,'')")}, 1, {S.CLAIM_MAX_CHARS}) AS t, row_number() OVER (PARTITION BY message_id ORDER BY claim_no) AS raw_no FROM v_claims)
  WHERE raw_no <= {S.MAX_RAW_CLAIMS} AND t <> '') WHERE copy = 1 QUALIFY claim_index < {S.MAX_CLAIMS}"""
VIEWS["o_ujudged"] = classified("o_usable")
VIEWS["o_conflict"] = f"""
SELECT DISTINCT a.message_id FROM (SELECT message_id, claim_no, len({V.markers_in('claim_text')}) > 0 AS neg, {V.subject('claim_text')} AS subj FROM o_ujudged WHERE reason IS NULL) a
JOIN (SELECT message_id, claim_no, len({V.markers_in('claim_text')}) > 0 AS neg, {V.subject('claim_text')} AS subj FROM o_ujudged WHERE reason IS NULL) b
 ON a.message_id=b.message_id AND a.neg AND NOT b.neg AND len(list_intersect(a.subj, b.subj)) >= {S.CONFLICT_MIN_SHARED}"""
VIEWS["o_answers"] = f"""
SELECT document_id*1000000+page_number AS message_id, document_id, raw_text AS answer, {V.pick('(document_id*1000000+page_number) % 4', ("answered", "conflicting_evidence", "answered", "not_found"))} AS answer_status FROM v_pages"""
VIEWS["o_verified"] = f"""
SELECT a.message_id, coalesce(n, 0) AS n_claims, coalesce(s, 0) AS n_supported, substr({V.strip('answer')}, 1, {S.ANSWER_MAX_CHARS}) AS answer,
  CASE WHEN x.message_id IS NULL THEN 'not_found' WHEN coalesce(s,0)=0 THEN 'insufficient_evidence' WHEN s >= 2 AND (answer_status='conflicting_evidence' OR k.message_id IS NOT NULL) THEN 'conflicting_evidence' ELSE 'completed' END AS status
FROM o_answers a LEFT JOIN (SELECT message_id, count(*) n, count(*) FILTER (reason IS NULL) s FROM o_ujudged GROUP BY ALL) c USING (message_id) LEFT JOIN o_conflict k USING (message_id)
LEFT JOIN (SELECT DISTINCT message_id FROM o_ctx) x USING (message_id)"""


@query("retrieve_context", """
WITH ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_index) AS rank FROM (SELECT query_id, chunk_id, chunk_index, score FROM o_s_bm UNION ALL SELECT query_id, chunk_id, chunk_index, score FROM o_s_scan)),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS copy FROM (SELECT r.query_id, r.rank, v.chunk_id, v.content_hash, substr(v.normalized_text, 1, 3000) AS text FROM ranked r JOIN v_chunks v USING (chunk_id) WHERE rank <= 8))
SELECT query_id, rank, chunk_id, total::BIGINT AS total FROM (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE copy = 1) WHERE total <= 12000 OR place = 1""")
def _retrieve_context(spark, folder):
    return Q.retrieve(C.v_queries(spark, folder), C.v_chunks(spark, folder), index=SQ.line_index(spark, folder)).select("query_id", "rank", "chunk_id", "total")


@query("retrieve_context_hybrid", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY rank) AS copy FROM (SELECT r.query_id, r.rank, v.chunk_id, v.content_hash, substr(v.normalized_text, 1, 3000) AS text FROM o_q_top r JOIN v_chunks v USING (chunk_id)))
SELECT query_id, rank, chunk_id, total::BIGINT AS total FROM (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE copy = 1) WHERE total <= 12000 OR place = 1""")
def _retrieve_context_hybrid(spark, folder):
    found = Q.retrieve(C.v_queries(spark, folder), C.v_chunks(spark, folder), X.deterministic_embedding, SQ.line_index(spark, folder))
    return found.select("query_id", "rank", "chunk_id", "total")


@query("recent_history", """SELECT thread_id, sequence_number, role, content FROM (SELECT m.thread_id, sequence_number, role, substr(content, 1, 2000) AS content, row_number() OVER (PARTITION BY m.thread_id ORDER BY sequence_number DESC) AS age
 FROM v_messages m JOIN (SELECT thread_id, max(sequence_number) AS before_seq FROM v_messages GROUP BY ALL) b USING (thread_id) WHERE (role='user' OR status IN ('completed','conflicting_evidence')) AND sequence_number < before_seq) WHERE age <= 8""")
def _recent_history(spark, folder):
    m = C.v_messages(spark, folder)
    return Q.recent_history(m, m.groupBy("thread_id").agg(F.max("sequence_number").alias("before_seq")))


@query("valid_sources", "SELECT message_id, claim_no, array_to_string(valid_ids, ',') AS valid_ids FROM o_judged")
def _valid_sources(spark, folder):
    return judged(spark, folder).select("message_id", "claim_no", F.array_join("valid_ids", ",").alias("valid_ids"))


VIEWS["o_refs"] = """
SELECT document_id*1000000+page_number AS message_id, block_id AS chunk_id, 0 AS ref_pos, page_number, block_id, x0, y0, x1, y1 FROM v_blocks
UNION ALL SELECT b.document_id*1000000+b.page_number, b.block_id, 1, b.page_number, f.block_id, f.x0, f.y0, f.x1, f.y1 FROM v_blocks b JOIN v_blocks f ON f.document_id=b.document_id AND f.page_number=b.page_number AND f.block_index=0 WHERE b.block_index > 0"""


def context_refs(spark, folder):
    """Two locations per chunk: its own block and the first block of its page."""
    b = C.v_blocks(spark, folder)
    own = b.select(C.message_id().alias("message_id"), F.col("block_id").alias("chunk_id"), F.lit(0).alias("ref_pos"), "page_number", "block_id",
                   F.array("x0", "y0", "x1", "y1").alias("bbox"))
    first = own.filter(F.col("block_id").endswith("-0")).select("message_id", "page_number", F.col("block_id").alias("fb"), F.col("bbox").alias("fx"))
    second = own.filter(~F.col("block_id").endswith("-0")).join(first, ["message_id", "page_number"]).select(
        "message_id", "chunk_id", F.lit(1).alias("ref_pos"), "page_number", F.col("fb").alias("block_id"), F.col("fx").alias("bbox"))
    return own.unionByName(second)


@query("rebuild_source_refs", """SELECT message_id, claim_no, page_number, block_id, min(id_pos*10+ref_pos)::BIGINT AS ref_order, any_value(x0) AS x0, any_value(y1) AS y1 FROM (
 SELECT j.message_id, claim_no, unnest(range(len(valid_ids))) AS id_pos, unnest(valid_ids) AS chunk_id FROM o_judged j) JOIN o_refs USING (message_id, chunk_id) GROUP BY message_id, claim_no, page_number, block_id""")
def _rebuild_source_refs(spark, folder):
    return Q.rebuild_source_refs(judged(spark, folder), context_refs(spark, folder)).select(
        "message_id", "claim_no", "page_number", "block_id", (F.col("order.id_pos") * 10 + F.col("order.ref_pos")).cast("bigint").alias("ref_order"),
        F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1"))


def flagged(name, column, expr):
    @query(name, f"SELECT message_id, claim_no, {column} FROM o_judged WHERE len(valid_ids) > 0")
    def run(spark, folder):
        df = Q.with_context(C.v_claims(spark, folder), context(spark, folder), M).filter(F.size("valid_ids") > 0)
        return df.select("message_id", "claim_no", expr().alias(column.split(" AS ")[-1]))

    return run


flagged("numbers_grounded", "num_ok AS grounded", Q.numbers_grounded)
flagged("lexically_grounded", "lex_ok AND pol_ok AS grounded", lambda: Q.lexically_grounded(M))
flagged("polarity_consistent", "pol_ok AS consistent", lambda: Q.polarity_consistent(M))


@query("classify_claims", "SELECT message_id, claim_no, reason FROM o_judged")
def _classify_claims(spark, folder):
    return judged(spark, folder).select("message_id", "claim_no", "reason")


@query("claims_conflict", "SELECT message_id, message_id IN (SELECT message_id FROM o_conflict) AS conflict FROM (SELECT DISTINCT message_id FROM o_ujudged WHERE reason IS NULL)")
def _claims_conflict(spark, folder):
    kept = Q.classify_claims(Q.usable_claims(C.v_claims(spark, folder)), context(spark, folder), M)
    return Q.claims_conflict(kept.filter("reason is null"), M)


@query("verify_answers", "SELECT message_id, status, n_supported, n_claims, answer, 'a'||message_id||'|b|c' AS follow_ups FROM o_verified")
def _verify_answers(spark, folder):
    return verified(spark, folder)[0].withColumn("follow_ups", F.array_join("follow_ups", "|"))


@query("verified_claims", """SELECT u.message_id, u.claim_index, CASE WHEN reason IS NULL AND v.status='conflicting_evidence' THEN 'conflicting' WHEN reason IS NULL THEN 'supported' ELSE 'unsupported' END AS verification
FROM o_ujudged u JOIN o_verified v USING (message_id) WHERE reason IS NULL OR v.status NOT IN ('not_found','insufficient_evidence')""")
def _verified_claims(spark, folder):
    return verified(spark, folder)[1].select("message_id", F.col("claim_index").cast("bigint"), "verification")


@query("deterministic_answers", f"""SELECT message_id, substr(string_agg(t, ' ' ORDER BY place), 1, 4000) AS answer, 'answered' AS answer_status FROM (
 SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY rank) AS place, {V.strip('substr(text, 1, 200)')} AS t FROM v_context) WHERE place <= 3 GROUP BY ALL""")
def _deterministic_answers(spark, folder):
    return Q.deterministic_answers(C.v_context(spark, folder))[0]


@query("public_citation", """SELECT page_number, block_id, x0, y1, substr(text, 1, 80) AS section_title, source_method FROM v_blocks""")
def _public_citation(spark, folder):
    refs = C.v_blocks(spark, folder).withColumn("bbox", F.array("x0", "y0", "x1", "y1")).withColumn("section_title", F.substring("text", 1, 80))
    return Q.public_citation(refs).select("page_number", "block_id", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1"), "section_title", "source_method")


VIEWS["o_sethash"] = "SELECT document_id, sha256(string_agg(chunk_id||':'||content_hash, chr(10) ORDER BY chunk_id, content_hash)) AS set_hash, count(*) AS n_chunks FROM v_chunks GROUP BY document_id"


@query("chunk_set_hash", "SELECT * FROM o_sethash")
def _chunk_set_hash(spark, folder):
    return Q.chunk_set_hash(C.v_chunks(spark, folder))


@query("chunk_set_hash_corpus", "SELECT 'all' AS corpus, sha256(string_agg(chunk_id||':'||content_hash, chr(10) ORDER BY chunk_id, content_hash)) AS set_hash, count(*) AS n_chunks FROM v_chunks")
def _chunk_set_hash_corpus(spark, folder):
    return Q.chunk_set_hash(C.v_chunks(spark, folder).withColumn("corpus", F.lit("all")), "corpus")


@query("revision_guard", """SELECT r.document_id, CASE WHEN d.deleted_at IS NULL AND r.document_id%7<>1 AND r.document_id%4<>0 AND r.document_id%13<>2 THEN 'completed' ELSE 'revision_changed' END AS final_status
 FROM (SELECT DISTINCT document_id FROM v_chunks) r JOIN v_documents d USING (document_id)""")
def _revision_guard(spark, folder):
    docs, d = C.v_documents(spark, folder), F.col("document_id")
    hashes = Q.chunk_set_hash(C.v_chunks(spark, folder))
    results = hashes.join(docs, "document_id").select(
        "document_id", F.lit("completed").alias("status"),
        F.when(d % 7 == 1, F.col("content_revision") - 1).otherwise(F.col("content_revision")).alias("start_content_revision"),
        F.when(d % 4 == 0, F.lit(0)).otherwise(F.col("chunk_revision")).alias("start_chunk_revision"),
        F.when(d % 13 == 2, F.lit("x")).otherwise(F.col("set_hash")).alias("start_hash"))
    return Q.revision_guard(results, docs, hashes).select("document_id", "final_status")


@query("thread_transcript", """SELECT m.thread_id, m.sequence_number, m.role, c.claims, coalesce(c.n, 0) AS n_claims FROM (SELECT *, thread_id*1000000+sequence_number AS message_id FROM v_messages) m
LEFT JOIN (SELECT message_id, string_agg(claim_text, '|' ORDER BY claim_index) AS claims, count(*) AS n FROM o_ujudged GROUP BY ALL) c USING (message_id)""")
def _thread_transcript(spark, folder):
    messages = C.v_messages(spark, folder).withColumn("message_id", C.message_id("thread_id", "sequence_number"))
    kept = Q.usable_claims(C.v_claims(spark, folder)).select("message_id", "claim_index", F.col("text").alias("claim_text"), F.lit("raw").alias("verification"))
    return Q.thread_transcript(messages, kept).select(
        "thread_id", "sequence_number", "role", F.array_join("claims.claim_text", "|").alias("claims"), F.coalesce(F.nullif(F.size("claims"), F.lit(-1)), F.lit(0)).cast("bigint").alias("n_claims"))


@query("next_sequence", "SELECT d.document_id AS thread_id, coalesce(max(sequence_number), 0)+1 AS next_sequence FROM v_documents d LEFT JOIN v_messages m ON m.thread_id=d.document_id GROUP BY ALL")
def _next_sequence(spark, folder):
    return Q.next_sequence(C.v_messages(spark, folder), C.v_documents(spark, folder).select(F.col("document_id").alias("thread_id")))


@query("retryable_answers", """WITH last AS (SELECT thread_id, max(sequence_number) AS answer_seq, arg_max(status, sequence_number) AS status FROM v_messages WHERE role='assistant' GROUP BY ALL)
SELECT l.thread_id, answer_seq, l.status, max(m.sequence_number) AS question_seq, arg_max(m.content, m.sequence_number) AS question FROM last l JOIN v_messages m ON m.thread_id=l.thread_id AND m.role='user' AND m.sequence_number < answer_seq
WHERE l.status IN ('failed','revision_changed') GROUP BY l.thread_id, answer_seq, l.status""")
def _retryable_answers(spark, folder):
    return Q.retryable_answers(C.v_messages(spark, folder))


@query("public_answer_text", f"""SELECT message_id, CASE status WHEN 'not_found' THEN '{S.NOT_FOUND_TEXT}' WHEN 'insufficient_evidence' THEN '{S.INSUFFICIENT_TEXT}' ELSE CASE WHEN answer='' THEN '{S.NOT_FOUND_TEXT}' ELSE answer END END AS content FROM o_verified""")
def _public_answer_text(spark, folder):
    return verified(spark, folder)[0].select("message_id", Q.public_answer_text().alias("content"))


@query("consent_filter", """SELECT document_id, page_number FROM v_pages WHERE document_id IN (SELECT document_id FROM v_documents JOIN v_users USING (user_id) WHERE external_allowed AND external_ai_allowed)""")
def _consent_filter(spark, folder):
    return Q.consent_filter(C.v_pages(spark, folder), C.v_documents(spark, folder), C.v_users(spark, folder), "openai_compatible").select("document_id", "page_number")


@query("single_active_answer", """SELECT thread_id, count(*) AS active, min(sequence_number) AS first_active, count(*)-1 AS rejected FROM v_messages WHERE role='assistant' AND status IN ('pending','streaming','finalizing') GROUP BY ALL""")
def _single_active_answer(spark, folder):
    return Q.single_active_answer(C.v_messages(spark, folder))



"""Queries for hierarchical summaries, over one chunk per line."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import qa as Q
from pagewright.operators import summary as U
from pagewright.plans import oracle_views as V
from pagewright.plans import qa_queries  # noqa: F401  (its views are used here)
from pagewright.plans.registry import query
from pagewright.plans.text_queries import POP_SQL
from pagewright.session import per_folder
from pagewright.sources import corpus as C

VIEWS = V.VIEWS


@per_folder
def grouped(spark, folder):
    chunks = C.v_chunks(spark, folder)
    return U.group_chunks(chunks)


# the test documents are short: smaller groups give their trees several levels
SMALL_MAX, SMALL_MIN = 300, 250


@per_folder
def small_groups(spark, folder):
    chunks = C.v_chunks(spark, folder).select("document_id", "chunk_id", "chunk_index", "section_title", "normalized_text")
    return U.group_chunks(chunks, SMALL_MAX, SMALL_MIN)


@per_folder
def keys(spark, folder):
    """The key of each document, and how many chunks it has."""
    hashes = Q.chunk_set_hash(C.v_chunks(spark, folder)).join(C.v_documents(spark, folder), "document_id")
    lit = F.lit
    key = U.context_key(lit("deterministic"), lit("deterministic-test-v1"), lit(S.PROMPT_VERSION), lit(S.SCHEMA_VERSION), lit("nursing_student"), lit("ko"),
                        "content_revision", "set_hash")
    return hashes.select("document_id", key.alias("context_key"), "n_chunks")


@per_folder
def level0(spark, folder):
    return U.map_nodes(small_groups(spark, folder), keys(spark, folder))


@per_folder
def tree(spark, folder):
    return U.summary_tree(level0(spark, folder))


VIEWS["o_gin"] = "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn, length(normalized_text) AS n FROM v_chunks"


def group_walk(name, limit, minimum):
    return f"""RECURSIVE SELECT DISTINCT document_id, 0::BIGINT AS rn, NULL::BIGINT AS open, NULL::VARCHAR AS title, -1::BIGINT AS position FROM o_gin
  UNION ALL SELECT g.document_id, g.rn, CASE WHEN st THEN n ELSE open+n END, CASE WHEN st THEN section_title ELSE title END, CASE WHEN st THEN position+1 ELSE position END
  FROM {name} w JOIN o_gin g ON g.document_id=w.document_id AND g.rn=w.rn+1
  CROSS JOIN LATERAL (SELECT open IS NULL OR open+n > {limit} OR (section_title IS DISTINCT FROM title AND open >= {minimum}) AS st) q"""


VIEWS["o_gwalk"] = group_walk("o_gwalk", S.GROUP_MAX_CHARS, S.GROUP_MIN_CHARS)
VIEWS["o_gsmall"] = group_walk("o_gsmall", SMALL_MAX, SMALL_MIN)
VIEWS["o_grouped"] = "SELECT i.*, w.position FROM o_gin i JOIN o_gwalk w USING (document_id, rn)"
VIEWS["o_smallgroups"] = "SELECT i.*, w.position FROM o_gin i JOIN o_gsmall w USING (document_id, rn)"
VIEWS["o_key"] = f"""SELECT document_id, sha256(array_to_string(['deterministic','deterministic-test-v1','{S.PROMPT_VERSION}','{S.SCHEMA_VERSION}','nursing_student','ko',content_revision::VARCHAR,set_hash], chr(31))) AS context_key
FROM o_sethash JOIN v_documents USING (document_id)"""
VIEWS["o_n0"] = f"""SELECT document_id, position, 0 AS level, context_key, sha256(context_key||chr(31)||'L0'||chr(31)||string_agg(chunk_id||':'||sha256(normalized_text), chr(10) ORDER BY chunk_index)) AS input_hash,
 arg_min([section_title], chunk_index)[1] AS section_title, substr({V.strip("string_agg(normalized_text, ' ' ORDER BY chunk_index)")}, 1, 400) AS summary, count(*) AS n_sources
 FROM o_smallgroups JOIN o_key USING (document_id) GROUP BY document_id, position, context_key"""


def next_level(k):
    return f"""SELECT document_id, position // 8 AS position, {k} AS level, context_key, sha256(context_key||chr(31)||'L{k}'||chr(31)||string_agg(input_hash||':'||sha256(summary), chr(10) ORDER BY position)) AS input_hash,
 arg_min([section_title], position)[1] AS section_title, substr({V.strip("string_agg(summary, ' ' ORDER BY position)")}, 1, 400) AS summary, sum(n_sources)::BIGINT AS n_sources
 FROM o_n{k-1} WHERE document_id IN (SELECT document_id FROM o_n{k-1} GROUP BY document_id HAVING count(*) > 8) GROUP BY document_id, position // 8, context_key"""


for _k in (1, 2, 3):
    VIEWS[f"o_n{_k}"] = next_level(_k)
VIEWS["o_tree"] = " UNION ALL ".join(f"SELECT * FROM o_n{k}" for k in range(4))
VIEWS["o_last"] = "SELECT t.* FROM o_tree t JOIN (SELECT document_id, max(level) AS level FROM o_tree GROUP BY ALL) USING (document_id, level)"


@query("group_chunks", "SELECT document_id, chunk_id, position FROM o_grouped")
def _group_chunks(spark, folder):
    return grouped(spark, folder).select("document_id", "chunk_id", "position")


@query("summary_ready", """SELECT document_id, CASE WHEN c.n IS NULL THEN 'no_chunks' WHEN chunk_revision IS DISTINCT FROM content_revision THEN 'stale_chunks' WHEN j.document_id IS NOT NULL THEN 'already_running' END AS blocked_by
FROM v_documents d LEFT JOIN (SELECT document_id, count(*) n FROM v_chunks GROUP BY ALL) c USING (document_id) LEFT JOIN (SELECT DISTINCT document_id FROM v_jobs WHERE job_type='summarize' AND status IN ('queued','running')) j USING (document_id)""")
def _summary_ready(spark, folder):
    return U.summary_ready(C.v_documents(spark, folder), C.v_chunks(spark, folder), C.v_jobs(spark, folder))


VIEWS["o_lv"] = """RECURSIVE SELECT document_id, 0 AS lv, count(*) AS n FROM v_chunks GROUP BY document_id UNION ALL SELECT document_id, lv+1, (n+7)//8 FROM o_lv WHERE n > 8"""


@query("plan_levels", "SELECT document_id, string_agg(n::VARCHAR, ',' ORDER BY lv) AS sizes, sum(n)::BIGINT AS total FROM o_lv GROUP BY document_id")
def _plan_levels(spark, folder):
    n = C.v_chunks(spark, folder).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return U.plan_levels(n).select("document_id", F.array_join(F.transform("sizes", lambda x: x.cast("string")), ",").alias("sizes"), "total")


@query("context_key", "SELECT document_id, context_key FROM o_key")
def _context_key(spark, folder):
    return keys(spark, folder).select("document_id", "context_key")


@query("map_node_hash", "SELECT document_id, position, input_hash, section_title, n_sources FROM o_n0")
def _map_node_hash(spark, folder):
    return level0(spark, folder).select("document_id", "position", "input_hash", "section_title", "n_sources")


@query("summarize_groups", "SELECT document_id, position, summary, 'succeeded' AS status FROM o_n0")
def _summarize_groups(spark, folder):
    return U.summarize_groups(level0(spark, folder)).select("document_id", "position", "summary", "status")


@query("reduce_level", "SELECT document_id, level::BIGINT AS level, position, section_title, summary, n_sources FROM o_tree")
def _reduce_level(spark, folder):
    return tree(spark, folder).select("document_id", F.col("level").cast("bigint"), "position", "section_title", "summary", "n_sources")


@query("reduce_node_hash", "SELECT document_id, level::BIGINT AS level, position, input_hash FROM o_tree WHERE level > 0")
def _reduce_node_hash(spark, folder):
    return tree(spark, folder).filter("level > 0").select("document_id", F.col("level").cast("bigint"), "position", "input_hash")


@query("node_sources", "SELECT t.document_id, t.level::BIGINT AS level, t.position, count(*) AS n, min(g.chunk_index) AS first_index, max(g.chunk_index) AS last_index FROM o_tree t JOIN o_smallgroups g ON g.document_id=t.document_id AND g.position // (8**t.level)::BIGINT = t.position GROUP BY ALL")
def _node_sources(spark, folder):
    return U.node_sources(small_groups(spark, folder), tree(spark, folder)).groupBy("document_id", F.col("level").cast("bigint").alias("level"), "position").agg(
        F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"))


@query("reuse_nodes", """SELECT document_id, position, CASE WHEN position%2=0 AND document_id%3<>0 THEN 'stored '||position ELSE summary END AS summary, position%2=0 AND document_id%3<>0 AS reused, CASE WHEN position%2=0 AND document_id%3<>0 THEN 0 ELSE 1 END::BIGINT AS attempts FROM o_n0""")
def _reuse_nodes(spark, folder):
    plan = level0(spark, folder)
    store = plan.select(
        "document_id", "input_hash", F.concat(F.lit("stored "), F.col("position").cast("string")).alias("summary"),
        F.when((F.col("position") % 2 == 0) & (F.col("document_id") % 3 != 0), "succeeded").otherwise("failed").alias("status"))
    return U.reuse_nodes(plan, store).select("document_id", "position", "summary", "reused", F.col("attempts").cast("bigint"))


VIEWS["o_items"] = f"""
WITH ov AS (SELECT document_id, level, {V.strip(f"substr(string_agg(summary, ' ' ORDER BY position), 1, {S.SUMMARY_OVERVIEW_CHARS})")} AS text, min(position) AS a, max(position) AS b FROM o_last GROUP BY ALL)
SELECT document_id, 'overview' AS kind, NULL AS title, text, a AS from_pos, b AS to_pos FROM ov
UNION ALL SELECT document_id, 'section_summary', coalesce(nullif(section_title,''), '구역 '||(position+1)), summary, position, position FROM o_last
UNION ALL SELECT document_id, 'key_concept', section_title, substr(summary, 1, 200), position, position FROM o_last WHERE coalesce(section_title,'') <> ''
UNION ALL SELECT document_id, 'learner_explanation', 'nursing_student', text, a, b FROM ov"""


@query("document_summary", "SELECT * FROM o_items")
def _document_summary(spark, folder):
    return U.document_summary(tree(spark, folder)).select("document_id", "kind", "title", "text", "from_pos", "to_pos")


def tokens(spark, folder):
    """One item per document and node, citing its own group twice and the next one (every seventh document
    cites a group that does not exist)."""
    d, p = F.col("document_id"), F.col("position")
    g = F.concat(F.lit("g"), p.cast("string"))
    more = F.when(d % 7 == 2, F.lit("gx")).otherwise(g)
    return grouped(spark, folder).select("document_id", "position").distinct().select(
        "document_id", p.alias("item_no"), F.posexplode(F.array(g, more, F.lit("g0"))).alias("token_pos", "token"))


def resolved(spark, folder):
    g = grouped(spark, folder)
    groups = g.select("document_id", F.concat(F.lit("g"), F.col("position").cast("string")).alias("token"), "chunk_id", F.col("chunk_index").alias("chunk_pos"))
    return U.resolve_group_sources(tokens(spark, folder), groups)


@query("resolve_group_sources", """SELECT DISTINCT g.document_id, g.position AS item_no, s.chunk_id FROM (SELECT DISTINCT document_id, position FROM o_grouped WHERE document_id%7<>2) g
JOIN o_grouped s ON s.document_id=g.document_id AND s.position IN (g.position, 0)""")
def _resolve_group_sources(spark, folder):
    return resolved(spark, folder)[0].select("document_id", "item_no", "chunk_id")


@query("rejected_group_sources", "SELECT DISTINCT document_id FROM o_grouped WHERE document_id%7=2")
def _rejected_group_sources(spark, folder):
    return resolved(spark, folder)[1]


VIEWS["o_raw"] = f"""
SELECT document_id, chunk_index AS item_no, {V.pick('chunk_index % 5', ("overview", "section_summary", "key_concept", "prerequisite", "learner_explanation"))} AS kind, section_title AS title,
  CASE WHEN chunk_index%11=4 THEN ' ' ELSE normalized_text END AS text, CASE WHEN chunk_index%3=1 THEN 'general' ELSE 'document' END AS source_type FROM v_chunks"""
VIEWS["o_built"] = f"""
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY kn, item_no) - 1 AS position FROM (
 SELECT document_id, item_no, kind, kn, CASE WHEN kind='overview' THEN NULL ELSE name END AS title, coalesce(clean,'') AS text FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, kind, same ORDER BY item_no) AS copy FROM (
   SELECT *, CASE kind WHEN 'section_summary' THEN coalesce(name,'')||chr(31)||clean WHEN 'key_concept' THEN name ELSE item_no::VARCHAR END AS same FROM (
    SELECT *, CASE WHEN t<>'' AND length(t) <= CASE kind WHEN 'overview' THEN {S.OVERVIEW_MAX_CHARS} WHEN 'section_summary' THEN {S.SECTION_SUMMARY_MAX_CHARS} ELSE {S.GENERIC_MAX_CHARS} END THEN t END AS clean,
      CASE WHEN n<>'' AND length(n) <= CASE kind WHEN 'section_summary' THEN {S.SECTION_TITLE_MAX} ELSE {S.TERM_MAX_CHARS} END THEN n END AS name, list_position(['overview','section_summary','key_concept','prerequisite','learner_explanation'], kind) AS kn
    FROM (SELECT *, {V.strip('text')} AS t, {V.strip("coalesce(title,'')")} AS n FROM o_raw))
   WHERE CASE kind WHEN 'key_concept' THEN clean IS NOT NULL AND name IS NOT NULL WHEN 'prerequisite' THEN name IS NOT NULL AND source_type='document' ELSE clean IS NOT NULL END))
  WHERE copy = 1 AND item_no % 13 <> 5)"""


@per_folder
def built(spark, folder):
    """Items as a model might return them, one per chunk; some cite nothing that is stored."""
    i = F.col("chunk_index")
    items = C.v_chunks(spark, folder).select(
        "document_id", i.alias("item_no"), C.pick(i % 5, U.KINDS).alias("kind"), F.col("section_title").alias("title"),
        F.when(i % 11 == 4, " ").otherwise(F.col("normalized_text")).alias("text"), F.when(i % 3 == 1, "general").otherwise("document").alias("source_type"))
    sources = items.select("document_id", "item_no").filter(F.col("item_no") % 13 != 5)
    return U.build_artifacts(items, sources)


@query("build_artifacts", "SELECT document_id, item_no, kind AS artifact_type, title, text, position FROM o_built")
def _build_artifacts(spark, folder):
    return built(spark, folder)


MEAS = f"list_transform(regexp_extract_all(normalized_text, '{T.measurement_pattern(T.SPACE_RE2)}'), lambda mv: {V.strip('mv')})"
AROUND = V.strip("substr(normalized_text, greatest(1, strpos(normalized_text, value)-40), least(length(normalized_text), strpos(normalized_text, value)-1+length(value)+40) - greatest(1, strpos(normalized_text, value)-40) + 1)")
VIEWS["o_nums"] = f"""
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, pos) - 1 AS place FROM (
 SELECT document_id, value, chunk_index, pos, chunk_id, {AROUND} AS context FROM (SELECT *, unnest(range(len(m))) AS pos, unnest(m) AS value FROM (SELECT *, {MEAS} AS m FROM v_chunks))
 QUALIFY row_number() OVER (PARTITION BY document_id, value ORDER BY chunk_index, pos) = 1) QUALIFY place < {S.MAX_IMPORTANT_NUMBERS}"""
VIEWS["o_pops"] = f"""
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, pos) - 1 AS place FROM (
 SELECT document_id, value, chunk_index, pos, chunk_id FROM (SELECT *, unnest(range(len(m))) AS pos, unnest(m) AS value FROM (SELECT *, {POP_SQL} AS m FROM (SELECT *, normalized_text AS text FROM v_chunks)))
 QUALIFY row_number() OVER (PARTITION BY document_id, value ORDER BY chunk_index, pos) = 1) QUALIFY place < {S.MAX_POPULATIONS}"""


@query("important_numbers", "SELECT document_id, place, value, chunk_id, context FROM o_nums")
def _important_numbers(spark, folder):
    return U.important_numbers(C.v_chunks(spark, folder))


@query("target_populations", "SELECT document_id, place, value, chunk_id FROM o_pops")
def _target_populations(spark, folder):
    return U.target_populations(C.v_chunks(spark, folder), C.DATA_HINTS).drop("context")


@query("finalize_artifacts", """SELECT document_id, artifact_type, title, text, position FROM (
 SELECT document_id, kind AS artifact_type, title, text, position FROM o_built
 UNION ALL SELECT n.document_id, 'important_number', value, context, coalesce(b, 0)+place FROM o_nums n LEFT JOIN (SELECT document_id, count(*) b FROM o_built GROUP BY ALL) USING (document_id)
 UNION ALL SELECT p.document_id, 'target_population', NULL, value, coalesce(b, 0)+coalesce(k, 0)+place FROM o_pops p LEFT JOIN (SELECT document_id, count(*) b FROM o_built GROUP BY ALL) USING (document_id) LEFT JOIN (SELECT document_id, count(*) k FROM o_nums GROUP BY ALL) USING (document_id))""")
def _finalize_artifacts(spark, folder):
    chunks = C.v_chunks(spark, folder)
    return U.finalize_artifacts(built(spark, folder), U.important_numbers(chunks), U.target_populations(chunks, C.DATA_HINTS))


VIEWS["o_runs"] = """SELECT job_id AS run_id, document_id, created_at, CASE WHEN status='failed' AND job_id%8=7 THEN 'cancelled' ELSE status END AS status, job_id%50 AS planned_nodes, job_id%37 AS completed_nodes,
 job_id%3+1 AS source_revision, CASE WHEN status='failed' THEN CASE job_id%3 WHEN 0 THEN 'SUMMARY_TIMEOUT' WHEN 1 THEN 'SUMMARY_INVALID_RESPONSE' ELSE 'OTHER' END END AS error_code FROM v_jobs"""


def runs(spark, folder):
    j = F.col("job_id")
    failed = F.col("status") == "failed"
    return C.v_jobs(spark, folder).select(
        j.alias("run_id"), "document_id", "created_at", F.when(failed & (j % 8 == 7), "cancelled").otherwise(F.col("status")).alias("status"),
        (j % 50).alias("planned_nodes"), (j % 37).alias("completed_nodes"), (j % 3 + 1).alias("source_revision"),
        F.when(failed, C.pick(j % 3, ("SUMMARY_TIMEOUT", "SUMMARY_INVALID_RESPONSE", "OTHER"))).alias("error_code"))


@query("summary_progress", """SELECT run_id, CASE status WHEN 'failed' THEN 0 WHEN 'cancelled' THEN 0 WHEN 'succeeded' THEN 100 WHEN 'queued' THEN 5 ELSE CASE WHEN planned_nodes <= 0 THEN 10 ELSE greatest(10, least(99, 10 + least(completed_nodes, planned_nodes)*89//planned_nodes)) END END::BIGINT AS progress FROM o_runs""")
def _summary_progress(spark, folder):
    return U.summary_progress(runs(spark, folder)).select("run_id", "progress")


@query("latest_summary", """WITH l AS (SELECT * FROM o_runs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC)=1),
g AS (SELECT * FROM o_runs WHERE status='succeeded' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC)=1)
SELECT d.document_id, l.status, g.run_id, g.source_revision, coalesce(g.source_revision <> d.content_revision, false) AS stale, l.status IS NULL OR l.status IN ('failed','cancelled') AS can_retry,
 CASE l.error_code WHEN 'SUMMARY_TIMEOUT' THEN 'timeout' WHEN 'SUMMARY_INVALID_RESPONSE' THEN 'invalid_response' END AS failure_category FROM v_documents d LEFT JOIN l USING (document_id) LEFT JOIN g ON g.document_id=d.document_id""")
def _latest_summary(spark, folder):
    return U.latest_summary(runs(spark, folder), C.v_documents(spark, folder))


@query("latest_artifacts", """WITH g AS (SELECT * FROM o_runs WHERE status='succeeded' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, run_id DESC)=1)
SELECT a.document_id, g.run_id, a.kind AS artifact_type, a.title, a.text, a.position, coalesce(g.source_revision <> d.content_revision, false) AS stale
FROM o_built a JOIN g ON g.document_id = a.document_id AND g.run_id % 5 = a.item_no % 5 JOIN v_documents d ON d.document_id = a.document_id""")
def _latest_artifacts(spark, folder):
    """Every run leaves a fifth of what its document's summary may hold."""
    fifth = runs(spark, folder).select("document_id", "run_id", (F.col("run_id") % 5).alias("fifth"))
    left = built(spark, folder).withColumn("fifth", F.col("item_no") % 5).join(fifth, ["document_id", "fifth"]).drop("fifth", "item_no")
    return U.latest_artifacts(runs(spark, folder), left, C.v_documents(spark, folder))

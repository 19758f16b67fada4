"""The engine tables in DuckDB SQL, and small SQL text helpers."""

from __future__ import annotations

from pagewright import settings as S
from pagewright.functions.text import CONTROL_CHARS
from pagewright.functions.text import SPACE_RE2 as SPACE
from pagewright.sources.corpus import DATA_HINTS, DATA_MARKERS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def collapse(x: str, to: str = " ") -> str:
    return f"regexp_replace({x}, '[{SPACE}]+', '{to}', 'g')"


def blank(x: str) -> str:
    return f"coalesce({strip(x)}, '') = ''"


def normalize(x: str) -> str:
    t = f"regexp_replace(nfc_normalize({x}), '{CONTROL_CHARS}', '', 'g')"
    t = f"replace(replace({t}, chr(13)||chr(10), chr(10)), chr(13), chr(10))"
    t = rf"regexp_replace({t}, '([a-z])-\n([a-z])', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '[ \t\x{{A0}}]+', ' ', 'g')"
    t = f"array_to_string(list_transform(string_split({t}, chr(10)), lambda ln: {strip('ln')}), chr(10))"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10)||chr(10), 'g')"
    return strip(t)


def fingerprint(x: str) -> str:
    return rf"substr(regexp_replace(lower({collapse(strip(x))}), '\p{{Nd}}+', '#', 'g'), 1, {S.BAND_MAX_CHARS})"


def padded(x: str) -> str:
    return f"(' ' || {collapse(f'lower({x})')} || ' ')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[0-9A-Za-z가-힣]{{2,}}'))"


def markers_in(x: str, markers=DATA_MARKERS) -> str:
    return f"list_filter([{quoted(markers)}], lambda mk: contains({padded(x)}, mk))"


def subject(x: str, markers=DATA_MARKERS) -> str:
    cores = [m.strip() for m in markers]
    tests = " AND ".join(f"NOT contains(tk, '{c}')" for c in cores)
    return f"list_filter({words(x)}, lambda tk: {tests})"


def numbers(x: str) -> str:
    return rf"regexp_extract_all({x}, '\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?%?')"


def number_found(hay: str, num: str, mode: str) -> str:
    """RE2 has no look-around: the neighbours are consumed instead."""
    core = rf"replace(regexp_replace({num}, '[,%]', '', 'g'), '.', '\.')"
    h = f"replace({hay}, ',', '')"
    if mode == "claim":
        tail = r"'%?([^0-9]|$)'"
        return (
            f"CASE WHEN ends_with({num}, '%') THEN regexp_matches({h}, '(^|[^0-9])' || {core} || {tail}) "
            f"ELSE regexp_matches({h}, '(^|[^0-9])' || {core} || '([^0-9]|$)') END"
        )
    return (
        f"CASE WHEN ends_with({num}, '%') THEN regexp_matches({h}, '(^|[^0-9])' || {core} || '%') "
        f"ELSE regexp_matches({h}, '(^|[^0-9])' || {core} || '($|[^0-9.]|\\.$|\\.[^0-9])') END"
    )


def sentences(x: str) -> str:
    return (
        f"list_filter(string_split(regexp_replace({x}, '([.!?])[{SPACE}]+', '\\1'||chr(1), 'g'), chr(1)), "
        f"lambda sn: {strip('sn')} <> '')"
    )


def box_area(p: str) -> str:
    return f"(greatest(0.0, {p}x1-{p}x0) * greatest(0.0, {p}y1-{p}y0))"


def overlap(a: str, b: str) -> str:
    inter = (
        f"(greatest(0.0, least({a}x1,{b}x1)-greatest({a}x0,{b}x0)) * "
        f"greatest(0.0, least({a}y1,{b}y1)-greatest({a}y0,{b}y0)))"
    )
    return f"(CASE WHEN {box_area(a)} > 0 THEN {inter}/{box_area(a)} ELSE 0.0 END)"


def vertical(a: str, b: str) -> str:
    return f"greatest(0.0, {b}y0-{a}y1, {a}y0-{b}y1)"


def title_like(x: str) -> str:
    t = strip(x)
    ends = " OR ".join(f"ends_with({t}, '{e}')" for e in S.TITLE_REJECTED_ENDINGS)
    return f"({t} <> '' AND NOT contains({t}, chr(10)) AND length({t}) <= {S.TITLE_MAX_CHARS} AND NOT ({ends}))"


def pick(index: str, values) -> str:
    return f"([{quoted(values)}])[({index})::INT + 1]"


VIEWS: dict[str, str] = {}

VIEWS["v_lines"] = """
SELECT doc_id AS document_id, i AS line_no, lines[i+1] AS text
FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""

VIEWS["v_blocks"] = """
SELECT document_id, line_no, page_number, block_index, text, page_number // 256 AS page_shard,
  document_id||'-'||page_number||'-'||block_index AS block_id,
  CASE WHEN two AND block_index IN (4,5) THEN 316.0 ELSE 72.0 END::DOUBLE AS x0,
  CASE WHEN two AND block_index IN (2,3) THEN 296.0 ELSE 540.0 END::DOUBLE AS x1,
  y0::DOUBLE AS y0, (y0 + CASE WHEN block_index IN (0,7) THEN 20 ELSE 40 END)::DOUBLE AS y1,
  'text' AS block_type,
  CASE WHEN document_id % 5 = 0 AND (page_number % 2 = 0 OR block_index % 3 = 2) THEN 'ocr' ELSE 'digital' END AS source_method
FROM (SELECT *, CASE WHEN block_index = 0 THEN 24 WHEN block_index = 7 THEN 740
        WHEN two AND block_index IN (2,4) THEN 150 WHEN two AND block_index IN (3,5) THEN 250
        ELSE 90 + 80*(block_index-1) END AS y0
  FROM (SELECT document_id, line_no, line_no // 8 + 1 AS page_number, line_no % 8 AS block_index, text,
          document_id % 2 = 1 AS two FROM v_lines))"""

VIEWS["v_tables"] = """
SELECT document_id, page_shard, page_number, block_index AS table_index, x0-2 AS x0, y0-2 AS y0, x1+2 AS x1, y1+2 AS y1,
  '|'||text||'|' AS markdown_text FROM v_blocks WHERE contains(text, ' | ')"""

VIEWS["v_pages"] = """
SELECT document_id, page_number, page_shard, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height,
  string_agg(text, chr(10) ORDER BY block_index) AS raw_text
FROM v_blocks GROUP BY document_id, page_number, page_shard"""

VIEWS["v_images"] = """
SELECT document_id, page_shard, page_number, CASE WHEN page_number%2=1 THEN 0.0 ELSE 100.0 END::DOUBLE AS x0,
  CASE WHEN page_number%2=1 THEN 0.0 ELSE 200.0 END::DOUBLE AS y0, CASE WHEN page_number%2=1 THEN 612.0 ELSE 300.0 END::DOUBLE AS x1,
  CASE WHEN page_number%2=1 THEN 720.0 ELSE 300.0 END::DOUBLE AS y1
FROM v_pages WHERE document_id % 7 = 0"""

VIEWS["v_words"] = f"""
SELECT document_id, page_shard, page_number, block_index, k AS word_index, w[k+1] AS text, source_method,
  least(612.0, bx+20*k)::DOUBLE AS x0, y0, least(612.0, bx+20*k+18)::DOUBLE AS x1, y1,
  ((document_id*31 + line_no*7 + k*13) % 100) / 100.0::DOUBLE AS confidence
FROM (SELECT *, unnest(range(len(w))) AS k FROM (
  SELECT document_id, page_shard, page_number, block_index, line_no, source_method, x0 AS bx, y0, y1,
    list_filter(string_split(text, ' '), lambda z: NOT ({blank('z')})) AS w FROM v_blocks))"""

VIEWS["v_ocr_words"] = "SELECT * EXCLUDE (source_method) FROM v_words"

VIEWS["v_documents"] = f"""
SELECT *, CASE WHEN document_id%4=0 THEN NULL WHEN document_id%4=3 THEN content_revision-1 ELSE content_revision END AS chunk_revision
FROM (SELECT doc_id AS document_id, lang, source, doc_id % 3 AS user_id, 'Report '||source||' '||doc_id AS title,
  lang||'_'||doc_id||'.pdf' AS original_filename, sha256(text) AS sha256, strlen(text) AS file_size,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
  {pick('doc_id % 6', ("extracted", "partially_extracted", "ocr_required", "failed", "extracting", "uploaded"))} AS processing_status,
  doc_id % 3 + 1 AS content_revision,
  CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS deleted_at,
  CASE WHEN doc_id % 9 <> 0 THEN 'k/'||doc_id END AS storage_key, doc_id % 2 = 0 AS external_allowed,
  CASE WHEN doc_id % 4 <> 0 THEN 'layout' END AS extraction_engine,
  {pick('doc_id % 3', ("1.0", "1.1", "1.1"))} AS engine_version, 1::BIGINT AS schema_version
  FROM documents)"""

VIEWS["v_users"] = "SELECT DISTINCT user_id, user_id <> 1 AS external_ai_allowed FROM v_documents"

VIEWS["v_jobs"] = f"""
SELECT event_id AS job_id, user_id AS document_id,
  CASE event_type WHEN 'view' THEN 'chunk_rebuild' WHEN 'click' THEN 'extract_document' WHEN 'signup' THEN 'ocr_document'
    WHEN 'purchase' THEN 'summarize' ELSE 'validate_file' END AS job_type,
  {pick('event_id % 4', ("queued", "running", "succeeded", "failed"))} AS status, ts AS created_at,
  CASE WHEN event_id % 4 >= 2 THEN epoch_us(ts) + floor(value*1000)::BIGINT END AS completed_us,
  event_id % 5 AS attempt_count, 3::BIGINT AS max_attempts,
  CASE WHEN event_id % 4 = 3 THEN 'E_'||upper(event_type) END AS failure_code FROM events"""

VIEWS["v_lifecycle_events"] = """
SELECT user_id AS document_id, event_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'validating'
  WHEN 'signup' THEN 'ready' WHEN 'purchase' THEN 'extracting' ELSE 'failed' END AS new_status FROM events"""

VIEWS["v_chunks"] = f"""
SELECT b.document_id, b.document_id||':'||b.line_no AS chunk_id, b.line_no AS chunk_index,
  substr(string_split(p.raw_text, chr(10))[1], 1, {S.TITLE_MAX_CHARS}) AS section_title, b.text AS normalized_text,
  b.page_number AS page_start, b.page_number + CASE WHEN b.line_no % 7 = 3 THEN 1 ELSE 0 END AS page_end,
  sha256(b.text) AS content_hash
FROM v_blocks b JOIN v_pages p USING (document_id, page_number) WHERE NOT ({blank('b.text')})"""

VIEWS["v_queries"] = f"""
SELECT *, {pick('document_id % 3', ("hybrid", "keyword", "vector"))} AS mode, document_id % 12 + 4 AS "limit" FROM (
  SELECT document_id AS query_id, document_id, array_to_string(list_filter(w, lambda z: length(z) >= 3)[1:2], ' ') AS query
  FROM (SELECT document_id, string_split(text, ' ') AS w FROM v_lines WHERE line_no = 0)
  UNION ALL
  SELECT document_id + 10000000, document_id, coalesce(list_filter(w, lambda z: length(z) = 2)[1], '')
  FROM (SELECT document_id, string_split(text, ' ') AS w FROM v_lines WHERE line_no = 0))
WHERE query <> ''"""

VIEWS["v_chunk_vectors"] = """
SELECT vec_id::VARCHAR AS chunk_id, label::BIGINT AS document_id, 'm' AS embedding_model, 64 AS embedding_dimension,
  embedding AS vector FROM embeddings"""

VIEWS["v_query_vectors"] = """
SELECT document_id AS query_id, document_id, 'm' AS embedding_model, 64 AS embedding_dimension,
  arg_min(vector, chunk_id::BIGINT) AS vector FROM v_chunk_vectors GROUP BY document_id"""

VIEWS["v_messages"] = f"""
SELECT conv_id AS thread_id, turn+1 AS sequence_number, role, text AS content,
  CASE WHEN role = 'user' THEN 'completed' ELSE {pick('(conv_id*3+turn) % 7', ("completed", "conflicting_evidence", "failed", "revision_changed", "pending", "not_found", "streaming"))} END AS status,
  conv_id AS document_id FROM conversations WHERE role <> 'system'"""

VIEWS["v_context"] = f"""
SELECT document_id*1000000+page_number AS message_id, document_id, block_id AS chunk_id, block_index AS rank,
  substr(text, 1, {S.TITLE_MAX_CHARS}) AS section_title, text, sha256(text) AS content_hash, source_method
FROM v_blocks WHERE NOT ({blank('text')})"""

VIEWS["v_claims"] = f"""
SELECT document_id*1000000+page_number AS message_id, document_id, v*8+block_index AS claim_no,
  CASE v WHEN 1 THEN f||' 4711' WHEN 3 THEN reverse(f) WHEN 4 THEN f||' the one' ELSE f END AS text,
  CASE v WHEN 2 THEN ['none-'||block_id] WHEN 5 THEN [block_id, document_id||'-'||page_number||'-0', block_id]
    ELSE [block_id] END AS source_chunk_ids
FROM (SELECT *, unnest(range(6)) AS v FROM (
  SELECT document_id, page_number, block_index, block_id, {strip("regexp_extract(text, '^([^.!?]*[.!?]?)', 1)")} AS f
  FROM v_blocks WHERE NOT ({blank('text')})))"""

VIEWS["v_claim_events"] = f"""
SELECT message_id, document_id, claim_no+1 AS seq, 'claim' AS type, text, source_chunk_ids, NULL::VARCHAR AS answer_status FROM v_claims
UNION ALL
SELECT document_id*1000000+page_number, document_id, 1000, 'final', NULL::VARCHAR, NULL::VARCHAR[],
  {pick('(document_id*1000000+page_number) % 4', ("answered", "conflicting_evidence", "answered", "not_found"))}
FROM v_pages WHERE (document_id*1000000+page_number) % 5 <> 0"""

MARKERS = DATA_MARKERS
HINTS = DATA_HINTS

"""Queries for chunk building."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.operators import chunks as K
from pagewright.plans import oracle_views as V
from pagewright.plans.layout_queries import laid_out
from pagewright.plans.registry import query
from pagewright.plans.text_queries import LONG_SQL
from pagewright.session import per_folder, stored
from pagewright.sources import corpus as C

VIEWS = V.VIEWS

VIEWS["o_sel"] = f"""
SELECT * FROM (SELECT *, bool_or(source_method='digital') OVER (PARTITION BY document_id, page_number) AS dig FROM o_layout WHERE NOT (is_header OR is_footer))
WHERE NOT (dig AND source_method='ocr') AND (is_table OR NOT ({V.blank('text')}))"""
VIEWS["o_md"] = f"""
SELECT s.*, CASE WHEN is_table AND md IS NOT NULL AND NOT ({V.blank('md')}) THEN md ELSE {V.strip("coalesce(text,'')")} END AS chunk_text
FROM o_sel s LEFT JOIN (SELECT b.document_id, b.page_number, b.block_index, arg_min(t.markdown_text, (-{V.overlap('b.', 't.')}, t.table_index)) AS md
  FROM o_sel b JOIN v_tables t ON b.document_id=t.document_id AND b.page_number=t.page_number WHERE {V.overlap('b.', 't.')} >= {S.TABLE_MATCH_OVERLAP} GROUP BY ALL) m USING (document_id, page_number, block_index)"""
VIEWS["o_item"] = f"""
SELECT *, CASE WHEN is_table THEN 2 WHEN {V.title_like('chunk_text')} THEN 1 WHEN length(chunk_text) > {S.CHUNK_MAX_CHARS} THEN 3 ELSE 0 END AS kind,
  row_number() OVER (PARTITION BY document_id ORDER BY page_number, reading_order) AS rn FROM o_md"""
_pieces = LONG_SQL.strip()[len("WITH "):].replace("{limit}", str(S.CHUNK_MAX_CHARS))
VIEWS["o_lsrc"] = f"SELECT document_id, rn, chunk_text AS text, {V.sentences('chunk_text')} AS s FROM o_item WHERE kind = 3"
_L = S.CHUNK_MAX_CHARS
VIEWS["o_lwalk"] = f"""RECURSIVE SELECT document_id, rn, s, 0 AS i, '' AS open, []::VARCHAR[] AS done FROM o_lsrc WHERE len(s) > 1
  UNION ALL
  SELECT document_id, rn, s, i+1, CASE WHEN open <> '' AND length(open)+length(s[i+1]) > {_L} THEN s[i+1] ELSE {V.strip("open||' '||s[i+1]")} END,
    CASE WHEN open <> '' AND length(open)+length(s[i+1]) > {_L} THEN list_append(done, open) ELSE done END FROM o_lwalk WHERE i < len(s)"""
VIEWS["o_lparts"] = f"""
SELECT document_id, rn, flatten(list_transform(parts, lambda q: CASE WHEN length(q) <= {_L} THEN [q]
    ELSE list_transform(range(((length(q)-1)//{_L})+1), lambda k: substr(q, k*{_L}+1, {_L})) END)) AS parts
FROM (SELECT document_id, rn, [text] AS parts FROM o_lsrc WHERE len(s) <= 1
  UNION ALL SELECT document_id, rn, CASE WHEN open <> '' THEN list_append(done, open) ELSE done END FROM o_lwalk WHERE i = len(s))"""
VIEWS["o_pin"] = """
SELECT i.document_id, i.rn, i.kind, length(i.chunk_text) AS n, CASE WHEN kind=1 THEN i.chunk_text END AS title, coalesce(len(p.parts), 1) AS w,
  coalesce(p.parts, [i.chunk_text]) AS parts, i.page_number, i.reading_order, i.block_id, i.is_table
FROM o_item i LEFT JOIN o_lparts p USING (document_id, rn)"""
VIEWS["o_pwalk"] = f"""RECURSIVE SELECT DISTINCT document_id, 0::BIGINT AS rn, NULL::BIGINT AS open, -1::BIGINT AS last, -1::BIGINT AS draft, NULL::VARCHAR AS section FROM o_pin
  UNION ALL
  SELECT p.document_id, i.rn, CASE WHEN kind=1 THEN n WHEN kind IN (2,3) THEN NULL WHEN st THEN n ELSE open+n END,
    CASE WHEN st THEN last+w ELSE last END, CASE WHEN st THEN last+1 ELSE last END, coalesce(title, section)
  FROM o_pwalk p JOIN o_pin i ON i.document_id=p.document_id AND i.rn=p.rn+1
  CROSS JOIN LATERAL (SELECT kind<>0 OR open IS NULL OR open+n > {S.CHUNK_TARGET_CHARS} AS st) q"""
VIEWS["o_parts"] = """
SELECT document_id, rn, part_no, draft+part_no AS draft_no, section AS section_title, parts[part_no+1] AS part_text, page_number, reading_order, block_id, is_table
FROM (SELECT w.*, i.parts, i.page_number, i.reading_order, i.block_id, i.is_table, unnest(range(len(i.parts))) AS part_no
  FROM o_pwalk w JOIN o_pin i USING (document_id, rn) WHERE w.rn > 0)"""
VIEWS["o_drafts"] = """
SELECT document_id, draft_no, any_value(section_title) AS section_title, bool_or(is_table) AS is_table, sum(length(part_text)) AS n FROM o_parts GROUP BY ALL"""
VIEWS["o_mwalk"] = f"""RECURSIVE SELECT DISTINCT document_id, -1::BIGINT AS draft_no, NULL::BIGINT AS open, NULL::VARCHAR AS sec, -1::BIGINT AS idx FROM o_drafts
  UNION ALL
  SELECT m.document_id, d.draft_no, CASE WHEN j THEN open+n WHEN is_table THEN NULL ELSE n END, d.section_title, CASE WHEN j THEN idx ELSE idx+1 END
  FROM o_mwalk m JOIN o_drafts d ON d.document_id=m.document_id AND d.draft_no=m.draft_no+1
  CROSS JOIN LATERAL (SELECT coalesce(NOT d.is_table AND open < {S.CHUNK_MIN_CHARS} AND n < {S.CHUNK_MIN_CHARS} AND sec IS NOT DISTINCT FROM d.section_title, false) AS j) q"""
VIEWS["o_merged"] = """
SELECT p.*, m.idx AS chunk_index FROM o_parts p JOIN o_mwalk m USING (document_id, draft_no)"""
VIEWS["o_asm"] = f"""
SELECT *, sha256(normalized_text) AS content_hash FROM (SELECT document_id, chunk_index, section_title, page_start, page_end, n_refs, is_table, {V.normalize('raw')} AS normalized_text FROM (
  SELECT document_id, chunk_index, arg_min(section_title, rn) FILTER (section_title IS NOT NULL) AS section_title, bool_or(is_table) AS is_table, min(page_number) AS page_start, max(page_number) AS page_end, count(*) AS n_refs,
    string_agg(part_text, chr(10)||chr(10) ORDER BY draft_no, rn, part_no) AS raw FROM o_merged GROUP BY document_id, chunk_index)) WHERE normalized_text <> ''"""
VIEWS["o_dedup"] = """
SELECT document_id, content_hash, min(chunk_index) AS chunk_index, arg_min([section_title], chunk_index)[1] AS section_title, arg_min(normalized_text, chunk_index) AS normalized_text,
  min(page_start) AS page_start, max(page_end) AS page_end, sum(n_refs)::BIGINT AS n_refs, count(*) AS copies FROM o_asm GROUP BY document_id, content_hash"""
VIEWS["o_chunks"] = """
SELECT c.*, d.content_revision AS chunk_revision, sha256(c.document_id||chr(31)||d.content_revision||chr(31)||c.chunk_index) AS chunk_id,
  greatest(1, round_even(length(normalized_text)/4.0, 0))::BIGINT AS token_count FROM o_dedup c JOIN v_documents d USING (document_id)"""


@per_folder
def selected(spark, folder):
    return K.match_table_markdown(K.select_chunk_blocks(laid_out(spark, folder)))


@per_folder
def packed(spark, folder):
    return K.pack_chunks(selected(spark, folder))


@per_folder
def merged(spark, folder):
    return K.merge_short_chunks(K.pack_chunks(selected(spark, folder)))


@per_folder
def chunk_table(spark, folder):
    return K.build_chunks(laid_out(spark, folder), C.v_documents(spark, folder))


@per_folder
def stored_chunks(spark, folder):
    """The chunk table as later steps read it: written once, then scanned."""
    return stored(chunk_table(spark, folder))


@query("select_chunk_blocks", "SELECT document_id, page_number, block_index, reading_order, source_method FROM o_sel")
def _select_chunk_blocks(spark, folder):
    return K.select_chunk_blocks(laid_out(spark, folder)).filter("role = 'block'").select("document_id", "page_number", "block_index", "reading_order", "source_method")


@query("match_table_markdown", "SELECT document_id, page_number, block_index, chunk_text FROM o_md")
def _match_table_markdown(spark, folder):
    return selected(spark, folder).select("document_id", "page_number", "block_index", "chunk_text")


@query("pack_chunks", "SELECT document_id, block_id, part_no::BIGINT AS part_no, draft_no, section_title, length(part_text) AS n FROM o_parts")
def _pack_chunks(spark, folder):
    return packed(spark, folder).select("document_id", "block_id", F.col("part_no").cast("bigint"), "draft_no", "section_title",
                                        F.length("part_text").cast("bigint").alias("n"))


@query("merge_short_chunks", "SELECT document_id, block_id, part_no::BIGINT AS part_no, draft_no, chunk_index FROM o_merged")
def _merge_short_chunks(spark, folder):
    return merged(spark, folder).select("document_id", "block_id", F.col("part_no").cast("bigint"), "draft_no", "chunk_index")


@query("dedupe_chunks", """SELECT document_id, content_hash, chunk_index, section_title, page_start, page_end, n_refs, copies FROM o_dedup""")
def _dedupe_chunks(spark, folder):
    return K.dedupe_chunks(K.assemble_chunks(merged(spark, folder))).select(
        "document_id", "content_hash", "chunk_index", "section_title", "page_start", "page_end", "n_refs", "copies")


@query("build_chunks", "SELECT document_id, chunk_id, chunk_index, chunk_revision, token_count, content_hash, normalized_text FROM o_chunks")
def _build_chunks(spark, folder):
    return chunk_table(spark, folder).select("document_id", "chunk_id", "chunk_index", "chunk_revision", "token_count", "content_hash", "normalized_text")


@query("chunk_refs", """SELECT m.document_id, d.chunk_index, m.chunk_index AS copy, m.draft_no, m.block_id, m.part_no::BIGINT AS part_no
FROM o_merged m JOIN o_asm a USING (document_id, chunk_index) JOIN o_dedup d ON d.document_id=a.document_id AND d.content_hash=a.content_hash""")
def _chunk_refs(spark, folder):
    parts = merged(spark, folder)
    return K.chunk_refs(parts, K.assemble_chunks(parts)).select(
        "document_id", "chunk_index", F.col("ref_order.copy").alias("copy"), F.col("ref_order.draft_no").alias("draft_no"), "block_id",
        F.col("ref_order.part_no").cast("bigint").alias("part_no"))


@query("stale_chunks", "SELECT document_id, content_revision, chunk_revision FROM v_documents WHERE chunk_revision IS DISTINCT FROM content_revision")
def _stale_chunks(spark, folder):
    return K.stale_chunks(C.v_documents(spark, folder)).select("document_id", "content_revision", "chunk_revision")

"""Queries for the text and geometry expressions, over every line of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.plans import oracle_views as V
from pagewright.plans.registry import query
from pagewright.sources import corpus as C


def over_lines(name, exprs, sql_exprs):
    """One expression per output column, over all lines (`exprs` is called when the query runs)."""
    cols = ", ".join(f"{e} AS {n}" for n, e in sql_exprs.items())

    @query(name, f"SELECT document_id, line_no::BIGINT AS line_no, {cols} FROM v_lines")
    def run(spark, folder):
        df = C.line_rows(spark, folder).select("document_id", F.col("line_no").cast("bigint"), "text")
        return df.select("document_id", "line_no", *[e.alias(n) for n, e in exprs().items()])

    return run


def joined(arr):
    return F.array_join(arr, "¦")


def joined_sql(arr):
    return f"array_to_string({arr}, '¦')"


# a rougher text: extra spaces, a broken word, a tab, blank lines
def rough():
    return F.concat(F.lit("\t "), F.replace(F.col("text"), F.lit(" th"), F.lit("   a-\nth")), F.lit(" \n\n\n \n"), "text", F.lit("\r\n"))


ROUGH_SQL = "(chr(9)||' '||replace(text, ' th', ' '||chr(160)||' a-'||chr(10)||'th')||' '||chr(10)||chr(10)||chr(10)||' '||chr(10)||text||chr(13)||chr(10))"

over_lines("normalize_text", lambda: {"normalized": T.normalize_text(rough())}, {"normalized": V.normalize(ROUGH_SQL)})

def bare():
    return T.strip(F.regexp_replace("text", r"[^0-9\- ]", ""))


over_lines(
    "is_page_number_line",
    lambda: {"flag": T.is_page_number_line("text"), "bare_flag": T.is_page_number_line(bare())},
    {"flag": rf"regexp_matches(text, '^[{T.SPACE_RE2}]*(?:-[{T.SPACE_RE2}]*)?\p{{Nd}}{{1,4}}(?:[{T.SPACE_RE2}]*-)?[{T.SPACE_RE2}]*\z')",
     "bare_flag": rf"regexp_matches({V.strip("regexp_replace(text, '[^0-9\\- ]', '', 'g')")}, '^[{T.SPACE_RE2}]*(?:-[{T.SPACE_RE2}]*)?\p{{Nd}}{{1,4}}(?:[{T.SPACE_RE2}]*-)?[{T.SPACE_RE2}]*\z')"},
)
over_lines(
    "valid_char_ratio",
    lambda: {"ratio": F.round(T.valid_char_ratio(F.concat("text", F.lit("�​"))), 6)},
    {"ratio": rf"round(CASE WHEN length({V.collapse('tx', '')}) = 0 THEN 1.0 ELSE length(regexp_replace({V.collapse('tx', '')}, '[\p{{C}}\p{{Z}}\x{{FFFD}}]', '', 'g')) / length({V.collapse('tx', '')})::DOUBLE END, 6)".replace("tx", "(text||chr(65533)||chr(8203))")},
)
over_lines("band_fingerprint", lambda: {"fingerprint": T.band_fingerprint("text")}, {"fingerprint": V.fingerprint("text")})
over_lines("nonspace_char_count", lambda: {"chars": T.nonspace_char_count("text")}, {"chars": f"length({V.collapse('text', '')})"})
over_lines("looks_like_section_title", lambda: {"is_title": T.looks_like_section_title("text")}, {"is_title": V.title_like("text")})
over_lines(
    "split_sentences",
    lambda: {"n": F.size(T.split_sentences("text")).cast("bigint"), "sentences": joined(T.split_sentences("text"))},
    {"n": f"len({V.sentences('text')})", "sentences": joined_sql(V.sentences("text"))},
)
over_lines("content_hash", lambda: {"hash": T.content_hash("text")}, {"hash": "sha256(text)"})
over_lines("token_estimate", lambda: {"tokens": T.token_estimate("text")}, {"tokens": "greatest(1, round_even(length(text)/4.0, 0))::BIGINT"})
over_lines("text_preview", lambda: {"preview": T.text_preview("text")}, {"preview": f"substr(text, 1, {S.PREVIEW_CHARS})"})

def think():
    return F.concat(F.substring("text", 1, 20), F.lit("<Think>"), F.substring("text", 21, 30), F.lit("\n</think> "),
                 F.substring("text", 51, 40), F.when(F.col("line_no") % 2 == 1, "<THINK> open").otherwise(""),
                 F.substr(F.col("text"), F.lit(91)))
over_lines(
    "strip_thinking", lambda: {"answer": T.strip_thinking(think())},
    {"answer": V.strip("regexp_replace(regexp_replace(substr(text,1,20)||'<Think>'||substr(text,21,30)||chr(10)||'</think> '||substr(text,51,40)||CASE WHEN line_no%2=1 THEN '<THINK> open' ELSE '' END||substr(text,91), '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*', '', 'g')")},
)
over_lines("extract_numbers", lambda: {"numbers": joined(T.extract_numbers("text"))}, {"numbers": joined_sql(V.numbers("text"))})
over_lines("word_tokens", lambda: {"tokens": joined(F.array_sort(T.word_tokens("text")))},
           {"tokens": joined_sql(f"list_sort({V.words('text')})")})
over_lines(
    "negation_markers",
    lambda: {"markers": joined(T.negation_markers("text", C.DATA_MARKERS)), "fixed_list_hit": T.has_negation("text")},
    {"markers": joined_sql(V.markers_in("text")), "fixed_list_hit": f"len({V.markers_in('text', S.NEGATION_MARKERS)}) > 0"},
)
over_lines("has_negation", lambda: {"negated": T.has_negation("text", C.DATA_MARKERS)}, {"negated": f"len({V.markers_in('text')}) > 0"})
over_lines("subject_tokens", lambda: {"tokens": joined(F.array_sort(T.subject_tokens("text", C.DATA_MARKERS)))},
           {"tokens": joined_sql(f"list_sort({V.subject('text')})")})
over_lines("clean_text", lambda: {"cleaned": T.clean_text(F.concat(F.lit(" "), "text", F.lit("\n")), 200)},
           {"cleaned": f"CASE WHEN length({V.strip('text')}) BETWEEN 1 AND 200 THEN {V.strip('text')} END"})
over_lines("measurement_candidates", lambda: {"values": joined(T.measurement_candidates("text"))},
           {"values": joined_sql(f"list_transform(regexp_extract_all(text, '{T.measurement_pattern(T.SPACE_RE2)}'), lambda mv: {V.strip('mv')})")})

POP = f"string_split(regexp_replace(text, '([.!?。\\n])[{T.SPACE_RE2}]+', '\\1'||chr(1), 'g'), chr(1))"
POP_SQL = (
    f"list_filter(list_transform({POP}, lambda sn: {V.strip('sn')}), lambda sn: length(sn) BETWEEN 6 AND 300 AND ("
    + " OR ".join(f"contains(sn, '{h}')" for h in C.DATA_HINTS) + "))"
)
over_lines("population_sentences", lambda: {"sentences": joined(T.population_sentences("text", C.DATA_HINTS))},
           {"sentences": joined_sql(POP_SQL)})

def second_word():
    return F.coalesce(F.get(F.split("text", " ", -1), F.lit(1)), F.lit("absent value"))


SECOND_SQL = "coalesce(string_split(text, ' ')[2], 'absent value')"
AT_SQL = f"strpos(text, {SECOND_SQL})"
FROM_SQL = f"greatest(1, {AT_SQL} - 40)"
TO_SQL = f"least(length(text), {AT_SQL} - 1 + length({SECOND_SQL}) + 40)"
AROUND_SQL = V.strip(f"substr(text, {FROM_SQL}, {TO_SQL} - {FROM_SQL} + 1)")
over_lines(
    "context_window", lambda: {"around": T.context_window("text", second_word())},
    {"around": f"CASE WHEN {AT_SQL} > 0 THEN {AROUND_SQL} ELSE {SECOND_SQL} END"},
)
over_lines(
    "validate_question",
    lambda: {"reject": T.validate_question("text"), "reject_control": T.validate_question(F.concat("text", F.lit("\u0007")))},
    {"reject": f"CASE WHEN {V.blank('text')} THEN 'blank' WHEN length({V.strip('text')}) > 2000 THEN 'too_long' WHEN regexp_matches({V.strip('text')}, '[\\x00-\\x08\\x0B-\\x1F]') THEN 'control_character' END",
     "reject_control": f"CASE WHEN length({V.strip('text||chr(7)')}) > 2000 THEN 'too_long' ELSE 'control_character' END"},
)

# Long lines only are split; the SQL twin packs sentences with a recursive walk.
LONG_SQL = rf"""
WITH src AS (SELECT document_id, line_no, text, {V.sentences('text')} AS s FROM v_lines),
walk(document_id, line_no, s, i, open, done) AS (
  SELECT document_id, line_no, s, 0, '', []::VARCHAR[] FROM src WHERE length(text) > {{limit}} AND len(s) > 1
  UNION ALL
  SELECT document_id, line_no, s, i+1,
    CASE WHEN open <> '' AND length(open)+length(s[i+1]) > {{limit}} THEN s[i+1] ELSE {V.strip("open||' '||s[i+1]")} END,
    CASE WHEN open <> '' AND length(open)+length(s[i+1]) > {{limit}} THEN list_append(done, open) ELSE done END
  FROM walk WHERE i < len(s)),
packed AS (SELECT document_id, line_no, CASE WHEN open <> '' THEN list_append(done, open) ELSE done END AS parts
  FROM walk WHERE i = len(s)),
pieces AS (
  SELECT document_id, line_no, [text] AS parts FROM src WHERE length(text) <= {{limit}}
  UNION ALL SELECT document_id, line_no, [text] FROM src WHERE length(text) > {{limit}} AND len(s) <= 1
  UNION ALL SELECT document_id, line_no, parts FROM packed)
SELECT document_id, line_no::BIGINT AS line_no, len(p)::BIGINT AS n, array_to_string(p, '¦') AS parts FROM (
  SELECT document_id, line_no, flatten(list_transform(parts, lambda q: CASE WHEN length(q) <= {{limit}} THEN [q]
    ELSE list_transform(range(((length(q)-1)//{{limit}})+1), lambda k: substr(q, k*{{limit}}+1, {{limit}})) END)) AS p FROM pieces)
"""


@query("split_long_text", LONG_SQL.replace("{limit}", "300"))
def _split_long_text(spark, folder):
    parts = T.split_long_text("text", 300)
    return C.line_rows(spark, folder).select(
        "document_id", F.col("line_no").cast("bigint"), parts.alias("p")
    ).select("document_id", "line_no", F.size("p").cast("bigint").alias("n"), joined(F.col("p")).alias("parts"))


@query("number_in_text", f"""
SELECT document_id, line_no::BIGINT AS line_no, num, {V.number_found("text", "num", "claim")} AS claim_hit,
  {V.number_found("text", "num", "eval")} AS eval_hit, {V.number_found("text", "substr(num,1,1)", "claim")} AS digit_claim_hit,
  {V.number_found("text", "substr(num,1,1)", "eval")} AS digit_eval_hit, {V.number_found("text", "num||'%'", "eval")} AS percent_hit
FROM (SELECT *, unnest(list_distinct({V.numbers("text")})) AS num FROM v_lines)""")
def _number_in_text(spark, folder):
    n = C.line_rows(spark, folder).filter(F.col("text").rlike(r"\p{Nd}")).select(
        "document_id", F.col("line_no").cast("bigint"), "text",
        F.explode(F.array_distinct(T.extract_numbers("text"))).alias("num"),
    )
    digit = F.substring("num", 1, 1)
    return n.select(
        "document_id", "line_no", "num",
        T.number_in_text("text", "num", "claim").alias("claim_hit"),
        T.number_in_text("text", "num", "eval").alias("eval_hit"),
        T.number_in_text("text", digit, "claim").alias("digit_claim_hit"),
        T.number_in_text("text", digit, "eval").alias("digit_eval_hit"),
        T.number_in_text("text", F.concat("num", F.lit("%")), "eval").alias("percent_hit"),
    )


UNITS = ("%", "St", "Main", "-", ".")


@query("value_unit_adjacent", rf"""
SELECT document_id, line_no::BIGINT AS line_no, num, unit,
  regexp_matches(text, '(^|[^0-9])'||replace(regexp_replace(num,'[,%]','','g'),'.','\.')||'[{T.SPACE_RE2}]*'||regexp_escape(unit)) AS adjacent
FROM (SELECT *, unnest([{V.quoted(UNITS)}]) AS unit FROM
  (SELECT *, unnest(list_distinct({V.numbers("text")})) AS num FROM v_lines))""")
def _value_unit_adjacent(spark, folder):
    n = C.line_rows(spark, folder).filter(F.col("text").rlike(r"\p{Nd}")).select(
        "document_id", F.col("line_no").cast("bigint"), "text",
        F.explode(F.array_distinct(T.extract_numbers("text"))).alias("num"),
    ).withColumn("unit", F.explode(F.array(*[F.lit(u) for u in UNITS])))
    return n.select("document_id", "line_no", "num", "unit", T.value_unit_adjacent("text", "num", "unit").alias("adjacent"))


# --- geometry ------------------------------------------------------------------------

@query("clamp_bbox", """
SELECT document_id, page_number, block_index, least(ax, bx)::DOUBLE AS x0, least(ay, cy)::DOUBLE AS y0,
  greatest(ax, bx)::DOUBLE AS x1, greatest(ay, cy)::DOUBLE AS y1
FROM (SELECT *, greatest(0.0, least(x1+300, 612.0)) AS ax, greatest(0.0, least(x0-100, 612.0)) AS bx,
   greatest(0.0, least(y1*2, 792.0)) AS ay, greatest(0.0, least(y0-30, 792.0)) AS cy FROM v_blocks)""")
def _clamp_bbox(spark, folder):
    b = G.clamp_bbox((F.col("x1") + 300, F.col("y1") * 2, F.col("x0") - 100, F.col("y0") - 30), F.lit(612.0), F.lit(792.0))
    return C.v_blocks(spark, folder).select("document_id", "page_number", "block_index", *[c.alias(n) for n, c in b.items()])


def _next_box(spark, folder):
    """Each block with the next one on its page."""
    b = C.v_blocks(spark, folder).select("document_id", "page_shard", "page_number", "block_index", "x0", "y0", "x1", "y1")
    n = b.select("document_id", "page_shard", "page_number", (F.col("block_index") - 1).alias("block_index"),
                 *[F.col(c).alias("n_" + c) for c in ("x0", "y0", "x1", "y1")])
    return b.join(n, ["document_id", "page_shard", "page_number", "block_index"])


NEXT_SQL = "v_blocks a JOIN v_blocks b ON a.document_id=b.document_id AND a.page_number=b.page_number AND b.block_index=a.block_index+1"


@query("bbox_area", f"SELECT document_id, page_number, block_index, {V.box_area('v_blocks.')} AS area FROM v_blocks")
def _bbox_area(spark, folder):
    return C.v_blocks(spark, folder).select("document_id", "page_number", "block_index", G.bbox_area(G.box()).alias("area"))


@query("overlap_ratio", f"""SELECT a.document_id, a.page_number, t.table_index, a.block_index, round({V.overlap('a.', 't.')}, 6) AS ratio
FROM v_blocks a JOIN v_tables t ON a.document_id=t.document_id AND a.page_number=t.page_number""")
def _overlap_ratio(spark, folder):
    t = C.v_tables(spark, folder).select("document_id", "page_shard", "page_number", "table_index",
                                         *[F.col(c).alias("t_" + c) for c in ("x0", "y0", "x1", "y1")])
    j = C.v_blocks(spark, folder).join(t, ["document_id", "page_shard", "page_number"])
    return j.select("document_id", "page_number", "table_index", "block_index",
                    F.round(G.overlap_ratio(G.box(), G.box("t_")), 6).alias("ratio"))


@query("vertical_distance", f"SELECT a.document_id, a.page_number, a.block_index, {V.vertical('a.', 'b.')} AS gap FROM {NEXT_SQL}")
def _vertical_distance(spark, folder):
    return _next_box(spark, folder).select("document_id", "page_number", "block_index",
                                           G.vertical_distance(G.box(), G.box("n_")).alias("gap"))


@query("pixels_to_points", """
SELECT document_id, page_number, block_index, round(least(612.0, x0*0.24),2) AS x0, round(least(792.0, y0*0.24),2) AS y0,
  round(least(612.0, (x0+x1)*0.24),2) AS x1, round(least(792.0,(y0+y1)*0.24),2) AS y1 FROM v_blocks""")
def _pixels_to_points(spark, folder):
    p = G.pixels_to_points(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(300), F.lit(612.0), F.lit(792.0))
    return C.v_blocks(spark, folder).select("document_id", "page_number", "block_index", *[c.alias(n) for n, c in p.items()])

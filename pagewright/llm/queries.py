"""One query for each operator of this subpackage, over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import (
    bpe, collocations, conversations, jaccard, language, licenses, mixing, neighbours, quality, secrets, substrings, tokenfile, topk,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_bpe_round_trip")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"))


_DRAW = "CAST('0x' || substr(md5({seed} || ':' || mark), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_TRIES = ", ".join(
    f"{{'gap': abs(floor(rate) * source_size + sum(CASE WHEN {_DRAW.format(seed=repr(str(s)))} < rate - floor(rate) THEN size ELSE 0 END) - target), 'seed': {s}}}"
    for s in range(16)
)


@_query("op2_mix_sources", f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null') AS mark FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][1 + (place - 1) % 3] AS weight, CAST(2 AS DOUBLE) * source_size / [3, 1, 2][1 + (place - 1) % 3] AS reach FROM per_source
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - CAST(2 AS DOUBLE) * (sum(source_size) OVER upto - source_size))
    / (sum(weight) OVER () - (sum(weight) OVER upto - weight)) AS level
  FROM weighted WINDOW upto AS (ORDER BY reach, place ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, coalesce(least(CAST(2 AS DOUBLE) * source_size, (SELECT level FROM levels WHERE level <= reach ORDER BY reach, place LIMIT 1) * weight), CAST(2 AS DOUBLE) * source_size) AS target
  FROM levels
), rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
seeds AS (
  SELECT r.source, source_size, target, rate, list_min([{_TRIES}]).seed AS seed
  FROM sizes JOIN rated r ON sizes.source IS NOT DISTINCT FROM r.source GROUP BY r.source, source_size, target, rate
)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate) + CASE WHEN {_DRAW.format(seed="CAST(seed AS VARCHAR)")} < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sizes JOIN seeds ON sizes.source IS NOT DISTINCT FROM seeds.source
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.read(spark, tokenfile.write(table(spark, folder, "documents")), ids=False)


@_query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(table(spark, folder, "documents"))


@_query("op8_license_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@_query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate(table(spark, folder, "documents"))


@_query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return language.digest(table(spark, folder, "documents"))


@_query("op6_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(table(spark, folder, "documents")).select("doc_id", "class_id", "n_links", "copy_of", "n_copies")


@_query("op5_substring_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digest(table(spark, folder, "documents"))


@_query("op4_nearest_neighbours")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.digest(table(spark, folder, "embeddings"))


@_query("op11_phrase_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM lists, (VALUES (1), (2), (3)) AS sizes(size) WHERE len(w) >= size
), counted AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY ALL),
wanted AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest FROM wanted, (VALUES (1), (2)) AS ks(k) WHERE k < size
), scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.phrase = c.first_part AND x.size = k JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest AND y.size = c.size - k
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) AS place FROM scored),
covered AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM wanted WHERE size = 3) GROUP BY ALL
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN covered USING (lang, phrase) WHERE place = 1 AND NOT (size = 2 AND coalesce(100 * longer >= 50 * a, false))
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


@_query("op12_exact_topk", """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return topk.digest(table(spark, folder, "embeddings"))


#: CRC-32 of ASCII text, byte by byte and bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte:
  list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@_query("op13_conversation_repair", f"""
WITH RECURSIVE keyed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), drawn AS (SELECT *, {_CRC.format(key="key")} % 20 AS draw FROM keyed),
damaged AS (
  SELECT c, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE draw WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE draw <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), seen AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM numbered),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) AS pair FROM seen
), moves AS (
  SELECT * FROM (VALUES (0, 's', '', 1), (0, 'u', '', 2), (0, 'a', 'u', 3), (1, 'u', '', 2), (1, 'a', 'u', 3), (2, 'a', '', 3), (2, 'u', 'a', 2), (3, 'u', '', 2), (3, 'a', 'u', 3)) m(state, initial, made, next)
), edits AS (
  SELECT state, initial, next, edit, len(made) * 2 + CASE edit WHEN 'R' THEN 2 ELSE 0 END AS price, repeat('I', len(made)) || edit AS letters,
    CASE made WHEN 'u' THEN ['user:'] WHEN 'a' THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END AS lines
  FROM moves, (VALUES ('K'), ('R')) e(edit) WHERE edit = 'K' OR initial <> 's'
  UNION ALL SELECT state, '', state, 'D', 3, 'D', CAST([] AS VARCHAR[]) FROM (VALUES (0), (1), (2), (3)) d(state)
), walk AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM keyed
  UNION ALL
  SELECT w.c, f.i, e.next, min({{'cost': CAST(w.best.cost + e.price + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'audit': w.best.audit || e.letters,
    'lines': list_concat(w.best.lines, e.lines, CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE e.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END)}})
  FROM walk w JOIN faulty f ON f.c = w.c AND f.i = w.i + 1
  JOIN edits e ON e.state = w.state AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR substr(f.role, 1, 1) = e.initial)
  GROUP BY w.c, f.i, e.next
), ended AS (
  SELECT w.c, min({{'cost': best.cost + [0, 4, 2, 0][state + 1], 'audit': best.audit || ['', 'II', 'I', ''][state + 1],
    'lines': list_concat(best.lines, [CAST([] AS VARCHAR[]), ['user:', 'assistant:'], ['assistant:'], []][state + 1])}}) AS best
  FROM walk w WHERE w.i = coalesce((SELECT max(i) FROM faulty f WHERE f.c = w.c), 0) GROUP BY w.c
), told AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) k JOIN ended USING (c) LEFT JOIN told USING (c)
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.digest(table(spark, folder, "conversations"))

"""Queries for the sources, over text that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.plans.registry import query
from pagewright.sources import corpus as C
from pagewright.sources import files as I


@query("seed_fixture_layout", """
SELECT document_id::VARCHAR AS name, page_number, block_index, 72.0 + coalesce(sum(h+8) OVER (PARTITION BY document_id, page_number ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0,
 72.0 + coalesce(sum(h+8) OVER (PARTITION BY document_id, page_number ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + h AS y1, text
FROM (SELECT document_id, page_number, block_index, replace(text, '. ', '.'||chr(10)) AS text, 18.0::DOUBLE + 14.0::DOUBLE*(length(replace(text, '. ', '.'||chr(10)))-length(replace(replace(text, '. ', '.'||chr(10)), chr(10), ''))) AS h FROM v_blocks)""")
def _seed_fixture_layout(spark, folder):
    pages = C.v_pages(spark, folder).groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("page_number", "raw_text"))).alias("p"))
    fixtures = pages.select(F.col("document_id").cast("string").alias("name"), F.transform(
        "p", lambda x: F.transform(F.split(x["raw_text"], "\n", -1), lambda t: F.replace(t, F.lit(". "), F.lit(".\n")))).alias("pages"))
    return I.seed_fixture_layout(fixtures).select("name", "page_number", "block_index", "y0", "y1", "text")


@query("read_model_output", """SELECT message_id, seq, type, text, array_to_string(source_chunk_ids, ',') AS sources, answer_status FROM v_claim_events WHERE seq % 10 <> 7""")
def _read_model_output(spark, folder):
    e = C.v_claim_events(spark, folder)
    seq = F.col("seq")
    body = F.to_json(F.struct(F.when(seq % 10 == 7, "note").otherwise(F.col("type")).alias("type"), "text", F.col("source_chunk_ids").alias("sourceChunkIds"), F.col("answer_status").alias("answerStatus")))
    line = F.when(seq % 3 == 0, F.concat(F.lit("data: "), body)).when(seq % 3 == 1, F.concat(F.lit("  "), body)).otherwise(body)
    noise = F.array(line, F.lit(": keep-alive"), F.lit("data: [DONE]"), F.lit("{broken"), F.lit(""), F.lit("[1]"))
    lines = e.select("message_id", "seq", F.explode(noise).alias("value"))
    return I.parse_model_lines(lines).select("message_id", "seq", "type", "text", F.array_join("sourceChunkIds", ",").alias("sources"), F.col("answerStatus").alias("answer_status"))


@query("read_model_stream", """SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY seq) AS seq, type, text FROM (
 SELECT *, count(*) FILTER (type='claim') OVER w AS claims, coalesce(max((type='final')::INT) OVER (PARTITION BY message_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
 FROM v_claim_events WHERE type IN ('claim', 'final') WINDOW w AS (PARTITION BY message_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE ended = 0 AND claims <= 20""")
def _read_model_stream(spark, folder):
    """Events cut into frames in the middle of their text, with noise between and claims after the end."""
    e = C.v_claim_events(spark, folder)
    body = F.concat(F.to_json(F.struct("type", "text", F.col("source_chunk_ids").alias("sourceChunkIds"), F.col("answer_status").alias("answerStatus"))), F.lit("\n"))
    half = F.floor(F.length(body) / 2).cast("int")

    def frame(text):
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices"))))

    pieces = F.array(frame(F.substr(body, F.lit(1), half)), F.lit(": keep-alive"), F.lit("{broken"), F.lit(""), frame(F.substr(body, half + 1)))
    lines = e.select("message_id", F.col("seq"), F.posexplode(pieces).alias("k", "value")).select("message_id", (F.col("seq") * 8 + F.col("k")).alias("line_no"), "value")
    last = e.groupBy("message_id").agg(F.max("seq").alias("m"))
    late = frame(F.lit('{"type":"claim","text":"too late"}\n'))
    tail = last.select("message_id", F.posexplode(F.array(F.lit("data: [DONE]"), late)).alias("k", "value"), "m").select("message_id", ((F.col("m") + 1) * 8 + F.col("k")).alias("line_no"), "value")
    found = I.parse_model_stream(lines.unionByName(tail), "message_id")
    return found.select("message_id", F.col("seq").cast("bigint").alias("seq"), "type", "text")


@query("ingest_ocr_tsv", f"""SELECT document_id, page_number, block_index, word_index, text, round(confidence, 6) AS confidence, round(least(612.0, x0*0.24), 2)::DOUBLE AS x0, round(least(792.0, (y0+10)*0.24), 2)::DOUBLE AS y1
FROM v_words WHERE confidence >= 0.2 AND (word_index + block_index) % 6 <> 0 AND NOT contains(text, chr(9))""")
def _ingest_ocr_tsv(spark, folder):
    w = C.v_words(spark, folder).filter(~F.col("text").contains("\t"))
    k = (F.col("word_index") + F.col("block_index")) % 6

    def whole(c):
        return F.col(c).cast("int").cast("string")

    level = F.when(k == 0, "4").otherwise("5")
    conf = (F.col("confidence") * 100).cast("string")
    line = F.concat_ws("\t", level, F.lit("1"), whole("block_index"), F.lit("0"), F.lit("0"), whole("word_index"), whole("x0"), whole("y0"), F.lit("18"), F.lit("10"), conf, "text")
    noise = F.array(line, F.lit("level\tpage_num\tblock_num"), F.concat(F.lit("5\t1\tx\t0\t0\t0\t0\t0\t1\t1\t90\t"), "text"), F.lit("5\t1\t1\t0\t0\t0\t0\t0\t1\t1\t-1\tnone"))
    lines = w.select("document_id", "page_number", F.explode(noise).alias("value"))
    return I.parse_ocr_tsv(lines, 300).select(
        "document_id", "page_number", F.col("block_index").cast("bigint"), F.col("word_index").cast("bigint"), "text", F.round("confidence", 6).alias("confidence"), "x0", "y1")


@query("verify_stored_files", """SELECT document_id, CASE WHEN document_id%8=1 THEN 'FILE_MISSING' WHEN document_id%8=2 THEN 'HASH_MISMATCH' WHEN document_id%8=3 THEN 'SIZE_MISMATCH' ELSE 'ok' END AS verdict FROM v_documents WHERE storage_key IS NOT NULL""")
def _verify_stored_files(spark, folder):
    catalog = C.v_documents(spark, folder).filter("storage_key is not null").select("document_id", "storage_key", "sha256", "file_size")
    d = F.col("document_id")
    files = catalog.filter(d % 8 != 1).select("storage_key", F.when(d % 8 == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
                                              (F.col("file_size") + F.when(d % 8 == 3, 1).otherwise(0)).alias("length"))
    return I.verify_stored_files(files, catalog).select("document_id", "verdict")



"""Blocks to search chunks that keep their source locations.

Source locations stay rows of their own (`chunk_refs`): a phrase repeated a million times in one
document is one chunk with a million reference rows, never one row with a million-element array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import geometry as G
from pagewright.functions import text as T
from pagewright.operators import folds
from pagewright.operators.layout import PAGE
from pagewright.session import stored

ORDER = ["page_number", "reading_order"]


def select_chunk_blocks(page_sheet: DataFrame) -> DataFrame:
    """Blocks that may enter chunks: no bands, no blanks, and digital text before OCR text.
    Table rows of the sheet stay for `match_table_markdown`."""
    is_block = F.col("role") == "block"
    kept = page_sheet.filter(F.col("role").isin("block", "table") & ~(F.col("is_header") | F.col("is_footer")))
    digital = F.max(F.when(is_block, F.col("source_method") == "digital")).over(Window.partitionBy(*PAGE))
    kept = kept.withColumn("page_has_digital", digital)
    usable = ~(F.col("page_has_digital") & (F.col("source_method") == "ocr")) & (F.col("is_table") | ~T.is_blank("text"))
    return kept.filter(~is_block | usable).drop("page_has_digital")


def match_table_markdown(page_sheet: DataFrame) -> DataFrame:
    """Text of every block; a table block takes the markdown of the table it overlaps most."""
    table = F.struct("x0", "y0", "x1", "y1", "table_index", "markdown_text")
    df = page_sheet.withColumn(
        "page_tables", F.collect_list(F.when(F.col("role") == "table", table)).over(Window.partitionBy(*PAGE))
    ).filter("role = 'block'")
    scored = F.transform(
        "page_tables",
        lambda t: F.struct(
            G.overlap_ratio(G.box(), (t["x0"], t["y0"], t["x1"], t["y1"])).alias("ratio"),
            (-t["table_index"]).alias("first"), t["markdown_text"].alias("markdown"),
        ),
    )
    best = F.array_max(F.filter(scored, lambda s: s["ratio"] >= S.TABLE_MATCH_OVERLAP))["markdown"]
    plain = T.strip(F.coalesce("text", F.lit("")))
    return df.withColumn(
        "chunk_text", F.when(F.col("is_table") & ~T.is_blank(best), best).otherwise(plain)
    ).drop("page_tables", "role", "table_index", "markdown_text")


def pack_chunks(blocks: DataFrame) -> DataFrame:
    """Greedy packing in reading order.  One row per block and draft: `draft_no`, the section title
    and `part_text` (an over-long block becomes several drafts)."""
    length = F.length("chunk_text")
    title = ~F.col("is_table") & T.looks_like_section_title("chunk_text")
    long = ~F.col("is_table") & ~title & (length > S.CHUNK_MAX_CHARS)
    items = (
        blocks.withColumn("is_title", title).withColumn("is_long", long)
        .withColumn("parts", F.when(F.col("is_long"), T.split_long_text("chunk_text", S.CHUNK_MAX_CHARS)).otherwise(F.array("chunk_text")))
        .withColumns(
            {
                "shard": F.col("page_shard"),
                "item_size": length.cast("bigint"),
                "item_kind": F.when(F.col("is_title"), folds.TITLE)
                .when(F.col("is_table") | F.col("is_long"), folds.ALONE).otherwise(folds.PLAIN),
                "item_tag": F.when(F.col("is_title"), F.col("chunk_text")),
                "item_weight": F.size("parts").cast("bigint"),
            }
        )
        .drop("chunk_text", "is_title", "is_long")
    )
    packed = folds.fold(items, ORDER, folds.PackChunks(S.CHUNK_TARGET_CHARS), "first_draft", "section_title")
    rest = [c for c in packed.columns if c not in ("parts", "first_draft", "shard", "text")]
    return packed.select(*rest, "first_draft", F.posexplode("parts").alias("part_no", "part_text")).withColumn(
        "draft_no", F.col("first_draft") + F.col("part_no")
    ).drop("first_draft")


def merge_short_chunks(parts: DataFrame) -> DataFrame:
    """Adds `chunk_index`: short neighbouring drafts of one section share it."""
    df = parts.withColumn("shard", F.floor(F.col("draft_no") / S.DRAFTS_PER_SHARD)).repartition("document_id", "shard")
    draft = Window.partitionBy("document_id", "shard", "draft_no")
    df = df.withColumns(
        {
            "item_size": F.sum(F.length("part_text")).over(draft).cast("bigint"),
            "first": F.row_number().over(draft.orderBy(*ORDER, "part_no")) == 1,
        }
    )
    df = df.withColumns(
        {
            "item_kind": F.when(~F.col("first"), folds.FOLLOW).when(F.col("is_table"), folds.ALONE).otherwise(folds.PLAIN),
            "item_tag": F.col("section_title"),
            "item_weight": F.lit(1).cast("bigint"),
        }
    ).drop("first")
    order = ["draft_no", *ORDER, "part_no"]
    return folds.fold(df, order, folds.MergeShort(S.CHUNK_MIN_CHARS), "chunk_index").drop("shard")


def assemble_chunks(parts: DataFrame) -> DataFrame:
    """Text, hash and page range of every merged draft; blank ones are dropped."""
    piece = F.struct("draft_no", *ORDER, "part_no", "part_text", "section_title")
    rows = parts.groupBy("document_id", "chunk_index").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.bool_or("is_table").alias("is_table"),
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"),
        F.count(F.lit(1)).alias("n_refs"),
    )
    text = T.normalize_text(F.array_join(F.transform("pieces", lambda p: p["part_text"]), "\n\n"))
    return (
        rows.withColumn("normalized_text", text)
        .withColumn("section_title", F.col("pieces")[0]["section_title"])
        .drop("pieces").filter("normalized_text <> ''")
        .withColumn("content_hash", T.content_hash("normalized_text"))
    )


def dedupe_chunks(drafts: DataFrame) -> DataFrame:
    """One chunk per content hash and document: the first one, with the page range of all copies.

    Copies are merged by partial aggregation, so a group of a billion copies is reduced before the
    shuffle and no task gathers it.
    """
    at = F.col("chunk_index")
    return drafts.groupBy("document_id", "content_hash").agg(
        F.min(F.struct(at, "section_title", "is_table", "normalized_text")).alias("kept"),
        F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.sum("n_refs").alias("n_refs"),
        F.count(F.lit(1)).alias("copies"),
    ).select("document_id", "kept.*", "page_start", "page_end", "n_refs", "copies", "content_hash")


def chunk_refs(parts: DataFrame, drafts: DataFrame) -> DataFrame:
    """Source locations of every kept chunk, ordered by `ref_order` (copies after the first one)."""
    # hashes are stored, so that the texts behind them are put together once
    hashes = stored(drafts.select("document_id", "chunk_index", "content_hash"))
    kept = hashes.groupBy("document_id", "content_hash").agg(F.min("chunk_index").alias("kept_index"))
    owner = hashes.join(kept, ["document_id", "content_hash"])
    return parts.join(owner.select("document_id", "chunk_index", "kept_index"), ["document_id", "chunk_index"]).select(
        "document_id", F.col("kept_index").alias("chunk_index"),
        F.struct(F.col("chunk_index").alias("copy"), "draft_no", *ORDER, "part_no").alias("ref_order"),
        "page_number", "block_id", F.array("x0", "y0", "x1", "y1").alias("bbox"), "reading_order", "source_method",
    )


def draft_chunks(page_sheet: DataFrame) -> DataFrame:
    """A marked sheet to numbered chunk parts (rows of blocks with `chunk_index`)."""
    return merge_short_chunks(pack_chunks(match_table_markdown(select_chunk_blocks(page_sheet))))


def build_chunks(page_sheet: DataFrame, documents: DataFrame) -> DataFrame:
    """The chunk table: built from a marked sheet, stamped with the document's content revision."""
    chunks = dedupe_chunks(assemble_chunks(draft_chunks(page_sheet)))
    revision = documents.select("document_id", F.col("content_revision").alias("chunk_revision"))
    chunk_id = F.sha2(F.concat_ws("\u001f", "document_id", "chunk_revision", "chunk_index"), 256)
    return chunks.join(revision, "document_id").withColumns(
        {"chunk_id": chunk_id, "token_count": T.token_estimate("normalized_text")}
    )


def stale_chunks(documents: DataFrame) -> DataFrame:
    """Documents whose chunks do not belong to their present content."""
    return documents.filter(~F.col("chunk_revision").eqNullSafe(F.col("content_revision")))

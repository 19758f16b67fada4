"""Hierarchical summaries: groups of chunks, a tree of bounded fan-in, reuse by content hash, artifacts.

The sources of a node are rows (node_sources), never an array that grows up the tree: a chunk of
group g belongs to node g div 8^k at level k, which needs no gathering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import folds
from pagewright.session import cut_lineage, stored

FAN = S.REDUCE_FAN_IN
#: Positions that meet in one task: whole batches of FAN, and what documents' keys are spread by.
NODE_RUN = FAN**4


def group_chunks(chunks: DataFrame, limit: int = S.GROUP_MAX_CHARS, minimum: int = S.GROUP_MIN_CHARS) -> DataFrame:
    """Adds `position`, the group of every chunk in reading order (blank chunks are skipped)."""
    df = chunks.filter(~T.is_blank("normalized_text")).withColumns(
        {
            "shard": F.floor(F.col("chunk_index") / S.DRAFTS_PER_SHARD),
            "item_size": F.length("normalized_text").cast("bigint"), "item_kind": F.lit(folds.PLAIN),
            "item_tag": F.col("section_title"), "item_weight": F.lit(1).cast("bigint"),
        }
    )
    return folds.fold(df, ["chunk_index"], folds.GroupChunks(limit, minimum), "position").drop("shard")


def summary_ready(documents: DataFrame, chunks: DataFrame, jobs: DataFrame, level: str = "nursing_student") -> DataFrame:
    """Why a summary cannot start for each document (null: it can)."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    active = jobs.filter("job_type = 'summarize' and status in ('queued', 'running')").select("document_id").distinct().withColumn("active", F.lit(True))
    df = documents.join(counts, "document_id", "left").join(active, "document_id", "left")
    reason = (
        F.when(~F.lit(level).isin(*S.LEARNER_LEVELS), "unknown_level")
        .when(F.coalesce("n_chunks", F.lit(0)) == 0, "no_chunks")
        .when(~F.col("chunk_revision").eqNullSafe(F.col("content_revision")), "stale_chunks")
        .when(F.col("active"), "already_running")
    )
    return df.select("document_id", reason.alias("blocked_by"))


def plan_levels(groups: DataFrame) -> DataFrame:
    """Nodes per level for a group count (document_id, n): n, ceil(n/8), ... until at most 8.

    The number of levels is logarithmic, so it is a short fold over a fixed list of levels.
    """
    n = F.col("n").cast("bigint")
    empty = F.struct(F.array().cast("array<bigint>").alias("sizes"), n.alias("count"), (n > 0).alias("open"))

    def step(acc, _):
        size = acc["count"]
        more = acc["open"]
        return F.struct(
            F.when(more, F.concat(acc["sizes"], F.array(size))).otherwise(acc["sizes"]).alias("sizes"),
            F.ceil(size / FAN).cast("bigint").alias("count"), (more & (size > FAN)).alias("open"),
        )

    sizes = F.aggregate(F.sequence(F.lit(0), F.lit(21)), empty, step, lambda acc: acc["sizes"])
    total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return groups.withColumn("sizes", sizes).withColumn("total", total).drop("n")


def context_key(provider, model, prompt, schema, level, language, revision, chunk_hash) -> Column:
    """Fingerprint of the conditions of a run; a different key never reuses nodes."""
    parts = [T.col(c).cast("string") for c in (provider, model, prompt, schema, level, language, revision, chunk_hash)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _input_hash(key: Column, level, lines: Column) -> Column:
    body = F.array_join(F.transform(F.array_sort(lines), lambda p: p["line"]), "\n")
    return F.sha2(F.concat(key, F.lit(f"\u001fL{level}\u001f"), body), 256)


def _lines(ident: str) -> Column:
    """Hash lines of gathered parts; hashes are made here, behind the shuffle."""
    return F.transform("parts", lambda p: F.struct(p["order"].alias("order"), F.concat(p[ident], F.lit(":"), F.sha2(p["text"], 256)).alias("line")))


def _run() -> Column:
    return F.floor(F.col("position") / NODE_RUN).alias("run")


def map_nodes(grouped: DataFrame, keys: DataFrame) -> DataFrame:
    """Level-0 nodes: joined text of each group (bounded by its size limit), title and input hash.

    `keys` are (document_id, context_key) and, where it is known, n_chunks: no document has more groups than that.
    A key is spread over the runs of its document, so that join and grouping share one shuffle of the texts.
    """
    if "n_chunks" not in keys.columns:
        keys = keys.join(grouped.groupBy("document_id").agg((F.max("position") + 1).alias("n_chunks")), "document_id")
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_chunks") - 1) / NODE_RUN))
    df = grouped.select("*", _run()).join(keys.select("document_id", "context_key", F.explode(runs).alias("run")), ["document_id", "run"])
    part = F.struct(F.col("chunk_index").alias("order"), F.col("normalized_text").alias("text"), "section_title", "chunk_id")
    rows = df.groupBy("document_id", "run", "position").agg(
        F.min("context_key").alias("context_key"), F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("n_sources"),
    )
    return rows.select(
        "document_id", "position", F.lit(0).alias("level"), "context_key",
        _input_hash(F.col("context_key"), 0, _lines("chunk_id")).alias("input_hash"),
        F.col("parts")[0]["section_title"].alias("section_title"),
        F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("source_text"), "n_sources",
    )


def summarize_groups(nodes: DataFrame, summarizer=None) -> DataFrame:
    """Summary text of every node.  `summarizer` maps a text column to a text column (a pandas UDF for
    a model); the default takes the first 400 characters.  A blank or over-long result fails the node."""
    text = T.strip("source_text")
    summary = F.substring(text, 1, S.GROUP_SUMMARY_MAX_CHARS) if summarizer is None else summarizer(F.col("source_text"))
    df = nodes.withColumn("summary", summary)
    ok = T.clean_text("summary", S.GROUP_SUMMARY_MAX_CHARS).isNotNull()
    return df.withColumn("status", F.when(ok, "succeeded").otherwise("failed")).drop("source_text")


def reuse_nodes(plan: DataFrame, store: DataFrame, summarizer=None) -> DataFrame:
    """Nodes whose (document, input hash) already succeeded take the stored text; only the rest is summarised."""
    done = store.filter("status = 'succeeded'").groupBy("document_id", "input_hash").agg(F.min("summary").alias("stored"))
    df = plan.join(done, ["document_id", "input_hash"], "left")
    known = df.filter("stored is not null").withColumns(
        {"summary": F.col("stored"), "status": F.lit("succeeded"), "reused": F.lit(True), "attempts": F.lit(0)}
    ).drop("source_text", "stored")
    fresh = summarize_groups(df.filter("stored is null").drop("stored"), summarizer).withColumns(
        {"reused": F.lit(False), "attempts": F.lit(1)}
    )
    return known.unionByName(fresh)


def reduce_level(nodes: DataFrame, level: int, store: DataFrame | None = None, summarizer=None) -> DataFrame:
    """The next level of documents that still have more than eight nodes: batches of eight, in order."""
    big = nodes.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FAN).select("document_id")
    # the runs of these documents, so that the nodes themselves are moved once, for their grouping
    runs = nodes.select("document_id", _run()).distinct().join(big, "document_id")
    part = F.struct(F.col("position").alias("order"), F.col("summary").alias("text"), "section_title", "input_hash")
    up = F.floor(F.col("position") / FAN)
    rows = nodes.select("*", _run()).join(runs, ["document_id", "run"], "left_semi").groupBy("document_id", "run", up.alias("position")).agg(
        F.min("context_key").alias("context_key"), F.array_sort(F.collect_list(part)).alias("parts"), F.sum("n_sources").alias("n_sources"),
    )
    plan = rows.select(
        "document_id", "position", F.lit(level).alias("level"), "context_key",
        _input_hash(F.col("context_key"), level, _lines("input_hash")).alias("input_hash"),
        F.col("parts")[0]["section_title"].alias("section_title"),
        F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("source_text"), "n_sources",
    )
    if store is not None:
        return reuse_nodes(plan, store, summarizer)
    return summarize_groups(plan, summarizer).withColumns({"reused": F.lit(False), "attempts": F.lit(1)})


def summary_tree(level0: DataFrame, store: DataFrame | None = None, summarizer=None) -> DataFrame:
    """All nodes of all levels.  The driver only learns the largest node count (one number), and every
    level is stored in the shared folder, so a lost executor never replays the tree and a reader takes the columns it needs."""
    nodes = reuse_nodes(level0, store, summarizer) if store is not None else summarize_groups(level0, summarizer).withColumns(
        {"reused": F.lit(False), "attempts": F.lit(1)}
    )
    nodes = stored(nodes)
    top = nodes.agg(F.max("position")).first()[0]
    count = 0 if top is None else top + 1
    everything, level = nodes, 0
    while count > FAN:
        level += 1
        nodes = stored(reduce_level(nodes, level, store, summarizer))
        everything = everything.unionByName(nodes)
        count = -(-count // FAN)
    return everything


def last_level(nodes: DataFrame) -> DataFrame:
    """The at most eight nodes per document that feed the structured summary."""
    top = nodes.groupBy("document_id").agg(F.max("level").alias("level"))
    return nodes.join(top, ["document_id", "level"])


def node_sources(grouped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source chunks of every node, as rows (document_id, level, position, chunk_id, chunk_index)."""
    levels = nodes.select("document_id", "level").distinct()
    at = F.floor(F.col("position") / F.pow(F.lit(FAN), F.col("level"))).cast("bigint")
    return grouped.select("document_id", "chunk_id", "chunk_index", "position").join(levels, "document_id").select(
        "document_id", "level", at.alias("position"), "chunk_id", "chunk_index"
    )


def document_summary(nodes: DataFrame, learner_level: str = "nursing_student") -> DataFrame:
    """Structured items of every document from its last nodes: overview, a section per node, a key
    concept per titled node and an explanation.  `from_pos`/`to_pos` are the nodes an item cites."""
    last = last_level(nodes).filter("status = 'succeeded'")
    parts = F.array_sort(F.collect_list(F.struct("position", "summary")))
    overview = last.groupBy("document_id", "level").agg(
        T.strip(F.substring(F.array_join(F.transform(parts, lambda p: p["summary"]), " "), 1, S.SUMMARY_OVERVIEW_CHARS)).alias("text"),
        F.min("position").alias("from_pos"), F.max("position").alias("to_pos"),
    )
    title = F.coalesce(F.nullif("section_title", F.lit("")), F.concat(F.lit("구역 "), (F.col("position") + 1).cast("string")))

    def item(df, kind, title, text, first, last_):
        return df.select(
            "document_id", F.col("level").alias("node_level"), F.lit(kind).alias("kind"), title.alias("title"), text.alias("text"),
            first.alias("from_pos"), last_.alias("to_pos"), F.lit("document").alias("source_type"),
        )

    pos, none = F.col("position"), F.lit(None).cast("string")
    titled = last.filter(F.coalesce("section_title", F.lit("")) != "")
    return (
        item(overview, "overview", none, F.when(F.col("text") == "", "문서 요약").otherwise(F.col("text")), F.col("from_pos"), F.col("to_pos"))
        .unionByName(item(last, "section_summary", title, F.col("summary"), pos, pos))
        .unionByName(item(titled, "key_concept", F.col("section_title"), F.substring("summary", 1, 200), pos, pos))
        .unionByName(item(overview, "learner_explanation", F.lit(learner_level), F.when(F.col("text") == "", "학습자 설명").otherwise(F.col("text")),
                          F.col("from_pos"), F.col("to_pos")))
    )


def resolve_group_sources(tokens: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model group tokens (document_id, item_no, token_pos, token) to stored chunk ids.

    `groups` are (document_id, token, chunk_id, chunk_pos).  A document with any unknown token is
    rejected as a whole.  Returns (sources, rejected documents).
    """
    known = groups.select("document_id", "token").distinct().withColumn("known", F.lit(True))
    marked = tokens.join(known, ["document_id", "token"], "left")
    rejected = marked.filter("known is null").select("document_id").distinct()
    good = tokens.join(rejected, "document_id", "left_anti").join(groups, ["document_id", "token"])
    first = F.min(F.struct("token_pos", "chunk_pos")).alias("order")
    return good.groupBy("document_id", "item_no", "chunk_id").agg(first), rejected


# --- artifacts -----------------------------------------------------------------------------------

KINDS = ("overview", "section_summary", "key_concept", "prerequisite", "learner_explanation")
#: Item numbers of a run: what one task numbers at a time.
ITEM_RUN = 4096


def build_artifacts(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Checked artifacts: over-long or blank texts and items without a stored source are dropped,
    sections and concepts are unique, prerequisites must come from the document.

    `sources` are the valid (document_id, item_no) pairs.  Positions run over the kinds in order; no window
    holds more of a document than ITEM_RUN items of a kind, or its counts per run.
    """
    kind = F.col("kind")
    limit = F.when(kind == "overview", S.OVERVIEW_MAX_CHARS).when(kind == "section_summary", S.SECTION_SUMMARY_MAX_CHARS).when(
        kind == "key_concept", S.CONCEPT_MAX_CHARS).otherwise(S.GENERIC_MAX_CHARS)
    text = T.strip(F.coalesce("text", F.lit("")))
    title = T.strip(F.coalesce("title", F.lit("")))
    longest = F.when(kind == "section_summary", S.SECTION_TITLE_MAX).otherwise(S.TERM_MAX_CHARS)
    df = items.withColumns(
        {
            "clean": F.when((text != "") & (F.length(text) <= limit), text),
            "name": F.when((title != "") & (F.length(title) <= longest), title),
            "kind_no": F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind),
        }
    )
    df = df.filter(
        F.when(kind == "key_concept", F.col("clean").isNotNull() & F.col("name").isNotNull())
        .when(kind == "prerequisite", F.col("name").isNotNull() & (F.coalesce("source_type", F.lit("document")) == "document"))
        .otherwise(F.col("clean").isNotNull())
    )
    same = (
        F.when(kind == "section_summary", F.concat_ws("\u001f", F.coalesce("name", F.lit("")), "clean"))
        .when(kind == "key_concept", F.col("name")).otherwise(F.col("item_no").cast("string"))
    )
    df = df.withColumn("same", same)
    first = df.groupBy("document_id", "kind", "same").agg(F.min("item_no").alias("item_no"))
    df = df.join(first, ["document_id", "kind", "same", "item_no"], "left_semi")
    df = df.join(sources.select("document_id", "item_no").distinct(), ["document_id", "item_no"], "left_semi")
    # positions in two levels: counts of each kind and run of items give where a run starts, rows are numbered within their run
    run = ["document_id", "kind_no", "run"]
    df = cut_lineage(df.withColumn("run", F.floor(F.col("item_no") / ITEM_RUN)))
    before = Window.partitionBy("document_id").orderBy("kind_no", "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*run).agg(F.count(F.lit(1)).alias("n")).select(*run, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    df = df.join(starts, run)
    inside = F.row_number().over(Window.partitionBy(*run).orderBy("item_no"))
    return df.select(
        "document_id", "item_no", kind.alias("artifact_type"),
        F.when(kind == "overview", F.lit(None).cast("string")).otherwise(F.col("name")).alias("title"), F.coalesce("clean", F.lit("")).alias("text"),
        (F.col("start") + inside - 1).cast("bigint").alias("position"),
    )


def _first_distinct(found: DataFrame, limit: int) -> DataFrame:
    """First `limit` distinct values of every document in (chunk_index, pos) order.

    Values are reduced by aggregation before the shuffle; the row-number limit also runs before it.
    """
    first = found.groupBy("document_id", "value").agg(F.min(F.struct("chunk_index", "pos", "chunk_id", "context")).alias("at"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("at.chunk_index", "at.pos"))
    kept = first.withColumn("place", place).filter(F.col("place") <= limit)
    return kept.select("document_id", (F.col("place") - 1).cast("bigint").alias("place"), "value", "at.chunk_id", "at.context")


def important_numbers(chunks: DataFrame) -> DataFrame:
    """First thirty distinct measurements of every document, with their surroundings."""
    found = chunks.select("document_id", "chunk_index", "chunk_id", "normalized_text", F.posexplode(T.measurement_candidates("normalized_text")).alias("pos", "value"))
    return _first_distinct(found.withColumn("context", T.context_window("normalized_text", "value")).drop("normalized_text"), S.MAX_IMPORTANT_NUMBERS)


def target_populations(chunks: DataFrame, hints=S.POPULATION_HINTS) -> DataFrame:
    """First fifteen distinct sentences of every document that name a study population."""
    found = chunks.select("document_id", "chunk_index", "chunk_id", F.posexplode(T.population_sentences("normalized_text", hints)).alias("pos", "value"))
    return _first_distinct(found.withColumn("context", F.lit(None).cast("string")), S.MAX_POPULATIONS)


def finalize_artifacts(built: DataFrame, numbers: DataFrame, populations: DataFrame) -> DataFrame:
    """Model artifacts, then numbers, then populations, with positions that run on."""
    sizes = built.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_built"))
    counts = numbers.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_numbers"))
    zero = F.lit(0).cast("bigint")
    base = F.coalesce("n_built", zero)
    nums = numbers.join(sizes, "document_id", "left").select(
        "document_id", F.lit("important_number").alias("artifact_type"), F.col("value").alias("title"), F.col("context").alias("text"),
        (base + F.col("place")).alias("position"),
    )
    pops = populations.join(sizes, "document_id", "left").join(counts, "document_id", "left").select(
        "document_id", F.lit("target_population").alias("artifact_type"), F.lit(None).cast("string").alias("title"), F.col("value").alias("text"),
        (base + F.coalesce("n_numbers", zero) + F.col("place")).alias("position"),
    )
    return built.select("document_id", "artifact_type", "title", "text", "position").unionByName(nums).unionByName(pops)


def summary_progress(runs: DataFrame) -> DataFrame:
    """Progress of every run in percent: by state, and by finished nodes while it runs."""
    s, planned = F.col("status"), F.coalesce("planned_nodes", F.lit(0))
    done = F.least(F.coalesce("completed_nodes", F.lit(0)), planned)
    running = F.when(planned <= 0, 10).otherwise(F.greatest(F.lit(10), F.least(F.lit(99), 10 + F.floor(done * 89 / planned))))
    return runs.withColumn(
        "progress",
        F.when(s.isNull() | s.isin("failed", "cancelled"), 0).when(s == "succeeded", 100).when(s == "queued", 5).otherwise(running).cast("bigint"),
    )


def latest_summary(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document: state of the latest run, and revision and staleness of the latest successful one."""
    def newest(df, *cols):
        return df.groupBy("document_id").agg(F.max(F.struct("created_at", "run_id", *cols)).alias("r"))

    last = newest(runs, "status", "error_code").select("document_id", "r.status", "r.error_code")
    good = newest(runs.filter("status = 'succeeded'"), "source_revision").select("document_id", F.col("r.run_id").alias("run_id"), "r.source_revision")
    df = documents.join(last, "document_id", "left").join(good, "document_id", "left")
    return df.select(
        "document_id", "status", "run_id", "source_revision",
        F.coalesce(F.col("source_revision") != F.col("content_revision"), F.lit(False)).alias("stale"),
        (F.col("status").isNull() | F.col("status").isin("failed", "cancelled")).alias("can_retry"),
        F.when(F.col("error_code") == "SUMMARY_TIMEOUT", "timeout").when(F.col("error_code") == "SUMMARY_INVALID_RESPONSE", "invalid_response").alias("failure_category"),
    )


def latest_artifacts(runs: DataFrame, artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Artifacts (run_id, document_id, position, ...) of every document's newest successful run, as rows, and whether they are stale.

    Of runs made at one time the one with the larger id counts, as in `latest_summary`.  A document whose runs all failed, or whose
    newest successful one left nothing, has no row; artifacts of older runs are never shown in its place.
    """
    good = runs.filter("status = 'succeeded'").groupBy("document_id").agg(F.max(F.struct("created_at", "run_id", "source_revision")).alias("r"))
    shown = good.join(documents.select("document_id", "content_revision"), "document_id").select(
        "document_id", F.col("r.run_id").alias("run_id"), F.coalesce(F.col("r.source_revision") != F.col("content_revision"), F.lit(False)).alias("stale"))
    return artifacts.join(shown, ["document_id", "run_id"])

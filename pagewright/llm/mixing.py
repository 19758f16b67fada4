"""Mixing sources to target weights.

Words are counted per source, sources get targets by weight under a limit of repetition, and each document is taken
floor(rate) times plus once more with the probability of the rate's fraction. That draw is a hash of the document's id, its
text and a seed, so that re-runs agree and documents without an id, or with the same one, are drawn apart. A few seeds are tried for each source, all in one pass, and the one that comes nearest the
target is kept: for any one of them each document's draw has the right probability, and small sources with long documents
come nearer their target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import cut_lineage

#: Weights of sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: Times that a source may be repeated.
MOST = 2
#: Seeds that are tried for each source.
SEEDS = 16
#: Sources up to which their table (some 60 bytes each) is sent to every machine; a shuffle join beyond.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def mark(key: str = "doc_id", text: str = "text") -> Column:
    """What a document is drawn by: its id and the digest of its whole text; null is a value of its own."""
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")))


def draw(marked: Column, seed: Column) -> Column:
    """A number from 0 up to 1 for a mark and a seed, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), marked)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source; sizes: rows of source and size.

    Sources stand by code point, null last, with `weights` repeating. Targets in proportion to weights, with no source above
    its limit, are weight times one level: the limits that lie lowest for their weight are reached first, and the level
    follows from what they leave. Windows run over one row for each source, after the documents have been summed up.
    """
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_limit = Window.orderBy("reach", "place")
    upto = by_limit.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    of = of.withColumn("place", F.row_number().over(by_name))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    of = of.withColumn("weight", weight.cast("bigint")).withColumn("reach", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    of = of.withColumns({
        "total": F.sum("source_size").over(every), "weights": F.sum("weight").over(every),
        "full": F.sum("source_size").over(upto) - F.col("source_size"), "full_weight": F.sum("weight").over(upto) - F.col("weight"),
    })
    # the level if this source and those after it stay below their limits
    level = (F.lit(float(share)) * F.col("total") - F.lit(float(most)) * F.col("full")) / (F.col("weights") - F.col("full_weight"))
    of = of.withColumn("level", level)
    # the first for which that holds, as all later ones have higher limits
    of = of.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "place", "level"))).over(every)["level"])
    limit = F.lit(float(most)) * F.col("source_size")
    return of.select("source", "source_size", F.coalesce(F.least(limit, F.col("level") * F.col("weight")), limit).alias("target"))


def rates(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rate, seed of each source; sizes: rows of source, size and mark.

    Tries the seeds in one pass with partial sums, so that a source with a third of all rows is summed up where its rows are.
    """
    of = targets(sizes, share, most, weights)
    of = cut_lineage(of.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    part = F.col("rate") - F.floor("rate")
    hits = [F.sum(F.when(draw(F.col("mark"), F.lit(s)) < part, F.col("size")).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    tried = with_source(sizes, of).groupBy("source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "rate")), *hits)
    gap = [F.struct(F.abs(F.floor("rate") * F.col("source_size") + F.col(f"s{s}") - F.col("target")).alias("gap"), F.lit(s).alias("seed")) for s in range(SEEDS)]
    return cut_lineage(tried.select("source", "source_size", "target", "rate", F.array_min(F.array(*gap))["seed"].alias("seed")))


def with_source(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows with what `of` (a written table) has for their source; null meets null."""
    named = of.withColumnsRenamed({c: f"_mix_{c}" for c in of.columns})
    if of.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("_mix_source")))
    return joined.select(*rows.columns, *(F.col(f"_mix_{c}").alias(c) for c in of.columns if c != "source"))


def copies(marked: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and a draw with the probability of the rest."""
    whole = F.floor("rate").cast("bigint")
    return whole + F.when(draw(marked, F.col("seed")) < F.col("rate") - whole, 1).otherwise(0)


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("source"), word_count().alias("size"), mark().alias("mark"))


def plan(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document.

    Null and empty texts have size 0, and a source without words has rate 0. A null source is a source of its own, the last.
    Repeated rows are documents each; those alike in id and text draw alike. An empty table gives an empty plan. Other columns
    of `docs` are not read. Only ids, sources, sizes and digests are kept and moved, never texts.
    """
    sizes = cut_lineage(_sizes(docs))
    rated = with_source(sizes, rates(sizes, share, most, weights))
    return rated.select("doc_id", "source", "size", "source_size", "target", copies(F.col("mark")).alias("copies"), (copies(F.col("mark")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of `docs` with their columns, each as often as plan() takes it; texts are not moved between machines."""
    of = rates(cut_lineage(_sizes(docs)), share, most, weights)
    # the columns of `docs` travel in one struct, so that none can clash with those of the mix
    rows = docs.select(F.struct("*").alias("_row"), F.col("source"), mark().alias("mark"))
    taken = with_source(rows, of).select("_row", copies(F.col("mark")).alias("_copies")).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))).select("_row.*")

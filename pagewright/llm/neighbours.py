"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted, and put in the order of a Hilbert curve; several such orderings are
made. Who is near in space is mostly near in some ordering. Spark sorts the orderings by range, so that each vector has a place
in each; a query is compared, in double precision, with all vectors whose places lie within a window around its own, and the
best of all orderings are merged.

Copies of a vector are one point, with as many of the smallest ids as an answer can hold. How wide a window must be depends on
the vectors, so it is measured: the true neighbours of a bounded sample of queries are found by comparing them with all
points, and the window is what most of them need. On vectors with structure it is narrow; where all directions are alike, no
ordering tells much and it is wide.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import runs
from pagewright.llm.hilbert import hilbert_keys
from pagewright.session import cut_lineage

#: Neighbours of a query.
K = 10
#: Orderings, their directions, and bits for each direction.
CURVES = 16
DIRECTIONS = 12
BITS = 5
#: Queries whose true neighbours are looked up, and points that centre and scale are taken from. The index holds all points.
SAMPLE = 64
FITTED = 2048
#: Share of the sample's true neighbours that must lie in a window, and what is added to its width.
SHARE = 0.96
MARGIN = 1.2
#: Places of a block, at least and at most.
BLOCK = (1024, 16_384)


def points(vectors: DataFrame, k: int = K) -> DataFrame:
    """point (smallest id), vector array<double>, members (the k + 1 smallest ids) of each distinct usable vector.

    Vectors that are null, zero, or hold what is null or not finite, and rows without id, take no part.
    """
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    # Spark applies the limit where the rows are, before any of a hot vector's copies move
    few = usable.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members")).select(F.element_at("members", 1).alias("point"), "vector", "members")


@functools.lru_cache(maxsize=64)
def _directions(width: int, curve: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng((width, curve))
    turned, _ = np.linalg.qr(draw.normal(size=(width, min(many, width))))
    return turned, draw.random(turned.shape[1])


def _keys(rows: np.ndarray, curve: int, centre: np.ndarray, scale: float) -> np.ndarray:
    """Place on a curve: four deviations on either side, with a quarter of the range for the shift."""
    turned, shift = _directions(rows.shape[1], curve, DIRECTIONS)
    at = ((rows - centre) @ turned) / (8 * scale) + 0.5
    cells = (at * 0.75 + shift * 0.25) * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def places(found: DataFrame, curves: int = CURVES) -> DataFrame:
    """width, curve, point, place (from 0, in each curve) of points of each width (number of components)."""
    fitted: dict[int, tuple[np.ndarray, float]] = {}
    sample = found.select(F.size("vector").alias("width"), F.xxhash64("point").alias("draw"), "vector").orderBy("draw").limit(FITTED)
    for r in sample.collect():
        fitted.setdefault(r["width"], []).append(r["vector"])
    for width, rows in fitted.items():
        table = np.array(rows)
        fitted[width] = (table.mean(axis=0), max(float(table.std()), 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                centre, scale = fitted.get(width, (np.zeros(width), 1.0))
                rows = _stacked(part.column("vector"))
                for curve in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), width, np.int32)), pa.array(np.full(len(rows), curve, np.int32)), pa.array(_keys(rows, curve, centre, scale)), part.column("point")],
                                                     ["width", "curve", "key", "point"])

    keyed = cut_lineage(found.select("point", "vector", F.size("vector").alias("width")).mapInArrow(run, "width int, curve int, key bigint, point bigint"))
    dealt = keyed.repartitionByRange("width", "curve", "key", "point").sortWithinPartitions("width", "curve", "key", "point")
    dealt = cut_lineage(dealt.select("width", "curve", "point", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    # one row for each part and curve in it; parts are as many as tasks
    upto = Window.partitionBy("width", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("width", "curve", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    offsets = cut_lineage(offsets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))))
    return dealt.join(F.broadcast(offsets), ["width", "curve", "part"]).select("width", "curve", "point", (F.col("before") + F.col("row") - F.col("first")).alias("place"))


def _nearest(query: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points and their distances, ties to smaller ids."""
    gap = rows - query
    far = np.sqrt((gap * gap).sum(axis=1))
    if len(far) > k:
        edge = np.partition(far, k - 1)[k - 1]
        near = np.flatnonzero(far <= edge)
        far, names = far[near], names[near]
    order = np.lexsort((names, far))[:k]
    return names[order], far[order]


HITS = "query bigint, point bigint, score double"


def _batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([np.full(len(n), q) for q, n, _ in rows]), pa.int64()), pa.array(np.concatenate([n for _, n, _ in rows]), pa.int64()),
        pa.array(np.concatenate([s for _, _, s in rows]), pa.float64())], ["query", "point", "score"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "point")
    return hits.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def true_neighbours(found: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query, point, score of the k nearest points of a few queries, themselves included, by comparing with all points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                rows, names = _stacked(part.column("vector")), part.column("point").to_numpy()
                if made := [(q, *_nearest(np.array(v), rows, names, k)) for q, v in queries if len(v) == width]:
                    yield _batch(made)

    return _best(found.select("point", "vector", F.size("vector").alias("width")).mapInArrow(run, HITS), k)


def window_for(found: DataFrame, placed: DataFrame, asked: DataFrame, k: int) -> int:
    """Places to either side of a query that hold most true neighbours of a sample of queries in some ordering."""
    sample = found.join(asked, "point").orderBy(F.xxhash64("point")).limit(SAMPLE).select("point", "vector").collect()
    if not sample:
        return 1
    true = cut_lineage(true_neighbours(found, [(r["point"], list(r["vector"])) for r in sample], k).filter("query <> point"))
    own = placed.join(F.broadcast(true.select(F.col("query").alias("point")).distinct()), "point").select(F.col("point").alias("query"), "curve", F.col("place").alias("own"))
    theirs = placed.join(F.broadcast(true.select("query", "point")), "point").join(F.broadcast(own), ["query", "curve"])
    gaps = [r["gap"] for r in theirs.groupBy("query", "point").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("gap")).collect()]
    return max(4 * k, int(np.ceil(MARGIN * np.quantile(gaps, SHARE)))) if gaps else 4 * k


def _compare(window: int, k: int):
    """For mapInArrow over blocks: each query against the points of its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["width", "curve", "block"]):
            group = group.combine_chunks()
            asked = group.column("asked").to_numpy(zero_copy_only=False)
            place, names = group.column("place").to_numpy(), group.column("point").to_numpy()
            rows = _stacked(group.column("vector").combine_chunks())
            order = np.argsort(place[~asked], kind="stable")
            inside, of, by = place[~asked][order], names[~asked][order], rows[~asked][order]
            made = []
            for q, p, v in zip(names[asked].tolist(), place[asked].tolist(), rows[asked]):
                a, b = np.searchsorted(inside, p - window), np.searchsorted(inside, p + window, side="right")
                if a < b:
                    made.append((q, *_nearest(v, by[a:b], of[a:b], k)))
            if made:
                yield _batch(made)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, window: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found of all rows but its own, by Euclidean distance.

    vectors: vec_id and embedding; queries: the same columns, for the rows that ask. Nearest first, ties to smaller ids. Rows
    repeated whole count once; vectors are compared with those of as many components. A query with no usable vector has no
    answers, one with fewer than k candidates has them all. Other columns are not read.
    """
    found = cut_lineage(points(vectors, k))
    wanted = queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("query_id is not null").distinct()
    wanted = cut_lineage(wanted.join(found.select("vector", "point"), "vector").select("query_id", "point"))
    asked = cut_lineage(wanted.select("point").distinct())
    placed = cut_lineage(places(found))
    width = window or window_for(found, placed, asked, k + 1)
    block = int(min(max(2 * width, BLOCK[0]), BLOCK[1]))
    spots = placed.groupBy("point").agg(F.collect_list(F.struct("width", "curve", "place")).alias("spots"))
    rows = cut_lineage(found.select("point", "vector").join(spots, "point").join(asked.withColumn("asks", F.lit(True)), "point", "left"))
    each = rows.select("point", "vector", F.explode("spots").alias("s"), F.coalesce("asks", F.lit(False)).alias("asks"))
    there = each.select("s.*", F.floor(F.col("s.place") / block).alias("block"), "point", "vector", F.lit(False).alias("asked"))
    low, high = F.floor((F.col("s.place") - width) / block), F.floor((F.col("s.place") + width) / block)
    asking = each.filter("asks").select("s.*", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("block"), "point", "vector", F.lit(True).alias("asked"))
    dealt = there.union(asking).repartition("width", "curve", "block").sortWithinPartitions("width", "curve", "block")
    hits = dealt.mapInArrow(_compare(width, k + 1), HITS)
    best = _best(hits, k + 1).join(found.select("point", "members"), "point").select("query", "score", F.explode("members").alias("vec_id"))
    near = Window.partitionBy("query").orderBy("score", "vec_id")
    best = best.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k + 1).select(F.col("query").alias("point"), "vec_id", "score")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = wanted.join(best, "point").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """Answers for the rows whose id is divisible by 100."""
    return search(vectors, vectors.filter("vec_id % 100 = 0"))

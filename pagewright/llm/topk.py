"""Exact top-k search by inner product of integer vectors, with a table of distances to pivots.

An inner product is (|q|^2 + |o|^2 - d(q, o)^2) / 2, so a lower bound on a distance is an upper bound on a score. Distances of
all vectors to many pivots are computed once and stored; by the triangle inequality d(q, o) is at least the largest
|d(q, p) - d(o, p)| over the pivots p. Each query is bounded from below by the k-th best score in a bounded sample, whole cells
(vectors nearest to one pivot) are passed over where even the cell's interval of distances can't reach it, and in the other cells
candidates are evaluated in the order of their bounds until the next bound lies under the k-th best score so far. Bounds carry a
slack for rounding, scores are exact, so the answers are those of a full comparison.

Copies of a vector are one candidate with as many of its smallest ids as an answer can hold. A cell is cut into shards of
bounded size; a task holds one shard, and queries pass through it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import stored

#: Answers to a query, and what components are multiplied by before they are cut to integers.
K = 5
SCALE = 256
#: Pivots of a width, and the bounded sample of candidates that they and the first bounds come from.
PIVOTS = 48
SAMPLE = 2048
#: Candidates of a shard, and pairs of queries and candidates that are bounded at a time.
SHARD = 8192
PAIRS = 1 << 21
#: Candidates that are evaluated together; twice as many each time.
STEP = 64
#: Relative slack of bounds, far above the rounding of a distance.
SLACK = 1e-9
#: Sums of products below this are exact in double precision; scores are cut to 64 bits.
EXACT = float(1 << 53)
ENDS = (-(1 << 63), (1 << 63) - 1)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vector array<double> (whole numbers) of each distinct usable row: floor(scale * x).

    Rows without id, and vectors that are null or hold what is null or not finite, take no part; zero vectors do.
    """
    x = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    # from 2**53 on, doubles are whole numbers
    whole = F.transform("vector", lambda c: F.when(F.abs(c * scale) < EXACT, F.floor(c * scale).cast("double")).otherwise(c * scale))
    return x.select("vec_id", whole.alias("vector")).distinct()


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """vector and members (its k + 1 smallest ids) of each distinct vector."""
    # Spark applies the limit where the rows are, before any of a hot vector's copies move
    few = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))


def _stacked(column: pa.Array, rows: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, width)


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _apart(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(rows), 0))


def _inner(rows: np.ndarray, query: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products with a query, cut to 64 bits: in double precision where that is exact, else as Python integers."""
    if rows.size and float(np.abs(rows).max()) * float(np.abs(query).max()) * rows.shape[1] >= EXACT:
        ints = [int(x) for x in query]
        return np.array([min(max(sum(int(a) * b for a, b in zip(r, ints)), ENDS[0]), ENDS[1]) for r in rows.tolist()], object)
    return rows @ query


def choose_pivots(rows: np.ndarray, many: int) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen so far."""
    chosen = [int(np.argmax((rows * rows).sum(axis=1)))]
    far = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < many and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


class Plan:
    """Pivots of each width, and the sample that first bounds come from."""

    def __init__(self, found: DataFrame, k: int) -> None:
        self.k = k
        by_width: dict[int, list] = {}
        for r in found.orderBy(F.xxhash64("vector"), "members").limit(SAMPLE).collect():
            by_width.setdefault(len(r["vector"]), []).append(r)
        self.rows = {w: np.array([r["vector"] for r in x], np.float64).reshape(len(x), w) for w, x in by_width.items()}
        self.members = {w: [r["members"] for r in x] for w, x in by_width.items()}
        self.pivots = {w: choose_pivots(x, PIVOTS) for w, x in self.rows.items()}

    def apart(self, rows: np.ndarray) -> np.ndarray:
        return _apart(rows, self.pivots.get(rows.shape[1], np.zeros((0, rows.shape[1]))))

    def floor(self, query: int, vector: np.ndarray) -> float:
        """A score that k rows of the sample reach, those of the query's own id left out."""
        rows = self.rows.get(len(vector))
        if rows is None:
            return -np.inf
        scores = np.array(_inner(rows, vector), np.float64)
        order, got = np.argsort(-scores, kind="stable"), 0
        for i in order.tolist():
            got += sum(m != query for m in self.members[len(vector)][i])
            if got >= self.k:
                return float(scores[i]) - SLACK * abs(float(scores[i]))
        return -np.inf


def _per_width(fn, columns: list[str]):
    """For mapInArrow: `fn(part, rows)` for the rows of each width in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                yield pa.RecordBatch.from_arrays(fn(part, _stacked(part.column("vector"), part.num_rows, width)), columns)

    return run


def pivot_table(found: DataFrame, plan: Plan) -> DataFrame:
    """Candidates with width, cell (the nearest pivot), apart (distances to all pivots) and norm (squared length)."""

    def fill(part: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
        apart = plan.apart(rows)
        cell = apart.argmin(axis=1) if apart.shape[1] else np.zeros(len(rows), np.int64)
        return [part.column("width"), pa.array(cell, pa.int32()), part.column("vector"), part.column("members"), _lists(apart), pa.array((rows * rows).sum(axis=1))]

    wide = found.select(F.size("vector").alias("width"), "vector", "members")
    return wide.mapInArrow(_per_width(fill, ["width", "cell", "vector", "members", "apart", "norm"]),
                           "width int, cell int, vector array<double>, members array<bigint>, apart array<double>, norm double")


def asked(queries: DataFrame, plan: Plan) -> DataFrame:
    """Queries with their distances to all pivots and the score that an answer must reach."""

    def fill(part: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
        ids = part.column("query_id").to_pylist()
        floors = pa.array([plan.floor(q, v) for q, v in zip(ids, rows)], pa.float64())
        return [part.column("width"), part.column("query_id"), part.column("vector"), _lists(plan.apart(rows)), pa.array((rows * rows).sum(axis=1)), floors]

    wide = queries.select(F.size("vector").alias("width"), "query_id", "vector")
    return wide.mapInArrow(_per_width(fill, ["width", "query_id", "vector", "apart", "norm", "reach"]),
                           "width int, query_id bigint, vector array<double>, apart array<double>, norm double, reach double")


def cells(table: DataFrame) -> DataFrame:
    """A row for each width and pivot: shards, the largest norm, and the interval of distances to each pivot."""
    each = table.select("width", "cell", "norm", F.posexplode_outer("apart").alias("pivot", "far"))
    per = each.groupBy("width", "cell", "pivot").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("far").alias("low"), F.max("far").alias("high"))
    rows = F.array_sort(F.collect_list(F.struct("pivot", "low", "high")))
    return per.groupBy("width", "cell").agg(F.ceil(F.max("n") / SHARD).cast("int").alias("shards"), F.max("norm").alias("most"), rows.alias("spans"))


def reachable(queries: DataFrame, of: DataFrame) -> DataFrame:
    """Queries beside each cell whose interval of distances leaves room for an answer."""
    outside = F.zip_with("apart", "spans", lambda d, s: F.greatest(d - s["high"], s["low"] - d, F.lit(0.0)))
    gap = F.coalesce(F.array_max(outside), F.lit(0.0))
    bound = (F.col("norm") + F.col("most")) * (1 + SLACK) - gap * gap * (1 - SLACK)
    # one row of cells for each width and pivot: their number doesn't follow the rows
    return queries.join(F.broadcast(of), "width").filter(F.greatest(bound / 2, F.lit(float(ENDS[0]))) >= F.col("reach"))


def _evaluate(query: int, vector: np.ndarray, bounds: np.ndarray, reach: float, rows: np.ndarray, members: list[list[int]], own: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard in the order of bounds; stops once no bound can reach the k-th best.

    own: candidates that have no other id than the query's.
    """
    left = np.flatnonzero((bounds >= reach) & ~own)
    left = left[np.argsort(-bounds[left], kind="stable")]
    best: list[tuple[int, int, int]] = []
    at, step = 0, STEP
    while at < len(left) and not (len(best) >= k and bounds[left[at]] < -best[k - 1][0]):
        now = left[at:at + step]
        scores = _inner(rows[now], vector)
        if len(best) >= k:
            near = np.flatnonzero(scores >= -best[k - 1][0])
            now, scores = now[near], scores[near]
        best = sorted(best + [(-int(s), next(m for m in members[i] if m != query), i) for s, i in zip(scores.tolist(), now.tolist())])[:k]
        at, step = at + step, step * 2
    return [(-s, m) for s, m in sorted((s, m) for s, _, i in best for m in members[i] if m != query)[:k]]


def _search(k: int):
    """For mapInArrow over rows sorted by shard, candidates before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shard = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("width", "cell", "shard", "asks"))))
            cuts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if names[a][:3] != key:
                    key, held, shard = names[a][:3], [], None
                part, width = batch.slice(a, b - a), key[0]
                if not names[a][3]:
                    held.append(part)
                    continue
                if shard is None:
                    got = pa.Table.from_batches(held).combine_chunks() if held else None
                    if got is None:
                        continue
                    n = got.num_rows
                    members = got.column("members").to_pylist()
                    far = got.column("apart").combine_chunks()
                    shard = (_stacked(got.column("vector").combine_chunks(), n, width), members, _stacked(far, n, -1 if len(far.flatten()) else 0),
                             got.column("norm").to_numpy(), np.array([m[0] for m in members]), np.array([len(m) == 1 for m in members]))
                    held = []
                rows, members, apart, norms, first, single = shard
                made = []
                asking, theirs = _stacked(part.column("vector"), part.num_rows, width), part.column("apart")
                theirs = _stacked(theirs, part.num_rows, apart.shape[1])
                ids, their_norms, reach = part.column("query_id").to_pylist(), part.column("norm").to_numpy(), part.column("reach").to_numpy()
                for lo in range(0, len(ids), max(1, PAIRS // len(rows))):
                    to = lo + max(1, PAIRS // len(rows))
                    gap = np.zeros((len(ids[lo:to]), len(rows)))
                    for p in range(apart.shape[1]):
                        np.maximum(gap, np.abs(theirs[lo:to, p, None] - apart[None, :, p]), out=gap)
                    bounds = ((their_norms[lo:to, None] + norms[None, :]) * (1 + SLACK) - gap * gap * (1 - SLACK)) / 2
                    np.maximum(bounds, float(ENDS[0]), out=bounds)
                    for i in range(len(gap)):
                        q = ids[lo + i]
                        best = _evaluate(q, asking[lo + i], bounds[i], reach[lo + i], rows, members, single & (first == q), k)
                        made += [(q, m, s) for s, m in best]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with rows of another id, all if fewer.

    vectors: vec_id and embedding; queries: the same columns, for the rows that ask. Highest first, ties to smaller ids. Rows
    repeated whole count once; an id with several vectors is several rows, and asks with all of them. Vectors are compared with
    those of as many components. A query without a usable vector has no answers. Scores beyond 64 bits are cut to their ends.
    Other columns are not read.
    """
    found = stored(candidates(integers(vectors, scale), k))
    plan = Plan(found, k)
    table = stored(pivot_table(found, plan))
    of = stored(cells(table))
    shards = F.broadcast(of.select("width", "cell", "shards"))
    shard = F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard")
    there = table.join(shards, ["width", "cell"]).select("width", "cell", shard, F.lit(False).alias("asks"), "vector", "apart", "norm", "members", F.lit(None).cast("bigint").alias("query_id"), F.lit(0.0).alias("reach"))
    asking = reachable(asked(integers(queries, scale).withColumnRenamed("vec_id", "query_id"), plan), of)
    asking = asking.select("width", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"),
                           "vector", "apart", "norm", F.lit(None).cast("array<bigint>").alias("members"), "query_id", "reach")
    dealt = there.union(asking).repartition("width", "cell", "shard").sortWithinPartitions("width", "cell", "shard", "asks")
    hits = dealt.mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """Answers for the rows whose id is divisible by 50."""
    return search(vectors, vectors.filter("vec_id % 50 = 0"))

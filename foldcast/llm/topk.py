"""Exact top-k inner products by aggregation without random access, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table

TOP = 5
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
#: Queries whose bounds are held at once.
TOGETHER = 128
#: Equal steps in which sorted lists are read.
STEPS = 32
FOUND = "query_row long, query_id long, vec_id long, score long"
LONG = 2**63


def usable(vector: Column) -> Column:
    """No null among its components, none infinite and none that is no number."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))


def matrix(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) as rows; a shorter vector ends in zeros."""
    lists = vectors.combine_chunks()
    values, at = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    sizes = np.diff(at)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(scale * values[at[0] : at[-1]])
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


class SortedLists:
    """The components of a block's rows, each sorted once for all queries, read to ``STEPS`` equal depths.

    ``high[s]`` and ``low[s]`` are the last values read at depth s from the top and from the bottom.
    """

    def __init__(self, x: np.ndarray) -> None:
        lists, n = np.sort(x, axis=0), len(x)
        self.depths = np.unique(np.ceil(np.linspace(0, n, STEPS + 1)).astype(int)[1:])
        self.high, self.low = lists[n - self.depths], lists[self.depths - 1]
        self.first, self.last = lists[0], lists[-1]


def nra(x: np.ndarray, lists: SortedLists, own: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the rows of ``x`` that may be among its ``k`` best, no fewer than those, and the depth it read to.

    A query reads component d from the top where its weight is positive and from the
    bottom where it is negative, all lists to the same depth. A row's upper bound takes
    for what is unread the value at that depth, its lower bound the worst value of
    the list. ``floor`` is a score that ``k`` rows of other blocks reach already; without one it
    is the k-th best lower bound found here. When the upper bounds of all but few rows
    lie below it, these rows cannot qualify, and only the few are left to be scored.

    A row that no list has shown yet is bounded by the lists' values alone. Before
    that bound is below the floor nothing can be left out, so lists are
    read on to there before any row is bounded. Bounds of many queries come from the same
    lists as products of matrices. ``own[j, i]`` excludes row i from query j.
    """
    n, found, read = len(x), [np.zeros(0, np.int64)] * len(q), np.zeros(len(q), np.int64)
    positive, negative = np.maximum(q, 0), np.minimum(q, 0)
    ends, carried = len(lists.depths) - 1, np.isfinite(floor)
    shown = positive @ lists.high.T + negative @ lists.low.T < floor[:, None]
    start = np.where(shown.any(axis=1), shown.argmax(axis=1), ends)
    start[~carried] = ends // 2  # the first look that gives lower bounds
    least, few = floor.copy(), max(4 * k, n // 16)
    left = np.arange(len(q))
    for s, depth in enumerate(lists.depths):
        these = left[start[left] <= s]
        if not len(these):
            continue
        p, m, high, low = positive[these], negative[these], lists.high[s], lists.low[s]
        may = ~own[these]
        upper = p @ np.maximum(x, high).T + m @ np.minimum(x, low).T
        loose = np.flatnonzero(~carried[these])
        if len(loose) and n > k:
            lower = p[loose] @ np.where(x >= high, x, lists.first).T + m[loose] @ np.where(x <= low, x, lists.last).T
            lower[~may[loose]] = -np.inf
            least[these[loose]] = np.partition(lower if s < ends else np.where(may[loose], upper[loose], -np.inf), n - k, axis=1)[:, n - k]
        may &= upper >= least[these, None]
        done = (may.sum(axis=1) <= few) | (s == ends)
        for at in np.flatnonzero(done):
            found[these[at]], read[these[at]] = np.flatnonzero(may[at]), depth
        left = np.setdiff1d(left, these[done], assume_unique=True)
    return found, read


def best_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's ``k`` best rows that reach its floor, ties to the smaller id."""
    width = max(x.shape[1], q.shape[1])
    x, q = widened(x, width), widened(q, width)
    out = []
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, width) >= 2**53:  # beyond what doubles add exactly
        x, q = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (x, q))
        near = [np.flatnonzero(ids != i) for i in query_ids]
    else:
        near, lists = [], SortedLists(x)
        for a in range(0, len(q), TOGETHER):
            part = slice(a, a + TOGETHER)
            near += nra(x, lists, query_ids[part, None] == ids[None], q[part], floor[part], k)[0]
    for j, rows in enumerate(near):
        scores = x[rows] @ q[j] if len(rows) else np.zeros(0)
        scores = [max(-LONG, min(LONG - 1, int(s))) for s in scores]
        order = sorted(range(len(rows)), key=lambda r: (-scores[r], ids[rows[r]]))[:k]
        out += [(j, int(rows[r]), scores[r]) for r in order]
    return out


def top_k(vectors: DataFrame, every: int, k: int = TOP, scale: float = 256.0) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows for each query row of ``vectors(vec_id, embedding)``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; all rows
    but those of the query's own id are searched. Vectors that are null or hold a null
    or a value that is not finite take no part, nor do rows without id. Vectors of
    different lengths are compared as if the shorter ended in zeros; a repeated
    row is found, and asks, as often as it is there. Scores beyond 64 bits are cut to them.

    Rows and queries meet in blocks of bounded size, each block pair in one
    group; a block returns at most ``k`` rows a query, of which the best stay. The first
    block is searched before the others: the k-th best score there is a floor that
    rows of other blocks have to reach, so their lists are read less far.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    )
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    asked = rows.where(F.col("vec_id") % every == 0).select(*(F.col(c).alias(f"query_{c}") for c in rows.columns))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    dealt = rows.withColumn("block", F.col("row") % blocks).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = asked.withColumn("query_block", (F.col("query_row") % query_blocks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def search(of_block: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["query_row", "query_id", "vec_id", "score"], pa.int64()
        if not len(of_block) or not len(queries):
            return pa.table([pa.array([], kinds)] * 4, names=names)
        ids = of_block.column("vec_id").to_numpy()
        query_ids, query_rows = (queries.column(c).to_numpy() for c in ("query_vec_id", "query_row"))
        floor = queries.column("floor").to_numpy()
        found = best_of_block(matrix(of_block.column("embedding"), scale), ids, matrix(queries.column("query_embedding"), scale), query_ids, floor, k)
        j, r, s = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(c, kinds) for c in (query_rows[j], query_ids[j], ids[r], s)], names=names)

    def searched(these: DataFrame, floors: DataFrame) -> DataFrame:
        return these.groupBy("block", "query_block").cogroup(floors.groupBy("block", "query_block")).applyInArrow(search, FOUND)

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    none = F.lit(float("-inf"))
    pairs = searched(dealt.where("block = 0"), asking.where("block = 0").withColumn("floor", none))
    if blocks > 1:
        pairs = staged(pairs, "topk-first")
        kth = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("query_row", F.col("score").cast("double").alias("floor"))
        others = asking.where("block > 0").join(kth, "query_row", "left").withColumn("floor", F.coalesce("floor", none))
        pairs = pairs.unionByName(searched(dealt.where("block > 0"), others))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=50)


OP7_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""

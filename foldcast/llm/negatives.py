"""Exact hard negatives by cover trees over norm-augmented candidates.

A vector x of the table with largest norm M is given one more component,
sqrt(M^2 - |x|^2), so that all candidates lie on one sphere and a query with a zero
there has the same inner products as before; its nearest candidates are those of
the largest product. The table is cut into bounded cover trees of neighbouring
rows. The covering radius of a node bounds the products of all rows below it from
both sides, so a search descends best first, leaves out nodes outside its windows
and scores the rows of the leaves it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table
from foldcast.llm.topk import usable

POSITIVES = NEGATIVES = 5
#: Rows of a tree, anchors of a block, rows of a leaf, nodes expanded at once, anchors searched together.
TREE_ROWS, BLOCK_ANCHORS, LEAF, AT_ONCE, TOGETHER = 1024, 1024, 16, 64, 256
#: Factor between the covering radii of two levels.
BASE = 2.0
#: Rows that the pivots, to which rows are dealt before they are cut into trees, are taken from. Pivots only decide which rows share a tree.
PIVOTS = 128
#: Salts of an anchor block: its trees are searched by so many tasks.
SALTS = 16
EXACT = float(2**53)


class Tree:
    """Nodes with the position of their centre, covering radius, and their children or rows, both as ranges."""

    def __init__(self, x: np.ndarray, augmented: np.ndarray) -> None:
        order: list[np.ndarray] = []
        self.centre, self.radius, self.low, self.high, self.leaf = [0], [0.0], [0], [0], [False]
        used, todo = 0, [(0, np.arange(len(x)), 0)]
        self.radius[0] = float(self._far(augmented, np.arange(len(x)), 0).max(initial=0.0))
        while todo:
            node, members, centre = todo.pop()
            radius = self.radius[node]
            if len(members) <= LEAF or radius == 0.0:
                self.leaf[node], self.low[node], self.high[node] = True, used, used + len(members)
                order.append(members)
                used += len(members)
                continue
            # centres more than radius / BASE apart that cover all members at that distance
            centres, near = [centre], self._far(augmented, members, centre)
            owner = np.zeros(len(members), np.int64)
            while near.max() > radius / BASE:
                centres.append(int(members[near.argmax()]))
                far = self._far(augmented, members, centres[-1])
                closer = far < near
                owner[closer] = len(centres) - 1
                near = np.where(closer, far, near)
            first = len(self.centre)
            self.low[node], self.high[node] = first, first + len(centres)
            for k, c in enumerate(centres):
                of_child = owner == k
                self.centre.append(c)
                self.radius.append(float(near[of_child].max(initial=0.0)))
                self.low.append(0), self.high.append(0), self.leaf.append(False)
                todo.append((first + k, members[of_child], c))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)

    @staticmethod
    def _far(augmented: np.ndarray, members: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.square(augmented[members] - augmented[centre]).sum(axis=1))


class Found:
    """Scores of the rows of one tree that were reached, and the k best of every window so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, best: np.ndarray) -> None:
        self.low, self.high, self.best = low, high, best

    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.best[:, :, 0])

    def add(self, at: np.ndarray, scores: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            inside = (scores >= self.low[at, w, None]) & (scores <= self.high[at, w, None])
            both = np.concatenate([self.best[at, w], np.where(inside, scores, -np.inf)], axis=1)
            k = self.best.shape[2]
            self.best[at, w] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)


def search(tree: dict, q: np.ndarray, allowed: np.ndarray, found: Found) -> tuple[np.ndarray, int]:
    """Scores of queries and the tree's rows, NaN where no row of a node reached was allowed, and how many were computed.

    ``allowed[i, r]``: row r may be found by query i.
    """
    x, top = tree["x"], tree["norm"]
    norms = np.sqrt(np.square(q).sum(axis=1))
    scores = np.full((len(q), len(x)), np.nan)
    slack = 1e-9 * top * (norms + 1.0)  # bounds are rounded, scores are not
    computed, queue, number = 0, [], 0

    def push(nodes: np.ndarray, at: np.ndarray) -> None:
        nonlocal number
        dots = q[at] @ x[tree["centre"][nodes]].T
        radius = tree["radius"][nodes]
        apart = np.sqrt(np.maximum(0.0, np.square(norms[at, None]) + top * top - 2.0 * dots))
        on_sphere = np.square(norms[at, None]) + top * top
        reach = norms[at, None] * radius
        upper = np.minimum(dots + reach, (on_sphere - np.square(np.maximum(0.0, apart - radius))) / 2.0) + slack[at, None]
        lower = np.maximum(dots - reach, (on_sphere - np.square(apart + radius)) / 2.0) - slack[at, None]
        for k, node in enumerate(nodes.tolist()):
            number += 1
            heappush(queue, (-upper[:, k].max(), number, node, at, upper[:, k], lower[:, k]))

    push(np.zeros(1, np.int64), np.arange(len(q)))
    while queue:
        rows, askers = [], np.zeros(len(q), bool)
        floor = found.floor()
        for _ in range(min(AT_ONCE, len(queue))):
            _, _, node, at, upper, lower = heappop(queue)
            open_ = ((upper[:, None] >= floor[at]) & (lower[:, None] <= found.high[at])).any(axis=1)
            if not open_.any():
                continue
            if tree["leaf"][node]:
                rows.append(np.arange(tree["low"][node], tree["high"][node]))
                askers[at[open_]] = True
            else:
                push(np.arange(tree["low"][node], tree["high"][node]), at[open_])
        if rows:
            rows, at = np.concatenate(rows), np.flatnonzero(askers)
            exact = q[at] @ x[rows].T
            computed += exact.size
            exact[~allowed[np.ix_(at, rows)]] = np.nan
            scores[np.ix_(at, rows)] = exact
            found.add(at, exact)
    return scores, computed


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0.0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind.encode() + x.astype(kind).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, data[:3].decode(), offset=3).reshape(-1, width).astype(np.float64)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector ends in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    at = vectors.offsets.to_numpy()
    out[np.arange(width) < sizes[:, None]] = vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return out


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, top * top - np.square(x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _runs_of(batches, size: int) -> Iterator[pa.Table]:
    """Rows in order, so many at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _ints(values, kind: str = "<i8") -> bytes:
    return np.asarray(values).astype(kind).tobytes()


TREE = "tree long, labels array<long>, root array<double>, spread double, ids binary, rows binary, of_label binary, x binary, nodes binary"
BLOCK = "block long, labels array<long>, middle array<double>, spread double, low double, high double, ids binary, rows binary, of_label binary, x binary, lows binary, highs binary"


def _number(k: int) -> int:
    return (TaskContext.get().partitionId() << 32) + k


def plant(dealt: DataFrame, width: int, top: float) -> DataFrame:
    """Cover trees of neighbouring rows of a table sorted along ranges."""

    def build(batches) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(_runs_of(batches, TREE_ROWS)):
            x = _matrix(t.column("x").combine_chunks(), width)
            tree = Tree(x, _augmented(x, top))
            o = tree.order
            place = np.argsort(o)  # where a row went
            nodes = np.array([place[tree.centre], tree.radius, tree.low, tree.high, tree.leaf], np.float64)
            label = t.column("label").to_numpy()[o]
            yield pa.RecordBatch.from_pylist(
                [
                    {"tree": _number(k), "labels": np.unique(label).tolist(), "root": x[tree.centre[0]].tolist(), "spread": tree.radius[0],
                     "ids": _ints(t.column("vec_id").to_numpy()[o]), "rows": _ints(t.column("row").to_numpy()[o]),
                     "of_label": _ints(label), "x": packed(x[o]), "nodes": nodes.tobytes()}
                ],
                _schema(TREE),
            )

    return dealt.mapInArrow(build, TREE)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _blocks(anchors: DataFrame, width: int, windows: int) -> DataFrame:
    """Blocks of neighbouring anchors with the windows ``lows`` and ``highs`` that each one searches."""

    def build(batches) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(_runs_of(batches, BLOCK_ANCHORS)):
            x = _matrix(t.column("x").combine_chunks(), width)
            middle = x.mean(axis=0)
            label = t.column("label").to_numpy()
            if windows:
                given = [t.column(c).combine_chunks() for c in ("lows", "highs")]
                lows, highs = (_matrix(g, windows) for g in given)
                missing = np.arange(windows) >= np.diff(given[0].offsets.to_numpy())[:, None]
                lows[missing], highs[missing] = np.inf, -np.inf  # windows that an anchor does not have are empty
            else:
                lows, highs = np.full((len(x), 1), -np.inf), np.full((len(x), 1), np.inf)
            yield pa.RecordBatch.from_pylist(
                [
                    {"block": _number(k), "labels": np.unique(label).tolist(), "middle": middle.tolist(),
                     "spread": float(np.sqrt(np.square(x - middle).sum(axis=1)).max()),
                     "ids": _ints(t.column("vec_id").to_numpy()), "rows": _ints(t.column("row").to_numpy()), "of_label": _ints(label),
                     "x": packed(x), "low": lows.min(), "high": highs.max(), "lows": lows.tobytes(), "highs": highs.tobytes()}
                ],
                _schema(BLOCK),
            )

    return anchors.mapInArrow(build, BLOCK)


FOUND = "anchor_row long, anchor_id long, window int, vec_id long, score long"


def _search_pairs(pairs: DataFrame, blocks: DataFrame, trees: DataFrame, width: int, top: float, windows: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each tree for each window of each anchor, less where earlier trees of a task give better ones."""
    salt = F.pmod(F.hash("tree"), F.lit(SALTS))
    asked = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({c: f"q_{c}" for c in blocks.columns if c != "block"})
    joined = pairs.join(trees, "tree").withColumn("salt", salt).join(asked, ["block", "salt"])
    names = ["block", "ids", "rows", "of_label", "x", "nodes", "q_ids", "q_rows", "q_of_label", "q_x", "q_lows", "q_highs"]
    count = max(windows, 1)
    schema = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):  # one tree in memory at a time
                r = {n: batch.column(c)[row].as_py() for c, n in enumerate(names)}
                longs = {n: np.frombuffer(r[n], "<i8") for n in ("ids", "rows", "of_label", "q_ids", "q_rows", "q_of_label")}
                x, q = unpacked(r["x"], width), unpacked(r["q_x"], width)
                if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * width >= EXACT:
                    raise ValueError("components are too large for exact scores")
                centre, radius, low, high, leaf = np.frombuffer(r["nodes"], np.float64).reshape(5, -1)
                tree = {"x": x, "norm": top, "centre": centre.astype(np.int64), "radius": radius, "low": low.astype(np.int64), "high": high.astype(np.int64), "leaf": leaf > 0}
                lows, highs = (np.frombuffer(r[n], np.float64).reshape(-1, count) for n in ("q_lows", "q_highs"))
                if at != r["block"]:
                    at, best = r["block"], np.full((len(q), count, k), -np.inf)
                for a in range(0, len(q), TOGETHER):
                    part = slice(a, a + TOGETHER)
                    allowed = longs["q_of_label"][part, None] == longs["of_label"]
                    allowed = allowed & (longs["q_rows"][part, None] != longs["rows"]) if same else ~allowed
                    found = Found(lows[part], highs[part], best[part])
                    scores, _ = search(tree, q[part], allowed, found)
                    for w in range(count):
                        good = (scores >= found.floor()[:, w, None]) & (scores <= found.high[:, w, None])
                        i, j = np.nonzero(good)
                        s, ids = scores[i, j].astype(np.int64), longs["ids"][j]
                        order = np.lexsort((ids, -s, i))
                        i, s, ids = i[order], s[order], ids[order]
                        first = np.arange(len(i)) - np.searchsorted(i, i) < k
                        i, s, ids = i[first], s[first], ids[first]
                        out = (longs["q_rows"][part][i], longs["q_ids"][part][i], np.full(len(i), w, np.int32), ids, s)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=schema)

    return joined.select(*names).sortWithinPartitions("block").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)


def whole_numbers(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))


def mine(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100, scale: float = 256.0
) -> DataFrame:
    """Hard negatives of the rows of ``vectors(vec_id, label, embedding)`` for which ``anchor`` holds.

    A row's score is the inner product of floor(scale * x) with the anchor's; higher
    scores come first, ties by smaller ``vec_id``. An anchor's positives are its first
    other rows of its label; for each of them, the first rows of other labels with
    ``low * positive <= 100 * score <= high * positive`` are returned as ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``. Rows without id or label, and vectors that are
    null or hold a null or a value that is not finite, take no part. Shorter vectors count as ending in zeros.
    A repeated row is found, and asks, as often as it is there. Other columns are ignored; no rows give no result.

    Rows are dealt along (label, nearest pivot, distance) in ranges and cut into trees of bounded size,
    so that a label, or a vector with many copies, is spread over tasks. Blocks of anchors meet the trees that hold
    their label, then those whose roots reach into their windows.
    """
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), whole_numbers(F.col("embedding"), scale).alias("x"), F.coalesce(anchor, F.lit(False)).alias("asks")
    )
    square = _dot(F.col("x"), F.col("x"))
    sizes = rows.agg(F.max(F.size("x")), F.max(square)).first()
    width, top = max(1, sizes[0] or 1), float(np.sqrt(sizes[1] or 0.0))
    sample = rows.select("x", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(PIVOTS).select("x").toArrow().column("x").combine_chunks()
    if isinstance(sample, pa.ChunkedArray):
        sample = pa.concat_arrays(sample.chunks) if sample.num_chunks else pa.array([], pa.list_(pa.float64()))
    pivots = _augmented(_matrix(sample, width), top)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _augmented(_matrix(batch.column(batch.schema.get_field_index("x")), width), top)
            near = z @ pivots.T
            cell = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(-near[np.arange(len(z)), cell])], [*batch.schema.names, "cell", "far"]
            )

    kinds = "vec_id long, label long, x array<double>, asks boolean, row long, cell int, far double"
    dealt = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(deal, kinds), "negatives-rows")
    along = ("label", "cell", "far", "vec_id")
    trees = staged(plant(dealt.repartitionByRange(*along).sortWithinPartitions(*along), width, top), "negatives-trees")
    asking = dealt.where("asks")
    blocks = staged(_blocks(asking.repartitionByRange(*along).sortWithinPartitions(*along), width, 0), "negatives-blocks")

    holds = trees.select("tree", F.explode("labels").alias("label")).join(blocks.select("block", F.explode("labels").alias("label")), "label")
    met = _search_pairs(holds.select("block", "tree").distinct(), blocks, trees, width, top, 0, positives, same=True)
    liked = staged(_best(met, positives), "negatives-positives")

    # whole scores s with low * positive <= 100 * s <= high * positive
    bounds = {"low": _hundredth(F.lit(low) * F.col("score") + 99), "high": _hundredth(F.lit(high) * F.col("score"))}
    windows = liked.groupBy("anchor_row").agg(
        F.sort_array(F.collect_list(F.struct("rank", *(b.cast("double").alias(n) for n, b in bounds.items())))).alias("w")
    )
    ready = asking.join(windows, asking["row"] == windows["anchor_row"]).withColumns({"lows": F.col("w.low"), "highs": F.col("w.high")}).drop("w", "anchor_row")
    blocks = staged(_blocks(ready.repartitionByRange(*along).sortWithinPartitions(*along), width, positives), "negatives-windows")
    hard = _best(_search_pairs(_near_pairs(blocks, trees), blocks, trees, width, top, positives, negatives, same=False), negatives)
    own = liked.select("anchor_row", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(own, ["anchor_row", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _hundredth(c: Column) -> Column:
    """floor(c / 100) of whole numbers."""
    return (c - F.pmod(c, F.lit(100))) / F.lit(100)


def _near_pairs(blocks: DataFrame, trees: DataFrame) -> DataFrame:
    """Blocks and the trees whose roots reach into the block's windows: only their balls are compared."""
    group = F.pmod(F.hash("tree"), F.lit(SALTS)).alias("group")
    balls = trees.select(group, "tree", "root", F.col("spread").alias("t"))
    asked = blocks.select("block", "middle", F.col("spread").alias("b"), "low", "high", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("group"))
    product = _dot(F.col("middle"), F.col("root"))
    reach = F.col("t") * (F.sqrt(_dot(F.col("middle"), F.col("middle"))) + F.col("b")) + F.col("b") * F.sqrt(_dot(F.col("root"), F.col("root")))
    slack = (reach + F.abs(product)) * 1e-9 + 1e-6
    met = asked.join(balls, "group").withColumns({"product": product, "reach": reach + slack})
    return met.where("product + reach >= low AND product - reach <= high").select("block", "tree")


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved by one; every hundredth row is an anchor."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), liked AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
), hard AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM liked JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= {NEGATIVES}
"""

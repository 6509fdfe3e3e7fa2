"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table
from foldcast.llm.sharding import HASH_BITS, hash60, top_bits

BLOCK_BYTES = 64 << 10
#: A source without a weight weighs one of so many parts of the others.
TICKS = 1000
#: What given weights add up to as integers.
PARTS = 10**9
#: Blocks whose slots are gathered together; the cost of the schedule, never the result.
RUN_BLOCKS = 1024
#: Rows that are numbered together; memory of a task, never the result.
BUCKET_ROWS = 20_000

#: Columns that the operator adds.
MADE = ("src_block", "released", "due", "slot", "src_offset")

def weigh(sizes: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row ``(s, n)``, none for no sources: ``s`` has ``(src, t, blocks)`` by name; a source's share is t / n.

    ``weights`` are positive target weights by source, kept to a part in ``PARTS``; a
    source without one weighs a thousandth of the others. Without ``weights`` a source
    weighs the square root of its bytes.
    """
    if weights is None:
        weight = F.floor(F.sqrt(F.col("size").cast("double")))
    else:
        whole = math.fsum(weights.values())
        known = F.create_map(*map(F.lit, chain.from_iterable((f"s{k}", max(1, round(v / whole * PARTS))) for k, v in weights.items())))
        weight = F.try_element_at(known, F.col("src"))
    one = sizes.groupBy("src").agg(F.sum("size").alias("size")).select("src", "size", weight.cast("long").alias("w"))
    row = one.agg(F.sort_array(F.collect_list(F.struct("src", "w", "size"))).alias("s"), F.greatest(F.sum("w"), F.lit(1)).alias("w"))
    t = f"coalesce(x.w, greatest(1L, w div {TICKS}L))"
    row = row.where(F.size("s") > 0).selectExpr(f"transform(s, x -> named_struct('src', x.src, 't', greatest(1L, {t}), 'blocks', x.size div {block_bytes}L + 1)) AS s")
    return row.selectExpr("s", "aggregate(s, 0L, (a, x) -> a + x.t) AS n")


#: One block of a source gets its slot: of those released the one due first, or the next to be released if none is.
STEP = """
(y, step) -> element_at(transform(
  array(greatest(y.at, array_min(transform(y.next, x -> x.released)))),
  at -> element_at(transform(
    array(array_min(transform(y.next, x -> if(x.released <= at, x, null)))),
    p -> named_struct(
      'at', at + 1,
      'next', filter(
        transform(y.next, x -> if(x.i != p.i, x, named_struct(
          'due', ((x.k + 2) * n + s[x.i].t - 1) div s[x.i].t, 'i', x.i, 'k', x.k + 1, 'released', ((x.k + 1) * n) div s[x.i].t))),
        x -> x.k < s[x.i].blocks),
      'picks', concat(y.picks, array(named_struct('i', p.i, 'k', p.k, 'slot', at))))), 1)), 1)
"""
NO_PICKS = "cast(array() as array<struct<i: int, k: bigint, slot: bigint>>)"
ALL_STEPS = f"""
aggregate(
  sequence(0L, (aggregate(s, 0L, (a, x) -> a + x.blocks) - 1) div {{run}}),
  named_struct(
    'at', 0L,
    'next', transform(s, (x, i) -> named_struct('due', (n + x.t - 1) div x.t, 'i', i, 'k', 0L, 'released', 0L)),
    'runs', cast(array() as array<array<struct<i: int, k: bigint, slot: bigint>>>)),
  (z, run) -> element_at(transform(
    array(aggregate(
      sequence(1L, least({{run}}, aggregate(s, 0L, (a, x) -> a + x.blocks) - run * {{run}})),
      named_struct('at', z.at, 'next', z.next, 'picks', {NO_PICKS}),
      {STEP})),
    y -> named_struct('at', y.at, 'next', y.next, 'runs', concat(z.runs, array(y.picks)))), 1),
  z -> z.runs)
"""


def schedule(weighed: DataFrame, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """Slots ``(src, k, slot)`` of all blocks: block k is released at floor(k n / t) and due at ceil((k + 1) n / t).

    The shares t / n are not rounded to a round. In each slot the released
    block that is due first goes, ties to the first source by name; a slot is empty if none is
    released. Shares add up to 1, so all deadlines are met, and no source that has blocks left is a whole
    block ahead or behind in any slot, however many there are. It is a fold over the blocks
    in one row, with a step of as many terms as sources are left; ``run_blocks`` bounds what
    each step copies.
    """
    runs = weighed.selectExpr("s", f"explode({ALL_STEPS.format(run=f'{run_blocks}L')}) AS picks")
    return runs.selectExpr("inline(transform(picks, p -> named_struct('src', s[p.i].src, 'k', p.k, 'slot', p.slot)))")


def interleave(docs: DataFrame, weights: Mapping[str, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``src_block``, ``released``, ``due``, ``slot`` and ``src_offset``.

    Sorted by ``(slot, src_offset)`` the documents are in mixed order. A
    source's documents stand in the order of a hash of id and text; each belongs
    to the block of ``block_bytes`` in which it begins. All rows stay: while no
    source is used up, every prefix of slots holds each source's share to
    within a block; the slots of a source that is used up are empty, and the others
    go on at their own pace. A null source is a source, a null text has no
    bytes, equal rows stand next to each other; columns of these names are replaced.

    Offsets are summed within ranges of the hash and carried over by one row a
    range, so a hot source is dealt to as many tasks as its rows need.
    """
    docs = docs.drop(*MADE)
    own = "_mix"
    while any(c.lower().endswith(own) for c in docs.columns):
        own += "_"
    src, h, size, bucket, k = (c + own for c in ("src", "h", "size", "bucket", "k"))
    bits = max(4, math.ceil(math.log2(max(1, docs.count() / BUCKET_ROWS))))
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    hashed = hash60("doc_id", "text")
    rows = docs.select(
        "*",
        named.alias(src),
        hashed.alias(h),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias(size),
        top_bits(hashed, HASH_BITS, F.lit(bits)).alias(bucket),
    )
    sizes = staged(rows.groupBy(F.col(src).alias("src"), F.col(bucket).alias("bucket")).agg(F.sum(size).alias("size")), "mix-buckets")
    weighed = weigh(sizes, weights, block_bytes)
    slots = staged(schedule(weighed), "mix-slots")
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("src", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start" + own)).join(
        weighed.selectExpr("inline(s)", "n").select("src", F.col("t").alias("t" + own), F.col("n").alias("n" + own)), "src"
    )
    starts = starts.withColumnsRenamed({"src": src, "bucket": bucket})
    ordered = Window.partitionBy(src, bucket).orderBy(h, "doc_id", size).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.join(starts, [src, bucket])
        .withColumn("src_offset", F.col("start" + own) + F.sum(size).over(ordered) - F.col(size))
        .withColumn("src_block", F.floor(F.col("src_offset") / block_bytes))
        .withColumn(k, F.col("src_block"))
    )
    at = slots.select(F.col("src").alias(src), F.col("k").alias(k), F.col("slot").alias("at" + own))
    return placed.join(at, [src, k]).select(
        *docs.columns,
        "src_block",
        F.expr(f"(src_block * n{own}) div t{own}").alias("released"),
        F.expr(f"((src_block + 1) * n{own} + t{own} - 1) div t{own}").alias("due"),
        F.col("at" + own).alias("slot"),
        "src_offset",
    )


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interleave(docs).drop("text")


OP5_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, strlen(coalesce(text, ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), weighed AS (
  SELECT source, greatest(1, floor(sqrt(sum(size)::DOUBLE)))::BIGINT AS t, (sum(size) // {BLOCK_BYTES} + 1)::BIGINT AS blocks,
    row_number() OVER (ORDER BY source) - 1 AS i
  FROM rows GROUP BY source
), src AS (
  SELECT *, (sum(t) OVER ())::BIGINT AS n FROM weighed
), state AS (
  SELECT 0::BIGINT AS free, i, source, t, n, blocks, 0::BIGINT AS k FROM src
  UNION ALL
  SELECT here + 1, i, source, t, n, blocks, k + (i = pick)::BIGINT
  FROM (SELECT *, arg_min(i, ((k + 1) * n + t - 1) // t * 1000000 + i) FILTER (WHERE k < blocks AND (k * n) // t <= here) OVER () AS pick
        FROM (SELECT *, greatest(free, min((k * n) // t) FILTER (WHERE k < blocks) OVER ()) AS here, bool_or(k < blocks) OVER () AS more FROM state)
        WHERE more)
), picks AS (
  SELECT source, k, free_then - 1 AS slot
  FROM (SELECT *, lead(k) OVER w AS later, lead(free) OVER w AS free_then FROM state WINDOW w AS (PARTITION BY i ORDER BY free))
  WHERE later > k
), placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS src_offset
  FROM rows
), blocked AS (
  SELECT p.*, s.t, s.n, src_offset // {BLOCK_BYTES} AS src_block FROM placed p JOIN src s USING (source)
)
SELECT b.doc_id, b.source, src_block, (src_block * b.n) // b.t AS released, ((src_block + 1) * b.n + b.t - 1) // b.t AS due,
  p.slot, src_offset
FROM blocked b JOIN picks p ON p.source = b.source AND p.k = src_block
"""

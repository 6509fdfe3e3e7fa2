"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.common import staged, table

SHARD_BYTES = 256 << 10
HASH_BITS = 60
#: Bits of a cell beyond those an even split needs. Rows of cells that are still too large are looked at to the last bit.
SLACK_BITS = 6


def hash60(*columns: str) -> Column:
    """The first 60 bits of the MD5 of the columns' text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def top_bits(h: Column, bits: int, depth: Column) -> Column:
    """The first ``depth`` of a number's ``bits`` bits."""
    return F.call_function("shiftright", h, (F.lit(bits) - depth).cast("int"))


def bucket_sizes(rows: DataFrame, low: int, high: int) -> DataFrame:
    """``(cell, depth, bucket, size)`` of each ``high``-bit cell at each depth, cells summed up before they are shuffled."""
    cells = rows.groupBy(top_bits(F.col("h"), HASH_BITS, F.lit(high)).alias("cell")).agg(F.sum("n_bytes").alias("size"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return levels.withColumn("bucket", top_bits(F.col("cell"), high, F.col("depth")))


def directory(rows: DataFrame, shard_bytes: int, high: int) -> DataFrame:
    """``(cell, depth)`` for the ``high``-bit cells: the bucket that a cell points to has ``depth`` bits.

    That is the first bucket on its way down that fits; null if not even the cell does.
    """
    sizes = bucket_sizes(rows, 0, high).groupBy("depth", "bucket").agg(F.sum("size").alias("total"))
    fit = sizes.where(F.col("total") <= shard_bytes).select("depth", "bucket")
    parents = fit.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    leaves = fit.withColumn("parent", F.call_function("shiftright", "bucket", F.lit(1))).join(parents, ["depth", "parent"], "left_anti")
    span = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(high) - F.col("depth")).cast("int"))
    cells = F.sequence(F.col("bucket") * span, (F.col("bucket") + 1) * span - 1)
    large = sizes.where((F.col("total") > shard_bytes) & (F.col("depth") == high))
    return leaves.select(F.explode(cells).alias("cell"), "depth").unionByName(
        large.select(F.col("bucket").alias("cell"), F.lit(None).cast("int").alias("depth"))
    )


def hash_depths(rows: DataFrame, shard_bytes: int, low: int) -> DataFrame:
    """The same for single hashes of cells that were too large; only these rows take part."""
    levels = bucket_sizes(rows, low, HASH_BITS)
    sizes = levels.groupBy("depth", "bucket").agg(F.sum("size").alias("total"))
    found = levels.join(sizes, ["depth", "bucket"]).groupBy(F.col("cell").alias("h"))
    return found.agg(F.min(F.when(F.col("total") <= shard_bytes, F.col("depth"))).alias("depth"))


def assign(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each row's shard: ``key``, ``n_bytes``, ``depth``, ``prefix``, ``page``.

    A shard is a bucket of the directory, named by its number of bits and the
    bits. Rows that no bit can tell apart (equal keys, null keys among them)
    and that are too large together go to overflow pages; a row above half the
    limit has a page of its own there, so that every page fits unless a single
    row does not. A null or empty text has 0 bytes. Columns besides the key and
    ``text`` are not read; an empty table gives no rows.

    Overflow pages are numbered within the partitions that rows are read from,
    so no task holds a hot key; a joined directory is a plain table that Spark
    broadcasts only if its size allows, and otherwise splits hot cells against.
    """
    rows = docs.select(
        *key,
        hash60(*key).alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("seq"),
    )
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, total / shard_bytes))) + SLACK_BITS))
    coarse = staged(directory(rows, shard_bytes, bits), "shard-cells")
    by_cell = rows.withColumn("cell", top_bits(F.col("h"), HASH_BITS, F.lit(bits))).join(coarse, "cell").drop("cell")
    placed = by_cell.where(F.col("depth").isNotNull()).withColumn("page", F.lit(0).cast("long"))
    if not coarse.where(F.col("depth").isNull()).isEmpty():
        rest = by_cell.where(F.col("depth").isNull()).drop("depth")
        fine = staged(hash_depths(rest, shard_bytes, min(bits + 1, HASH_BITS)), "shard-hashes")
        deep = rest.join(fine, "h")
        split = deep.where(F.col("depth").isNotNull()).withColumn("page", F.lit(0).cast("long"))
        over = deep.where(F.col("depth").isNull()).withColumn("depth", F.lit(HASH_BITS))
        placed = placed.unionByName(split).unionByName(paged(over, shard_bytes))
    return placed.select(*key, "n_bytes", "depth", top_bits(F.col("h"), HASH_BITS, F.col("depth")).alias("prefix"), "page")


def paged(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Pages 1, 2, ... for rows of one hash, in the order in which a partition reads them.

    Rows that begin in the same half of the limit share a page: with the last of them it is full at most.
    """
    half = max(1, shard_bytes // 2)
    alone = F.col("n_bytes") > half
    size = F.when(alone, 0).otherwise(F.col("n_bytes"))
    w = Window.partitionBy("h", "part").orderBy("seq")
    page = F.floor((F.sum(size).over(w) - size) / half)
    near = rows.withColumn("part", F.shiftrightunsigned("seq", 33))
    return near.withColumn("page", F.when(alone, -1 - F.col("seq")).otherwise(1 + page + F.col("part") * (1 << 32))).drop("part")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


#: For unique keys and texts within the limit, as no bucket then needs pages.
OP1_SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT *, d::INT AS depth, h >> ({HASH_BITS} - d::INT) AS prefix FROM rows, generate_series(0, {HASH_BITS}) g(d)
), sizes AS (
  SELECT depth, prefix, sum(n_bytes) AS total FROM levels GROUP BY ALL
), fitting AS (
  SELECT l.*, row_number() OVER (PARTITION BY doc_id ORDER BY l.depth) AS k
  FROM levels l JOIN sizes s ON l.depth = s.depth AND l.prefix = s.prefix
  WHERE s.total <= {SHARD_BYTES}
)
SELECT doc_id, n_bytes, depth, prefix, 0::BIGINT AS page FROM fitting WHERE k = 1
"""

"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.bytespans import U64, blocks, is_space, mix, text_bytes
from foldcast.llm.common import SPACES, one_each, staged, table, text_or_empty

#: A cut may follow where the low bits of the rolling hash are 0: chunks of 2 KiB on average beyond the least size.
CUT_MASK = U64((1 << 11) - 1)
LEAST, MOST = 512, 16 << 10
ROLL = 16
AT_ONCE = 1 << 20
GEAR = mix(np.arange(256, dtype=U64) + U64(0x5EED))
RECIPES = "doc_id long, text_sha256 string, recipe binary"


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ``[\\x20\\x09-\\x0D]`` in a text becomes one space."""
    space = is_space(data)
    drop = space.copy()
    drop[1:] &= space[:-1]
    if len(drop):
        drop[at[:-1][at[:-1] < len(drop)]] = False
    return np.where(space, np.uint8(32), data)[~drop], at - np.concatenate([[0], np.cumsum(drop)])[at]


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end, by the hash of the last ``ROLL`` bytes."""
    h, width = GEAR[data], 1
    while width < ROLL:  # the hash of 2w bytes is that of the last w and, shifted, that of the w before
        wider = h.copy()
        wider[width:] += h[:-width] << U64(width)
        h, width = wider, 2 * width
    return np.flatnonzero((h >> U64(20)) & CUT_MASK == 0) + 1


def chunk_ends(cuts: np.ndarray, low: int, high: int) -> list[int]:
    """Ends of the chunks of the text ``[low, high)``; they depend on its bytes only."""
    ends, last = [], low
    near = cuts[np.searchsorted(cuts, low + LEAST) : np.searchsorted(cuts, high)].tolist()
    for cut in near:
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST:
            last = cut
            ends.append(last)
    while high - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, high] if high > last else ends


def chunked(batch_column: pa.Array) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(index, normalised text, its chunks) of each text."""
    data, at = text_bytes(batch_column)
    for low, high in blocks(at, AT_ONCE):
        part, part_at = normalised(data[at[low] : at[high]], at[low : high + 1] - at[low])
        cuts, raw = cut_points(part), part.tobytes()
        for k in range(high - low):
            a, b = int(part_at[k]), int(part_at[k + 1])
            ends = chunk_ends(cuts, a, b)
            yield low + k, raw[a:b], [raw[x:y] for x, y in zip([a, *ends], ends)]


def chunk_id(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def recipes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, SHA-256 of the normalised text, and its chunks' identifiers in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (hashlib.sha256(text).hexdigest(), b"".join(chunk_id(c, width) for c in chunks))
                for _, text, chunks in chunked(batch.column(1))
            ]
            sha, recipe = zip(*rows) if rows else ((), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(sha, pa.string()), pa.array(recipe, pa.binary())],
                names=["doc_id", "text_sha256", "recipe"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RECIPES)


def distinct_chunks(docs: DataFrame, width: int) -> DataFrame:
    """``(id, chunk)``: each distinct chunk of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {c for _, _, chunks in chunked(batch.column(0)) for c in chunks}
            for part in np.array_split(np.array(list(found), object), max(1, len(found) // 5_000)):
                yield pa.record_batch(
                    [pa.array([chunk_id(c, width) for c in part], pa.binary()), pa.array(part, pa.binary())], names=["id", "chunk"]
                )

    return docs.select("text").mapInArrow(run, "id binary, chunk binary")


def collisions(docs: DataFrame, width: int) -> bool:
    """Whether two different chunks have one identifier: every chunk's bytes are compared with its namesakes'."""
    same = distinct_chunks(docs, width).groupBy("id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
    return not same.where(F.col("a") != F.col("b")).isEmpty()


def mark_copies(docs: DataFrame, width: int = 16) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are the same after each run of white space has
    become one space; null is empty, and empty texts are equal. The smallest
    ``doc_id`` stays; rows that repeat it all count as kept, and a row without
    id is kept only among rows that all have none. No other column is read.

    Texts are cut where their content says so, and each distinct chunk moves
    once a task to check that its identifier stands for nothing else; if one
    does not, identifiers are widened and made again. After that only short
    lists of identifiers move, and equal lists mean equal texts. Groups are
    counted before they are shuffled; the table of repeated lists is written
    and joined as a plain table, so Spark splits a hot group of the other side.
    """
    docs = docs.select("doc_id", "text")
    while width < 64 and collisions(docs, width):
        width *= 2
    lists = staged(recipes(docs, width), "recipes")
    groups = lists.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = staged(groups.where("group_size > 1"), "repeated-recipes")
    joined = lists.join(repeated, "recipe", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all their columns; of rows that repeat an id any stays."""
    id_key, key = F.xxhash64(F.col("doc_id").cast("long")), ["copy id", "copy text"]
    marks = mark_copies(docs).where("group_size > 1").select(id_key.alias(key[0]), F.col("text_sha256").alias(key[1]), "kept")
    groups = staged(marks.groupBy(*key, "kept").count(), "copies")
    sha = F.sha2(F.regexp_replace(text_or_empty(), f"[{SPACES}]+", " ").cast("binary"), 256)
    keyed = docs.select("*", id_key.alias(key[0]), sha.alias(key[1]))
    left = keyed.join(groups.where("NOT kept").select(key), key, "left_anti")
    again = staged(groups.where("kept AND count > 1").select(key), "copies-again")
    return one_each(left, again, key).select(docs.columns)


def op8_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)
"""

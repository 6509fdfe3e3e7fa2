"""Token ids in Parquet list columns, written in document order and read selectively.

Rows are dealt to files by ranges of ``doc_id``; each file holds ascending ids.
The list column is dictionary-encoded (ids repeat) or, by choice, delta-encoded
in version 2 pages; row groups and pages are small enough that a reader of few
documents or of the metadata alone skips the rest by row-group statistics and
page indexes, which Spark's writer adds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldcast.llm.bytespans import slices
from foldcast.llm.common import scratch, table
from foldcast.llm.tokens import default_path, encoder

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
FILE_BYTES = 128 << 20
WRITTEN = "doc_id long, shard int, start_in_shard long, n_tokens long, ids array<int>"


def layout(encoding: str = "dictionary") -> dict[str, str]:
    """Writer options. ``dictionary`` or ``delta`` for the ids; metadata columns always take what is smaller."""
    options = {
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.page.write-checksum.enabled": "true",
        "compression": "zstd",
    }
    if encoding == "delta":
        return options | {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
    if encoding != "dictionary":
        raise ValueError(f"encoding must be dictionary or delta, not {encoding!r}")
    return options


def file_count(docs: DataFrame, file_bytes: int) -> int:
    """Files of about ``file_bytes`` of text, and at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))


def encode_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of each document, with its place among the rows of its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, at = encoder(path).encode(batch.column(1), end_id)
            starts = start + at[:-1]
            start += int(at[-1])
            n = batch.num_rows
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.full(n, shard, np.int32)),
                    pa.array(starts),
                    pa.array(np.diff(at)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                ],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, WRITTEN)


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write ``docs(doc_id, text)`` as token files under ``out``.

    A null text is an empty document: only its end id. Rows of one ``doc_id``
    stand together in order of their text; rows without one come first. Columns
    other than these two are not read. An empty table gives a folder of no rows.
    """
    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text").repartitionByRange(file_count(docs, file_bytes), "doc_id", tie)
    ordered = dealt.sortWithinPartitions("doc_id", tie, "text")
    encode_rows(ordered, tokenizer or default_path(), end_id).write.options(**layout(encoding)).parquet(out)


def starts(files: DataFrame) -> DataFrame:
    """``(shard, before)``: the ids in all earlier files, summed over one row a file."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, shard, start_in_shard, n_tokens, ids of all files under ``out``.

    A reader that selects only metadata columns never touches the ids.
    """
    return spark.read.schema(WRITTEN).parquet(out)


def with_crc32(files: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned crc32 of their little-endian 32-bit form."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([*batch.columns[:4], pa.array(crc, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"])

    return files.mapInArrow(digest, WRITTEN.replace("ids array<int>", "ids_crc32 long"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out)
    files = read_tokens(spark, out)
    # The ids are reduced to checksums before rows meet their file's start.
    return with_crc32(files).join(starts(files), "shard").select(
        "doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )

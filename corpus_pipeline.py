"""A corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and is written and read again; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldcast.llm import exact_dedup, mixing, near_dedup, packing, quality
from foldcast.llm.common import staged, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8 and more."""
    return near_dedup.drop_near(docs)


#: Tokens of consecutive slots that are packed together.
RUN_TOKENS = 500_000


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixing schedule. Files are read in any order, so ``pack`` finds it again."""
    aside = {c: f"{c} of documents" for c in docs.columns if c in mixing.MADE}
    mixed = mixing.interleave(docs.withColumnsRenamed(aside)).sort("slot", "src_offset", "doc_id")
    return mixed.drop(*mixing.MADE).withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens, numbered along the mixing schedule, which depends on the documents alone."""
    mixed = mixing.interleave(docs.select("doc_id", "source", "text")).sort("slot", "src_offset", "doc_id")
    return packing.digest(packing.pack(mixed, block_tokens=RUN_TOKENS, in_order=True))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near),
    ("mixing sources", mix),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

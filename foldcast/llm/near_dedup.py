"""Near-duplicate groups by b-bit MinHash, with every link confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.bytespans import U64, blocks, is_space, mix, slices, span_hashes, spans, text_bytes
from foldcast.llm.common import one_each, staged, table
from foldcast.llm.components import components

#: Members of a bucket that are compared with each other at once.
CELL = 512
SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, set_key binary, bands array<long>, signature binary"
#: What tells rows apart: 128 bits of id and text. Rows equal in both share it.
ROW = ("k1", "k2")


@dataclass(frozen=True)
class Settings:
    """``words`` a shingle; links at ``percent`` / 100 Jaccard similarity and more.

    The number of bands makes a link of exactly that similarity miss all of
    them with a probability below ``miss``. Of each minimum, ``bits`` low bits are kept
    in the signature. Candidates whose estimate lies more than ``sigmas``
    standard deviations below the threshold are not compared in full.
    """

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6
    bits: int = 2
    sigmas: float = 6.5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Fewest equal signature places of a pair that is compared in full."""
        chance = 0.5**self.bits
        expected = self.percent / 100 * (1 - chance) + chance
        spread = math.sqrt(self.hashes * expected * (1 - expected))
        return max(0, math.floor(self.hashes * expected - self.sigmas * spread))

    def similarity(self, equal: np.ndarray) -> np.ndarray:
        """Jaccard similarity from equal places, corrected for those equal by chance."""
        chance = 0.5**self.bits
        return (equal / self.hashes - chance) / (1 - chance)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted. Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, A-Z in lower case."""
    low = data | (((data - np.uint8(65)) < 26) * np.uint8(32))
    start, end, counts = spans(is_space(data), at)
    h = span_hashes(low, start, end)
    ends = np.cumsum(counts)
    n = len(h)
    rolled = np.zeros(n, U64)
    if n >= words:
        total = np.zeros(n - words + 1, U64)
        for k in range(words):
            total = mix(total * U64(0x9E3779B97F4A7C15) + h[k : n - words + 1 + k])
        rolled[: n - words + 1] = total
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:  # the whole sequence is the one shingle
            total = np.array([b - a], U64)
            for k in range(a, b):
                total = mix(total * U64(0xC2B2AE3D27D4EB4F) + h[k : k + 1])
            yield total
        else:
            yield np.zeros(0, U64)


def sets_of(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    data, at = text_bytes(column)
    for a, b in blocks(at, 1 << 20):
        yield from shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], words)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> U64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * factor + shift).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, s: Settings) -> np.ndarray:
    key = np.arange(1, s.bands + 1, dtype=U64)
    for column in least.reshape(s.bands, s.rows).T:
        key = mix(key * U64(0x9E3779B97F4A7C15) + column.astype(U64))
    return key.view(np.int64)


def packed_bits(least: np.ndarray, s: Settings) -> bytes:
    low = (least[:, None] >> np.arange(s.bits, dtype=np.uint32)) & 1
    return np.packbits(low.T.astype(np.uint8), axis=1).tobytes()  # one plane of bits after another


def equal_places(a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Equal places of signatures (rows of bytes), by counting bits; broadcasts over leading axes."""
    width = a.shape[-1] // s.bits
    differ = a[..., :width] ^ b[..., :width]
    for k in range(1, s.bits):
        differ = differ | (a[..., k * width : (k + 1) * width] ^ b[..., k * width : (k + 1) * width])
    return s.hashes - np.bitwise_count(differ).sum(axis=-1, dtype=np.int32)


def row_key() -> list[Column]:
    row = F.col("doc_id").cast("long"), F.col("text")
    return [F.xxhash64(*row).alias("k1"), F.xxhash64(F.lit(1), *row).alias("k2")]


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Row key, set size, a key for the whole set, band keys and packed low bits of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        factor, shift = permutations(s.hashes)
        for batch in slices(batches):
            n, keys, bands, packed = [], [], [], []
            for x in sets_of(batch.column("text"), s.words):
                n.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                least = minima(x, factor, shift)
                bands.append(band_keys(least, s) if len(x) else np.zeros(0, np.int64))
                packed.append(packed_bits(least, s))
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", *ROW, "n_shingles", "set_key", "bands", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), *row_key(), "text").mapInArrow(run, SIGNED)


def confirmed(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The ``pairs(a, b)`` whose whole sets reach the threshold.

    Each text goes once to every group of pairs it is in: the pairs of one ``a``,
    in parts of at most about ``CELL``.
    """
    sizes = staged(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts")), "near-parts")
    parts = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    roles = parts.select("a", "part", F.col("b").alias("id")).unionByName(parts.select("a", "part", F.col("a").alias("id")).distinct())
    named = roles.select(F.col("a").alias("center"), "part", F.col("id").alias("member"))
    grouped = named.join(texts, named.member == texts.id).select("center", "part", "member", "text")

    def check(group: pa.Table) -> pa.Table:
        center, members = group.column("center")[0].as_py(), group.column("member").to_pylist()
        mine = next(sets_of(group.column("text").combine_chunks().slice(members.index(center), 1), s.words))
        linked = []
        for batch in slices(iter(group.select(["member", "text"]).to_batches()), 64):
            for member, other in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), s.words)):
                if member != center:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= s.percent * (len(mine) + len(other) - both):
                        linked.append(member)
        return pa.table([pa.array([center] * len(linked), pa.int64()), pa.array(linked, pa.int64())], names=["a", "b"])

    return grouped.groupBy("center", "part").applyInArrow(check, "a long, b long")


class Union:
    """Sets of numbers, joined pair by pair."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, v: int) -> int:
        above = self.above
        while above.setdefault(v, v) != v:
            above[v] = v = above[above[v]]
        return v

    def join(self, a: int, b: int) -> bool:
        """False if they were together already."""
        a, b = self.root(a), self.root(b)
        self.above[a] = b
        return a != b


def _near_pairs(group: pa.Table, s: Settings, band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and equal signature places of pairs of a group's two cells with different labels, near enough by bit counts.

    With ``band``, only those with no band in common before it.
    """
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    cell, ids, labels = (group.column(c).to_numpy() for c in ("cell", "id", "label"))
    bits = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
    if band is not None:
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), s.bands)
    left, right = np.flatnonzero(cell == x), np.flatnonzero(cell == y)
    found = []
    for k in left:
        equal = equal_places(bits[right], bits[k], s)
        may = (labels[right] != labels[k]) & (equal >= s.least_equal)
        if x == y:
            may &= ids[right] > ids[k]
        near, equal = right[may], equal[may]
        if band is not None:
            here = bands[k][(bands[near] == bands[k]).argmax(axis=1)] == band
            near, equal = near[here], equal[here]
        found.append(np.stack([np.full(len(near), k), near, equal]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3


def _edges(made: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*made) if made else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_cells(members: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """``members(by, id, ..., cells)`` dealt to ``cells`` cells by a hash, each two cells of one ``by`` as a pair ``(x, y)``."""
    dealt = members.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    return met.select(by, F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), "cell", *columns)


def linked_across(members: DataFrame, signs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """``(a, b)``: links between members of a bucket that have different labels.

    ``members(band, id, label)``, ``signs(id, signature, bands)``. A bucket's members are dealt
    to cells by a hash; each two cells of a bucket meet in one group of bounded
    size, which looks at signatures alone. Members with near signatures make clusters;
    only their texts are moved, once for each two cells of a cluster, and whole sets
    are compared, likeliest pairs first. A pair that a group's earlier links connect already
    is not needed, so groups return fewer links than they have members, however many
    pairs they look at.
    """
    sizes = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
    ).where("low < high").select("band", F.ceil(F.col("n") / CELL).alias("cells"))
    open_members = staged(members.join(staged(sizes, "near-open"), "band").join(signs, "id"), "near-open-members")
    met = _in_cells(open_members, "band", ["id", "label", "signature", "bands"])

    def near(group: pa.Table) -> pa.Table:
        a, b, _ = _near_pairs(group, s, group.column("band")[0].as_py())
        ids, union = group.column("id").to_pylist(), Union()
        return _edges([(ids[i], ids[j]) for i, j in zip(a.tolist(), b.tolist()) if union.join(i, j)])

    edges = met.groupBy("band", "x", "y").applyInArrow(near, "a long, b long")
    clusters = staged(components(edges, "near-clusters").withColumnRenamed("label", "cluster"), "near-clustered")
    cells = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    own = members.select("id", "label").distinct().join(signs.select("id", "signature"), "id")
    whole = clusters.join(own, "id").join(cells, "cluster").join(texts, "id")

    def links(group: pa.Table) -> pa.Table:
        a, b, equal = _near_pairs(group, s)
        ids, labels, union = group.column("id").to_pylist(), group.column("label").to_pylist(), Union()
        sets = [x for part in slices(iter(group.select(["text"]).to_batches()), 64) for x in sets_of(part.column(0), s.words)]
        made = []
        for k in np.argsort(-equal, kind="stable"):
            i, j = int(a[k]), int(b[k])
            if union.root(labels[i]) != union.root(labels[j]):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= s.percent * (len(sets[i]) + len(sets[j]) - both):
                    union.join(labels[i], labels[j])
                    made.append((ids[i], ids[j]))
        return _edges(made)

    grouped = _in_cells(whole, "cluster", ["id", "label", "signature", "text"])
    return grouped.groupBy("cluster", "x", "y").applyInArrow(links, "a long, b long")


def grouped_rows(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id``, ``k1``, ``k2``, ``n_shingles``, ``grouped``, ``component_id``, ``first`` for each row of ``docs(doc_id, text)``.

    ``grouped`` says whether the set is not empty; ``component_id`` is the smallest id of the rows reachable
    over links and ``first`` the row key of one of those that have it.

    First one row stands for all of equal sets, under a number of its own, whatever its id. Rows that share a band are
    candidates: each is compared with the center of its buckets that shares most of
    them with others, one comparison a row, and links join components. Only in buckets that
    still hold several components, pairs across them are looked at: by bit
    counts in bounded cells, then, if near enough, in full. Every link between different
    components is so found, and none inside a component is needed.
    """
    signed = staged(signatures(docs, s), "near-signed")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *ROW)
    sets = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min(row).alias("row"))
    keys = staged(sets.select("set_key", "row.*").withColumn("id", F.monotonically_increasing_id()), "near-sets")
    chosen = staged(
        signed.drop("doc_id").join(keys.select("set_key", *ROW, "id"), ["set_key", *ROW]).select("id", "signature", "bands").dropDuplicates(["id"]),
        "near-chosen",
    )
    signs = chosen.select("id", "signature", "bands")
    banded = chosen.select("id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = staged(banded.join(staged(sizes, "near-sizes"), "band"), "near-members")
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    met = staged(keys.join(weights, "id", "left_semi").select(*ROW, "id"), "near-met")
    # what meets grows with the documents, so it is never broadcast and the plan is the same at every size
    texts = staged(docs.select(*row_key(), "text").join(met.hint("merge"), list(ROW)).dropDuplicates(list(ROW)).select("id", "text"), "near-texts")
    # a bucket's center shares buckets with most others; a member takes the best center of its buckets
    weighed = members.select("band", "id").join(weights, "id")
    best = F.struct("weight", (-F.col("id")).alias("minus"))
    centers = staged(weighed.groupBy("band").agg(F.max(best).alias("best")), "near-centers")
    taken = members.select("band", "id").join(centers, "band").groupBy("id").agg(F.max("best").alias("best"))
    stars = taken.select((-F.col("best.minus")).alias("a"), F.col("id").alias("b")).where("a != b")
    links = staged(confirmed(staged(stars, "near-stars"), texts, s), "near-links")
    first = components(links, "near-first")
    labelled = members.drop("n").join(first, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = staged(linked_across(staged(labelled, "near-labelled"), signs, texts, s), "near-more")
    found = staged(components(links.unionByName(more), "near-final"), "near-labels")

    # only linked sets meet others' ids; a set without links has its own
    own = F.struct("nameless", "doc_id", *ROW)
    linked = keys.join(found, "id").select("id", "label", own.alias("row"))
    firsts = staged(linked.groupBy("label").agg(F.min("row").alias("first")), "near-firsts")
    moved = linked.join(firsts, "label").select("id", "first")
    labels = keys.join(moved, "id", "left").select("set_key", F.coalesce("first", own).alias("first"))
    joined = signed.join(staged(labels, "near-components"), "set_key", "left")
    grouped = F.col("n_shingles") > 0
    component = F.when(grouped, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", *ROW, "n_shingles", grouped.alias("grouped"), component.alias("component_id"), F.struct(*[f"first.{k}" for k in ROW]).alias("first"))


def near_groups(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs(doc_id, text)``.

    Rows whose sets reach the threshold are linked; ``component_id`` is the
    smallest ``doc_id`` reachable over links, itself included, and ``kept`` says whether
    it is the row's own. A text with fewer words than a shingle has all of them as its one
    shingle; without words it has an empty set and no links. Rows with equal sets
    are linked without being compared. Rows are told apart by id and text: different texts
    under one id are rows of their own, and rows without id link others like any row, but give no ``component_id`` unless
    no row they reach has an id. No other column is read.
    """
    rows = grouped_rows(docs, s)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    That is a row of the smallest id, any of those equal in id and text. Rows without words all stay.
    """
    rows = grouped_rows(docs, s).where("grouped")
    mine = F.struct(*ROW)
    dropped = staged(rows.where(mine != F.col("first")).select(*ROW).distinct(), "near-dropped")
    keyed = docs.select("*", *[k.alias(f"near {n}") for k, n in zip(row_key(), ROW)])
    named = [F.col(k).alias(f"near {k}") for k in ROW]
    left = keyed.join(dropped.select(*named), [f"near {k}" for k in ROW], "left_anti")
    again = rows.where(mine == F.col("first")).groupBy(*ROW).count().where("count > 1").select(*named)
    return one_each(left, staged(again, "near-repeated"), [f"near {k}" for k in ROW]).select(docs.columns)


CONTRACT = Settings(words=3, percent=85)


def op9_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), CONTRACT)

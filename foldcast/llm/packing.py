"""Packing documents into windows: best fit, longest first, with a segment tree over remaining capacity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.bytespans import slices
from foldcast.llm.common import table
from foldcast.llm.tokens import default_path, encoder

WINDOW = 2048
#: Tokens that one task packs together; its memory, and the only bound on how far a window's documents lie apart.
BLOCK_TOKENS = 4_000_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Segment tree indexed by remaining capacity: a node counts the open windows in its range."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.waiting: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.waiting[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window that takes ``length``."""
        k = length + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.waiting[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of indices into ``lengths``, each at most ``window`` long."""
    open_windows, windows = OpenWindows(window), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        found = open_windows.take(length)
        if found is None:
            found = window, len(windows)
            windows.append([])
        room, at = found
        windows[at].append(k)
        if room > length:
            open_windows.put(room - length, at)
    return windows


def plan(lengths: np.ndarray, window: int, close_gaps: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document, start, length).

    Overlong documents give full windows first; what is left of them and all
    shorter ones is packed by ``best_fit``. With ``close_gaps`` the emptiest
    windows are then cut up to fill the others, and the one that remains is cut
    at powers of two, which need no padding.
    """
    full = [[(d, s, window)] for d in np.flatnonzero(lengths >= window).tolist() for s in range(0, int(lengths[d]) - window + 1, window)]
    docs = np.flatnonzero(lengths % window)
    tails = lengths[docs] % window
    packed = [
        [(int(docs[k]), int(lengths[docs[k]] - tails[k]), int(tails[k])) for k in items] for items in best_fit(tails, window)
    ]
    if not close_gaps:
        return full + packed
    filled = sorted(packed, key=lambda w: -sum(p[2] for p in w))
    pieces = []  # of the emptiest window, cut from its end
    for k, target in enumerate(filled):
        room = window - sum(p[2] for p in target)
        while room:
            if not pieces:
                if len(filled) - 1 <= k:
                    break
                pieces = filled.pop()
            d, s, n = pieces.pop()
            cut = min(n, room)
            target.append((d, s + n - cut, cut))
            room -= cut
            if cut < n:
                pieces.append((d, s, n - cut))
    rest = pieces
    if not rest and filled and sum(p[2] for p in filled[-1]) < window:
        rest = filled.pop()
    return full + filled + powers_of_two(rest)


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in windows whose lengths are powers of two, longest first."""
    left, total, windows = list(reversed(pieces)), sum(p[2] for p in pieces), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        windows.append([])
        while room:
            d, s, n = left.pop()
            cut = min(n, room)
            windows[-1].append((d, s, cut))
            room -= cut
            if cut < n:
                left.append((d, s + cut, n - cut))
    return windows


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    block_tokens: int = BLOCK_TOKENS,
    close_gaps: bool = True,
    in_order: bool = False,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in windows of at most ``window`` tokens.

    Columns: ``doc_id``, ``start`` (its ids before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.
    A null text is an empty document of one id, ``end_id``; repeated rows and null
    ids are packed like any other; further columns are not read. Tasks pack runs of
    about ``block_tokens`` of their own rows, so nothing is shuffled, no group grows
    with the data, and a lost task repeats the same rows. The numbers of sequences
    are the task's number and the window's number in it.
    """
    path = tokenizer or default_path()

    def pieces_of(ids_of: list, held: list, first: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate(held).astype("<u4")
        lengths = np.fromiter((n for _, n in ids_of), np.int64, len(ids_of))
        at = np.cumsum(lengths) - lengths
        windows = plan(lengths, window, close_gaps)
        if in_order:
            windows.sort(key=lambda w: sum(d * n for d, _, n in w) / sum(n for *_, n in w))
        rows = [(d, s, n, first + k) for k, w in enumerate(windows) for d, s, n in w]
        d, s, n, seq = np.array(rows, np.int64).reshape(-1, 4).T
        ends = np.cumsum(n)
        opens = np.flatnonzero(np.diff(seq, prepend=-1))
        offset = (ends - n) - np.repeat((ends - n)[opens], np.diff(np.append(opens, len(seq))))
        names = [x for x, _ in ids_of]
        blobs = [ids[a:b].tobytes() for a, b in zip(at[d] + s, at[d] + s + n)]
        batch = pa.record_batch(
            [
                pa.array([names[k] for k in d], pa.int64()), pa.array(s), pa.array(n), pa.array(blobs, pa.binary()),
                pa.array(lengths[d]), pa.array(seq), pa.array(offset),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        return batch, first + len(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        docs_held, held, total = [], [], 0
        for batch in slices(batches):
            ids, at = encoder(path).encode(batch.column(1), end_id)
            docs_held += zip(batch.column(0).to_pylist(), np.diff(at).tolist())
            held.append(ids)
            total += len(ids)
            if total >= block_tokens:
                out, first = pieces_of(docs_held, held, first)
                yield out
                docs_held, held, total = [], [], 0
        if docs_held:
            yield pieces_of(docs_held, held, first)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum for their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))

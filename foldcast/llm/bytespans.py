"""Words of a batch of texts as spans of its byte buffer, and hashes of spans, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and offsets; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in runs of few rows, so that what is made from them stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def blocks(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def is_space(data: np.ndarray) -> np.ndarray:
    """``[\\x20\\x09-\\x0D]``."""
    return (data == 32) | ((data - np.uint8(9)) < 5)


def spans(space: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs that are not space, none across texts, and how many each text has."""
    n = len(space)
    if not n:
        return (z := np.zeros(0, np.int64)), z, np.zeros(len(at) - 1, np.int64)
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = at[(at > 0) & (at < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.diff(np.searchsorted(start, at))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[0] = tuple(made)
    return _powers[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it lies."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))

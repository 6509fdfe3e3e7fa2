"""Token ids of whole texts by a public tokenizer, word by word.

The tokenizer drops white space and never merges across it, so a text's ids are
its words' ids in a row. Each distinct word is encoded by the library once while
the worker remembers it. Texts for which that is not sure to hold (characters
outside Latin-1, special tokens, separators that only one of the two sides
takes for white space) go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from foldcast.llm.bytespans import blocks, is_space, span_hashes, spans, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered by a worker; beyond that it starts anew. Memory only, never the result.
REMEMBERED = 400_000
#: Bytes encoded together.
AT_ONCE = 1 << 20
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ragged:
    """Lists of ids, appended in batches; list k is ``flat[start[k] : start[k] + size[k]]``."""

    def __init__(self) -> None:
        self.flat, self.start, self.size = (np.zeros(1024, t) for t in (np.int32, np.int64, np.int32))
        self.used = self.count = 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, need in (("flat", self.used + len(flat)), ("start", self.count + len(sizes)), ("size", self.count + len(sizes))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, len(have)), have.dtype)]))
        end = self.count + len(sizes)
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.count : end] = sizes
        self.start[self.count : end] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.count = end

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the lists ``index`` in a row, and each list's size."""
        sizes = self.size[index].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[index] - (ends - sizes), sizes) + np.arange(total)], sizes


class WordEncoder:
    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # The same vocabulary for pieces that are already normal and split.
        self.piecewise = Tokenizer.from_file(path)
        self.piecewise.normalizer = normalizers.Sequence([])
        self.piecewise.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.split = regex.compile(PRETOKENS).findall
        vocab = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.piece_at: dict[str, int] = {}
        self.words, self.pieces = Ragged(), Ragged()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """A piece's last id ends a word, and no other id of it does."""
        lines = [" ".join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)]
        got = self.piecewise.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, np.int32) for x in got])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(pieces):
            raise ValueError("the tokenizer does not mark word ends")
        self.piece_at.update(zip(pieces, range(self.pieces.count, self.pieces.count + len(pieces))))
        self.pieces.extend(ids, np.diff(ends, prepend=-1))

    def _learn_words(self, words: list[str]) -> None:
        parts = [[w] if w.isalpha() else self.split(w) for w in words]
        flat_parts = list(chain.from_iterable(parts))
        if new := set(flat_parts).difference(self.piece_at):
            self._learn_pieces(list(new))
        index = np.fromiter(map(self.piece_at.__getitem__, flat_parts), np.int64, len(flat_parts))
        flat, sizes = self.pieces.take(index)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        self.words.extend(flat, np.diff(bounds, prepend=0))

    def _by_word(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in Latin-1 characters, and each text's number of ids."""
        low = data | (((data - np.uint8(65)) < 26) * np.uint8(32))  # A-Z
        second = np.zeros(len(data), bool)
        second[1:] = data[:-1] == 0xC3
        low += (second & ((data - np.uint8(0x80)) < 0x1F) & (data != 0x97)) * np.uint8(32)  # the same beyond ASCII
        space = is_space(data)
        wide = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))
        space[wide] = space[wide + 1] = True
        start, end, per_text = spans(space, at)
        if not len(start):
            return np.zeros(0, np.int32), per_text
        hashes, first, which = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != hashes[inside]
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self.forget()
                place, new = np.zeros(len(hashes), np.int64), np.ones(len(hashes), bool)
            raw = low.tobytes()
            spans_ = zip(start[first[new]].tolist(), end[first[new]].tolist())
            count = self.words.count
            self._learn_words([raw[s:e].decode() for s, e in spans_])
            self.known = np.insert(self.known, place[new], hashes[new])
            self.known_at = np.insert(self.known_at, place[new], np.arange(count, self.words.count))
            place = np.searchsorted(self.known, hashes)
        flat, sizes = self.words.take(self.known_at[place][which])
        return flat, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(per_text)], prepend=0)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by ``end_id``, and offsets: text k is ``ids[at[k] : at[k + 1]]``."""
        data, at = text_bytes(texts)
        end, pieces = np.array([end_id], np.int32), []
        odd = (data >= 0xC4) | ((data - np.uint8(0x1C)) < 4)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        odd = np.diff(np.searchsorted(np.flatnonzero(odd), at)) > 0
        for low, high in blocks(at, AT_ONCE):
            runs = np.flatnonzero(np.diff(odd[low:high], prepend=~odd[low])) + low
            for a, b in zip(runs, [*runs[1:], high]):
                part = data[at[a] : at[b]]
                if odd[a]:
                    for k in range(a, b):
                        ids = self.whole.encode(data[at[k] : at[k + 1]].tobytes().decode(), add_special_tokens=False).ids
                        pieces.append(np.asarray([*ids, end_id], np.int32))
                else:
                    flat, sizes = self._by_word(part, at[a : b + 1] - at[a])
                    pieces.extend(np.append(x, end) for x in np.split(flat, np.cumsum(sizes)[:-1]))
        lengths = [len(x) for x in pieces]
        return np.concatenate(pieces) if pieces else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker and file, kept over tasks."""
    return WordEncoder(path)

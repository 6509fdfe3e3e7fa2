"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is a row of symbols, at first its characters. An agenda holds the
adjacent pairs that are pieces of the vocabulary; the pair of the highest score,
the leftmost of equal ones, is merged until none is left. Symbols that are no pieces become
bytes. Where no piece spans two neighbouring characters nothing can merge
across them, so a text falls into words whose ids a worker remembers.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.common import table, text_or_empty

SPACE = "▁"
#: Words remembered by a worker, and the longest of them. Memory only, never the result.
REMEMBERED, SHORT = 600_000, 64
#: Characters encoded, checked and sent on together.
AT_ONCE = 1 << 20


def as_bytes(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    whole = array("I", ids)
    if sys.byteorder == "big":
        whole.byteswap()
    return whole.tobytes()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """The vocabulary of a model whose normalizer leaves texts as they are but for spaces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.library = SentencePieceProcessor(model_file=path)
        model = ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, normal = ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type vocabulary with bytes")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("the model changes texts before it encodes them")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has pieces that are not merged by score")
        self.ids, self.scores, self.bytes = {}, {}, {}
        for k, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.scores[p.piece] = k, -p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = k
        self.joined = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        alphabet = sorted({c for pair in self.joined for c in pair})
        self.width = len(alphabet) + 1
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        self.meet = np.zeros(self.width * self.width, bool)
        left, right = (self.place[[ord(pair[k]) for pair in self.joined]] for k in (0, 1))
        self.meet[left * self.width + right] = True
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The text cut wherever no piece spans two neighbours."""
        text = SPACE + text.replace(" ", SPACE)
        at = self.place[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.meet[at[:-1] * self.width + at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def merged_short(self, word: str) -> list[str]:
        """``merged`` with the agenda as a list, which is quicker for few symbols."""
        symbols, score, none = list(word), self.scores.get, float("inf")
        agenda = [score(word[k : k + 2], none) for k in range(len(word) - 1)]
        while agenda and (best := min(agenda)) < none:
            k = agenda.index(best)  # the leftmost
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k:
                agenda[k - 1] = score(symbols[k - 1] + symbols[k], none)
            if k < len(agenda):
                agenda[k] = score(symbols[k] + symbols[k + 1], none)
        return symbols

    def merged(self, word: str) -> list[str]:
        """The symbols left when the agenda is empty."""
        symbols: list[str] = list(word)
        before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        scores = self.scores
        agenda = [(scores[pair], k, pair) for k in range(len(word) - 1) if (pair := word[k : k + 2]) in scores]
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            # a merge has changed one of the two since
            if not symbols[left] or right < 0 or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                if (wider := pair + symbols[after[left]]) in scores:
                    heappush(agenda, (scores[wider], left, wider))
            if before[left] >= 0 and (wider := symbols[before[left]] + pair) in scores:
                heappush(agenda, (scores[wider], before[left], wider))
        return [s for s in symbols if s]

    def _of_symbols(self, symbols: list[str]) -> bytes:
        ids, of_byte = self.ids, self.bytes
        return as_bytes(chain.from_iterable((ids[s],) if s in ids else map(of_byte.__getitem__, s.encode()) for s in symbols))

    def _of_word(self, word: str) -> bytes:
        if len(word) > SHORT:
            return self._of_symbols(self.merged(word))
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = self._of_symbols(self.merged_short(word))
        return found

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        words = self.words(text) if text else []
        parts = list(map(self.known.get, words))
        if None in parts:
            parts = [part or self._of_word(w) for part, w in zip(parts, words)]
        return as_bytes([self.begin]) + b"".join(parts) + as_bytes([self.end])

    def check(self, texts: list[str], ids: list[bytes]) -> list[list[int]]:
        """The library's ids of the texts; raise where it encodes one otherwise."""
        wanted = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        for text, want, got in zip(texts, wanted, ids, strict=True):
            if as_bytes(want) != got:
                raise ValueError(f"the library encodes a text of {len(text)} characters otherwise: {text[:80]!r}")
        return wanted


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One per worker and file, kept over tasks."""
    return PieceEncoder(path)


def _runs(texts: list[str], most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of texts of about so many characters."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(first, k)
            first, size = k, 0
        size += len(t)
    yield slice(first, len(texts))


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), decode: bool = False, check: bool = True) -> DataFrame:
    """``ids`` of each row's whole ``text``, begin and end included, as little-endian unsigned 32-bit integers.

    ``decode`` adds ``decoded``, the text that the ids stand for. ``check`` has the library
    encode each batch too and fails the job where the ids differ. A null text is
    empty: begin and end alone. Columns ``keep`` are passed on, all others ignored;
    repeated rows are encoded as often as they are there, no rows give no result.
    """
    path = path or default_path()
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids binary", *(["decoded string"] if decode else [])])

    def run(batches) -> Iterator[pa.RecordBatch]:
        of = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            for start in range(0, len(texts), 1000):  # strings of few rows at a time
                part = texts.slice(start, 1000).to_pylist()
                for run in _runs(part):
                    some = part[run]
                    ids = [of.encode(t) for t in some]
                    # decoded are the ids returned, as numbers: checked ones are there as such
                    numbers = of.check(some, ids) if check else (np.frombuffer(i, "<u4").tolist() for i in ids)
                    columns = [batch.column(k).slice(at, len(some)) for k in range(len(kept))]
                    columns.append(pa.array(ids, pa.binary()))
                    if decode:
                        columns.append(pa.array([of.library.decode(i) for i in numbers], pa.string()))
                    at += len(some)
                    yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *(["decoded"] if decode else [])])

    return docs.select(*keep, text_or_empty().alias("_text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decoded`` of each row's ``ids`` as ``encode`` gives them; null ids are an empty text."""
    path = path or default_path()
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "decoded string"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            texts = pa.array((library.decode(np.frombuffer(i.as_py() or b"", "<u4").tolist()) for i in ids), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*keep, "decoded"])

    return rows.select(*keep, "ids").mapInArrow(run, schema)


def op13_agenda_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), decode=True)
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

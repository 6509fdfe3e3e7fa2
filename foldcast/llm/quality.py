"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldcast.llm.bytespans import U64, blocks, is_space, mix, slices, span_hashes, spans, text_bytes
from foldcast.llm.common import staged, table

#: Labelled rows that models are fitted on; of more, those with the smallest hash.
MAX_LABELLED = 20_000
ROUNDS = 4
#: Steps on the labels of a round; each starts from the last.
STEPS = 3
#: No row's loss bends more: steps that take this for all rows never raise the loss, however sure a model is.
MOST_BENT = 0.25
CONFIDENT = 0.95
THRESHOLD = 0.5
SOURCES, LANGUAGES, LENGTHS = 64, 8, 24
META_WIDTH = SOURCES + LANGUAGES + LENGTHS
#: Places that words are hashed to.
WORDS = 64
TEXT_WIDTH = 18 + WORDS
TEXT_PENALTY = np.repeat([1.0, 10.0], [18, WORDS])
META_PENALTY = np.full(META_WIDTH, 10.0)
FEATURES = "doc_id long, text_view array<float>, source_at int, lang_at int, length_at int"
LOWER, UPPER, DIGIT, SPACE, LINE, MARK, SIGN, OTHER = range(8)


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, SIGN, np.uint8)
    kinds[0x80:] = OTHER
    for low, high, kind in ((97, 123, LOWER), (65, 91, UPPER), (48, 58, DIGIT)):
        kinds[low:high] = kind
    kinds[[32, 9]] = SPACE
    kinds[[10, 11, 12, 13]] = LINE
    kinds[[ord(c) for c in ".,;:'\"-()?"]] = MARK
    return kinds


KINDS = byte_kinds()


def text_view(column: pa.Array) -> np.ndarray:
    """Shares of kinds of bytes, how words and lines repeat, and the share of each hashed word, of each whole text."""
    data, at = text_bytes(column)
    out = [_text_view(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in blocks(at, 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, TEXT_WIDTH), np.float32)


def _repeats(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spans and spans like the one before, for each text."""
    distinct = np.bincount(doc[np.unique(mix(hashes ^ mix(doc.astype(U64))), return_index=True)[1]], minlength=n)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    return distinct, again


def _text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, size = len(at) - 1, np.diff(at)
    kinds = np.bincount(np.repeat(np.arange(n) * 8, size) + KINDS[data], minlength=8 * n).reshape(n, 8)
    start, end, words = spans(is_space(data), at)
    doc = np.repeat(np.arange(n), words)
    hashes = span_hashes(data, start, end)
    distinct, again = _repeats(hashes, doc, n)
    at_word = doc * WORDS + (mix(hashes) % U64(WORDS)).astype(np.int64)
    said = np.bincount(at_word, minlength=n * WORDS).reshape(n, WORDS)
    a, b, lines = spans(data == 10, at)
    line_doc = np.repeat(np.arange(n), lines)
    lines_distinct, lines_again = _repeats(span_hashes(data, a, b), line_doc, n)
    long = np.bincount(doc, np.minimum(end - start, 40), n)
    one, w, k = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    columns = [
        *(kinds / one[:, None]).T, long / w, distinct / w, again / w, np.log1p(words), (words < 20) * 1.0, lines / w,
        lines_distinct / k, lines_again / k, kinds[:, UPPER] / np.maximum(kinds[:, UPPER] + kinds[:, LOWER], 1), (size == 0) * 1.0,
        *(said / w[:, None]).T,
    ]
    return np.stack(columns, 1).astype(np.float32)


USED = ("doc_id", "text", "source", "lang", "n_chars")
PLACES = ("source_at", "lang_at", "length_at")


def with_places(docs: DataFrame) -> DataFrame:
    """``docs`` and, last, where a row's source, language and length stand among the metadata features."""
    length = F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    source, lang = (F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("source", "lang"))
    return docs.select(
        "*",
        F.pmod(source, F.lit(SOURCES)).cast("int").alias(PLACES[0]),
        (F.pmod(lang, F.lit(LANGUAGES)) + SOURCES).cast("int").alias(PLACES[1]),
        (F.least(F.floor(F.log2(length + 1)), F.lit(LENGTHS - 1)) + SOURCES + LANGUAGES).cast("int").alias(PLACES[2]),
    )


def views(docs: DataFrame) -> DataFrame:
    """Both views of each row: text features, and the places of source, language and length among the metadata features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = pa.array(text_view(batch.column(1)).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TEXT_WIDTH), flat)
            yield pa.record_batch([batch.column(0), lists, *batch.columns[2:]], names=["doc_id", "text_view", *PLACES])

    return with_places(docs.select(*USED)).select(
        F.col("doc_id").cast("long"), "text", *PLACES
    ).mapInArrow(run, FEATURES)


def one_hot(places: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(places[0]), META_WIDTH))
    for p in places:
        out[np.arange(len(p)), p] = 1.0
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised columns with a penalty, by Newton steps."""

    penalty: np.ndarray = field(default_factory=lambda: np.ones(1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    spread: np.ndarray = field(default_factory=lambda: np.ones(1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.spread, np.ones(len(x))]

    def sums(self, x: np.ndarray, y: np.ndarray | float, least_bent: float = MOST_BENT) -> np.ndarray:
        """Rows, gradient and second derivatives of the loss, which add up over rows."""
        z = self.standard(x)
        p = sigmoid(np.clip(z @ self.weights, -30, 30))
        bent = np.maximum(p * (1 - p) + 1e-9, least_bent)
        return np.r_[len(x), z.T @ (p - y), ((z * bent[:, None]).T @ z).ravel()]

    def step(self, sums: np.ndarray) -> Logistic:
        """The model after a Newton step."""
        n = len(self.weights)
        ridge = np.r_[self.penalty, 1e-3]
        down = np.linalg.solve(sums[1 + n :].reshape(n, n) + np.diag(ridge), sums[1 : 1 + n] + ridge * self.weights)
        return Logistic(self.penalty, self.mean, self.spread, self.weights - down)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.spread = x.mean(0), x.std(0)
        self.spread[self.spread < 1e-9] = 1.0
        self.weights = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            before, self.weights = self.weights, self.step(self.sums(x, y, 0.0)).weights
            if np.abs(self.weights - before).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class CoTrained:
    """Both views' models and their calibration. Without labels of both classes it keeps all that it sees."""

    text: Logistic | None = None
    meta: Logistic | None = None
    text_scale: Logistic | None = None
    meta_scale: Logistic | None = None
    prior: float = 0.0
    rounds: list[dict] = field(default_factory=list)

    def raw(self, text: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if self.text is None:
            return np.zeros(len(text)), np.zeros(len(text))
        return self.text.logit(text), self.meta.logit(one_hot(meta))

    def scores(self, text: np.ndarray, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        a, b = self.raw(text, meta)
        if self.text_scale is None:
            return sigmoid(a), sigmoid(b), np.ones(len(text))
        a, b = self.text_scale.logit(a[:, None]), self.meta_scale.logit(b[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(np.clip(a + b - self.prior, -30, 30))


def _columns(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    flat = t.column("text_view").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, TEXT_WIDTH).astype(float), [t.column(c).to_numpy() for c in PLACES]


def scored(features: DataFrame, model: CoTrained) -> DataFrame:
    """``features`` with ``p_text``, ``p_meta``, ``score`` and the raw ``z_text``, ``z_meta``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(pa.Table.from_batches([batch]))
            found = [*model.scores(*x), *model.raw(*x)]
            yield pa.record_batch([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "p_text", "p_meta", "score", "z_text", "z_meta"])

    schema = ", ".join(f"{n} {t}" for n, t in features.dtypes)
    return features.mapInArrow(run, f"{schema}, p_text double, p_meta double, score double, z_text double, z_meta double")


def taught(unknown: DataFrame, teacher: CoTrained, model: CoTrained) -> dict[tuple[int, int], np.ndarray]:
    """The sums for a Newton step of each view of ``model``, 0 for text and 1 for metadata, and label, over all rows that ``teacher``'s other view is sure of.

    Each task adds up its rows; what comes back has the size of the models.
    """
    sure_from = float(np.log(CONFIDENT / (1 - CONFIDENT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            text, meta = _columns(pa.Table.from_batches([batch]))
            by_text, by_meta = teacher.raw(text, meta)
            for view, (z, x, m) in enumerate(((by_meta, text, model.text), (by_text, one_hot(meta), model.meta))):
                for label, sure in enumerate((z <= -sure_from, z >= sure_from)):
                    if sure.any():
                        total[view, label] = total.get((view, label), 0.0) + m.sums(x[sure], float(label))
        for (view, label), sums in total.items():
            n = len(sums)
            columns = [np.full(n, view, np.int32), np.full(n, label, np.int32), np.arange(n, dtype=np.int32), sums]
            yield pa.record_batch([pa.array(c) for c in columns], names=["view", "label", "place", "value"])

    parts = unknown.select("text_view", *PLACES).mapInArrow(run, "view int, label int, place int, value double")
    got = parts.groupBy("view", "label", "place").agg(F.sum("value").alias("value")).toArrow()
    view, label, place, value = (got.column(c).to_numpy() for c in ("view", "label", "place", "value"))
    out = {}
    for v in (0, 1):
        for c in (0, 1):
            at = np.flatnonzero((view == v) & (label == c))
            if len(at):
                out[v, c] = value[at[np.argsort(place[at])]]
    return out


def co_train(features: DataFrame, labels: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, most: int = MAX_LABELLED) -> CoTrained:
    """Fit both views on labelled rows, then let each label rows for the other.

    ``features`` is a written table of ``views``; ``labels(doc_id, quality)``
    gives 0 or 1, several labels of a document count as their rounded mean. At most ``most``
    labelled rows take part, a quarter of them only to calibrate. In each round both views
    score all unlabelled rows, and all of which a view is surer than ``CONFIDENT``
    join the other's training rows. Those of a class weigh alike and together,
    round by round, a growing share of what the labelled rows of that class weigh, the same at the end;
    none weighs more than a labelled row. So their number is not bounded and ties
    need no order. The driver holds the labelled rows' features and sums of the size of the models.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(
        F.round(F.avg("quality")).cast("int").alias("label")
    )
    known = staged(features.join(marks, "doc_id", "left"), "quality-labelled")
    order = F.xxhash64("doc_id", F.lit(17))
    taken = known.where("label IS NOT NULL").withColumn("order", order).orderBy("order", "doc_id", "text_view").limit(most).toArrow()
    y = taken.column("label").to_numpy().astype(float)
    held = taken.column("order").to_numpy() % 4 == 0
    if not all(0 < part.sum() < len(part) for part in (y[held], y[~held])):
        return CoTrained()
    text, meta = _columns(taken)
    hot = one_hot(meta)
    mean = y[~held].mean()
    model = CoTrained(Logistic(TEXT_PENALTY).fit(text[~held], y[~held]), Logistic(META_PENALTY).fit(hot[~held], y[~held]), prior=float(np.log(mean / (1 - mean))))
    unknown = known.where("label IS NULL").drop("label")
    own = ((text[~held], y[~held]), (hot[~held], y[~held]))
    for r in range(1, rounds + 1):
        teacher, counts = CoTrained(model.text, model.meta), [0, 0]
        for _ in range(steps):
            got, moved = taught(unknown, teacher, model), []
            for view, m in enumerate((model.text, model.meta)):
                sums = m.sums(*own[view])
                for label in (0, 1):
                    if (view, label) in got:
                        share = r / rounds * (own[view][1] == label).sum() / got[view, label][0]
                        sums = sums + min(1.0, share) * got[view, label]
                counts[view] = int(sum(got[view, c][0] for c in (0, 1) if (view, c) in got))
                moved.append(m.step(sums))
            model.text, model.meta = moved
        model.rounds.append({"from_text": counts[1], "from_meta": counts[0]})
    a, b = model.raw(text[held], [m[held] for m in meta])
    model.text_scale = Logistic(np.array([1e-3])).fit(a[:, None], y[held])
    model.meta_scale = Logistic(np.array([1e-3])).fit(b[:, None], y[held])
    rate = y[held].mean()
    model.prior = float(np.log(rate / (1 - rate)))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``p_text``, ``p_meta``, ``score``, ``accepted`` of each row of ``docs(doc_id, text, lang, source, n_chars)``.

    Null texts are empty, null metadata are a value of their own, equal rows get
    equal scores, a row without id is scored but never labelled, and further
    columns are not read. Without labels of both classes every row is accepted with score 1.
    """
    features = staged(views(docs), "quality-views")
    found = scored(features, co_train(features, labels))
    return found.select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= threshold).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns; rows are scored where they are read, so no text is shuffled."""
    model = co_train(staged(views(docs), "quality-views"), labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = text_view(batch.column(names.index("text"))).astype(float)
            meta = [batch.column(len(names) + k).to_numpy() for k in range(3)]
            good = model.scores(text, meta)[2] >= threshold
            yield pa.record_batch(batch.columns[: len(names)], names=names).filter(pa.array(good))

    return with_places(docs.toDF(*[f"c{k}" if n not in USED else n for k, n in enumerate(names)])).mapInArrow(run, docs.schema)


def op3_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

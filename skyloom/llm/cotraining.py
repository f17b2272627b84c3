"""Quality classifier by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.arrays import SPACE, runs, small_batches, utf8, word_hashes
from skyloom.session import staged, unstage

#: The documented bounds of the fit: labelled documents, and pseudo-labels that a view hands over in a round.
LABELLED_ROWS = 3000
GIVEN_ROWS = 100
#: Rounds, and how sure a view must be of a pseudo-label.
ROUNDS, SURE = 5, 0.95
#: Numbers of the two views: hashed trigrams and two shares of words; layout and hashed fields.
TRIGRAMS = 2048
TEXT_DIMS = TRIGRAMS + 2
LANG_DIMS, SOURCE_DIMS = 8, 32
LAYOUT = 10
LAYOUT_DIMS = LAYOUT + LANG_DIMS + SOURCE_DIMS
#: Words of a span in which distinct ones are counted.
SPAN = 2000
#: Bytes whose trigrams are counted at a time.
PIECE = 1 << 20


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, PIECE bytes at a time."""
    counts = np.zeros(TRIGRAMS, np.int64)
    for at in range(0, max(len(text) - 2, 0), PIECE):
        data = np.frombuffer(text[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=TRIGRAMS)
    return counts


def fresh_words(words: np.ndarray) -> float:
    """The share of distinct words in spans of SPAN words at most, evenly cut, over the whole text; 1 without words."""
    if not len(words):
        return 1.0
    spans = np.array_split(words, -(-len(words) // SPAN))
    return sum(len(np.unique(x)) for x in spans) / len(words)


def text_view(texts: list[bytes]) -> np.ndarray:
    """What a text says, as bytes: 25 log(1 + count) of its hashed byte trigrams, and the shares of distinct and of repeated words, over the whole text."""
    out = np.zeros((len(texts), TEXT_DIMS), np.uint8)
    words, n_words = word_hashes(texts)
    at = np.concatenate([[0], np.cumsum(n_words)])
    for i, t in enumerate(texts):
        out[i, :TRIGRAMS] = np.minimum(np.rint(25 * np.log1p(trigrams(t))), 255)
        own = words[at[i] : at[i + 1]]
        out[i, TRIGRAMS] = round(255 * fresh_words(own))
        out[i, TRIGRAMS + 1] = round(255 * float((own[1:] == own[:-1]).mean())) if len(own) > 1 else 0
    return out


def layout_view(texts: list[bytes], langs: list, sources: list, n_chars: list) -> np.ndarray:
    """What describes a page without its words: its fields (language and source hashed, size as stated), and the layout of the whole page in lines and kinds of characters."""
    out = np.zeros((len(texts), LAYOUT_DIMS), np.float32)
    for i, t in enumerate(texts):
        size = max(len(t), 1)
        hist = sum((np.bincount(np.frombuffer(t[at : at + PIECE], np.uint8), minlength=256) for at in range(0, len(t), PIECE)), np.zeros(256, np.int64)) / size
        lines = t.count(b"\n") + 1
        stated = n_chars[i] if n_chars[i] is not None else len(t)
        symbols = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
        out[i, :LAYOUT] = (
            np.log1p(max(stated, 0)), np.log1p(len(t)), np.log1p(lines), np.log1p(size / lines), stated / size,
            hist[65:91].sum(), hist[48:58].sum(), symbols, hist[128:].sum(), hist[SPACE].sum(),
        )
        out[i, LAYOUT + zlib.crc32(repr(langs[i]).encode()) % LANG_DIMS] = 1
        out[i, LAYOUT + LANG_DIMS + zlib.crc32(repr(sources[i]).encode()) % SOURCE_DIMS] = 1
    return out


@dataclass
class Linear:
    """A logistic model on scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 100, rate: float = 0.05, unit: bool = True) -> Linear:
    """Logistic regression by full-batch Adam; deterministic."""
    mean = x.mean(axis=0) if unit else np.zeros(x.shape[1], np.float32)
    scale = np.maximum(x.std(axis=0), 1e-3) if unit else np.ones(x.shape[1], np.float32)
    z = ((x - mean) / scale).astype(np.float32)
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        miss = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y
        g = np.append(z.T @ miss / len(y) + l2 * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    return Linear(mean.astype(np.float32), scale.astype(np.float32), w, float(b))


@dataclass
class CoTrained:
    text: Linear
    layout: Linear
    #: Platt scales of both views and of their combination
    text_scale: Linear
    layout_scale: Linear
    both: Linear

    def probabilities(self, text: np.ndarray, layout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.logit(text.astype(np.float32)), self.layout.logit(layout)
        pair = np.stack([self.text_scale.logit(a[:, None]), self.layout_scale.logit(b[:, None])], axis=1)
        return _probability(pair[:, 0]), _probability(pair[:, 1]), _probability(self.both.logit(pair))


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


class CoTraining:
    """Both views on labelled rows, and the pseudo-labelled rows that each was given by the other.

    A fifth of the labelled rows is kept for calibration, of each view and of
    both together.
    """

    def __init__(self, text: np.ndarray, layout: np.ndarray, y: np.ndarray):
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        self.views, self.y = (text.astype(np.float32), layout), y
        self.fit, self.check = ~held, held if held.any() else ~held
        self.given: list[tuple[list[np.ndarray], list[int]]] = [([], []), ([], [])]
        self.models: list[Linear] = []

    def train(self) -> list[Linear]:
        self.models = []
        for view, (rows, labels) in zip(self.views, self.given, strict=True):
            x = np.concatenate([view[self.fit], np.array(rows, np.float32).reshape(-1, view.shape[1])])
            self.models.append(fit_logistic(x, np.concatenate([self.y[self.fit], labels]).astype(np.float32)))
        return self.models

    def share(self, label: int) -> int:
        """Pseudo-labels of a class that a view hands over in a round, in the proportion of the labels."""
        return max(1, round(GIVEN_ROWS * float((self.y[self.fit] == label).mean())))

    def give(self, view: int, row: np.ndarray, label: int) -> None:
        self.given[view][0].append(row)
        self.given[view][1].append(label)

    def finish(self) -> CoTrained:
        y = self.y[self.check].astype(np.float32)
        logits = [m.logit(v[self.check])[:, None] for m, v in zip(self.models, self.views, strict=True)]
        scales = [fit_logistic(z, y, 1e-4, 300, unit=False) for z in logits]
        pair = np.stack([s.logit(z) for s, z in zip(scales, logits, strict=True)], axis=1)
        return CoTrained(*self.models, *scales, fit_logistic(pair, y, 1e-3, 300, unit=False))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TYPES = ("long", "string", "string", "string", "long")


def _typed(docs: DataFrame) -> list[Column]:
    """The columns that both views need, under names of their own."""
    return [F.col(f"`{c}`").cast(t).alias(f"_view_{c}") for c, t in zip(COLUMNS, TYPES, strict=True)]


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch whose first columns are those of _typed, with both views."""
    texts = utf8(batch.column(1))
    for i, j in runs(texts, 500_000):
        more = [batch.column(k).slice(i, j - i).to_pylist() for k in (2, 3, 4)]
        yield i, j, text_view(texts[i:j]), layout_view(texts[i:j], *more)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, text, layout in _views(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in layout], pa.binary())], ["doc_id", "text", "layout"]
            )


def _matrix(column: list[bytes], kind: type, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, columns)


def _sure(models: list[Linear]):
    """Documents of whose class a view is sure: doc_id, the view, the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k, x in enumerate((_matrix(batch.column(1).to_pylist(), np.uint8, TEXT_DIMS).astype(np.float32), _matrix(batch.column(2).to_pylist(), np.float32, LAYOUT_DIMS))):
                p = _probability(models[k].logit(x))
                some = np.flatnonzero((p >= SURE) | (p <= 1 - SURE))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(np.full(len(some), k), pa.int32()), pa.array((p[some] > 0.5).astype(np.int32))], ["doc_id", "view", "label"])

    return run


def _scorer(model: CoTrained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, *views in _views(batch):
                scores = model.probabilities(*views)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(np.round(s.astype(np.float64), 6)) for s in scores)], ["doc_id", "p_text", "p_layout", "score"])

    return run


def _rows_of(features: DataFrame, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both views of some documents; of rows that repeat a doc_id, the one of greatest bytes."""
    wanted = F.broadcast(features.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))  # as many as the fit's bounds allow
    once = features.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "layout")).alias("x")).collect()
    return {r["doc_id"]: (np.frombuffer(r["x"]["text"], np.uint8), np.frombuffer(r["x"]["layout"], np.float32)) for r in once}


def fit_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views in rounds of exchange; None without labels of both classes.

    Both are fitted on LABELLED_ROWS labelled documents at most, drawn by hash.
    In each round, both score every document without a label, and each view
    hands GIVEN_ROWS pseudo-labels at most, of both classes in the proportion of
    the labels, to the other: documents of which it is SURE, drawn by hash from
    all such documents, that neither has been given before. Features are made
    once and written. Labels with null doc_id or quality do not count; of
    several labels of a document the lowest counts.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    marks = staged(marks, "marks")
    by_hash = F.xxhash64("doc_id", F.lit(17))
    chosen = {r["doc_id"]: int(r["y"] > 0) for r in marks.orderBy(by_hash, "doc_id").limit(LABELLED_ROWS).collect()}
    if len(set(chosen.values())) < 2:
        unstage(marks)
        return None
    features = staged(small_batches(docs).select(*_typed(docs)).where("_view_doc_id is not null").mapInArrow(_features, "doc_id long, text binary, layout binary"), "features", compression="zstd")
    rows = _rows_of(features, list(chosen))
    known = sorted(rows, key=lambda i: (zlib.crc32(str(i).encode()), i))
    y = np.array([chosen[i] for i in known])
    model = None
    if len(set(y.tolist())) > 1:
        both = CoTraining(*(np.array([rows[i][k] for i in known]) for k in (0, 1)), y)
        given: set[int] = set()
        for _ in range(rounds):
            sure = features.mapInArrow(_sure(both.train()), "doc_id long, view int, label int")
            sure = staged(sure.join(marks, "doc_id", "left_anti").distinct(), "sure")
            picks = []
            for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
                taken = spark.createDataFrame([(i,) for i in sorted(given)], "doc_id long")
                own = sure.where((F.col("view") == view) & (F.col("label") == label)).join(F.broadcast(taken), "doc_id", "left_anti")
                found = [r["doc_id"] for r in own.orderBy(by_hash, "doc_id").limit(both.share(label)).collect()]
                given.update(found)
                picks += [(1 - view, i, label) for i in found]
            unstage(sure)
            rows = _rows_of(features, [i for _, i, _ in picks])
            for view, i, label in picks:
                both.give(view, rows[i][view], label)
        both.train()
        model = both.finish()
    for df in (marks, features):
        unstage(df)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_layout, score and keep of every document.

    ``docs`` has doc_id, text, lang, source and n_chars, ``labels`` doc_id and
    quality; other columns of either are ignored, whatever their names. p_text
    and p_layout are the calibrated probabilities of the two views, score that
    of both; keep is score >= threshold. Null or empty text is scored like any
    other; a null lang, source or n_chars is a value of its own (for n_chars,
    the text's bytes). Texts of any length are read whole, in pieces. Rows that
    repeat a doc_id are scored each by itself. Without labels of both classes,
    scores are null and all documents are kept. An empty table gives an empty
    result.
    """
    model = fit_quality(docs, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("p_text"), none.alias("p_layout"), none.alias("score"), F.lit(True).alias("keep"))
    scored = small_batches(docs).select(*_typed(docs)).mapInArrow(_scorer(model), "doc_id long, p_text double, p_layout double, score double")
    return scored.withColumn("keep", F.col("score") >= threshold)


def _keeper(model: CoTrained, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.select(batch.schema.names[len(COLUMNS) :])
            for i, j, *views in _views(batch):
                good = np.round(model.probabilities(*views)[2].astype(np.float64), 6) >= threshold
                yield whole.slice(i, j - i).filter(pa.array(good))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score_quality keeps, with all their columns as they are."""
    model = fit_quality(docs, labels)
    if model is None:
        return docs
    # columns travel under numbers, so that no name can clash
    numbered = docs.select(*_typed(docs), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    kept = small_batches(numbered).mapInArrow(_keeper(model, threshold), numbered.drop(*[f"_view_{c}" for c in COLUMNS]).schema)
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, FloatType

from ontocat.llm.common import free_name

#: Bounds of the sample a model is fitted on: trusted positives, unlabelled texts.
MAX_POSITIVES = 6_000
MAX_UNLABELLED = 9_000
BINS = 12
FOLDS = 3
HELD_OUT = 1

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
N_FEATURES = 14 + len(_PUNCTUATION)


def features(text: bytes | None) -> np.ndarray:
    """Style of a whole text: lengths, character classes, punctuation per word, repetition, compressibility."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), len(text)
    letters = max(1, count[_UPPER].sum() + count[_LOWER].sum() + count[192:].sum())
    out[:14] = (np.log1p(len(words)), np.log1p(len(lines)), np.log1p(len(words) / len(lines)),
                (size - count[[9, 10, 11, 12, 13, 32]].sum()) / n,
                count[_UPPER].sum() / letters, count[_DIGIT].sum() / size, count[192:].sum() / letters,
                count[[9, 32]].sum() / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
                len(set(zip(words, words[1:]))) / n, len(set(lines)) / len(lines),
                len(zlib.compress(text, 1)) / size, max(map(len, words), default=0) / 64)
    out[14:] = count[_PUNCTUATION] / n
    return out


@dataclass
class Model:
    """A score table per feature bin: ``sigmoid(bias + sum of the cells a text falls in)``."""

    edges: np.ndarray  # features x (BINS - 1), ascending
    weights: np.ndarray  # features x BINS
    bias: float
    prior: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The bin of each feature, numbered through all features."""
        bins = (x[:, :, None] > self.edges[None]).sum(axis=2)
        return bins + np.arange(x.shape[1]) * BINS

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + self.weights.ravel()[self.cells(x)].sum(axis=1))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(cells_p: np.ndarray, cells_u: np.ndarray, prior: float, steps: int, rate: float = 0.05,
             decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with the logistic loss.

    Risk: prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]). While the
    second part is negative the step goes against it, which undoes overfitting
    to the positives.
    """
    size = int(max(cells_p.max(), cells_u.max())) + 1
    w, moment, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias

    def gather(cells: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(cells.ravel(), np.repeat(slope, cells.shape[1]), size + 1)
        g[-1] = slope.sum()
        return g / len(slope)

    for step in range(1, steps + 1):
        zp, zu = w[cells_p].sum(axis=1) + w[-1], w[cells_u].sum(axis=1) + w[-1]
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = gather(cells_u, su) - prior * gather(cells_p, sp)
        grad = (prior * gather(cells_p, sp - 1) + rest if negative >= 0 else -rest) + decay * w
        moment, second = 0.9 * moment + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= rate * (moment / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the two tails above a score.

    Above any score at least ``prior`` times the share of the positives must be
    found among the unlabelled; a confidence margin keeps thin tails from
    deciding.
    """
    tops = np.quantile(score_p, np.linspace(0.05, 0.95, 91))
    tail_p = np.array([(score_p >= t).mean() for t in tops])
    tail_u = np.array([(score_u >= t).mean() for t in tops])
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(score_u)) + 1 / np.sqrt(len(score_p)))
    best = np.argmin((tail_u + margin) / np.maximum(tail_p, 1e-9))
    return float(np.clip(tail_u[best] / max(tail_p[best], 1e-9), 0.05, 0.98))


def fit(x_p: np.ndarray, x_u: np.ndarray, most: float = 1.0, steps: int = 300) -> Model | None:
    """The model of trusted positives ``x_p`` and unlabelled ``x_u``; None without either.

    ``most``: an upper bound of the prior from elsewhere, such as a labelled share.
    """
    if not len(x_p) or not len(x_u):
        return None
    grid = np.quantile(np.concatenate([x_p, x_u]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(np.ascontiguousarray(grid), np.zeros((x_p.shape[1], BINS)), 0.0, 0.5)

    def weights(cells_p, cells_u, prior, n):
        w, bias = _descend(cells_p, cells_u, prior, n)
        return np.concatenate([w, np.zeros(x_p.shape[1] * BINS - len(w))]).reshape(-1, BINS), bias

    cells_p, cells_u = model.cells(x_p), model.cells(x_u)
    if min(len(x_p), len(x_u)) >= 20:  # prior: scores of the odd rows by a model of the even ones
        model.weights, model.bias = weights(cells_p[::2], cells_u[::2], 0.5, steps // 2)
        model.prior = min(most, estimate_prior(model.scores(x_p[1::2]), model.scores(x_u[1::2])))
    model.weights, model.bias = weights(cells_p, cells_u, model.prior, steps)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


@arrow_udf(ArrayType(FloatType()))
def _features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for chunk in texts:
        yield pa.array([features(t.as_py()) for t in chunk.cast(pa.binary())], pa.list_(pa.float32()))


def learn(docs: DataFrame, labels: DataFrame, *, max_positives: int = MAX_POSITIVES,
          max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on the learning folds of ``docs (doc_id, text)`` and ``labels (doc_id, quality)``.

    Trusted positives: ids that ``labels`` only marks 1. Unlabelled: ids of the
    documents, whatever their label. Of each at most the stated number is
    taken, by the smallest hash of the id, so a rerun fits the same model. Marks
    0 are no training rows; where there are any, the share of marks 1 bounds the
    estimated class prior.
    """
    marks = (labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
             .filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.min("quality").alias("q")))
    share = marks.agg(F.avg("q")).first()[0]
    ids = docs.select("doc_id").filter("doc_id is not null").filter(fold(F.col("doc_id")) != HELD_OUT)

    def few(frame: DataFrame, seed: int, n: int, positive: bool) -> DataFrame:
        return (frame.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)
                .withColumn("positive", F.lit(positive)))

    # positives are drawn among ids that have a document
    positives = marks.filter("q = 1").join(ids, "doc_id", "left_semi")
    chosen = few(positives, 1, max_positives, True).unionByName(few(ids, 2, max_unlabelled, False))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "positive", _features("text").alias("x"))
            .groupBy("doc_id", "positive").agg(F.min("x").alias("x")).collect())
    rows.sort(key=lambda r: (r.doc_id, r.positive))
    x = {p: np.array([r.x for r in rows if r.positive == p], np.float32).reshape(-1, N_FEATURES) for p in (True, False)}
    return fit(x[True], x[False], share if share and share < 1 else 1.0)


def _scorer(shared):
    @arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for chunk in texts:
            done = []
            for at in range(0, len(chunk), 512):
                part = chunk.slice(at, 512).cast(pa.binary())
                x = np.array([features(t.as_py()) for t in part]).reshape(-1, N_FEATURES)
                done.append(np.full(len(x), 0.5) if model is None else model.scores(x))
            yield pa.array(np.concatenate(done) if done else np.zeros(0))
    return score


def add_score(docs: DataFrame, model: Model | None, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1, higher: better quality) in column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 50 features x 12 cells
    return docs.withColumn(out, _scorer(shared)(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, *, out: str = "score", **bounds) -> DataFrame:
    """Scores of all ``docs (doc_id, text, ...)`` by a model learned on the folds that are not held out.

    Labels are read only for ids whose ``fold`` is not 1, and only marks 1 are
    used as positives; labels, ids, languages and sources are never inputs of
    the score. Null and empty texts get the score of a text without words.
    Without trusted positives or without documents every score is 0.5. Labels
    that are null, other than 0 and 1, contradictory or without id are ignored;
    repeated rows are scored row by row. Other columns of ``docs`` are kept.
    """
    return add_score(docs, learn(docs, labels, **bounds), out=out)


def keep_good(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with their columns."""
    name = free_name(docs, "score")
    return classify(docs, labels, out=name, **bounds).filter(F.col(name) >= 0.5).select(*docs.columns)

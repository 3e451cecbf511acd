"""Quality by regularised quadratic discriminants over transformed document statistics.

Every whole text is turned into shares and means (word lengths, capitals, marks, repeats, line shapes); shares
go through the arc sine of their root, sizes through a logarithm.  Each class gets a mean and a
covariance that is shrunk towards its own diagonal and a common floor; its Cholesky factor is computed once and
kept in the model.  A score is the log-density difference of the classes, from Mahalanobis distances by
triangular solves, put on the scale of a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Words, bounded_sample, logistic, sigmoid, text_segments

#: Labelled documents of each class that a model is fitted on at most.
SAMPLE = 20_000
#: Share of the class's own diagonal, and variance added to every statistic.
SHRINKAGE, FLOOR = 0.1, 2e-4
LAGS = 8
STATISTICS = [
    "log_words", "mean_length", "length_spread", "capital_words", "title_words", "marked_words", "mark_letters",
    "bare_marks", "digit_letters", "short_words", "distinct", "adjacent", "cycle", "repeat_lines", "log_line", "plain_ends",
]


def _word_table(words: list[str]) -> np.ndarray:
    """Per distinct word: length, squared length, and what it counts for."""
    out = np.zeros((len(words), 10))
    for k, w in enumerate(words):
        n = len(w)
        letters = sum(map(str.isalpha, w)) if not w.isalpha() else n
        digits = sum(map(str.isdigit, w)) if letters < n else 0
        marks = n - letters - digits
        out[k] = (
            n, n * n, letters > 1 and w.isupper(), w[0].isupper() and not w.isupper(), marks > 1, marks, letters + digits == 0,
            digits, n <= 3, letters == n or (marks == 1 and w[-1] in ".,;:?"),
        )
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def statistics(texts: list[str]) -> np.ndarray:
    """(texts, STATISTICS); an empty text has a row of its own kind: all shares zero."""
    words = Words(texts)
    n = words.counts.astype(float)
    table = _word_table(words.distinct)
    per = np.stack([words.sums(table[words.codes, j]) for j in range(10)], axis=1) if len(words.codes) else np.zeros((len(texts), 10))
    owner, codes = words.owner(), words.codes
    pairs = np.unique(owner.astype(np.int64) << 32 | codes) if len(codes) else np.empty(0, np.int64)
    distinct = np.bincount(pairs >> 32, minlength=len(texts)).astype(float)
    lagged = np.zeros((len(texts), LAGS))
    for lag in range(1, LAGS + 1):
        same = (codes[lag:] == codes[:-lag]) & (owner[lag:] == owner[:-lag])
        lagged[:, lag - 1] = np.bincount(owner[lag:][same], minlength=len(texts))
    again, lines = np.zeros(len(texts)), np.zeros(len(texts))
    for k, text in enumerate(texts):
        own = text.split("\n")
        lines[k] = len(own)
        again[k] = len(own) - len(set(own))
    mean = per[:, 0] / np.maximum(n, 1)
    return np.stack(
        [
            np.log1p(n) / 4,
            np.log1p(mean),
            np.sqrt(np.maximum(per[:, 1] / np.maximum(n, 1) - mean**2, 0)) / 4,
            _share(per[:, 2], n),
            _share(per[:, 3], n),
            _share(per[:, 4], n),
            _share(per[:, 5], per[:, 0]),
            _share(per[:, 6], n),
            _share(per[:, 7], per[:, 0]),
            _share(per[:, 8], n),
            # distinct words as a power of all words: the same for short and long texts
            np.where(n > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)), 1.0),
            _share(lagged[:, 0], n),
            _share(lagged[:, 1:].max(axis=1), n),
            _share(again, lines),
            np.log1p(n / np.maximum(lines, 1)) / 3,
            _share(per[:, 9], n),
        ],
        axis=1,
    )


class Model:
    """Means, Cholesky factors of shrunk covariances and their log determinants, and the scale of scores."""

    def __init__(self, means: list[np.ndarray], factors: list[np.ndarray], scale: np.ndarray):
        self.means, self.factors, self.scale = means, factors, scale
        self.log_dets = [2 * np.log(np.diag(f)).sum() for f in factors]

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 minus that of class 0."""
        out = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = _solve_lower(factor, (x - mean).T)
            out.append(-0.5 * ((z * z).sum(axis=0) + log_det))
        return out[1] - out[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        r = _squash(self.log_ratio(statistics(texts))) if self.factors else np.zeros(len(texts))
        return sigmoid(r * self.scale[0] + self.scale[1])


def _squash(r: np.ndarray) -> np.ndarray:
    return np.sign(r) * np.log1p(np.abs(r))


def _solve_lower(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward substitution with a lower triangular factor."""
    out = np.empty_like(b)
    for k in range(len(factor)):
        out[k] = (b[k] - factor[k, :k] @ out[:k]) / factor[k, k]
    return out


def shrunk_factor(x: np.ndarray) -> np.ndarray:
    cov = np.atleast_2d(np.cov(x, rowvar=False, bias=True)) if len(x) > 1 else np.zeros((x.shape[1],) * 2)
    diagonal = np.diag(np.diag(cov))
    return np.linalg.cholesky((1 - SHRINKAGE) * cov + SHRINKAGE * diagonal + FLOOR * np.eye(len(cov)))


def fit(x: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on statistics and labels; with one class only, every text scores near that class."""
    y = np.asarray(labels)
    if len(set(y.tolist())) < 2:
        return Model([], [], np.array([0.0, 4.0 if len(y) and y[0] == 1 else -4.0]))
    model = Model([x[y == c].mean(axis=0) for c in (0, 1)], [shrunk_factor(x[y == c]) for c in (0, 1)], np.array([1.0, 0.0]))
    r = _squash(model.log_ratio(x))
    model.scale = logistic(np.stack([r, np.ones(len(r))], axis=1), y.astype(float), ridge=0.1)
    return model


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, raw in text_segments(batches):
        x = statistics([t.decode("utf-8", "replace") if t else "" for t in raw])
        yield pa.RecordBatch.from_arrays([labels, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of each class of ``labels`` (doc_id, ``label``), chosen by hash of the id.

    Rows with a null id or a label other than 0 and 1 teach nothing; an id with both labels counts
    as 1, rows that repeat an id all count, and null texts are empty.  Without any labelled document all score alike.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    chosen = bounded_sample(ids.groupBy("doc_id").agg(F.max("y").alias("y")), "y", "doc_id", sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    got = rows.select("y", "text").mapInArrow(_stat_rows, "y int, x array<double>").collect()
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in got], int))


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for ids, raw in text_segments(batches):
            texts = [t.decode("utf-8", "replace") if t else "" for t in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(texts))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of label 1 for every whole text; null counts as empty.

    Repeated rows and null ids are returned as they come; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scored(held), f"id {kind}, score double")

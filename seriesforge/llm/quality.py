"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian with a covariance shrunk towards the pooled one and the
diagonal; a document's score is the logistic of the difference of the two
Mahalanobis log densities plus the log prior odds, with Cholesky factors computed
once when fitting. The statistics of a text come from its whole byte buffer.

Only fitting uses a sample: at most ``SAMPLE`` labelled training rows, those with
the smallest hashes of their ids, so that the fit is the same at any partitioning.

Cases: null and empty texts have the statistics of an empty text and get a
score; without labels of both classes every score is the share of label 1 (0.5
without labels); several labels of a document count one by one; repeated rows
are scored one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _arrow
from ._split import bounded_sample, held_out

SAMPLE = 20_000
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.3, 0.2, 1e-3

# Byte classes: 0 other symbol, 1 lower case, 2 upper case, 3 digit, 4 blank, 5 line end, 6 ordinary punctuation, 7 beyond ASCII
_CLASS = np.zeros(256, dtype=np.int64)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n\r\v\f", 5), (".,;:!?'\"()-", 6)):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = 7
FEATURES = 14


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text."""
    n_rows = len(offs) - 1
    size = np.diff(offs).astype(float)
    kinds = np.bincount(np.repeat(np.arange(n_rows), np.diff(offs)) * 8 + _CLASS[buf], minlength=n_rows * 8).reshape(n_rows, 8).astype(float)
    starts, ends, word_offs = _arrow.words(buf, offs)
    h = _arrow.word_hashes(buf, starts, ends)
    n_words = np.diff(word_offs).astype(float)
    row = np.repeat(np.arange(n_rows), np.diff(word_offs))
    per_row = lambda x: np.bincount(row, weights=x, minlength=n_rows)
    length = (ends - starts).astype(float)
    again = np.zeros(len(h))
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((h, row)) if len(h) else np.zeros(0, int)
    distinct = np.ones(len(h))
    if len(h):
        distinct[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
    mean_length = per_row(length) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(per_row(length**2) / np.maximum(n_words, 1) - mean_length**2, 0))
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            np.log1p(mean_length),
            np.log1p(spread),
            share(kinds[:, 0], size),
            share(kinds[:, 2], size),
            share(kinds[:, 3], size),
            share(kinds[:, 4], size),
            share(kinds[:, 5], size),
            share(kinds[:, 6], size),
            share(per_row(again), n_words),
            share(np.bincount(row[order], weights=distinct, minlength=n_rows), n_words) if len(h) else np.zeros(n_rows),
            share(per_row(length == 1), n_words),
            share(per_row(length <= 3), n_words),
        ]
    )


@dataclass(frozen=True)
class Model:
    """means, inverse Cholesky factors and log normalisers by class; shared centre and scale."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    prior = float(y.mean()) if len(y) else 0.5
    empty = np.zeros((0, 0))
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), empty, empty, empty, prior)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    own = [np.cov(p, rowvar=False, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
    means, factors, constants = [], [], []
    for part, cov in zip(parts, own, strict=True):
        cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        means.append(part.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(len(part) / len(z)) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), np.array(constants), prior)


def _statistics_batches(keep: list[str]):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                x = statistics(buf, offs)
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[lo:hi] for k in keep), pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out third."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    chosen = bounded_sample(rows, "doc_id", sample)  # so many pairs of numbers at most: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = texts.mapInArrow(_arrow.tidy(_statistics_batches(["quality"])), "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, FEATURES)
    order = np.lexsort(np.vstack([x.T, got["quality"].to_numpy()])) if len(x) else np.zeros(0, int)
    return fit(x[order], got["quality"].to_numpy()[order])  # in one order, so that sums are the same every time


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all their columns and ``score``, in their order; a column of that name is replaced."""
    docs = docs.drop("score")

    def run(batches):
        for batch in batches:
            parts = [model.score(statistics(buf, offs)) for _, _, buf, offs in _arrow.chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*parts, np.zeros(0)]))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(_arrow.tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def score_only(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score; the texts don't come back from the workers."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(model.score(statistics(buf, offs)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_only(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

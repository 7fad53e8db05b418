"""Language identification: averaged hashed subword embeddings under a linear softmax.

Byte 2-, 3- and 4-grams of the lower-cased letters are hashed into buckets, each
bucket has an embedding, a text is the mean of its embeddings, and a linear
softmax gives the languages. Embeddings and weights are trained by stochastic
gradient descent in numpy. As the mean and the softmax's logits are linear in the
bucket counts, scoring multiplies the two matrices once and then only sums a few
numbers for each byte of a whole text.

A temperature, fitted on a part of the sample that training doesn't see, makes
probabilities honest; the rejection limit is the probability that the given share
of that part falls below. Only fitting uses a sample: at most ``SAMPLE`` training
rows, those with the smallest hashes of their ids.

Cases: null texts and texts without a letter give ``und`` with score 1; if
nothing can be learned, every text gives ``und`` with score 0; repeated rows are
scored one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow
from ._split import bounded_sample, held_out

BUCKETS, DIMENSIONS, ORDERS = 1 << 13, 16, (2, 3, 4)
SAMPLE, EPOCHS, RATE, BATCH, REJECTED_SHARE = 3000, 12, 0.5, 32, 0.01
UNKNOWN = "und"

# Letters lower-cased, bytes beyond ASCII as they are, all else one separator
_LETTER = np.zeros(256, dtype=np.uint32)
_LETTER[0x61:0x7B] = np.arange(1, 27)
_LETTER[0x41:0x5B] = np.arange(1, 27)
_LETTER[0x80:] = np.arange(27, 27 + 128)
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def grams(buf: np.ndarray, offs: np.ndarray):
    """For each order: bucket of the gram at each byte, and which grams lie in one text and have a letter."""
    code = _LETTER[buf]
    row_end = np.repeat(offs[1:], np.diff(offs))
    place = np.arange(len(buf))
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, dtype=np.uint32)
        letter = np.zeros(m, dtype=bool)
        for i in range(n):
            part = code[i : i + m]
            key = key * np.uint32(0x01000193) + part
            letter |= part > 0
        key ^= np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        key *= np.uint32(0x85EBCA6B)
        key ^= key >> np.uint32(13)
        key *= np.uint32(0xC2B2AE35)
        yield key >> np.uint32(32 - 13), letter & (place[:m] + n <= row_end[:m])


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter in Unicode's sense."""
    seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[buf])))
    out = seen[offs[1:]] > seen[offs[:-1]]
    for i in np.flatnonzero(~out):
        text = buf[offs[i] : offs[i + 1]]
        if (text >= 0x80).any():
            out[i] = any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace"))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # logits of each bucket
    bias: np.ndarray
    temperature: float
    limit: float

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        return _softmax((mean_logits + self.bias) / self.temperature)

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each text."""
        n_rows = len(offs) - 1
        total, count = np.zeros((n_rows, len(self.languages))), np.zeros(n_rows)
        for bucket, ok in grams(buf, offs):
            edges = np.minimum(offs, len(bucket))
            counts = np.concatenate(([0], np.cumsum(ok)))
            count += counts[edges[1:]] - counts[edges[:-1]]
            for k in range(len(self.languages)):
                sums = np.concatenate(([0.0], np.cumsum(np.where(ok, self.table[:, k][bucket], 0.0))))
                total[:, k] += sums[edges[1:]] - sums[edges[:-1]]
        return self.probabilities(total / np.maximum(count, 1)[:, None])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """bags: bucket numbers and their shares of each text."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    order = rng.permutation(len(bags))
    held = order[: len(order) // 10]
    used = order[len(order) // 10 :]
    emb = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, k)), np.zeros(k)
    mean = lambda e, i: bags[i][1] @ e[bags[i][0]]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        step = rng.permutation(used)
        for at in range(0, len(step), BATCH):
            part = step[at : at + BATCH]
            x = np.array([mean(emb, i) for i in part])
            p = _softmax(x @ weights + bias)
            p[np.arange(len(part)), y[part]] -= 1
            back = p @ weights.T
            weights -= rate * x.T @ p / len(part)
            bias -= rate * p.mean(axis=0)
            for g, i in zip(back, part, strict=True):  # each text's step alone: the sums of a bag move as one
                emb[bags[i][0]] -= rate * 20 * np.outer(bags[i][1], g)
    logits = np.array([mean(emb, i) for i in held]).reshape(len(held), DIMENSIONS) @ weights
    best, limit = 1.0, 0.0
    if len(held):
        loss = lambda t: -np.log(np.maximum(_softmax((logits + bias) / t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        best = float(min(np.geomspace(0.25, 8, 41), key=loss))
        limit = float(np.quantile(_softmax((logits + bias) / best).max(axis=1), REJECTED_SHARE))
    return Model(languages, emb @ weights, bias, best, limit)


def _bags(batches):
    for batch in batches:
        for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
            row = np.repeat(np.arange(hi - lo), np.diff(offs))
            keys = [row[: len(b)][ok] * BUCKETS + b[ok].astype(np.int64) for b, ok in grams(buf, offs)]
            found, counts = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_counts=True)
            edges = np.searchsorted(found, np.arange(hi - lo + 1) * BUCKETS)
            parts = [(found[a:b] % BUCKETS, counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang")[lo:hi],
                    batch.column("doc_id")[lo:hi],
                    pa.array([i.astype("<u2").tobytes() for i, _ in parts], pa.binary()),
                    pa.array([c.astype("<u4").tobytes() for _, c in parts], pa.binary()),
                ],
                names=["lang", "doc_id", "buckets", "counts"],
            )


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on at most ``sample`` documents outside the held-out third; None if no language is given."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    chosen = bounded_sample(rows.select("doc_id").distinct(), "doc_id", sample)
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id")
    got = texts.select("doc_id", "lang", "text").mapInArrow(_arrow.tidy(_bags), "lang string, doc_id long, buckets binary, counts binary").toPandas().sort_values(["doc_id", "lang", "buckets"])
    bags = [(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4") / max(1, np.frombuffer(c, "<u4").sum())) for b, c in zip(got["buckets"], got["counts"], strict=True)]
    full = [i for i, b in enumerate(bags) if len(b[0])]
    languages = sorted(set(got["lang"]))
    if not full:
        return None
    y = got["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    return fit([bags[i] for i in full], y[full], languages)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, rejected."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in _arrow.chunks(batch.column("text")):
                n = hi - lo
                pred, best, rejected = np.full(n, UNKNOWN, dtype=object), np.full(n, 0.0), np.ones(n, dtype=bool)
                letters = has_letter(buf, offs)
                if model is not None:
                    p = model.predict(buf, offs)
                    pred = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
                    best = p.max(axis=1)
                    rejected = best < model.limit
                pred[~letters], best[~letters], rejected[~letters] = UNKNOWN, 1.0, True
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(pred, pa.string()), pa.array(best), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(_arrow.tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")

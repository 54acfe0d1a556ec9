"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text: the shapes of its tokens (letter and digit runs as one sign, other signs kept), pairs of neighbouring shapes,
words in lower case, and repeats of the token before, each hashed to a fixed number of columns. A truncated singular
value decomposition of the weighted terms of labelled texts gives the latent space. The labelled vectors (at most
2 * PER_CLASS rows of DIMS numbers) are broadcast; each block of documents is multiplied with all of them, so the cosines are
exact, and the K nearest vote, each with its cosine to the power SHARP as weight; all that are as near as the K-th vote with them.

Fitted on a bounded sample of labelled texts; every text is scored whole.
Defined results: null, empty and blank texts have a zero vector and score as the share of label 1 in the sample (1 without labels);
repeated rows each get a row; extra columns are ignored; very long texts are one row of fixed width; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import labelled_sample, prepared, rejected, scored, sole, table

BINS, DIMS, K, SHARP = 1024, 32, 15, 4
PER_CLASS = 2000
HELD = (3, 1)
WIDTH = 3 * BINS + 1
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_A]+"), re.compile(r"\d+")


def _shape(token: str) -> str:
    return _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", token)))


class Terms(dict):
    """Token to shape column * BINS + word column, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        shape = zlib.crc32(_shape(token).encode()) % BINS
        word = zlib.crc32(token.lower().encode()) % BINS
        found = self[token] = shape * BINS + word
        return found


_TERMS = Terms()


def vectors(texts: list[str | None]) -> np.ndarray:
    """Term weights (square roots of shares) of each text, one row each."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for n, text in enumerate(texts):
        tokens = (text or "").split()
        if not tokens:
            continue
        both = np.fromiter(map(_TERMS.__getitem__, tokens), np.int64, len(tokens))
        shape, word = both // BINS, both % BINS
        out[n, :BINS] = np.bincount(shape, minlength=BINS)
        if len(tokens) > 1:
            out[n, BINS : 2 * BINS] = np.bincount((shape[:-1] * 31 + shape[1:] * 7) % BINS, minlength=BINS)
            out[n, -1] = sum(map(eq, tokens, tokens[1:]))
        out[n, 2 * BINS : -1] = np.bincount(word, minlength=BINS)
        out[n] = np.sqrt(out[n] / len(tokens))
    out[:, 2 * BINS : -1] *= 0.3
    out[:, -1] *= 2
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-9)


class Model:
    def __init__(self, weight: np.ndarray, space: np.ndarray, known: np.ndarray, label: np.ndarray, base: float):
        self.weight, self.space, self.known, self.label, self.base = weight, space, known, label, base

    def scores(self, texts: list[str | None]) -> list[float]:
        if not len(self.known):
            return [self.base] * len(texts)
        own = _unit((_unit(vectors(texts)) * self.weight) @ self.space)
        cos = own @ self.known.T
        k = min(K, len(self.known))
        least = np.partition(cos, len(self.known) - k, axis=1)[:, -k]
        row, near = np.nonzero(cos >= least[:, None])
        vote = np.maximum(cos[row, near], 0).astype(np.float64) ** SHARP
        total = np.bincount(row, vote, len(texts))
        score = np.divide(np.bincount(row, vote * self.label[near], len(texts)), total, out=np.full(len(texts), self.base), where=total > 1e-9)
        return np.clip(score, 0, 1).tolist()


def fit(rows: list[tuple[str, int]]) -> Model:
    """Latent space and labelled vectors; the decomposition is that of the terms' Gram matrix by blocks."""
    if not rows:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 1.0)
    texts, label = [t for t, _ in rows], np.array([v for _, v in rows], np.float64)
    x = _unit(np.concatenate([vectors(texts[i : i + 256]) for i in range(0, len(texts), 256)]))
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) * 0.25 + 0.5
    x *= weight
    draw = np.random.Generator(np.random.PCG64(7))
    basis = x.T @ (x @ draw.standard_normal((x.shape[1], min(DIMS + 16, len(x)))).astype(np.float32))
    for _ in range(4):
        basis = np.linalg.qr(basis)[0]
        basis = x.T @ (x @ basis)
    basis = np.linalg.qr(basis)[0]
    values, turn = np.linalg.eigh((x @ basis).T @ (x @ basis))
    space = (basis @ turn[:, np.argsort(-values)[:DIMS]]).astype(np.float32)
    return Model(weight, space, _unit(x @ space).astype(np.float32), label, float(label.mean()))


def trained(spark: SparkSession, sf_dir: str, held: tuple[int, int] = HELD) -> Model:
    return fit(labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", held, PER_CLASS))


def worker(spark: SparkSession, model: Model):
    """A factory of scorers for tasks; the model is broadcast (at most 2 * PER_CLASS vectors and the space, about 1 MB)."""
    sent = prepared(spark).sparkContext.broadcast(model)

    def make():
        sole("quality", _TERMS.clear)
        return sent.value.scores

    return make


def classify(docs: DataFrame, model: Model, held: tuple[int, int] = HELD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; one pass, no shuffle."""
    return scored(docs, held, worker(docs.sparkSession, model))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``."""
    return rejected(docs, worker(docs.sparkSession, model), least, keep_high=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trained(spark, sf_dir))

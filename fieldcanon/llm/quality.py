"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become weighted term vectors: words above all, and with half their weight the shapes of
character runs and repeated words. A truncated singular value decomposition of the labelled ones
gives the latent space. The labelled vectors go to every task; each document is compared exactly
with all of them, in blocks, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Most labelled rows of either class that the model is fitted on: the bound of what is broadcast.
FIT_PER_CLASS = 1500
DIMENSIONS = 32
NEIGHBOURS = 15
#: A neighbour's vote is its cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.7
#: Documents that are compared at a time.
BLOCK = 256

#: Terms of each kind, words by hash, and the weights of the kinds.
WORDS, SHAPES, LAGS = 2048, 512, 8
WIDTH = WORDS + SHAPES + LAGS
WEIGHTS = (1.0, 0.5, 0.5)
#: Cosines are compared in steps of this, so that equal texts are equally near however they are batched.
STEP = 1e-5
#: Rounds of the iteration that finds the latent axes.
ROUNDS = 24

_CLASSES = np.full(256, 6, np.uint16)  # other marks
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:?'\"-()")):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 0  # letters beyond ASCII count as small ones


def term_vector(text: str | None) -> np.ndarray:
    """The text's term weights: square roots of relative frequencies, by kind of term."""
    out = np.zeros(WIDTH, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    hashed = np.fromiter(map(zlib.crc32, data.lower().split()), np.uint32, len(words))
    n = len(hashed)
    out[:WORDS] = np.sqrt(np.bincount(hashed % WORDS, minlength=WORDS) / n) * WEIGHTS[0]
    shapes, lags = out[WORDS : WORDS + SHAPES], out[WORDS + SHAPES :]
    c = _CLASSES[np.frombuffer(data, np.uint8)]
    if len(c) > 2:
        counts = np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=SHAPES)
        shapes[:] = np.sqrt(counts / counts.sum()) * WEIGHTS[1]
    for lag in range(1, LAGS + 1):
        if n > lag:
            lags[lag - 1] = np.sqrt(np.count_nonzero(hashed[lag:] == hashed[:-lag]) / (n - lag)) * WEIGHTS[2]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Model:
    """What every task gets; its size is bounded by ``FIT_PER_CLASS``."""

    idf: np.ndarray
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, terms: np.ndarray) -> np.ndarray:
        return _unit((terms * self.idf - self.mean) @ self.axes)

    def score(self, texts: list[str | None]) -> np.ndarray:
        scores = np.full(len(texts), self.prior)
        for at in range(0, len(texts), BLOCK):
            terms = np.stack([term_vector(t) for t in texts[at : at + BLOCK]])
            if len(self.labels):
                known = terms.any(axis=1)
                scores[at : at + BLOCK] = np.where(known, self._vote(self.project(terms)), self.prior)
        return np.clip(scores, 0.0, 1.0)

    def _vote(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 in the votes of the nearest; those as near as the last one vote too."""
        near = np.round((rows @ self.vectors.T).astype(np.float64) / STEP)
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, -k, axis=1)[:, -k, None]
        votes = np.where(near >= last, np.clip(near * STEP, 0, None), 0) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.where(total > 0, votes @ self.labels / np.where(total > 0, total, 1), self.prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label must not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = FIT_PER_CLASS) -> Model:
    """Fit on the labelled rows that aren't held out, ``per_class`` of either label at most.

    The rows are those with the smallest hash of their id, so any input gives the same kind of
    sample. Labels other than 0 and 1, null ids, ids with different labels, and ids that
    ``docs`` lacks are left out. Without labelled rows all scores are 0.5.
    """
    known = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    )
    prior = known.agg(F.avg("label")).first()[0]
    by_hash = lambda k: known.where(F.col("label") == k).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = F.broadcast(by_hash(0).unionByName(by_hash(1)))

    @F.pandas_udf("binary")
    def terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([term_vector(t).tobytes() for t in batch], dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).join(chosen, "doc_id").select("doc_id", "label", terms("text").alias("terms"))
    # Of rows that repeat an id with different texts, the smallest vector counts, so that any order of rows gives the same.
    sample = rows.groupBy("doc_id", "label").agg(F.min("terms").alias("terms")).toPandas().sort_values("doc_id")
    if sample.empty:
        empty = np.zeros((0, WIDTH), np.float32)
        return Model(np.ones(WIDTH, np.float32), np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), empty[:, :1], np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(t, np.float32) for t in sample["terms"]])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = x * idf
    mean = x.mean(axis=0)
    axes = latent_axes(x - mean)
    return Model(idf, mean, axes, _unit((x - mean) @ axes), sample["label"].to_numpy(np.float64), float(prior))


def latent_axes(x: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors of ``x`` as columns, by subspace iteration.

    A fixed start of twice as many columns is multiplied by ``x`` and its transpose ``ROUNDS`` times,
    so the driver holds no square matrix of all terms. A vector's sign is that of its largest entry,
    as any sign would do.
    """
    width = min(2 * dimensions, *x.shape)
    basis = np.random.default_rng(7).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    seen = (x @ basis).astype(np.float64)
    values, turn = np.linalg.eigh(seen.T @ seen)
    values, turn = values[::-1][:dimensions], turn[:, ::-1][:, :dimensions]
    kept = values > max(values[0], 0) * 1e-9
    if not kept.any():
        return np.zeros((x.shape[1], 1), np.float32)
    axes = basis @ turn[:, kept]
    return np.ascontiguousarray((axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])).astype(np.float32))


def score_column(model: Model, text_col: str = "text") -> Column:
    """The score of each row's whole text as a column."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(batch.tolist()))

    return score(text_of(text_col))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A score reads the text only, of any length. Null texts are empty; texts without words get the
    share of label 1 among the labelled rows. Where several labelled documents are equally near,
    all of them vote. Repeated rows and null ids are kept (a null id is not held out); an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(model, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_scores`` predicts as 1."""
    model = fit(docs, labels, id_col, text_col, label_col)
    return docs.where(score_column(model, text_col) >= threshold)

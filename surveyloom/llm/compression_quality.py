"""Quality by compression: one zstandard dictionary from good texts, one from bad ones; the smaller output tells.

The texts that dictionaries and calibration are made from are a bounded sample of the labelled rows (``PER_LABEL`` documents
and ``TRAIN_BYTES`` of text, parameters); the base rate comes from all labels, and every document is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm import common

PER_LABEL = 3000
TRAIN_BYTES = 24 << 20
DICTIONARY_BYTES = 96 << 10
BLOCK = 2048
LEVEL = 3


class Compressors:
    """The two dictionaries, ready to compress; pickles as the dictionaries' bytes."""

    def __init__(self, good: bytes, bad: bytes):
        self.parts = (good, bad)
        self._ready: list | None = None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.parts, self._ready = parts, None

    def features(self, text: bytes) -> tuple[float, float, float, float]:
        """The normalised difference: bytes that the bad dictionary takes more than the good one, for each byte of text; and
        what the calibration needs to read it: bytes out for each byte of text, squared too (repetition makes any
        dictionary look good), and the length's logarithm. Blocks are compressed each on its own.
        """
        if self._ready is None:
            self._ready = []
            for raw in self.parts:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        good, bad = self._ready
        by_good = by_bad = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            by_good += len(good.compress(block))
            by_bad += len(bad.compress(block))
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        ratio = min(by_good, by_bad) / len(text)
        return (by_bad - by_good) / len(text), ratio, ratio * ratio, math.log1p(len(text))


def _dictionary(texts: list[str]) -> bytes:
    blocks = [b for t in texts for raw in [t.encode()] for i in range(0, len(raw), BLOCK) if len(b := raw[i : i + BLOCK]) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples to train from: they are the dictionary themselves
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps; ``x`` is of unit scale, the intercept bears no penalty."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return w


#: Features that the calibration may use: the difference alone, with the ratio and its square, and with the length.
COVARIATES, FOLDS = (1, 3, 4), 5


def _log_loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Mean log-loss of ``logistic`` on folds that it was not fitted to; a row's fold is its place modulo ``FOLDS``."""
    fold = np.arange(len(y)) % FOLDS
    total = 0.0
    for k in range(FOLDS):
        own = fold == k
        w = logistic(x[~own], y[~own], weight[~own], ridge=1.0)
        p = np.clip(1 / (1 + np.exp(-np.clip(x[own] @ w[:-1] + w[-1], -30, 30))), 1e-9, 1 - 1e-9)
        total -= float((weight[own] * (y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p))).sum())
    return total / float(weight.sum())


class Model:
    """score(text): calibrated probability of good quality.

    How many of the features are used is chosen by cross-validation within the rows that are learned from.
    """

    def __init__(self, good: list[str], bad: list[str], rate: float):
        self.compressors, self.used = None, 0
        self.mean = self.scale = self.slopes = np.zeros(4)
        self.intercept = math.log(rate / (1 - rate))
        if not good or not bad:
            return  # one class only: its base rate is all there is to say
        split = lambda t: (t[: len(t) // 2] or t, t[len(t) // 2 :] or t)  # noqa: E731  dictionaries from the one half, calibration from the other
        (good, good2), (bad, bad2) = split(good), split(bad)
        self.compressors = Compressors(_dictionary(good), _dictionary(bad))
        x = np.array([self.compressors.features(t.encode()) for t in [*good2, *bad2]])
        y = np.array([1.0] * len(good2) + [0.0] * len(bad2))
        weight = np.where(y == 1, rate / len(good2), (1 - rate) / len(bad2)) * len(y)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - self.mean) / self.scale
        self.used = min(COVARIATES, key=lambda n: _log_loss(z[:, :n], y, weight)) if min(len(good2), len(bad2)) >= FOLDS else COVARIATES[0]
        fitted = logistic(z[:, : self.used], y, weight, ridge=1.0)
        self.slopes = np.append(fitted[:-1], np.zeros(4 - self.used))
        self.intercept = float(fitted[-1])

    def score(self, text: bytes) -> float:
        z = self.intercept
        if self.compressors:
            z += sum((x - m) / s * w for x, m, s, w in zip(self.compressors.features(text), self.mean.tolist(), self.scale.tolist(), self.slopes.tolist(), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_label: int = PER_LABEL, train_bytes: int = TRAIN_BYTES) -> Model:
    """From the rows of ``labels`` whose label is 0 or 1; others, null ids and ids without a text are not learned from."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}
    rate = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = common.fetch_texts(docs, common.sample_ids(known, "label", per_label, id_col), train_bytes, text_col, id_col)
    return Model(texts.get(1, []), texts.get(0, []), min(0.999, max(0.001, rate)))


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score for each row: null and empty texts get the score of features that are all 0. Repeated rows score alike, ids may be null."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    handle = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text"):
                scores = [handle.value.score(t) for t in common.text_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return common.long_rows(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def op2_compression_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(common.id_remainder("doc_id", 5) == 0, F.lit(False))
    model = train(docs, common.table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

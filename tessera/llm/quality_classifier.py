"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0 < 1 < ... < K. One weight vector over hashed tokens gives every text a position f, and
ordered thresholds t_1 < ... < t_K cut it: P(grade >= k) = sigmoid(f - t_k). The expected grade and the tail
probability of the top grade select documents. Fitting takes a bounded, documented sample of labelled rows;
scoring is a map over the documents with the weights in its closure (at most one a dimension) and without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1 << 20
#: Labelled rows that are fitted, those with the least hash of their id.
SAMPLE = 6_000
EPOCHS, RATE = 200, 0.3
#: L1 penalty, least sampled rows that have a dimension, and L2 penalty of the second fit.
SPARSITY, LEAST_ROWS, DECAY = 2e-3, 5, 1e-4
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE = 300_000


class Hasher:
    """Tokens to dimensions, remembered up to a bound."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """The distinct dimensions of a text: its words and runs of punctuation, lower-cased, and in eighths
        how many of its tokens differ, are punctuation and are shouted."""
        found = _TOKEN.findall(text or "")
        kinds = set(found)
        n = max(1, len(found))
        marks = sum(not t[0].isalnum() for t in found)
        loud = sum(len(t) > 1 and t.isupper() for t in found)
        extra = [f"\x00{name} {8 * k // n}" for name, k in (("kinds", len(kinds)), ("marks", marks), ("loud", loud))]
        kinds = {t.lower() for t in kinds}
        kinds.update(extra)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for t in kinds:
            if t not in known:
                known[t] = zlib.crc32(t.encode("utf-8", "replace")) % DIMENSIONS
        return np.unique(np.fromiter([known[t] for t in kinds], dtype=np.int32, count=len(kinds)))


@dataclass(frozen=True)
class Fitted:
    #: The dimensions with a weight, in order, their weights, and the thresholds.
    dims: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to K: (rows, K)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None] - f[:, None], -50, 50)))

    def full(self) -> np.ndarray:
        """The weight of every dimension."""
        out = np.zeros(DIMENSIONS)
        out[self.dims] = self.weights
        return out

    def positions(self, rows: list[np.ndarray], full: np.ndarray | None = None) -> np.ndarray:
        full = self.full() if full is None else full
        return np.array([full[r].sum() for r in rows], dtype=np.float64)


def _ascend(flat: np.ndarray, owner: np.ndarray, size: int, grades: np.ndarray, top: int, sparsity: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch proximal AdaGrad. The thresholds are a first cut and positive
    steps, so they stay ordered."""
    n, w, theta = len(grades), np.zeros(size), np.concatenate(([-(top - 1) / 2.0], np.zeros(top - 1)))
    g_w, g_t, edge = np.full(size, 1e-6), np.full(top, 1e-6), np.array([np.inf])
    cuts_of = lambda t: t[0] + np.concatenate(([0.0], np.cumsum(np.exp(t[1:]))))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for _ in range(EPOCHS):
        cuts = cuts_of(theta)
        f = np.bincount(owner, weights=w[flat], minlength=n)
        # P(y = k) = s(f - t_k) - s(f - t_k+1) with t_0 = -inf and t_K+1 = inf
        low, high = np.concatenate((-edge, cuts))[grades], np.concatenate((cuts, edge))[grades]
        a, b = np.where(np.isinf(low), 1.0, sigmoid(f - low)), np.where(np.isinf(high), 0.0, sigmoid(f - high))
        p, da, db = np.maximum(a - b, 1e-9), a * (1 - a), b * (1 - b)
        grad = np.bincount(flat, weights=(-(da - db) / p / n)[owner], minlength=size) + decay * w
        by_cut = np.zeros(top)
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, da / p, 0) / n)
        np.add.at(by_cut, np.minimum(grades, top - 1), np.where(grades < top, -db / p, 0) / n)
        after = np.cumsum(by_cut[::-1])[::-1]
        grad_t = np.concatenate(([after[0]], after[1:] * np.exp(theta[1:])))
        g_w += grad * grad
        g_t += grad_t * grad_t
        w -= RATE * grad / np.sqrt(g_w)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * sparsity / np.sqrt(g_w), 0)
        theta -= RATE * grad_t / np.sqrt(g_t)
    return w, cuts_of(theta)


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int) -> Fitted:
    """Maximum likelihood in two deterministic passes: an L1 penalty chooses the dimensions, and these are
    fitted again without it. Without rows there are no weights and the cuts are even."""
    if not rows:
        return Fitted(np.zeros(0, np.int32), np.zeros(0), np.arange(top) - (top - 1) / 2.0)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    dims, flat, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = (often >= LEAST_ROWS)[flat]
    w, _ = _ascend(flat[common], owner[common], len(dims), grades, top, SPARSITY, 0.0)
    chosen = np.flatnonzero(w)
    new = np.full(len(dims), -1)
    new[chosen] = np.arange(len(chosen))
    flat = new[flat]
    w, cuts = _ascend(flat[flat >= 0], owner[flat >= 0], len(chosen), grades, top, 0.0, DECAY)
    return Fitted(dims[chosen], w, cuts)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from the synthetic labels: 0 toxic, 1 of low quality, 2 neither; rows without a label go."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), grade.alias("grade")).where("doc_id is not null and grade is not null")


def learn(docs: DataFrame, ratings: DataFrame, top: int = 2, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Fitted:
    """Fits on at most ``sample`` rated documents; ``ratings`` is (doc_id, grade) with grades 0 to ``top``.

    An id that is rated more than once counts with its least grade, and one that several rows of ``docs`` share with its
    least text (null, as an empty text, only where there is no other)."""
    chosen = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    @F.pandas_udf("binary")
    def features(t: pd.Series) -> pd.Series:
        hashed = Hasher()
        return t.map(lambda x: hashed(x).tobytes())

    # the limit bounds what is broadcast; one row an id comes back
    rated = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "doc_id")
    each = rated.groupBy("doc_id", "grade").agg(F.min("t").alias("t"))
    found = each.select("doc_id", "grade", features("t").alias("x")).orderBy("doc_id").collect()
    return fit([np.frombuffer(r["x"], dtype=np.int32) for r in found], np.array([r["grade"] for r in found], dtype=np.int64), top)


def rate(docs: DataFrame, fitted: Fitted, text: str = "text", into: str = "rating", keep_from: float = 0.5) -> DataFrame:
    """``docs`` with a struct ``into`` (replaced if there): expected_grade, tail (of the top grade) and kept
    (tail at least ``keep_from``, so a tail equal to it is kept). A null text is an empty one; very long texts are read
    whole; every row of the whole table is rated, repeated ones alike; an empty table gives an empty result."""

    @F.pandas_udf("expected_grade double, tail double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashed, full = Hasher(), fitted.full()
        for t in batches:
            tails = fitted.tails(fitted.positions([hashed(x) for x in t], full))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, -1]})

    scored = docs.withColumn(into, score(F.col(f"`{text}`")))
    return scored.withColumn(into, F.struct(f"`{into}`.*", (F.col(f"`{into}`")["tail"] >= keep_from).alias("kept")))

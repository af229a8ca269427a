"""Regularised quadratic discriminant analysis over transformed document statistics.

Training needs only counts, sums and products of the statistics by class, which Spark adds up; the
driver sees those and nothing a row.  Each class keeps the Cholesky factor of its shrunk covariance,
so a score is two triangular solves.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

STATISTICS = ("words", "word_bytes", "symbols", "bars", "shouts", "capitals", "digits", "dup_lines", "same_word", "top_word", "other")
#: Part of the pooled spherical covariance in each class covariance.
SHRINKAGE = 0.01

_KEEP_SYMBOLS = bytes(i for i in range(256) if i not in b"#*$%&|<>@^~=_{}[]\\/")
_NO_CAPITALS = bytes(i for i in range(256) if not 65 <= i <= 90)
_NO_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)
_ASCII = bytes(range(128))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; zeros for NULL, empty or blank texts."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [s for s in raw.split(b"\n") if s.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    top = Counter(words).most_common(1)[0][1] if n >= 20 else 0
    rates = [
        len(raw.translate(None, _KEEP_SYMBOLS)) / n, raw.count(b"|") / n, raw.count(b"!") / n, len(raw.translate(None, _NO_CAPITALS)) / n,
        len(raw.translate(None, _NO_DIGITS)) / n, 1 - len(set(lines)) / max(1, len(lines)), same / n, top / n, len(raw.translate(None, _ASCII)) / len(raw)]
    return [np.log1p(n), np.log1p(len(raw) / n), *[float(np.sqrt(r)) for r in rates]]


def document_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the statistics of every row."""
    def compute(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=["key", "x"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), text).mapInArrow(compute, f"key {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, lower Cholesky factor and log prior; ``centre`` and ``scale`` standardise."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_priors: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, prior in zip(self.means, self.factors, self.log_priors, strict=True):
            u = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - np.log(np.diag(factor)).sum() - 0.5 * (u * u).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant | float:
    """From (count, sums, products) by class; a constant score if fewer than two classes have rows."""
    if set(moments) != {0, 1}:
        return {frozenset([0]): 0.0, frozenset([1]): 1.0}.get(frozenset(moments), 0.5)
    n = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / n
    spread = sum(np.diag(m[2]) for m in moments.values()) / n - centre**2
    scale = np.sqrt(np.where(spread > 1e-12, spread, 1.0))
    means, factors, priors = [], [], []
    for c in (0, 1):
        k, sums, products = moments[c]
        mean = sums / k
        cov = (products / k - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(len(mean))
        means.append((mean - centre) / scale)
        factors.append(np.linalg.cholesky((cov + cov.T) / 2 + 1e-9 * np.eye(len(mean))))
        priors.append(float(np.log(k / n)))
    return Discriminant(centre, scale, means, factors, priors)


def class_moments(rows: DataFrame, label: str = "label", x: str = "x") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and products by class: each batch adds up its own, Spark the rest, cell by cell."""
    d = len(STATISTICS)

    def partial(batches):
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, d)
            v1 = np.hstack([np.ones((len(v), 1)), v])
            for c in np.unique(y):
                m = v1[y == c]
                yield pa.record_batch({"label": pa.array([int(c)] * (d + 1) ** 2, pa.int64()), "cell": pa.array(range((d + 1) ** 2), pa.int32()), "v": (m.T @ m).ravel()})

    sums = rows.select(F.col(label).cast("bigint"), x).mapInArrow(partial, "label bigint, cell int, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(int(r["label"]), np.zeros((d + 1) ** 2))[r["cell"]] = r["v"]
    return {c: (m[0], m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for c, m in out.items()}


def apply_discriminant(stats: DataFrame, model: Discriminant | float) -> DataFrame:
    """(key, score) of every row of ``document_statistics``."""
    def score(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            s = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    return stats.mapInArrow(score, f"key {dict(stats.dtypes)['key']}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, score) of every row of ``docs``, learnt from all rows of ``labels`` (key, label 0 or 1).

    Rows of ``labels`` without a document, or whose key or label is NULL, teach nothing.  Texts do not
    move: the statistics join the labels.  Without labels every score is 0.5; with one class, that class.
    """
    stats = reliable_checkpoint(document_statistics(docs, key, text))
    taught = stats.join(labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").isin(0, 1)), "key")
    return apply_discriminant(stats, fit(class_moments(taught))).withColumnRenamed("key", key)

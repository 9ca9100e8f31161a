"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shopfloor.sources.staging import stage

FEATURES = [
    "log_words", "log_chars", "word_length", "word_length_spread", "distinct_share", "adjacent_repeats", "upper_share",
    "digit_share", "symbol_share", "bang_share", "bar_share", "comma_stop_share", "line_rate", "non_ascii_share",
]
SHRINKAGE = 0.1
CLIP = 12.0
_SYMBOLS = np.frombuffer(b"#*$%&<>=_{}[]^~@", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(data, minlength=256)
    words = text.split()
    n, chars = len(words), len(text)
    per_word = lambda k: math.log1p(20.0 * k / max(n, 1))
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    letters = int(seen[65:91].sum() + seen[97:123].sum())
    return [
        math.log1p(n),
        math.log1p(chars),
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        len(set(words)) / max(n, 1) * math.log1p(n),
        per_word(sum(map(eq, words, words[1:]))),
        math.log1p(20.0 * seen[65:91].sum() / max(letters, 1)),
        per_word(seen[48:58].sum()),
        per_word(seen[_SYMBOLS].sum()),
        per_word(seen[33]),
        per_word(seen[124]),
        per_word(seen[44] + seen[46]),
        per_word(seen[10]),
        math.log1p(20.0 * seen[128:].sum() / len(data)),
    ]


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add the statistics of each whole text as array<double>."""
    @arrow_udf("array<double>")
    def stats(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([statistics(t.as_py()) for t in part], pa.list_(pa.float64()))

    return df.withColumn(out, stats(F.col(text)))


@dataclass
class Discriminant:
    """Two Gaussians over scaled statistics; the Cholesky factors of their covariances are computed once."""

    center: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_prior: float
    share: float
    """Share of label 1 among what was learned; the score where a class could not be learned."""
    usable: bool

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Posterior probability of label 1."""
        if not self.usable:
            return np.full(len(stats), self.share)
        x = np.clip((stats - self.center) / self.scale, -CLIP, CLIP)
        density = []
        for mean, factor in zip(self.means, self.factors):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.log_prior, -500, 500)))


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From count, sum and sum of outer products of each class.

    Each class covariance is drawn by ``shrinkage`` towards its own mean variance
    times the identity, so it stays regular with few rows or constant statistics.
    """
    d = len(FEATURES)
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    both = [moments.get(k, none) for k in (0, 1)]
    n = sum(m[0] for m in both)
    share = both[1][0] / n if n else 0.5
    center = sum(m[1] for m in both) / max(n, 1)
    scale = np.sqrt(np.maximum(np.diag(sum(m[2] for m in both)) / max(n, 1) - center**2, 0.0))
    scale[scale < 1e-6] = 1.0
    means, factors = [], []
    for count, total, outer in both:
        mean = total / max(count, 1)
        cov = (outer / max(count, 1) - np.outer(mean, mean)) / np.outer(scale, scale)
        target = max(float(np.trace(cov)) / d, 1e-3)
        cov = (1 - shrinkage) * cov + shrinkage * target * np.eye(d)
        means.append((mean - center) / scale)
        factors.append(np.linalg.cholesky((cov + cov.T) / 2 + 1e-6 * np.eye(d)))
    usable = all(m[0] >= 2 for m in both)
    prior = math.log(both[1][0] / both[0][0]) if usable else 0.0
    return Discriminant(center, scale, tuple(means), tuple(factors), prior, share, usable)


def learn(rows: DataFrame, stats: str = "stats", label: str = "label") -> Discriminant:
    """Fit on all rows with label 0 or 1; the moments are summed in Spark, per task and then over tasks."""
    d = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
            y = np.array(batch.column(1).to_pylist(), np.int64)
            x1 = np.hstack([np.ones((len(x), 1)), x])
            for k in (0, 1):
                if (y == k).any():
                    sums[k] = sums.get(k, 0) + x1[y == k].T @ x1[y == k]
        labels, vectors = list(sums), [s.ravel().tolist() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(vectors, pa.list_(pa.float64()))], names=["label", "sums"])

    known = rows.where(F.col(label).isin(0, 1)).select(stats, F.col(label).cast("int"))
    summed = (
        known.mapInArrow(partial, "label int, sums array<double>")
        .select("label", F.posexplode("sums"))
        .groupBy("label", "pos")
        .agg(F.sum("col").alias("sum"))
        .collect()  # (d + 1)^2 numbers for each of two labels
    )
    moments = {}
    for k in (0, 1):
        m = np.zeros((d + 1) ** 2)
        for row in summed:
            if row["label"] == k:
                m[row["pos"]] = row["sum"]
        m = m.reshape(d + 1, d + 1)
        if m[0, 0]:
            moments[k] = (float(m[0, 0]), m[0, 1:], m[1:, 1:])
    return discriminant(moments)


def with_scores(df: DataFrame, model: Discriminant, stats: str = "stats", out: str = "score") -> DataFrame:
    @arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(model.scores(np.array(part.to_pylist(), np.float64).reshape(-1, len(FEATURES))), pa.float64())

    return df.withColumn(out, score(F.col(stats)))


def classify(
    docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) to every document.

    Learns from the labels of documents where ``learn_from`` (over ``key``) holds;
    labels other than 0 and 1 are ignored, repeated ones count as often as they
    stand. If a class has fewer than two rows, every score is the share of label 1
    (0.5 without labels). Null and empty texts are scored by their statistics.
    Returns the key, stats and score; rows are kept, repeated ones too.
    """
    measured = stage(with_statistics(docs.select(key, text), text).drop(text), "document-stats")
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("label"))
    model = learn(measured.where(learn_from).join(known, key))
    return with_scores(measured, model)

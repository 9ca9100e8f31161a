"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a window, the largest
response of each filter is kept, and a softmax layer reads the language off.
Texts of any length are cut into windows that together cover all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from shopfloor.llm.workers import own_turn

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
TRAIN_ROWS = 1_500
"""Labelled rows per language that the network is fitted on at most (about: rows are drawn by a hash of their text)."""
TRAIN_CHARS = 1_024
STEPS = 700
_LETTER = re.compile("[A-Za-z]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text)))


def windows(text: str) -> np.ndarray:
    """All bytes of a text as rows of WINDOW bytes, A-Z lower-cased; the last row is padded with zeros."""
    data = _LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    padded = np.zeros(-(-len(data) // WINDOW) * WINDOW, np.uint8)
    padded[: len(data)] = data
    return padded.reshape(-1, WINDOW)


@dataclass
class Network:
    """Parameters: byte embedding, one filter bank per width, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> "Network":
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        embedding = draw(256, EMBEDDING, by=1)
        embedding[0] = 0
        wide = FILTERS * len(WIDTHS)
        return cls(
            languages,
            embedding,
            [draw(w * EMBEDDING, FILTERS, by=w * EMBEDDING) for w in WIDTHS],
            np.zeros(wide, np.float32),
            draw(wide, len(languages), by=wide),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.weights, self.offset]

    def _columns(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Embedded bytes of every position, side by side for a filter of that width."""
        x = self.embedding[rows].reshape(len(rows), -1)
        seen = np.lib.stride_tricks.sliding_window_view(x, width * EMBEDDING, axis=1)
        return seen[:, ::EMBEDDING]

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Language probabilities of windows."""
        widest = max(WIDTHS)
        # All filters in one product: narrow ones are padded with zeros, and the windows with zero bytes.
        bank = np.zeros((widest * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
        for k, f in enumerate(self.filters):
            bank[: len(f), k * FILTERS : (k + 1) * FILTERS] = f
        found = np.empty((len(rows), bank.shape[1]), np.float32)
        for at in range(0, len(rows), 32):
            part = np.pad(rows[at : at + 32], ((0, 0), (0, widest - 1)))
            columns = np.ascontiguousarray(self._columns(part, widest)).reshape(-1, widest * EMBEDDING)
            found[at : at + 32] = (columns @ bank).reshape(len(part), -1, bank.shape[1]).max(axis=1)
        return softmax(np.maximum(found + self.bias, 0) @ self.weights + self.offset)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy; only the positions that won the pooling take part."""
        n = len(rows)
        rows = np.pad(rows, ((0, 0), (0, max(WIDTHS) - 1)))
        pooled, winners = [], []
        for width, bank in zip(WIDTHS, self.filters):
            columns = self._columns(rows, width)[:, :WINDOW]
            response = np.ascontiguousarray(columns).reshape(-1, width * EMBEDDING) @ bank
            response = response.reshape(n, -1, FILTERS)
            best = response.argmax(axis=1)
            winners.append((columns, best))
            pooled.append(np.take_along_axis(response, best[:, None], 1)[:, 0])
        before = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(before, 0)
        wrong = softmax(hidden @ self.weights + self.offset)
        wrong[np.arange(n), labels] -= 1
        wrong /= n
        back = (wrong @ self.weights.T) * (before > 0)
        embedding = np.zeros_like(self.embedding)
        banks = []
        for k, (width, bank, (columns, best)) in enumerate(zip(WIDTHS, self.filters, winners)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = columns[np.arange(n)[:, None], best]
            banks.append(np.einsum("bf,bfx->xf", part, seen))
            to_bytes = (part[:, :, None] * bank.T[None]).reshape(-1, width, EMBEDDING)
            where = (best[:, :, None] + np.arange(width)).reshape(-1, width)
            np.add.at(embedding, rows[np.repeat(np.arange(n), FILTERS)[:, None], where], to_bytes)
        embedding[0] = 0
        return [embedding, *banks, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], steps: int = STEPS, batch: int = 64, seed: int = 0) -> Network:
    """Train on labelled texts: each step takes windows of random place and length, languages in equal shares."""
    names = sorted(set(languages))
    net = Network.fresh(names, seed)
    if len(names) < 2:
        return net
    data = [windows(t).ravel() for t in texts]
    lengths = [int(np.count_nonzero(d)) or 1 for d in data]
    of = [np.flatnonzero(np.array(languages) == n) for n in names]
    rng = np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(names), batch)
        rows = np.zeros((batch, WINDOW), np.uint8)
        for i, label in enumerate(labels):
            k = int(rng.choice(of[label]))
            size = min(int(rng.integers(12, WINDOW + 1)), lengths[k])
            at = int(rng.integers(0, lengths[k] - size + 1))
            rows[i, :size] = data[k][at : at + size]
        rate = 0.004 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, m, v, g in zip(params, first, second, net.gradients(rows, labels)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def training_rows(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = TRAIN_ROWS) -> list[tuple[str, str]]:
    """A bounded sample of (text, language): at most ``per_language`` distinct texts each, those of the least hashes.

    Of long texts a stretch of TRAIN_CHARS characters from a hashed place is used.
    Copies of a text are drawn once, however many rows hold them.
    """
    usable = df.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    usable = usable.withColumn("mark", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n")).collect()}
    if not counts:
        return []
    # Half as many again as are wanted, so that the cut below decides whatever the error of the estimate.
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, 1.5 * per_language / max(n, 1)))])
    place = F.pmod(F.shiftright("mark", 20), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(1))).cast("int") + 1
    drawn = usable.where(F.pmod("mark", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    drawn = drawn.select("lang", "mark", F.substring(F.col("text"), place, F.lit(TRAIN_CHARS)).alias("text")).distinct()
    least = Window.partitionBy("lang").orderBy(F.pmod("mark", F.lit(1 << 20)), "mark", "text")
    rows = drawn.withColumn("at", F.row_number().over(least)).where(F.col("at") <= per_language).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in rows)


def identify(
    df: DataFrame,
    learn: Column | None = None,
    text: str = "text",
    lang: str = "lang",
    per_language: int = TRAIN_ROWS,
    out: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Add the predicted language and its score to every row.

    The network learns from rows where ``learn`` holds and ``lang`` is known; no
    other column is an input. A text's probabilities are the mean over windows
    that cover all of it; ``score`` is the largest. Null texts, texts without a
    letter, and all texts when there is nothing to learn from, are ``und`` with
    score 0. Rows are kept as they are; columns of the names in ``out`` are replaced.
    """
    sample = training_rows(df if learn is None else df.where(learn), text, lang, per_language)
    net = fit([t for t, _ in sample], [l for _, l in sample])

    @arrow_udf("lang_pred string, score double")
    @own_turn()
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            found = list(predicted(net, (t.as_py() for t in part)))
            names, scores = zip(*found) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return (
        df.withColumn("_language", predict(F.col(text)))
        .withColumn(out[0], F.col("_language.lang_pred"))
        .withColumn(out[1], F.col("_language.score"))
        .drop("_language")
    )


def predicted(net: Network, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
    """(language, score) of each text; windows of many texts go through the network together."""
    held: list[np.ndarray] = []
    sums: list[tuple[np.ndarray, int] | None] = []

    def flush() -> Iterator[tuple[str, float]]:
        if held:
            p = net.probabilities(np.concatenate(held))
        at = 0
        for waiting in sums:
            if waiting is None:
                yield UNKNOWN, 0.0
                continue
            total, n = waiting
            mean = (total + p[at : at + n].sum(axis=0)) / n
            at += n
            yield net.languages[int(mean.argmax())], float(min(1.0, mean.max()))
        held.clear()
        sums.clear()

    size = 0
    for text in texts:
        if not net.languages or not has_letter(text):
            sums.append(None)
            continue
        rows = windows(text)
        held.append(rows)
        sums.append((np.zeros(len(net.languages)), len(rows)))
        size += len(rows)
        if size >= 4_096:
            yield from flush()
            size = 0
    yield from flush()

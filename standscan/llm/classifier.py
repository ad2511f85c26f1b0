"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are words and word pairs hashed to ``2**bits`` weights; a feature's value is
``1 + log(count)``, divided by the Euclidean norm of the text. Spark tasks hash the
training texts; the per-coordinate FTRL-proximal updates then run over the bounded
sample in an order fixed by a hash of the ids. A score is the logistic function of a
sparse dot product, computed batch by batch.

The fit reads at most ``max_rows`` labelled rows (those with the smallest hashes), a
documented bound; scoring reads every whole text.

Defined results: a null or empty text has no features and gets the score of the bias
alone. Without training rows every score is 0.5. Labels other than 0 and 1, and null
ids, are not learned from; a repeated label row counts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standscan.llm.batches import slices

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray = field(repr=False)
    bias: float = 0.0
    bits: int = 18


class Features:
    """Hashed n-grams of a text; remembers the hashes of recent words."""

    def __init__(self, bits: int, max_words: int = 100_000) -> None:
        self.shift = np.uint64(64 - bits)
        self.max_words = max_words
        self.known: dict[str, int] = {}

    def _new(self, word: str) -> int:
        if len(self.known) >= self.max_words:
            self.known.clear()
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            self.known[word] = value
        return value

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature numbers and their values."""
        words = text.lower().split() if text else []
        if not words:
            return np.empty(0, "i4"), np.empty(0, "f4")
        get, new = self.known.get, self._new
        h = np.array([get(w) or new(w) for w in words], dtype="u8")
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * MIX) ^ (h[1:] + (h[:-1] >> np.uint64(7)))
            slots = (np.concatenate([h, pairs]) * MIX) >> self.shift
        index, counts = np.unique(slots.astype("i4"), return_counts=True)
        values = (1.0 + np.log(counts)).astype("f4")
        return index, values / np.sqrt((values * values).sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> Model:
    """FTRL-proximal with per-coordinate rates over ``rows`` in the given order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for index, values, label in rows:
            i = np.append(index, size - 1)
            x = np.append(values, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size))
    return Model(w[:-1].astype("f4"), float(w[-1]), bits)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_rows: int = 8000,
    bits: int = 18,
    epochs: int = 6,
    alpha: float = 4.0,
    beta: float = 1.0,
    l1: float = 0.0005,
    l2: float = 0.0,
) -> Model:
    """Learn from the ``max_rows`` labelled rows with the smallest hashes of their ids."""
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
        .select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(id_col).cast("string")).alias("o"))
        .orderBy("o", "k", "y")
        .limit(max_rows)
    )
    sample = docs.select(F.col(id_col).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k").select("o", "k", "y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in slices(batches):
            made = [features.of(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("o"),
                    batch.column("y"),
                    pa.array([m[0].tobytes() for m in made], pa.binary()),
                    pa.array([m[1].tobytes() for m in made], pa.binary()),
                ],
                names=["o", "y", "i", "x"],
            )

    hashed = sample.mapInArrow(run, "o bigint, y int, i binary, x binary").orderBy("o", "y", "i").limit(max_rows)
    rows = [(np.frombuffer(r["i"], "i4"), np.frombuffer(r["x"], "f4"), r["y"]) for r in hashed.toLocalIterator()]
    if not rows:
        return Model(np.zeros(1 << bits, "f4"), 0.0, bits)
    return ftrl(rows, bits, epochs, alpha, beta, l1, l2)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", cut: float = 0.3, extra: dict[str, Column] | None = None) -> DataFrame:
    """``(id, *extra, score, predicted)`` for every row; ``predicted`` is 1 from ``cut`` up."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = extra or {}
    names = ["k", *[f"x{i}" for i in range(len(extra))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        features = Features(held.bits)
        for batch in slices(batches):
            scores = []
            for t in batch.column("t").to_pylist():
                index, values = features.of(t)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(float(held.weights[index] @ values) + held.bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(scores, pa.float64())], names=[*names, "s"])

    df = docs.select(F.col(id_col).alias("k"), *[c.alias(f"x{i}") for i, c in enumerate(extra.values())], F.col(text).alias("t"))
    out = df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes[:-1]) + ", s double")
    return out.select(F.col("k").alias(id_col), *[F.col(f"x{i}").alias(n) for i, n in enumerate(extra)], F.col("s").alias("score"), (F.col("s") >= cut).cast("int").alias("predicted"))

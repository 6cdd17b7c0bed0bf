"""Quality by ordinal regression: hashed text, one weight vector, ordered thresholds."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pangrove.llm.training import held_out, labelled_sample

BITS = 16
#: Words whose hashes a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


@dataclass
class Model:
    """``weights`` of hashed features and ``thresholds`` between grades, rising."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]


def _index(feature: bytes) -> int:
    return zlib.crc32(feature) & ((1 << BITS) - 1)


#: A-Z, a-z with all bytes of other scripts, and 0-9 as one class each; other signs stay.
_CLASSES = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _shape(word: bytes) -> bytes:
    """A word's letters and digits as classes, runs once; its other signs as they are."""
    return b"\x00" + _RUNS.sub(rb"\1", word.translate(_CLASSES))


class Features:
    """Hashed features of a text: words, word shapes, and repetition; unit length."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode("utf-8").split()
        if not words:
            return np.array([_index(b"\x01empty")]), np.ones(1)
        freq = Counter(words)
        if len(self.known) + len(freq) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in freq:
            if w not in known:
                known[w] = _index(w.lower()) << BITS | _index(_shape(w))
        pairs = np.fromiter(map(known.__getitem__, freq), np.int64, len(freq))
        counts = np.fromiter(freq.values(), float, len(freq))
        words_x = np.log1p(counts)
        shapes, where = np.unique(pairs & ((1 << BITS) - 1), return_inverse=True)
        shape_share = np.bincount(where, counts) / len(words)
        again = sum(map(operator.eq, words, words[1:])) / len(words)
        lines = text.split("\n")
        extra = [1.0, again, 1 - len(freq) / len(words), 1 - len(set(lines)) / len(lines)]
        index = np.concatenate([pairs >> BITS, shapes, [_index(b"\x01" + bytes([k])) for k in range(len(extra))]])
        return index, np.concatenate([words_x / np.sqrt((words_x**2).sum()), 2 * np.sqrt(shape_share), extra])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(sample: list[tuple[int, str]], ridge: float = 1e-4, steps: int = 300, rate: float = 0.05) -> Model:
    """Cumulative-link regression: P(grade > k) = sigmoid(score - threshold k).

    Full-batch Adam on the weights and on the thresholds, which are a first
    value plus positive steps, so they stay in order.  A sample with fewer
    than two grades gives a model that expects that grade.
    """
    grades = sorted({y for y, _ in sample})
    weights = np.zeros(1 << BITS)
    if len(grades) < 2:
        return Model(weights, np.zeros(0), grades or [0])
    features = Features()
    parts = [features.of(t) for _, t in sample]
    rows = np.repeat(np.arange(len(parts)), [len(i) for i, _ in parts])
    index, value = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
    y = np.array([grades.index(g) for g, _ in sample])
    balance = 1 / np.bincount(y)[y]
    balance = 0.5 * balance / balance.sum() + 0.5 / len(y)
    above = y[:, None] > np.arange(len(grades) - 1)[None, :]
    cuts = np.concatenate([[0.0], np.zeros(len(grades) - 2)])
    moments = [np.zeros(weights.size + cuts.size), np.zeros(weights.size + cuts.size)]
    for step in range(1, steps + 1):
        thresholds = cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])
        score = np.bincount(rows, weights[index] * value, len(parts))
        wrong = (_sigmoid(score[:, None] - thresholds[None, :]) - above) * balance[:, None]
        by_score = np.bincount(index, value * wrong.sum(axis=1)[rows], weights.size) + ridge * weights
        by_cut = -wrong.sum(axis=0)
        by_cuts = np.concatenate([[by_cut.sum()], np.exp(cuts[1:]) * by_cut[1:][::-1].cumsum()[::-1]])
        g = np.concatenate([by_score, by_cuts])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[: weights.size]
        cuts -= move[weights.size :]
    return Model(weights, cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))]), grades)


def rate_text(model: Model, features: Features, text: str) -> tuple[float, np.ndarray]:
    """The expected grade and the probability of each grade or better."""
    index, value = features.of(text)
    tails = np.concatenate([[1.0], _sigmoid(model.weights[index] @ value - model.thresholds)])
    return float(model.grades[0] + np.diff(model.grades) @ tails[1:]), tails


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 2000, label: str = "quality") -> Model:
    """Train on ``most`` rated documents of each grade at most (the bound of the sample)."""
    return train(labelled_sample(docs, labels, label, most))


def score_quality(
    docs: DataFrame, model: Model, tail: int | None = None, keep_above: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, held_out, expected_grade, tail_probability, keep)`` for every row.

    ``tail_probability`` is that of grade ``tail`` (the highest, if not given)
    or better; rows of ``keep_above`` or more are kept.  Whole texts count.
    Null and empty texts have one feature of their own.  Rows are independent:
    ties, repeated rows and null ids (never held out) come out as they came in;
    an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    at = len(model.grades) - 1 if tail is None else int(np.searchsorted(model.grades, tail))
    packed = Model(model.weights.astype(np.float32), model.thresholds, model.grades)

    def run(batches):
        features = Features()
        for batch in batches:
            rated = [rate_text(packed, features, t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([e for e, _ in rated], pa.float64()), pa.array([float(t[at]) if at < len(t) else 0.0 for _, t in rated], pa.float64())],
                names=[id_col, "expected_grade", "tail_probability"],
            )

    rated = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, expected_grade double, tail_probability double"
    )
    return rated.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "expected_grade", "tail_probability",
        (F.col("tail_probability") >= keep_above).alias("keep"),
    )

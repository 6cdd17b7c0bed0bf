"""Toxicity by compression distance: two zstandard dictionaries, compared window by window."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pangrove.llm.training import held_out, labelled_sample, logistic, without_copies

WINDOW = 8  # words in a window


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


def _starts(word: bytes) -> set[bytes]:
    """The padded word's beginnings of 5 to 10 bytes; short words count whole."""
    padded = b" " + word + b" "
    return {padded[:n] for n in range(min(5, len(padded)), min(10, len(padded)) + 1)}


def _evidence(a: int, n1: int, b: int, n0: int) -> float:
    """Log-likelihood ratio of a in n1 against b in n0; 0 unless the first share is the larger."""
    if a * n0 <= b * n1:
        return 0.0
    term = lambda k, n, p: (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)
    p = (a + b) / (n1 + n0)
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: list[float]


class Scorer:
    """A model's two compressors, made once in a worker."""

    def __init__(self, model: Model):
        # The compressor keeps the tables of its dictionary; windows are far smaller than they are.
        make = lambda d: zs.ZstdCompressor(
            dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT),
            compression_params=zs.ZstdCompressionParameters(
                window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16,
                strategy=zs.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            ),
        )
        self.same = model.ordinary == model.toxic
        self.compressors = make(model.ordinary), make(model.toxic)
        self.weights = np.array(model.weights)

    def distances(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, for each window."""
        some = windows(words_of(text))
        if not some or self.same:
            return np.zeros(max(1, len(some)), np.int64)
        a, b = (np.fromiter((len(c.compress(w)) for w in some), np.int64, len(some)) for c in self.compressors)
        return a - b

    def features(self, text: str) -> np.ndarray:
        d = np.sort(self.distances(text))[::-1]
        top = np.concatenate([d[:3], np.zeros(3, np.int64)])[:3]
        return np.array([top[0], top[1], top[2], min(top[0], 4), (d >= 3).sum() / len(d), math.log(len(d))], float)

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(sample: list[tuple[int, str]], size: int = 8192, least: float = 18.0) -> Model:
    """Dictionaries from one half of the sample, thresholds calibrated on the other.

    The ordinary dictionary holds the most frequent words of ordinary texts.
    The toxic one holds the segments whose beginnings toxic texts have and
    ordinary texts lack (log-likelihood ratio ``least`` or more), followed by
    the same frequent words, at the same distances: so a window that the toxic
    dictionary compresses better holds text of that class, and all others come
    out alike.  A sample with one label only gives a model that scores its share.
    """
    kept = without_copies(sample)
    fit, tune = kept[::2], kept[1::2]
    n = [sum(y == c for y, _ in fit) for c in (0, 1)]
    if not all(n):
        share = min(0.99, max(0.01, sum(y for y, _ in sample) / max(1, len(sample))))
        return Model(b" ", b" ", [0.0] * 6 + [math.log(share / (1 - share))])
    starts, texts, common = (Counter(), Counter()), Counter(), Counter()
    for y, text in fit:
        w = words_of(text)
        starts[y].update(set().union(*map(_starts, set(w))))
        if y:
            texts.update(set(w))
        else:
            common.update(w)
    telling = {
        s for s, a in starts[1].items()
        if a >= 2 and a * n[0] > 10 * starts[0][s] * n[1] and _evidence(a, n[1], starts[0][s], n[0]) >= least
    }
    found = [w for w, _ in texts.most_common() if _starts(w) & telling]
    join = lambda ws: b"".join(b" " + w + b" " for w in reversed(ws))[-size:]
    ordinary = join([w for w, _ in common.most_common(size // 2)])
    model = Model(ordinary, join(found) + ordinary, [0.0] * 7)
    scorer = Scorer(model)
    x = np.array([scorer.features(t) for _, t in tune] or np.zeros((0, 6)))
    y = np.array([y for y, _ in tune], float)
    if 0 < y.sum() < len(y):
        model.weights = logistic(x, y, 0.3).tolist()
    else:
        model.weights = [1.0, 0, 0, 0, 0, 0, -3.5]
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """Train on ``most`` labelled documents of each label at most (the bound of the sample)."""
    return train(labelled_sample(docs, labels, "toxic", most))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every row; each window of the whole text is compared.

    Null and empty texts have no window and get the score of a text without
    evidence.  Only the text counts; rows are independent, so ties and repeated
    rows come out as they came in, a null id is kept (and never held out), and
    an empty table gives an empty table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = np.fromiter((scorer.score(t.as_py() or "") for t in batch.column(1)), float, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    scored = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``.

    Null and empty texts get the score of a text without evidence; repeated
    rows and null ids come out as they came in, whatever the other columns are
    called; an empty table gives an empty table.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in parts:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype=float)

    return docs.where(score(F.col(text_col).cast("string")) < threshold)

"""What the trained operators share: labelled samples, sketches, small regressions."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, str]]:
    """``(label, whole text)`` of training rows, ``most`` of each label at most, those of least hash.

    Only rows outside the held-out fold are read.  The bound is a parameter of
    the trained operators; everything else they do covers all rows.  All labels
    count, however many there are.  An id that is rated twice alike is one row;
    of documents with one id the text of least hash counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y")).where("y is not null").distinct()
    values = [r[0] for r in known.select("y").distinct().orderBy("y").collect()]
    chosen = None
    for y in values:  # a top-k for each of the few grades
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return []
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("t"))
    rows = rows.select("y", "t.t", F.xxhash64("k").alias("h")).collect()  # ``most`` rows of each label at most
    return [(r.y, r.t) for r in sorted(rows, key=lambda r: (r.h, r.y, r.t))]


def without_copies(sample: list[tuple[int, str]], share: float = 0.7) -> list[tuple[int, str]]:
    """The sample less near copies, so that a copied text doesn't count as many."""
    seen: dict[int, list[int]] = {}
    kept: list[tuple[int, str]] = []
    for y, text in sample:
        sketch = sorted({zlib.crc32(w) for w in text.encode().lower().split()})[:16]
        hits: dict[int, int] = {}
        for h in sketch:
            for k in seen.get(h, ()):
                hits[k] = hits.get(k, 0) + 1
        if hits and max(hits.values()) >= share * len(sketch):
            continue
        for h in sketch:
            seen.setdefault(h, []).append(len(kept))
        kept.append((y, text))
    return kept


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w

"""Helpers that several operators share: folders, checkpoints, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from pangrove.operators.components import connected_components
from pangrove.plans.storage import checkpointed, discard, release, remove, shared_dir, written

__all__ = [
    "arrow_rows", "checkpointed", "connected_components", "discard", "forest", "least_labels", "release", "remove", "session_partitions", "shared_dir", "store", "written",
]


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, of a local path or a URI."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """While it lasts, tables go to Python ``most`` rows at a time, at most; for actions within, as texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def session_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, for edges between ``a`` and ``b``."""
    label = np.arange(n, dtype=np.int64)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same components as those given, fewer than ``n``."""
    label = least_labels(n, a, b)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]

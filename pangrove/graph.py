"""A pangenome graph as four DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Graph:
    """``segments(node, length, sn, so, sr, ord)``, ``links(link, src, src_rev, tgt, tgt_rev)``,
    ``lines(line, name, written, start, ord)`` and ``steps(line, i, node, rev)``.

    ``ord`` is the order of the input; node names may be of any type that sorts.
    ``longest`` is the most steps of a line, where that is known.
    """

    segments: DataFrame
    links: DataFrame
    lines: DataFrame
    steps: DataFrame
    longest: int | None = None

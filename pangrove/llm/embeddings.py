"""Embedding near duplicates with an inverted multi-index."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pangrove.llm.common import connected_components, discard, least_labels, session_partitions, written

#: Vectors in a block of a cell; a task compares two blocks at a time.
BLOCK = 1024
#: Steps in which the slack is measured: squared distances of unit vectors reach 4.
STEP, BINS = 0.01, 401
#: Probes with links that a calibration takes; links up to which a probe's are few; recall below which the exact bound is kept.
ENOUGH, FEW, LEAST_RECALL = 300, 8, 0.99


@dataclass
class Index:
    """Codebooks of the two vector halves, and how far beyond its own cell a query looks.

    ``apart`` is the greatest squared distance of linked vectors.  Without a
    slack only the exact bound holds, which no link outgrows.  ``recall`` was
    measured on probes that did not set the slack.
    """

    first: np.ndarray
    second: np.ndarray
    slack: float | None
    apart: float
    recall: float | None = None

    def most(self, own: np.ndarray) -> np.ndarray:
        """The squared distance up to which a query looks whose own cell lies at ``own``.

        A link's cell center is no farther from the link than the query's own
        center is, so no farther from the query than its own center and twice
        the link's distance.
        """
        exact = (np.sqrt(own) + 2 * np.sqrt(max(0.0, self.apart))) ** 2 + 1e-6
        return np.round(exact if self.slack is None else np.minimum(own + self.slack, exact), 9)

    def costs(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half to each of its codebook's entries."""
        half = self.first.shape[1]
        part = lambda x, c: np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :])
        return part(unit[:, :half], self.first), part(unit[:, half:], self.second)

    def own(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Cells in order of distance, by multi-sequence traversal, as far as the slack goes."""
        i, j = a.argsort(kind="stable"), b.argsort(kind="stable")
        most = self.most(a[i[0]] + b[j[0]])
        heap, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
        while heap:
            cost, x, y = heapq.heappop(heap)
            if np.round(cost, 9) > most:
                break
            out.append(int(i[x]) * len(self.second) + int(j[y]))
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < len(i) and v < len(j) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(heap, (a[i[u]] + b[j[v]], u, v))
        return out


def _k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centers * centers).sum(1)[None, :] - 2 * (x @ centers.T)).argmin(1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, near, x)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return centers


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _link_reach(classes: DataFrame, index: Index, cls: np.ndarray, probes: np.ndarray, threshold: float) -> np.ndarray:
    """How far beyond each probe's own cell its links' cells lie, by brute force over all rows.

    An array of (even or odd probes, many or few links, steps beyond).  A probe
    with links counts once, however many they are, so a large group never
    outweighs the small ones.
    """
    packed = pickle.dumps((index, cls, probes))

    def run(batches):
        index, cls, probes = pickle.loads(packed)
        qa, qb = index.costs(probes)
        own = qa.min(1) + qb.min(1)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                unit, other = _unit(part.column(0).to_pylist()), part.column(1).to_numpy()
                cell = index.own(*index.costs(unit))
                keys = []
                for first in range(0, len(probes), 2048):
                    q, x = np.nonzero(probes[first : first + 2048] @ unit.T >= threshold)
                    q += first
                    q, x = q[cls[q] != other[x]], x[cls[q] != other[x]]
                    extra = qa[q, cell[x] // len(index.second)] + qb[q, cell[x] % len(index.second)] - own[q]
                    keys.append(q * BINS + np.clip(np.ceil(extra / STEP), 0, BINS - 1).astype(np.int64))
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // BINS), pa.array(key % BINS), pa.array(n)], names=["probe", "bin", "n"])

    each = classes.select("blob", "cls").mapInArrow(run, "probe bigint, bin bigint, n bigint").groupBy("probe", "bin").agg(F.sum("n").alias("n"))
    each = written(each, "vector-probes")
    share = each.join(each.groupBy("probe").agg(F.sum("n").alias("links")), "probe")
    sides = ((F.col("probe") % 2).alias("odd"), (F.col("links") <= FEW).cast("int").alias("few"), "bin")
    out = np.zeros((2, 2, BINS))
    for r in share.groupBy(*sides).agg(F.sum(F.col("n") / F.col("links")).alias("n")).collect():
        out[r.odd, r.few, r.bin] = r.n
    return out


def _calibrate(reach: np.ndarray, whole: bool, target: float) -> tuple[float | None, float | None]:
    """The slack and its recall on probes that did not set it; no slack where the probes do not support one.

    ``whole`` tells that every row is a probe: then the farthest link is known.
    """
    if whole:
        bins = np.flatnonzero(reach.sum(axis=(0, 1)))
        return STEP * (int(bins.max(initial=0)) + 1), 1.0
    if reach[0].sum() < ENOUGH - 0.5:
        return None, None
    most = 0
    for side in reach[0]:  # many links and few apart: neither sets the other's slack
        if side.sum() >= ENOUGH - 0.5:
            most = max(most, int(np.searchsorted(np.cumsum(side), target * side.sum())))
        elif side.any():
            most = max(most, int(np.flatnonzero(side).max()))
    recall = min((side[: most + 1].sum() / side.sum() for side in reach[1] if side.any()), default=None)
    return (None, recall) if recall is None or recall < LEAST_RECALL else (STEP * (most + 1), recall)


def fit_index(
    classes: DataFrame, threshold: float, sample: int = 8000, probes: int = 2048, most_probes: int = 16384, target: float = 0.999, seed: int = 5, codes: int = 256
) -> Index:
    """An index fitted on ``sample`` vectors at most (those of least hash), calibrated on probes of greatest hash.

    The codebooks have about the square root of a hundredth of the rows each,
    ``codes`` at most, so a cell of the product grid holds about a hundred rows;
    beyond that cells grow, and are compared block by block as any large cell.
    Where ``probes`` show too few with links, ``most_probes`` (or 64 MB of
    them) are taken; where these show too few as well, the index keeps to the
    exact bound.
    """
    rows = classes.count()
    some = [r.blob for r in classes.orderBy(F.xxhash64("blob"), "cls").limit(sample).select("blob").collect()]
    unit = _unit(some)
    k = max(1, min(codes, int(np.sqrt(rows / 100)), len(unit) // 8 or 1))
    half = unit.shape[1] // 2
    index = Index(_k_means(unit[:, :half], k, seed), _k_means(unit[:, half:], k, seed + 1), None, 2 - 2 * threshold)
    del some, unit
    most_probes = min(most_probes, max(256, 64_000_000 // (16 * half + 8)))
    last = classes.orderBy(F.xxhash64("blob").desc(), "cls").limit(most_probes).select("blob", "cls").collect()
    cls, unit = np.array([r.cls for r in last], np.int64), _unit([r.blob for r in last])
    for n in sorted({min(probes, len(unit)), len(unit)}):
        reach = _link_reach(classes, index, cls[:n], unit[:n], threshold)
        if reach.sum(axis=(1, 2)).min() >= ENOUGH - 0.5 and n < rows:
            break
    index.slack, index.recall = _calibrate(reach, n == rows, target)
    return index


def _search(index: Index, threshold: float, q: dict, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of queries to a cell's members: ids and counts to add, and edges to join."""
    qu, mu = _unit(q["blob"]), _unit(m["blob"])
    sims = qu @ mu.T
    i, j = np.nonzero(sims >= threshold)
    qi, mi = np.array(q["cls"])[i], np.array(m["cls"])[j]
    apart = qi != mi
    i, j = i[apart], j[apart]
    qn, mn = np.array(q["n"]), np.array(m["n"])
    count_q = np.bincount(i, mn[j], len(qn))
    # A member whose own search does not come to the query's cell learns of the link here.
    qa, qb = index.costs(qu)
    ma, mb = index.costs(mu)
    home = index.own(qa, qb)
    n2 = len(index.second)
    far = np.round(ma[j, home[i] // n2] + mb[j, home[i] % n2], 9) > index.most(ma.min(1) + mb.min(1))[j]
    count_m = np.bincount(j[far], qn[i[far]], len(mn))
    ids = np.concatenate([q["cls"], m["cls"]]).astype(np.int64)
    label = least_labels(len(ids), i, len(qn) + j)
    child = np.flatnonzero(label != np.arange(len(ids)))
    return ids, np.concatenate([count_q, count_m]).astype(np.int64), ids[child], ids[label[child]]


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Two vectors link where their cosine in double precision is ``threshold``
    or more.  Equal vectors are one class, so copies never meet in pairs.  An
    inverted multi-index files each class in one cell of a product grid; each
    searches its nearest cells in turn until the target recall, which is
    calibrated by brute force on probes over all rows, each with links counted
    once, and verifies what it finds.  Where probes with links are too few, it
    searches as far as a link can lie.  A link counts for both ends, whichever found it.  Cells are
    cut into blocks, so a large group is many pairs of blocks, each reduced to
    counts and a forest at once.

    Vectors of one length are compared with each other, of another length with
    none; each length has an index of its own, so lengths should be few.  Null
    or zero vectors and those with null or non-finite components link with
    nothing.  A null id is kept and never names a component.  Repeated rows
    link with each other.  An empty table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            blobs = [None if v is None else (np.array(v, "<f8") + 0.0).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["id", "blob"])

    fine = rows.select("id", F.when(_valid(F.col("v")), F.col("v")).alias("v")).mapInArrow(pack, "id bigint, blob binary")
    fine = written(fine.withColumn("size", F.octet_length("blob")), "vectors")
    sizes = [r[0] for r in fine.where("blob is not null").select("size").distinct().orderBy("size").collect()]
    if not sizes:
        return fine.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    nodes = reduce(DataFrame.unionByName, [_linked(fine.where(F.col("size") == n), threshold) for n in sizes])
    out = fine.join(nodes, "blob", "left")
    component = F.when(F.col("blob").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _linked(fine: DataFrame, threshold: float) -> DataFrame:
    """``(blob, n_links, component_id)`` of each distinct vector; all have one length."""
    spark = fine.sparkSession
    classes = fine.groupBy("blob").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # Nodes are named by the least id; a class of null ids alone by a negative number of its hash.
    named = F.coalesce("least", -F.abs(F.xxhash64("blob") / 2).cast("bigint") - 1)
    classes = written(classes.select("blob", named.alias("cls"), "least", "n"), "vector-classes")
    index = fit_index(classes, threshold)
    packed = pickle.dumps(index)

    def file(batches):
        index = pickle.loads(packed)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                a, b = index.costs(_unit(part.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(index.own(a, b)), pa.array([index.visits(x, y) for x, y in zip(a, b)], pa.list_(pa.int64()))],
                    names=["blob", "cls", "n", "cell", "visits"],
                )

    filed = written(classes.select("blob", "cls", "n").mapInArrow(file, "blob binary, cls bigint, n bigint, cell bigint, visits array<bigint>"), "vector-cells")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        sizes = df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("k"))
        dealt = df.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("k")))
        return dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("cls", "n", "blob")).alias(name)).select("cell", name)

    members = blocks(filed.select("cell", "cls", "n", "blob"), "members")
    queries = blocks(filed.select(F.explode("visits").alias("cell"), "cls", "n", "blob"), "queries")
    pairs = queries.join(members, "cell").select("queries", "members").repartition(max(12, session_partitions(spark)))

    def search(batches):
        index = pickle.loads(packed)
        for batch in batches:
            for k in range(batch.num_rows):
                q, m = (
                    {c: rows.field(c).to_pylist() for c in ("cls", "n", "blob")}
                    for rows in (batch.column(0)[k].values, batch.column(1)[k].values)
                )
                ids, counts, child, parent = _search(index, threshold, q, m)
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([ids[some], child])),
                        pa.array(np.concatenate([counts[some], np.zeros(len(child), np.int64)])),
                        pa.array(np.concatenate([np.full(some.sum(), -1), parent]).astype(np.int64), mask=np.concatenate([np.ones(some.sum(), bool), np.zeros(len(child), bool)])),
                    ],
                    names=["cls", "links", "other"],
                )

    found = written(pairs.mapInArrow(search, "cls bigint, links bigint, other bigint"), "vector-links")
    discard(filed)
    links = found.where(F.col("other").isNull()).groupBy("cls").agg(F.sum("links").alias("links"))
    labels = connected_components(found.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b")))
    nodes = (
        classes.select("cls", "least", "n", "blob").join(links, "cls", "left")
        .join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left")
        .select("blob", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    )
    nodes = written(nodes, "vector-nodes")
    least = written(nodes.groupBy("component").agg(F.min("least").alias("component_id")), "vector-least")
    return nodes.join(least, "component").select("blob", "n_links", "component_id")

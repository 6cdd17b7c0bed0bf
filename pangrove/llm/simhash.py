"""SimHash near duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pangrove.llm.common import connected_components, discard, forest, remove, session_partitions, shared_dir, store, written

#: Fingerprints in a tile, about: a task holds two tiles and a strip of their comparison.
TILE = 8192


def fingerprint(text: str | None, words: int = 4, seed: int = 42, lanes: int = 1) -> np.ndarray:
    """The text's SimHash as ``lanes`` 64-bit numbers, one for each seed from ``seed``; zero without words."""
    out = np.zeros(lanes, "<u8")
    w = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not w:
        return out
    n = max(1, len(w) - words + 1)
    shingles = list(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else [b" ".join(w)]
    for lane in range(lanes):
        h = np.fromiter((xxhash.xxh64_intdigest(s, seed + lane) for s in shingles), np.dtype("<u8"), n)
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 1 << 16):
            bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(
    docs: DataFrame, words: int = 4, seed: int = 42, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the lanes' bytes, the least significant first."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed, lanes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {id_type}, fp binary")


# ---- tiles in the shared folder --------------------------------------------


def _record(extra: tuple[str, ...], lanes: int) -> np.dtype:
    return np.dtype([("node", "<i8"), *((c, "<i8") for c in extra), ("fp", "<u8", (lanes,))])


def _own_file(folder: str, kind: str):
    """A file of this attempt of the task: its name, and the stream to write it."""
    context = TaskContext.get()
    name = f"{kind}-{context.partitionId()}-{context.taskAttemptId()}"
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    return name, fs.open_output_stream(f"{root}/{name}")


class Pieces:
    """Stretches of the files in a folder, read where they stand; files stay open."""

    def __init__(self, folder: str):
        self.fs, self.root = store(folder)
        self.open = {}

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 256:
                self.open.clear()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(size, at)


def write_tiles(cells: DataFrame, folder: str, lanes: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` filed by ``(hi, lo, block)`` in the shared folder; returns where each tile stands.

    Tiles are written once and read by the tasks that compare them, so that
    only their places, ``(hi, lo, block, file, at, n)``, are shuffled in pairs.
    Files carry the name of the task's attempt, and only those of the table
    returned count: a lost executor does no harm.
    """
    kind = _record(extra, lanes)

    def run(batches):
        name = out = key = None
        held, at = [], 0

        def flush():
            nonlocal at
            data = b"".join(held)
            out.write(data)
            row = [*key, name, at, len(data) // kind.itemsize]
            at += len(data)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["hi", "lo", "block", "file", "at", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name, out = _own_file(folder, "tiles")
            keys = np.stack([batch.column(c).to_numpy() for c in ("hi", "lo", "block")], axis=1)
            data = np.zeros(batch.num_rows, kind)
            for c in ("node", *extra):
                data[c] = batch.column(c).to_numpy()
            data["fp"] = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, lanes)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:]):
                if held and key != keys[begin].tolist():
                    yield flush()
                key = keys[begin].tolist()
                held.append(data[begin:end].tobytes())
        if held:
            yield flush()
        if out is not None:
            out.close()

    keys = ["hi", "lo", "block"]
    n = max(12, session_partitions(cells.sparkSession))
    sorted_cells = cells.select(*(F.col(c).cast("bigint").alias(c) for c in keys), "node", "fp", *extra).repartition(n, *keys).sortWithinPartitions(*keys)
    return written(sorted_cells.mapInArrow(run, "hi bigint, lo bigint, block bigint, file string, at bigint, n bigint"), "tile-places")


def _tile_pairs(places: DataFrame, reach: int) -> DataFrame:
    """Places of each two tiles, once, whose cells are ``reach`` apart at most; a tile with itself too.

    Pairs come from the number of tiles in each cell, so no task gathers a
    cell's tiles, and are dealt evenly.
    """
    steps = [(x, y) for x in range(0, reach + 1) for y in range(-reach, reach + 1) if abs(x) + abs(y) <= reach and (x, y) >= (0, 0)]
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    sizes = places.groupBy("hi", "lo").agg((F.max("block") + 1).alias("tiles"))  # 33 x 33 cells at most, whatever the input
    left = places.select("hi", "lo", "block", *(F.col(c).alias(f"{c}_a") for c in ("file", "at", "n")), steps.alias("to")).select(
        (F.col("hi") + F.col("to.x")).alias("hi"), (F.col("lo") + F.col("to.y")).alias("lo"),
        F.when((F.col("to.x") == 0) & (F.col("to.y") == 0), F.col("block")).otherwise(F.lit(0)).alias("from"), "file_a", "at_a", "n_a",
    )
    left = left.join(F.broadcast(sizes), ["hi", "lo"]).where(F.col("from") < F.col("tiles"))
    left = left.withColumn("block", F.explode(F.sequence("from", F.col("tiles") - 1))).select("hi", "lo", "block", "file_a", "at_a", "n_a")
    pairs = left.join(places, ["hi", "lo", "block"]).select("file_a", "at_a", "n_a", "file", "at", "n")
    return pairs.repartition(max(12, session_partitions(places.sparkSession)))


def _both_tiles(batches, folder: str, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    pieces = Pieces(folder)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield tuple(np.frombuffer(pieces.read(f, at, n * kind.itemsize), kind) for f, at, n in (row[:3], row[3:]))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


# ---- comparison --------------------------------------------------------------


def _near(a: np.ndarray, b: np.ndarray, first: int, radius: int, apart) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of ``a`` and ``b`` within ``radius`` and, in the first lane, within ``first``, with their distance.

    They come strip by strip; ``apart`` tells of pairs that pass the first lane
    which still matter.
    """
    lanes = a.shape[1]
    part = lambda x: np.bitwise_count(x[:, 0] & np.uint64(0xFFFF0000FFFF0000)).astype(np.int64)
    order_a, order_b = np.argsort(part(a), kind="stable"), np.argsort(part(b), kind="stable")
    a, b = a[order_a], b[order_b]
    qa, qb = part(a), part(b)
    b0 = np.ascontiguousarray(b[:, 0])
    begin = 0
    for end in (np.flatnonzero(np.diff(qa, append=-1)) + 1).tolist():
        lo, hi = np.searchsorted(qb, qa[begin] - first, "left"), np.searchsorted(qb, qa[begin] + first, "right")
        strip = max(1, (1 << 19) // max(1, hi - lo))
        for k in range(begin, end, strip) if hi > lo else ():
            some = a[k : min(k + strip, end)]
            apart_by = np.bitwise_count(some[:, :1] ^ b0[None, lo:hi])
            x, y = np.nonzero(apart_by <= first)
            keep = apart(order_a[k + x], order_b[lo + y])
            x, y = x[keep], y[keep]
            if lanes == 1 and len(x):
                yield order_a[k + x], order_b[lo + y], apart_by[x, y]
            for m in range(0, len(x) if lanes > 1 else 0, 1 << 19):
                u, v = x[m : m + (1 << 19)], y[m : m + (1 << 19)]
                d = np.bitwise_count(some[u] ^ b[lo + v]).sum(axis=1)
                near = d <= radius
                if near.any():
                    yield order_a[k + u[near]], order_b[lo + v[near]], d[near]
        begin = end


class Groups:
    """Labels of the nodes of two tiles, which links join."""

    def __init__(self, na: np.ndarray, nb: np.ndarray):
        self.nodes, where = np.unique(np.concatenate([na, nb]), return_inverse=True)
        self.a, self.b = where[: len(na)], where[len(na) :]
        self.label = np.arange(len(self.nodes))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.label[self.a[x]] != self.label[self.b[y]]

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        every = np.arange(len(self.nodes))
        child, parent = forest(len(every), np.concatenate([every, self.a[x]]), np.concatenate([self.label, self.b[y]]))
        self.label = every.copy()
        self.label[child] = parent

    def edges(self) -> pa.RecordBatch:
        child = np.flatnonzero(self.label != np.arange(len(self.nodes)))
        return _edges(self.nodes[child], self.nodes[self.label[child]])


def fingerprint_edges(distinct: DataFrame, radius: int = 4, lanes: int = 1, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` between nodes that join exactly what all links join; written.

    ``distinct`` holds each fingerprint once, as ``(node, fp)``.  With one lane
    a fingerprint's cell is the population counts of its two halves; two
    fingerprints within the radius lie in cells whose counts differ by no more
    than the radius in all, so only such pairs of tiles meet.  (With more lanes
    and a wide radius no counts differ beyond it, and all tiles are one cell.)
    Cells with many fingerprints are dealt into tiles by a hash.  Within two
    tiles, stretches whose counts differ beyond the radius are skipped, the
    others compared bit by bit; each strip's pairs are reduced to a forest at
    once, so a group of copies never gives all its pairs.
    """
    byte = lambda k: F.conv(F.hex(F.substring(F.col("fp"), k, F.lit(1))), 16, 10).cast("int")
    half = lambda k: sum((F.bit_count(byte(k + x)) for x in range(1, 4)), F.bit_count(byte(k))).cast("int")
    narrow = lanes == 1 and radius <= 16
    cells = distinct.select("node", "fp", (half(5) if narrow else F.lit(0)).alias("hi"), (half(1) if narrow else F.lit(0)).alias("lo"))
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    cells = cells.join(F.broadcast(sizes), ["hi", "lo"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    folder = shared_dir(distinct.sparkSession, "simhash-tiles")
    places = write_tiles(cells, folder, lanes)
    kind = _record((), lanes)

    def run(batches):
        for a, b in _both_tiles(batches, folder, kind):
            groups = Groups(a["node"], b["node"])
            for x, y, _ in _near(a["fp"], b["fp"], min(64, radius), radius, groups.apart):
                groups.join(x, y)
            yield groups.edges()

    edges = written(_tile_pairs(places, radius if narrow else 0).mapInArrow(run, "a bigint, b bigint"), "simhash-edges")
    discard(places)
    remove(distinct.sparkSession, folder)
    return edges


def _digits(lanes: int) -> Column:
    """The lanes as 16 hexadecimal digits each, the most significant first."""
    digits = lambda k: F.lower(F.hex(F.substring(F.col("fp"), k, F.lit(1))))
    return F.concat(*[digits(8 * lane + k) for lane in range(lanes) for k in range(8, 0, -1)])


def _labelled(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``(key, component_id)`` of each node: the least id of its component.

    Each side of a join is a written table, so Spark can split the rows of a
    large component, or of a text that many documents have.
    """
    node = nodes.join(connected_components(edges), "node", "left").select(key, "least", F.coalesce("component", "node").alias("component"))
    node = written(node, "simhash-nodes")
    least = written(node.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    out = written(node.join(least, "component").select(key, "component_id"), "simhash-components")
    discard(node, least)
    return out


def simhash_groups(
    docs: DataFrame,
    words: int = 4,
    radius: int = 4,
    seed: int = 42,
    lanes: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile: int = TILE,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Rows are linked where their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the least id reachable.  Equal fingerprints are one
    node, so copies never meet in pairs.  Null and empty texts have the
    fingerprint zero and are linked like any other; a null id never is the
    least, and a component of null ids alone has none.  Repeated rows come out
    once each.  An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, words, seed, lanes, id_col, text_col), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = written(distinct, "simhash-distinct")
    edges = fingerprint_edges(distinct.select("node", "fp"), radius, lanes, tile)
    node = _labelled(distinct, edges, "fp")
    discard(edges, distinct)
    return fps.join(node, "fp").select(F.col("id").alias(id_col), _digits(lanes).alias("fingerprint"), "component_id")


#: Lanes of the fingerprints of shingle sets.  Sets of equal size and Jaccard
#: similarity 0.8 differ in 77.6 bits of 512 on average (9.7 of the first 64),
#: others of 0.8 in fewer; these are 4.5 deviations more.
SET_LANES, SET_RADIUS, SET_FIRST = 8, 114, 23
#: Sets of so few shingles differ in more bits than that; their links are looked up.
SMALL = 4


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the text's distinct shingles; a text of fewer words is one shingle."""
    w = (text or "").encode("utf-8").lower().split()
    shingles = set(map(b" ".join, zip(*(w[k:] for k in range(words))))) if len(w) >= words else {b" ".join(w)} if w else set()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.dtype("<u8"), len(shingles)))


def set_fingerprint(h: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, each counted once, in ``SET_LANES`` lanes; zero for the empty set."""
    out = np.zeros(SET_LANES, "<u8")
    for lane in range(SET_LANES if len(h) else 0):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 1 << 16):
            x = h[k : k + (1 << 16)] + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


class Sets:
    """Shingle sets in the shared folder: sorted 32-bit hashes; some stay in memory."""

    MOST = 64_000_000

    def __init__(self, folder: str):
        self.pieces, self.known, self.held = Pieces(folder), {}, 0

    def of(self, row: np.void) -> np.ndarray:
        key = int(row["part"]), int(row["attempt"]), int(row["at"])
        if key not in self.known:
            if self.held > self.MOST:
                self.known, self.held = {}, 0
            data = self.pieces.read(f"sets-{key[0]}-{key[1]}", key[2], 4 * int(row["n"]))
            self.known[key], self.held = np.frombuffer(data, "<u4"), self.held + len(data) + 200
        return self.known[key]

    def alike(self, a: np.void, b: np.void, similarity: float) -> bool:
        """Whether the sets' Jaccard similarity is ``similarity`` or more."""
        x, y = sorted((self.of(a), self.of(b)), key=len)
        shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return shared >= similarity * (len(x) + len(y) - shared) - 1e-9


#: Pairs that are checked before those which they join are left out.
ROUND = 64


def _verified(groups: Groups, a: np.ndarray, b: np.ndarray, sets: Sets, similarity: float) -> pa.RecordBatch:
    """Edges that join what all links between two tiles join.

    Candidates of a strip are checked on their sets, the nearest first; pairs
    that links have joined by then need no check.  So a large group of alike
    texts costs about a check for each of its texts, not for each pair.
    """
    n_a, n_b = a["n"], b["n"]
    for x, y, d in _near(a["fp"], b["fp"], SET_FIRST, SET_RADIUS, groups.apart):
        sized = np.minimum(n_a[x], n_b[y]) >= similarity * np.maximum(n_a[x], n_b[y]) - 1e-9
        order = np.argsort(d[sized], kind="stable")
        x, y = x[sized][order], y[sized][order]
        while len(x):
            some = np.array([sets.alike(a[i], b[j], similarity) for i, j in zip(x[:ROUND].tolist(), y[:ROUND].tolist())], bool)
            if some.any():
                groups.join(x[:ROUND][some], y[:ROUND][some])
            x, y = x[ROUND:], y[ROUND:]
            left = groups.apart(x, y)
            x, y = x[left], y[left]
    return groups.edges()


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = 16384) -> DataFrame:
    """``(id, component_id)`` for every row of ``docs``, whose id tells its text.

    Rows link where the sets of their shingles have a Jaccard similarity of
    ``similarity``, 0.8 or more.  Fingerprints only name the candidates; the
    task that finds a candidate checks it at once on the sets, which stand in
    the shared folder as sorted 32-bit hashes.  No pair leaves a task but the
    edges of a forest.  Sets of four and five shingles, whose fingerprints
    differ more, are linked by an equality join.  Equal sets are one node.
    Null and empty texts have the empty set and are one group; a null id never
    names a group; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    set_folder, tile_folder = shared_dir(spark, "near-sets"), shared_dir(spark, "near-tiles")

    def run(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        out, at, seen = None, 0, {}
        for batch in batches:
            if out is None:
                out = _own_file(set_folder, "sets")[1]
            rows = []
            for t in batch.column(1):
                h = shingle_set(t.as_py(), words)
                mark = xxhash.xxh3_128_digest(h.tobytes())
                if mark not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    short = np.unique((h >> np.uint64(32)).astype("<u4"))
                    less = [np.delete(h, k) for k in range(len(h))] if len(h) == SMALL + 1 else [h] if len(h) == SMALL else []
                    seen[mark] = set_fingerprint(h).tobytes(), mark, len(h), [xxhash.xxh64_intdigest(x.tobytes()) >> 1 for x in less], at, len(short)
                    out.write(short.tobytes())
                    at += 4 * len(short)
                rows.append(seen[mark])
            fp, mark, size, small, place, n = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(fp, pa.binary()), pa.array(mark, pa.binary()), pa.array(size, pa.int64()), pa.array(small, pa.list_(pa.int64())),
                    pa.array([part] * len(rows), pa.int64()), pa.array([attempt] * len(rows), pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()),
                ],
                names=["id", "fp", "mark", "size", "small", "part", "attempt", "at", "n"],
            )
        if out is not None:
            out.close()

    where = "part bigint, attempt bigint, at bigint, n bigint"
    fps = written(docs.mapInArrow(run, f"id {id_type}, fp binary, mark binary, size bigint, small array<bigint>, {where}"), "near-fp")
    one = F.first(F.struct("fp", "size", "small", "part", "attempt", "at", "n")).alias("one")
    nodes = fps.groupBy("mark").agg(F.min("id").alias("least"), one).select("mark", "least", "one.*")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    tiles = max(1, -(-nodes.count() // tile))
    extra = ("part", "attempt", "at", "n")
    cells = nodes.select(F.lit(0).alias("hi"), F.lit(0).alias("lo"), F.pmod(F.xxhash64("mark"), F.lit(tiles)).alias("block"), "node", "fp", *extra)
    places = write_tiles(cells, tile_folder, SET_LANES, extra)
    kind = _record(extra, SET_LANES)

    def check(batches):
        sets = Sets(set_folder)
        for a, b in _both_tiles(batches, tile_folder, kind):
            yield _verified(Groups(a["node"], b["node"]), a, b, sets, similarity)

    small = nodes.select("node", "size", F.explode("small").alias("key"))
    side = lambda n, c: small.where(F.col("size") == n).select("key", F.col("node").alias(c))
    equal = side(SMALL, "a").join(side(SMALL + 1, "b"), "key").select("a", "b")
    edges = written(_tile_pairs(places, 0).mapInArrow(check, "a bigint, b bigint").unionByName(equal), "near-edges")
    discard(places)
    remove(spark, tile_folder)
    remove(spark, set_folder)
    node = _labelled(nodes, edges, "mark")
    discard(nodes, edges)
    return fps.join(node, "mark").select(F.col("id").alias(id_col), "component_id")

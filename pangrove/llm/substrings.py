"""Exact removal of repeated substrings, by a locally consistent parse of the corpus.

Rolling-hash triggers cut each text into phrases; only the distinct phrase
contexts (the dictionary) are compared, never all suffixes.  A trigger is the
place of the least rolling hash among the ``W`` places of a window's inside, so
unlike a trigger by remainder it occurs in every window, and a phrase never
outgrows a window.  All windows of ``LENGTH`` bytes that share a trigger form a
run; the run's bytes are its context.  Equal windows have equal triggers at
equal places, hence:

1.  Runs with equal contexts hold equal windows: all but the earliest are
    repeats, whole.
2.  Otherwise equal windows lie in runs whose trigger strings are equal and
    whose contexts differ ("mixed" runs, at the edges of repeated passages).
    Their windows, few, are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pangrove.llm.common import arrow_rows, discard, session_partitions, written

LENGTH = 100  # bytes of a repeated string
GRAM = 32  # bytes of a trigger
W = LENGTH - GRAM + 1
#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 500_000
#: Bytes of text behind one bucket of a shuffle, about.
BUCKET_BYTES = 8_000_000
#: Mixed runs of one trigger string beyond which their windows are dealt out one by one.
HOT = 2000

#: Rows that go to a Python worker at a time: texts and blobs are large.
ROWS = 500
#: A long text is hashed in pieces of so many bytes; places take the low bits of a key.
PIECE = 4_000_000
PLACES = np.uint64((1 << 27) - 1)
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
NULL_ID = -(1 << 63)

RUN = np.dtype([("g", "<u8"), ("f1", "<u8"), ("f2", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the two bases and of their inverses, modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def reach(self, n: int) -> None:
        for k, base in enumerate(BASES):
            inverse = pow(base, -1, 1 << 64)
            for table, b in ((self.up, base), (self.down, inverse)):
                while len(table[k]) < n:
                    have = len(table[k])
                    table[k] = np.concatenate([table[k], table[k] * np.uint64(pow(b, have, 1 << 64))])


POWERS = Powers()


class Hashes:
    """Two 64-bit polynomial hashes of any stretch of ``data``."""

    def __init__(self, data: np.ndarray):
        POWERS.reach(len(data) + 1)
        x = data.astype(np.uint64) + np.uint64(1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * POWERS.up[k][: len(x)], dtype=np.uint64)]) for k in range(2)]

    def of(self, k: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][end] - self.sums[k][begin]) * POWERS.down[k][begin] + (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[: len(x) - width + 1], out[rest : rest + len(x) - width + 1])
    return out


def runs_of(texts: list[bytes], first_doc: int = 0, piece: int = PIECE) -> np.ndarray:
    """The runs of windows of some texts: trigger hash, context hashes, text, first window, windows.

    A text beyond ``piece`` bytes is taken in overlapping pieces, so that places
    fit in the low bits of a key; a run that is cut there only becomes mixed.
    """
    pieces = [(k, s, t[s : s + piece + LENGTH - 1]) for k, t in enumerate(texts) for s in range(0, len(t) - LENGTH + 1, piece)]
    if not pieces:
        return np.zeros(0, RUN)
    return np.concatenate([_runs(pieces[k : k + 16], first_doc) for k in range(0, len(pieces), 16)] if len(texts) < len(pieces) else [_runs(pieces, first_doc)])


def _runs(pieces: list[tuple[int, int, bytes]], first_doc: int) -> np.ndarray:
    sizes = np.array([len(p) for _, _, p in pieces], np.int64)
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    hashes = Hashes(data)
    place = np.arange(len(data) - GRAM + 1)
    # The hash above, the place below: the least is the leftmost of equal hashes.
    keys = (hashes.of(0, place, place + GRAM) & ~PLACES) | place.astype(np.uint64)
    trigger = (_least_within(keys, W) & PLACES).astype(np.int64)
    windows = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(pieces)), windows)
    window = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    trigger = trigger[window]
    new = np.ones(len(window), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    begin, owner = window[head], piece[head]
    end = begin + count + LENGTH - 1
    out = np.zeros(len(head), RUN)
    out["g"] = hashes.of(1, trigger[head], trigger[head] + GRAM)
    out["f1"], out["f2"] = hashes.of(0, begin, end), hashes.of(1, begin, end)
    out["doc"] = np.array([k for k, _, _ in pieces], np.int64)[owner] + first_doc
    out["at"] = begin - starts[owner] + np.array([s for _, s, _ in pieces], np.int64)[owner]
    out["n"] = count
    return out


def _texts(batches) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Documents in portions of about ``CHUNK`` bytes, with keys (id, text hash)."""
    for batch in batches:
        ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        begin, texts, total = 0, [], 0
        for k, value in enumerate(batch.column(2)):
            texts.append((value.as_py() or "").encode("utf-8"))
            total += len(texts[-1])
            if total >= CHUNK or k == batch.num_rows - 1:
                keys = np.zeros(len(texts), [("id", "<i8"), ("mark", "<i8")])
                keys["id"], keys["mark"] = ids[begin : k + 1], marks[begin : k + 1]
                yield keys, texts
                begin, texts, total = k + 1, [], 0


def _repeats(parts: list[np.ndarray], *where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``parts``, then ``where``, and which rows in it are not their group's first place."""
    order = np.lexsort([*where[::-1], *parts[::-1]])
    same = np.ones(len(order), bool)
    same[:1] = False
    for p in parts:
        same[1:] &= p[order][1:] == p[order][:-1]
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    later = np.zeros(len(order), bool)
    for w in where:
        later |= w[order] != w[order][head[group]]
    return order, later


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _emit(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
        names=["bucket", "id", "mark", "blob"],
    )


def _by_doc(
    keys: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray, spread: int = 0
) -> list[tuple[int, int, int, bytes]]:
    """Rows (bucket, id, mark, spans) with each document's spans: first window, windows, kind.

    The bucket is PLAIN or WITH_MIXED, or one of ``spread`` others below, by
    document and place in the task: copies of one text never meet in one.
    """
    spans = np.zeros(len(doc), SPAN)
    spans["at"], spans["n"], spans["kind"] = at, n, kind
    order = np.argsort(doc, kind="stable")
    doc, spans = doc[order], spans[order]
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    ends = np.append(heads[1:], len(doc))
    return [
        (
            -10 - (int(keys["mark"][doc[h]]) + int(keys["id"][doc[h]]) + h) % spread if spread else WITH_MIXED if spans["kind"][h:e].any() else PLAIN,
            int(keys["id"][doc[h]]), int(keys["mark"][doc[h]]), spans[h:e].tobytes(),
        )
        for h, e in zip(heads.tolist(), ends.tolist())
    ]


SPAN = np.dtype([("at", "<u4"), ("n", "<u4"), ("kind", "u1")])
REPEAT, MIXED, MIXED_HOT = 0, 1, 2
PLAIN, WITH_MIXED = -1, -2
SCHEMA = "bucket bigint, id bigint, mark bigint, blob binary"


def _first_map(buckets: int, piece: int):
    """Runs of a task's texts, dealt by trigger; of equal contexts only the task's earliest goes on."""

    def flush(keys: list[np.ndarray], runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, runs = np.concatenate(keys), np.concatenate(runs)
        order, later = _repeats([runs["f1"], runs["f2"]], keys["id"][runs["doc"]], keys["mark"][runs["doc"]], runs["at"].astype(np.int64))
        runs = runs[order]
        gone = runs[later]
        rows = _by_doc(keys, gone["doc"].astype(np.int64), gone["at"], gone["n"], np.full(len(gone), REPEAT), buckets)
        runs = runs[~later]
        bucket = (_mix(runs["g"]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, runs = bucket[order], runs[order]
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        for h, e in zip(heads.tolist(), np.append(heads[1:], len(bucket)).tolist()):
            mine = runs[h:e].copy()
            docs, where = np.unique(mine["doc"], return_inverse=True)
            mine["doc"] = where
            rows.append((int(bucket[h]), len(docs), 0, _pack(keys[docs], mine)))
        for k in range(0, len(rows), 500):
            yield _emit(rows[k : k + 500])

    def run(batches):
        keys, runs, docs, held = [], [], 0, 0
        for k, texts in _texts(batches):
            keys.append(k)
            runs.append(runs_of(texts, docs, piece))
            docs, held = docs + len(texts), held + len(runs[-1])
            if held >= 300_000:
                yield from flush(keys, runs)
                keys, runs, docs, held = [], [], 0, 0
        if held:
            yield from flush(keys, runs)

    return run


def _passed_on(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of repeats that a task found by itself: they only lose their bucket."""
    for batch in batches:
        yield batch.set_column(0, "bucket", pa.array(np.full(batch.num_rows, PLAIN)))


def _first_reduce(batches: list[pa.RecordBatch], hottest: int) -> Iterator[pa.RecordBatch]:
    """A bucket's runs together: repeats, and the earliest runs of triggers with several contexts."""
    keys, runs, docs = [], [], 0
    for batch in batches:
        for n, blob in zip(batch.column("id").to_pylist(), batch.column("blob")):
            blob = blob.as_py()
            keys.append(np.frombuffer(blob, [("id", "<i8"), ("mark", "<i8")], n))
            mine = np.frombuffer(blob, RUN, offset=16 * n).copy()
            mine["doc"] += docs
            docs += n
            runs.append(mine)
    if not runs:
        return
    keys, runs = np.concatenate(keys), np.concatenate(runs)
    order, later = _repeats([runs["g"], runs["f1"], runs["f2"]], keys["id"][runs["doc"]], keys["mark"][runs["doc"]], runs["at"].astype(np.int64))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs["g"][1:] != runs["g"][:-1]) | (runs["f1"][1:] != runs["f1"][:-1]) | (runs["f2"][1:] != runs["f2"][:-1])
    heads = runs[first]
    _, group, count = np.unique(heads["g"], return_inverse=True, return_counts=True)
    mixed, hot = count[group] > 1, count[group] > hottest
    out = np.concatenate([runs[later], heads[mixed]])
    kind = np.concatenate([np.full(later.sum(), REPEAT), np.where(hot[mixed], MIXED_HOT, MIXED)])
    rows = _by_doc(keys, out["doc"].astype(np.int64), out["at"], out["n"], kind)
    for k in range(0, len(rows), 2000):
        yield _emit(rows[k : k + 2000])


def _second_map(buckets: int, piece: int):
    """Contexts of a task's mixed runs, dealt by trigger; those of hot triggers window by window.

    Of equal windows of hot triggers only the earliest goes on.
    """

    def flush(keys, contexts, windows) -> Iterator[pa.RecordBatch]:
        gone = []
        for window, places in windows.items():
            first = min(places, key=lambda x: (keys[x[0]], x[1]))
            gone += [x for x in places if (keys[x[0]], x[1]) != (keys[first[0]], first[1])]
            contexts.setdefault(_short_hash(window) % buckets, []).append((*first, window))
        rows = []
        if gone:
            doc, at = np.array(gone, np.int64).T
            table = np.array(keys, [("id", "<i8"), ("mark", "<i8")])
            rows = _by_doc(table, doc, at, np.ones(len(gone), np.int64), np.full(len(gone), REPEAT), buckets)
        for bucket, items in contexts.items():
            docs = sorted({d for d, _, _ in items})
            number = {d: k for k, d in enumerate(docs)}
            head = np.zeros(len(items), [("doc", "<u4"), ("at", "<u4"), ("size", "u1")])
            head["doc"], head["at"], head["size"] = [number[d] for d, _, _ in items], [a for _, a, _ in items], [len(b) for _, _, b in items]
            table = np.array([keys[d] for d in docs], [("id", "<i8"), ("mark", "<i8")])
            rows.append((bucket, len(docs), len(items), _pack(table, head) + b"".join(b for _, _, b in items)))
        for k in range(0, len(rows), 50):
            yield _emit(rows[k : k + 50])

    def run(batches):
        keys, contexts, windows, held = [], {}, {}, 0
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, spans, total, first = [], [], 0, len(keys)
                while begin < batch.num_rows and total < CHUNK:
                    texts.append((batch.column(2)[begin].as_py() or "").encode("utf-8"))
                    mine = np.concatenate([np.frombuffer(b, SPAN) for b in batch.column(3)[begin].as_py()])
                    spans.append(mine[mine["kind"] != REPEAT])
                    keys.append((batch.column(0)[begin].as_py(), batch.column(1)[begin].as_py()))
                    total += len(texts[-1])
                    begin += 1
                runs = runs_of(texts, 0, piece)
                wanted = np.concatenate(spans)
                places = np.repeat(np.arange(len(texts), dtype=np.int64), [len(x) for x in spans]) << 32 | wanted["at"]
                have = runs["doc"].astype(np.int64) << 32 | runs["at"]
                order = np.argsort(places, kind="stable")
                where = np.minimum(np.searchsorted(places[order], have), len(order) - 1)
                found = places[order][where] == have if len(order) else np.zeros(len(have), bool)
                kinds = wanted["kind"][order][where][found] if len(order) else []
                for (g, _, _, doc, at, n), kind in zip(runs[found].tolist(), np.asarray(kinds).tolist()):
                    context = texts[doc][at : at + n + LENGTH - 1]
                    if kind == MIXED:
                        contexts.setdefault(g % buckets, []).append((first + doc, at, context))
                    else:
                        for k in range(n):
                            window = context[k : k + LENGTH]
                            windows.setdefault(window, []).append((first + doc, at + k))
                    held += len(context) if kind == MIXED else n * LENGTH
                if held >= 8_000_000:
                    yield from flush(keys, contexts, windows)
                    keys, contexts, windows, held = [], {}, {}, 0
        if held:
            yield from flush(keys, contexts, windows)

    return run


def _short_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=7).digest(), "little")


def _second_reduce(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's windows together: each that also starts earlier."""
    keys, heads, datas, docs = [], [], [], 0
    for batch in batches:
        for n, m, blob in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("blob")):
            blob = blob.as_py()
            kind = np.dtype([("doc", "<u4"), ("at", "<u4"), ("size", "u1")])
            keys.append(np.frombuffer(blob, [("id", "<i8"), ("mark", "<i8")], n))
            head = np.frombuffer(blob, kind, m, offset=16 * n).copy()
            head["doc"] += docs
            docs += n
            heads.append(head)
            datas.append(blob[16 * n + kind.itemsize * m :])
    if not heads:
        return
    keys, head = np.concatenate(keys), np.concatenate(heads)
    data = np.frombuffer(b"".join(datas), np.uint8)
    size = head["size"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = size - LENGTH + 1
    inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    place = np.repeat(begin, n) + inner
    hashes = Hashes(data)
    h = [hashes.of(k, place, place + LENGTH) for k in range(2)]
    doc, at = np.repeat(head["doc"].astype(np.int64), n), np.repeat(head["at"].astype(np.int64), n) + inner
    order, later = _repeats(h, keys["id"][doc], keys["mark"][doc], at)
    gone = order[later]
    rows = _by_doc(keys, doc[gone], at[gone], np.ones(len(gone), np.int64), np.full(len(gone), REPEAT))
    for k in range(0, len(rows), 2000):
        yield _emit(rows[k : k + 2000])


def _reduced(table: pa.Table, function) -> pa.Table:
    """``function`` on all batches of a bucket together, however many hold it."""
    batches = [b for b in table.to_batches() if b.num_rows]
    passed = bool(batches) and batches[0].column("bucket")[0].as_py() < 0
    done = list(_passed_on(batches) if passed else function(batches))
    return pa.Table.from_batches(done) if done else _emit([]).schema.empty_table()


def _grouped(shuffled: DataFrame, function) -> DataFrame:
    """``function`` on each bucket's rows together: a bucket holds a fixed share of the hashes."""
    return shuffled.groupBy("bucket").applyInArrow(lambda table: _reduced(table, function), SCHEMA)


#: Bits of the filter that spares texts without mixed runs a shuffle: 2**17 words at most, whatever the input.
FILTER_BITS = 23


def _may_be_in(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of ``texts`` whose hash of (k, mark) is one of ``keyed``'s, exact or passing too many.

    The words of the filter, a table of bounded size, are broadcast, so no
    Python worker is needed beside those of the steps around it.
    """
    low = F.xxhash64("k", "mark").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keyed.select(low.alias("low")).groupBy(F.shiftright("low", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 63 as int))")).alias("bits"))
    held = texts.withColumn("low", low).withColumn("word", F.shiftright("low", 6)).join(F.broadcast(words), "word")
    return held.where(F.expr("shiftrightunsigned(bits, cast(low & 63 as int)) & 1 = 1")).select(texts.columns)


def _finish(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, blobs in zip(batch.column(2), batch.column(3).to_pylist()):
            data = (text.as_py() or "").encode("utf-8")
            removed = np.zeros(0, np.int64)
            edges = np.zeros(len(data) + 1, np.int32)
            for b in blobs or ():
                s = np.frombuffer(b, SPAN)
                s = s[s["kind"] == REPEAT]
                np.add.at(edges, s["at"], 1)
                np.add.at(edges, s["at"].astype(np.int64) + s["n"] + LENGTH - 1, -1)
            gone = np.cumsum(edges[:-1]) > 0
            removed = int(gone.sum())
            n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = data if not removed else np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), removed, n_spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, hottest: int = HOT
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``.

    Each byte is removed that lies in a string of ``LENGTH`` bytes which also
    starts earlier: in a smaller id, or earlier in the same document.  Matches
    never cross documents; overlaps count; strings are judged on the input.

    Null texts are empty; texts under ``LENGTH`` bytes are kept whole.  A null
    id comes before all others.  Rows with equal ids and texts are one document
    (both come out alike); rows with equal ids and other texts stand in the
    order of a hash of the text.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.select(F.coalesce("id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("mark"), "id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    buckets = max(session_partitions(spark), -(-int(total) // BUCKET_BYTES))
    keyed = source.select("k", "mark", "text")
    long = keyed.where(F.octet_length("text") >= LENGTH)

    with arrow_rows(spark, ROWS):
        spans = written(_grouped(long.mapInArrow(_first_map(buckets, piece), SCHEMA), lambda b: _first_reduce(b, hottest)), "substring-spans")
        mixed = spans.where(F.col("bucket") == WITH_MIXED).groupBy("id", "mark").agg(F.collect_list("blob").alias("spans"))
        mixed = written(mixed.withColumnRenamed("id", "k"), "substring-mixed")
        second = _may_be_in(long, mixed).join(mixed, ["k", "mark"]).select("k", "mark", "text", "spans")
        more = written(_grouped(second.mapInArrow(_second_map(buckets, piece), SCHEMA), _second_reduce), "substring-windows")
        discard(mixed)
        per_doc = spans.unionByName(more).groupBy("id", "mark").agg(F.collect_list("blob").alias("spans")).withColumnRenamed("id", "k")
        done = source.join(per_doc, ["k", "mark"], "left").select("id", "mark", "text", "spans").mapInArrow(
            _finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        )
        done = written(done, "substring-done")
        discard(spans, more)
    return done.withColumnRenamed("id", id_col)

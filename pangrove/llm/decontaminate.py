"""Benchmark decontamination: q-gram lemma filter, then banded alignment."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8  # characters (bytes) in a q-gram: one machine word
SEGMENT, STRIDE = 96, 8  # longer items are cut into segments; a passage of 103 bytes holds one whole, wherever it begins
LEAST = 24  # items shorter than this are looked for exactly
WHOLE = 120  # items shorter than this are also looked for whole
EDITS_IN = 16  # one edit is allowed for as many characters
BLOCK_BYTES = 700_000  # of benchmark text in one pass over the documents, about
GAP = b"\x00" * 16

#: A-Z become a-z and every ASCII blank a space; lengths and places stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c or 1 for c in range(256))


def plain(text: str) -> bytes:
    return text.encode("utf-8").translate(_PLAIN)


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as a word."""
    return np.lib.stride_tricks.as_strided(data, (max(0, len(data) - Q + 1), Q), (1, 1)).copy().view("<u8").ravel()


def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Patterns:
    """Segments of benchmark items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.begin, self.text = [], [], []
        for item, text in items:
            data = plain(text)
            if not data.strip():
                continue
            last = max(0, len(data) - SEGMENT)
            parts = [(s, data[s : s + SEGMENT]) for s in sorted({*range(0, last, STRIDE), last})]
            for s, part in [*parts, (0, data)] if SEGMENT < len(data) < WHOLE else parts:
                self.item.append(item)
                self.begin.append(s)
                self.text.append(part)
        self.size = np.array([len(t) for t in self.text], np.int64)
        short = self.size < LEAST
        self.edits = np.where(short, 0, self.size // EDITS_IN)
        #: The lemma: a region within ``e`` edits of a pattern of ``m`` shares m + 1 - q (e + 1) q-grams.
        self.shared = np.where(short, 1 << 30, np.maximum(1, self.size + 1 - Q * (self.edits + 1)))
        grams = [_grams(np.frombuffer(b"" if s else t, np.uint8)) for t, s in zip(self.text, short)]
        #: Short patterns by length: their numbers, in the order of their first word, and these words.
        self.short = {}
        for m in np.unique(self.size[short]).tolist():
            mine = np.flatnonzero(self.size == m)
            words = np.array([int.from_bytes(self.text[k][:Q], "little") for k in mine], np.uint64)
            order = np.argsort(words, kind="stable")
            self.short[m] = mine[order], words[order]
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.owner, self.place = all_grams[order], owner[order], place[order]
        self.bits = max(16, int(8 * max(1, len(all_grams))).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[_slot(self.grams, self.bits)] = True

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern and band of each region that keeps the lemma's bound.

        Bands of 2 (e + 1) diagonals overlap by half, so the e + 1 diagonals
        that a region within e edits can use lie in one of them whole.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.text) == 0 or len(data) < Q:
            return none
        grams = _grams(data)
        hit = self.seen[_slot(grams, self.bits)]
        reach = int((self.size + self.edits).max())
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        upto = np.minimum(np.arange(len(hit)) + reach, len(hit))
        dense = (total[upto] - total[:-1]) >= int(self.shared.min())
        if not dense.any():
            return none
        # Hits within ``reach`` of a dense start.
        edges = np.zeros(len(hit) + 1, np.int32)
        starts = np.flatnonzero(dense)
        np.add.at(edges, starts, 1)
        np.add.at(edges, upto[starts], -1)
        at = np.flatnonzero(hit & (np.cumsum(edges[:-1]) > 0))
        lo, hi = np.searchsorted(self.grams, grams[at], "left"), np.searchsorted(self.grams, grams[at], "right")
        n = hi - lo
        k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        owner, diagonal = self.owner[k], np.repeat(at, n) - self.place[k] + 2 * reach
        band = diagonal // (self.edits[owner] + 1)
        key = np.concatenate([owner << 40 | band, owner << 40 | (band - 1)])
        keys, counts = np.unique(key, return_counts=True)
        owner, band = keys >> 40, keys & ((1 << 40) - 1)
        good = counts >= self.shared[owner]
        owner, band = owner[good], band[good]
        return owner, band * (self.edits[owner] + 1) - 2 * reach

    def distances(self, data: np.ndarray, owner: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each pattern in its band of ``data``, and where that ends."""
        best, end = np.full(len(owner), 1 << 20), np.zeros(len(owner), np.int64)
        for m in np.unique(self.size[owner]) if len(owner) else ():
            for part in np.array_split(mine := np.flatnonzero(self.size[owner] == m), max(1, len(mine) // 2048 + 1)):
                e = int(m) // EDITS_IN
                width = 4 * e + 2  # the band and e diagonals on either side
                pattern = np.frombuffer(b"".join(self.text[k] for k in owner[part]), np.uint8).reshape(-1, m)
                first = low[part] - e
                row = np.zeros((len(part), width), np.int64)
                step = np.arange(width)
                for i in range(int(m)):
                    place = first[:, None] + step + i
                    inside = (place >= 0) & (place < len(data))
                    same = inside & (data[np.where(inside, place, 0)] == pattern[:, i : i + 1])
                    new = row + 1 - same
                    new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
                    row = np.minimum.accumulate(new - step, axis=1) + step
                best[part] = row.min(axis=1)
                end[part] = first + row.argmin(axis=1) + m
        return best, end

    def exact(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short patterns and the places where they stand."""
        owners, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        words = _grams(np.concatenate([data, np.zeros(Q - 1, np.uint8)])) if self.short else None
        for m, (mine, first) in self.short.items():
            word = words & np.uint64((1 << 8 * min(m, Q)) - 1)
            seen = np.zeros(1 << 16, bool)
            seen[_slot(first, 16)] = True
            at = np.flatnonzero(seen[_slot(word, 16)])
            at = at[at + m <= len(data)]
            lo, hi = np.searchsorted(first, word[at], "left"), np.searchsorted(first, word[at], "right")
            n = hi - lo
            k = mine[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
            at = np.repeat(at, n)
            for i in range(Q, m):
                byte = np.array([self.text[x][i] for x in mine], np.uint8)
                order = np.argsort(mine)
                good = data[at + i] == byte[order][np.searchsorted(mine[order], k)]
                k, at = k[good], at[good]
            owners.append(k)
            places.append(at)
        return np.concatenate(owners), np.concatenate(places)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, pattern, begin, end, edits)`` of verified regions, for texts that are searched together."""
        joined = GAP.join(texts)
        data = np.frombuffer(joined, np.uint8)
        owner, low = self.regions(data)
        starts = np.cumsum([0] + [len(t) + len(GAP) for t in texts])
        for k, at in zip(*(x.tolist() for x in self.exact(data))):
            doc = int(np.searchsorted(starts, at, "right")) - 1
            yield doc, k, int(at - starts[doc]), int(at - starts[doc] + self.size[k]), 0
        edits, end = self.distances(data, owner, low)
        for k in np.flatnonzero(edits <= self.edits[owner]):
            doc = int(np.searchsorted(starts, end[k] - 1, "right")) - 1
            stop = min(int(end[k] - starts[doc]), len(texts[doc]))
            yield doc, int(owner[k]), max(0, stop - int(self.size[owner[k]])), stop, int(edits[k])


def _portions(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[bytes]]:
    """Plain texts in portions of about ``most`` bytes."""
    some, total = [], 0
    for text in texts:
        some.append(plain(text or ""))
        total += len(some[-1])
        if total >= most:
            yield some
            some, total = [], 0
    if some:
        yield some


def _blocks(benchmark: DataFrame, text_col: str, item_col: str) -> Iterator[bytes]:
    """The benchmark in pickled blocks of about ``BLOCK_BYTES`` of text, dealt by hash."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for block in range(blocks):
        yield pickle.dumps([(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()])


def _is_clean(packed: bytes):
    """A column function: whether a text holds no region of a block of the benchmark."""

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns = Patterns(pickle.loads(packed))
        for texts in parts:
            good = []
            for some in _portions(texts.tolist()):
                leaky = {m[0] for m in patterns.matches(some)}
                good += [k not in leaky for k in range(len(some))]
            yield pd.Series(good, dtype=bool)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, in which ``find_leaks`` finds no region.

    Each block of the benchmark is a filter over what the blocks before it
    kept, so texts are neither shuffled nor joined back.  Null and empty texts
    stay; repeated rows and null ids come out as they came in, whatever the
    other columns are called; empty tables are fine.
    """
    for packed in _blocks(benchmark, text_col, item_col):
        docs = docs.where(_is_clean(packed)(F.col(text_col).cast("string")))
    return docs


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id, contaminated, n_regions, items, least_edits)`` for every row of ``docs``.

    An item (its segments of 96 characters from every eighth place, if it is
    longer) leaks into a document where a region lies within one edit in 16
    characters of it, letter case and kinds of blanks aside; so any passage of
    103 bytes is found, wherever it begins.  Regions come from the q-gram lemma:
    shared q-grams are counted in overlapping diagonal bands, bands that keep
    the bound are verified by banded alignment, so none within the budget is
    missed.  Items under 24 bytes are looked for exactly.

    The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, dealt by
    hash; only one block at a time is sent to the tasks, so the benchmark can
    grow.  Null and empty texts on either side match nothing; null ids and
    repeated rows come out as they came in; empty tables are fine.
    """
    blocks = list(_blocks(benchmark, text_col, item_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    out = out.withColumn("items", F.expr("cast(array() as array<bigint>)")).withColumn("n_regions", F.lit(0).cast("bigint")).withColumn("least_edits", F.lit(None).cast("bigint"))
    for k, packed in enumerate(blocks):
        last = k == len(blocks) - 1

        def run(batches, packed=packed, last=last):
            patterns = Patterns(pickle.loads(packed))
            for batch in batches:
                begin = 0
                for texts in _portions(batch.column(1).to_pylist()):
                    part = batch.slice(begin, len(texts))
                    found = [set() for _ in texts]
                    edits = [None] * len(texts)
                    for doc, pattern, _, _, e in patterns.matches(texts):
                        found[doc].add(pattern)
                        edits[doc] = e if edits[doc] is None else min(e, edits[doc])
                    items = [sorted({*old, *(patterns.item[p] for p in new)}, key=lambda x: (x is not None, x)) for old, new in zip(part.column(2).to_pylist(), found)]
                    counts = [old + len(new) for old, new in zip(part.column(3).to_pylist(), found)]
                    least = [min([x for x in (a, b) if x is not None], default=None) for a, b in zip(part.column(4).to_pylist(), edits)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.nulls(part.num_rows, pa.string()) if last else part.column(1), pa.array(items, pa.list_(pa.int64())), pa.array(counts, pa.int64()), pa.array(least, pa.int64())],
                        names=[id_col, text_col, "items", "n_regions", "least_edits"],
                    )
                    begin += len(texts)

        out = out.mapInArrow(run, f"`{id_col}` {id_type}, `{text_col}` string, items array<bigint>, n_regions bigint, least_edits bigint")
    return out.select(id_col, (F.col("n_regions") > 0).alias("contaminated"), "n_regions", "items", "least_edits")

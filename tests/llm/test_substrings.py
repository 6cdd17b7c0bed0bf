import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pangrove.llm import substrings
from pangrove.llm.substrings import repeated_substrings


def brute(rows, length=100):
    """Rows in order; equal (id, text) are one document."""
    seen, out = {}, {}
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    for k, (d, text) in enumerate(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen.setdefault(data[i : i + length], (k, i)) != (k, i):
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *out[d, t or ""]) for d, t in rows), key=str)


def rows_of(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "é", "an", "in", "  ", "a"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.choice([15, 25, 60, 200])) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = [text(rng.choice([0, 3, 30, 100])) for _ in range(3)]
        parts[1:1] = [rng.choice(passages) for _ in range(rng.choice([0, 1, 2]))]
        rows.append((d * 7 % 61, " ".join(parts)))
    for d in range(20):
        t = list(rows[d][1])
        if t:
            t[rng.randrange(len(t))] = "#"
        rows.append((100 + d, "".join(t)))
    rows += [(200, None), (201, ""), (202, "a" * 99), (203, "a" * 5000), (204, "ab" * 300), (205, "a" * 300), (None, passages[3] * 2), rows[5], (300, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,piece,hot", [(1, 4_000_000, 2000), (2, 700, 1)])
def test_against_brute_force(spark, seed, piece, hot):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, spans string, k int").repartition(3)
    got = sorted((tuple(r) for r in repeated_substrings(docs, piece=piece, hottest=hot).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert repeated_substrings(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_equal_windows_share_triggers():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([90, 100, 150, 900]))).encode() for _ in range(20)]
    texts += [texts[-1][20:300] + b"zz" + texts[3][:140], b"a" * 500]
    runs = substrings.runs_of(texts)
    assert runs["n"].sum() == sum(max(0, len(t) - 99) for t in texts)
    where = {}
    for r in runs.tolist():
        for i in range(r[4], r[4] + r[5]):
            where.setdefault(texts[r[3]][i : i + 100], set()).add(r[0])
    assert all(len(g) == 1 for g in where.values())


def test_every_batch_of_a_bucket_counts():
    """Runs that come in several batches are compared across them; repeats on their way are all handed on."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    keys = np.array([(1, 5), (2, 5)], [("id", "<i8"), ("mark", "<i8")])
    blobs = [substrings._pack(keys[k : k + 1], substrings.runs_of([text])) for k in (0, 1)]
    table = pa.Table.from_batches([substrings._emit([(3, 1, 0, b)]) for b in blobs])
    got = substrings._reduced(table, lambda b: substrings._first_reduce(b, 2000)).to_pylist()
    assert [(r["id"], r["mark"]) for r in got] == [(2, 5)] and sum(np.frombuffer(got[0]["blob"], substrings.SPAN)["n"]) == 301
    table = pa.Table.from_batches([substrings._emit([(-12, k, 5, b"x")]) for k in range(4)])
    got = substrings._reduced(table, substrings._second_reduce).to_pylist()
    assert [r["id"] for r in got] == [0, 1, 2, 3] and {r["bucket"] for r in got} == {substrings.PLAIN}


def test_copies_are_dealt_over_buckets():
    keys = np.array([(k, 5) for k in range(1000)], [("id", "<i8"), ("mark", "<i8")])
    one = np.ones(1000, np.int64)
    buckets = Counter(r[0] for r in substrings._by_doc(keys, np.arange(1000), one, one, 0 * one, 10))
    assert len(buckets) > 4 and max(buckets.values()) < 400

import random
import re

import xxhash

import corpus_pipeline
from pangrove.llm import simhash
from pangrove.llm.common import connected_components


def brute(rows, words=4, radius=4):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def test_groups(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 50, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            if rng.random() < 0.7:
                text[rng.randrange(len(text))] = "X"
            rows.append((len(rows) * 3 % 1000, " ".join(text)))
    rows += [(5000, None), (4000, ""), (4500, " \t\n"), (None, None), (None, "a b c d e"), (7, "É é A"), (7, "É é A"), (6000, "z " * 70000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, fp int, component string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == brute(rows)


def test_small_tiles(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(200)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in rng.sample(range(63), rng.choice([2, 4, 5])):
                g ^= 1 << b
            fps.add(g)
    order = sorted(fps)
    rows = [(k, (f & (1 << 64) - 1).to_bytes(8, "little")) for k, f in enumerate(order)]
    edges = simhash.fingerprint_edges(spark.createDataFrame(rows, "node bigint, fp binary"), 4, tile=8)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    got = {order[k]: order[v] for k, v in found.items()}
    comp = {f: f for f in order}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, f in enumerate(order):
        for g in order[:i]:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 4:
                a, b = sorted((find(f), find(g)))
                comp[b] = a
    assert {f: got.get(f, f) for f in order} == {f: find(f) for f in order}


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_wide_links_are_all_found(spark):
    """Pairs of several lanes within the radius link, however their bits are spread over the lanes."""
    rng = random.Random(4)
    rows, want = [], []
    for k in range(30):
        a = rng.getrandbits(128)
        flips = range(40) if k % 2 else range(41)  # all of them in the first lane
        rows += [(2 * k, a), (2 * k + 1, a ^ sum(1 << b for b in flips))]
        want += [(2 * k, 2 * k + 1)] if k % 2 else []
    df = spark.createDataFrame([(n, f.to_bytes(16, "little")) for n, f in rows], "node bigint, fp binary")
    edges = simhash.fingerprint_edges(df, radius=40, lanes=2, tile=16).collect()
    near = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 40}
    assert set(want) <= near and {tuple(sorted(e)) for e in edges} <= near
    groups = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(groups[a] == groups[b] for a, b in near)


def test_wide(spark):
    """Eight lanes: similarity 0.85 and more links, 0.6 and less does not."""
    rng = random.Random(3)
    rows, want = [], []
    for d in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows.append((2 * d, " ".join(base)))
        changed = list(base)
        for k in rng.sample(range(400), 4 if d % 2 else 30):  # 20 or 150 of 396 shingles
            changed[k] = "x"
        rows.append((2 * d + 1, " ".join(changed)))
        want += [2 * d, 2 * d if d % 2 else 2 * d + 1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, words=5, lanes=8, radius=84, tile=16).collect()}
    assert [got[d] for d, _ in rows] == want


def test_near_copies_by_exact_jaccard(spark):
    """Pairs about similarity 0.8, repeated lines, short texts, chains and a large group, against all pairs."""
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for k in range(60):  # one stretch of 9 to 34 words changed in 104: similarity 0.77 to 0.6 and up
        base = words(104)
        texts += [base, base[: 95 - k % 15] + words(9 + k % 15)]
    line = words(6)
    texts += [line * 100 + words(20), line * 100 + words(20)]  # alike only by repeats
    for n in (8, 9, 10, 13):
        texts += [base := words(n), base[:-1], base[1:]]
    base = words(300)
    for _ in range(60):
        k = rng.randrange(300)
        texts.append(base[:k] + words(1) + base[k + 1 :])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " ")]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").split() for _, t in rows)]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if z == b else z for z in label]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copy_groups(docs, tile=64).collect()}
    assert [got[d] for d, _ in rows] == [rows[z][0] for z in label]
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {d for d, z in got.items() if d == z}
    assert simhash.near_copy_groups(docs.limit(0)).count() == 0

import random
import zlib

import numpy as np

from pangrove.llm import decontaminate, quality, toxicity
from pangrove.llm.embeddings import BINS, STEP, Index, _calibrate, embedding_groups


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    rows = [[float(x) for x in v] for v in rng.normal(size=(300, 16))]
    for k in range(0, 150):
        noise = rng.normal(size=16) * rng.choice([0.05, 0.1, 0.15, 0.3])
        rows.append([float(x) for x in np.array(rows[k]) + noise * np.linalg.norm(rows[k]) / 2])
    rows += [rows[0]] * 5 + [[3 * x for x in rows[1]]]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0], []]
    data = [(k * 2, v, 1, "x") for k, v in enumerate(rows + bad)] + [(None, rows[5], 1, "x")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_groups(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int, cls string")).collect()}
    good = [(i, np.array(v)) for i, v, _, _ in data if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    sims = unit @ unit.T >= 0.9
    ids = [i for i, _ in good]
    label = list(range(len(ids)))
    for a in range(len(ids)):
        for b in np.flatnonzero(sims[a]):
            x, y = label[a], label[b]
            if x != y:
                label = [min(x, y) if z == max(x, y) else z for z in label]
    least = {}
    for i, z in zip(ids, label):
        if i is not None:
            least[z] = min(i, least.get(z, i))
    found = links = 0
    for k, (i, z) in enumerate(zip(ids, label)):
        links += sims[k].sum() - 1
        found += got[i][0]
        assert got[i][0] <= sims[k].sum() - 1
    assert found >= 0.9 * links
    assert sum(got[i][1] == least[z] for i, z in zip(ids, label)) >= 0.95 * len(ids)
    for i, v, _, _ in data:
        if i not in ids:
            assert got[i] == (0, i, True)
    assert embedding_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_rare_links_across_cells(spark):
    """Links of 40 vectors in 4,000, and one tight group of a third: all are found."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(4000, 32)))
    side = rng.normal(size=(40, 32))
    side = unit(side - (side * base[:40]).sum(1, keepdims=True) * base[:40])
    near = 0.91 * base[:40] + np.sqrt(1 - 0.91**2) * side
    group = unit(base[-1] + 0.001 * rng.normal(size=(1500, 32)))
    for vectors in (np.concatenate([base, near]), np.concatenate([base, near, group])):
        rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
        got = {r.vec_id: r.n_links for r in embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
        u = unit(vectors)
        assert [got[k] for k in range(len(rows))] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_lengths(spark):
    """Vectors of each length link among themselves; of another length never."""
    rng = np.random.default_rng(3)
    rows = []
    for n in (4, 7, 7, 12):
        base = rng.normal(size=n)
        rows += [(base * (k + 1) + 0.01 * rng.normal(size=n)).tolist() for k in range(5)]
    rows += [[*rows[0], 0.0, 0.0, 0.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_groups(spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")).collect()}
    cos = lambda a, b: len(a) == len(b) and np.dot(a, b) >= 0.9 * np.linalg.norm(a) * np.linalg.norm(b)
    for k, v in enumerate(rows):
        near = [j for j, w in enumerate(rows) if cos(v, w)]
        assert got[k] == (len(near) - 1, min(near))


def test_calibration():
    reach = np.zeros((2, 2, BINS))
    assert _calibrate(reach, False, 0.999) == (None, None)  # no links seen: the exact bound
    reach[:, 0, 1] = 5000
    reach[:, 1, 40] = 400  # few against many, yet they set their own slack
    slack, recall = _calibrate(reach, False, 0.999)
    assert slack >= 40 * STEP and recall == 1
    reach[1, 1, 90] = 100
    assert _calibrate(reach, False, 0.999)[0] is None  # recall on other probes is too low
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x = np.concatenate([x, x + 0.1 * rng.normal(size=x.shape)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index(x[:30, :8].copy(), x[:30, 8:].copy(), None, 0.2)
    a, b = index.costs(x)
    cell = index.own(a, b)
    seen = [set(index.visits(i, j)) for i, j in zip(a, b)]
    assert all(cell[j] in seen[i] for i, j in zip(*np.nonzero(x @ x.T >= 0.9)))


def prose(rng, n, extra=()):
    words = [rng.choice(["the", "of", "then", "ation", "inger", "reth", "thon", "ed"]) + rng.choice(["", "er", "an", "in", ","]) for _ in range(n)]
    for w in extra:
        words[rng.randrange(n)] = w
    return " ".join(words)


def test_models(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for d in range(600):
        toxic, junk = d % 4 == 0, d % 5 == 0
        text = prose(rng, rng.choice([20, 60, 300]), rng.sample(["idiot", "scum", "moron", "pathetic"], 3) if toxic else ())
        text = " ".join(w + "!!" for w in text.upper().split()) if junk and not toxic else text
        docs.append((d, text, "x", 1))
        labels.append((d, 0 if junk and not toxic else 1, int(toxic)))
    docs += [(None, "null id", "x", 1), (9000, None, "x", 1), (9001, "", "x", 1), (0, docs[0][1], "x", 1), (9002, "word " * 50_000, "x", 1)]
    labels += [(None, 1, 1), (9001, None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string, y int")
    l = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels if q is not None}
    tox = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, l)).collect()
    assert len(tox) == len(docs)
    held = [r for r in tox if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in tox)
    assert sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in tox)
    qual = quality.score_quality(d, quality.fit_quality(d, l)).collect()
    held = [r for r in qual if r.held_out and r.doc_id in truth]
    assert len(qual) == len(docs) and sum(r.keep == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)
    one = l.where("toxic = 0")
    assert toxicity.score_toxicity(d, toxicity.fit_toxicity(d, one)).where("predicted = 1").count() == 0
    empty = d.limit(0)
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, l)).count() == 0
    assert quality.score_quality(empty, quality.fit_quality(empty, l)).count() == 0


def test_scores_by_hand(spark):
    """Scores of both classifiers, worked out from their models by plain loops."""
    import math

    import zstandard as zs

    rng = random.Random(9)
    sample = [(k % 3 == 0, prose(rng, 40, rng.sample(["idiot", "scum", "moron"], 2) if k % 3 == 0 else ())) for k in range(300)]
    sample = [(int(y), t) for y, t in sample]
    texts = [t for _, t in sample[:20]] + ["", "a", "scum " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = toxicity.train(sample)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    plain, toxic = (
        zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=zs.ZstdCompressionParameters(
            window_log=15, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )) for d in (model.ordinary, model.toxic)
    )
    for k, t in enumerate(texts):
        words = t.lower().encode().split()
        saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in (b" " + b" ".join(words[x : x + 8]) + b" " for x in range(0, len(words), 8))] or [0]
        top = sorted(saved, reverse=True) + [0, 0]
        x = [top[0], top[1], top[2], min(top[0], 4), sum(s >= 3 for s in saved) / len(saved), math.log(len(saved)), 1]
        assert abs(got[k] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))) < 1e-9

    graded = [(g, prose(rng, 30) + " fine" * g) for g in (0, 1, 2) for _ in range(40)]
    model = quality.train(graded)
    got = {r.doc_id: (r.expected_grade, r.tail_probability) for r in quality.score_quality(docs, model).collect()}
    for k, t in enumerate(texts):
        index, value = quality.Features().of(t)
        z = sum(float(np.float32(model.weights[i])) * v for i, v in zip(index, value))
        tails = [1 / (1 + math.exp(-(z - c))) for c in model.thresholds]
        assert abs(got[k][0] - sum(tails)) < 1e-4 and abs(got[k][1] - tails[-1]) < 1e-4


def test_more_labels(spark):
    """Grades beyond a few dozen all count; ids that are rated or stand twice don't count twice."""
    from pangrove.llm.training import labelled_sample

    docs = spark.createDataFrame([(d, f"text {d}") for d in range(400)] + [(1, "text 1"), (2, "other 2")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, d % 90) for d in range(400)] + [(1, 1), (2, 2)], "doc_id bigint, grade int")
    got = labelled_sample(docs, labels, "grade", 3)
    trained = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5]
    assert {y for y, _ in got} == {d % 90 for d in trained}
    assert len(got) == sum(min(3, sum(d % 90 == y for d in trained)) for y in range(90)) and len(set(got)) == len(got)


def test_ordinal_grades():
    rng = random.Random(1)
    sample = [(g, prose(rng, 80) + " good" * (g * 6) + " bad" * (12 - 4 * g)) for g in (0, 1, 2, 3) for _ in range(40)]
    model = quality.train(sample)
    assert (np.diff(model.thresholds) > 0).all()
    means = [np.mean([quality.rate_text(model, quality.Features(), t)[0] for y, t in sample if y == g]) for g in (0, 1, 2, 3)]
    assert means == sorted(means) and means[0] < 0.7 and means[3] > 2.3


def edits(a, b):
    """Least edits of all of ``a`` against any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, n) + f" item {k}") for k, n in enumerate((6, 8, 15, 20, 30))] + [(7, None), (8, ""), (9, "short")]
    rows = []
    for d in range(80):
        text = prose(rng, 40)
        if d % 2:
            leak = list(rng.choice(items[:5])[1])
            for _ in range(d // 10):
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice(["", "Q", "zz"])
            text = text[:50] + "".join(leak).upper() + text[50:]
        rows.append((d, text))
    rows += [(100, None), (101, ""), (None, items[3][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, items int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(docs, bench).collect()
    pats = decontaminate.Patterns([(i, t or "") for i, t in items])
    want = {}
    for d, t in rows:
        data = decontaminate.plain(t or "")
        found = {pats.item[k] for k, p in enumerate(pats.text) if edits(p, data) <= len(p) // decontaminate.EDITS_IN}
        want[d] = sorted(found)
    assert len(got) == len(rows)
    for r in got:
        assert r["items"] == want[r.doc_id] and r.contaminated == bool(want[r.doc_id])
    assert sum(map(bool, want.values())) > 15
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaked_passages_and_short_items(spark):
    """Any 103 bytes of a longer item leak, whatever their offset; items under 24 bytes by exact match."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    long, middle = (" ".join(word(5) for _ in range(n))[:m] for n, m in ((60, 350), (20, 112)))
    items = [(1, long), (2, middle), (3, "Zqx 17"), (4, "zebra zz quux 99 yes"), (5, " "), (6, "zebra zz 00")]
    rows = [(k, prose(rng, 10) + long[k : k + 103] + prose(rng, 10), [1]) for k in range(0, 247)]
    rows += [(300 + k, prose(rng, 10) + middle[k : k + 103] + prose(rng, 10), [2]) for k in range(9)]
    rows += [(400, "the zqx\t17 of", [3]), (401, "zebra zz quux 99 yeS", [4]), (402, "zebra zz quux 98 yes zqx 1", []), (403, "zebra zz 00", [6]), (404, "zebra zz 0", []), (405, "", [])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {d: want for d, _, want in rows}

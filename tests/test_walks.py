"""Walks, departures, windows and printed rows against plain loops over random graphs."""

import random

import pytest

from pangrove.operators import encode, intervals, place, walks, windows
from pangrove.plans import files
from pangrove.plans.storage import written
from pangrove.sources.gfa import gfa_of_text
from tests.graphs import Small, pieces, placed


def small(spark, seed, **kind):
    g = Small(seed, **kind)
    return g, gfa_of_text(spark, g.text(), walks=True)


@pytest.mark.parametrize("seed,stay", [(1, 0), (2, 40), (4, 200)])
def test_steps_stay_and_pieces(spark, seed, stay, monkeypatch):
    monkeypatch.setattr(place, "BLOCK", 6)  # lines of several blocks
    g, graph = small(spark, seed)
    got = {}
    for r in walks.walk_steps(graph, "R", 50, stay).collect():
        got.setdefault((r["name"], r.start), []).append((r.i, int(r.node), r.rev, r.offset, None if r.ref_offset is None else (r.ref_offset, r.ref_rev), r.t_tile, r.piece))
    want = {}
    for line in g.lines:
        rows = [(*row, p) for p, (_, run) in enumerate(pieces(placed(g, line, 50, stay))) for row in run]
        if rows:
            want[line[0], line[1]] = [(k, *row) for k, row in enumerate(rows)]
    assert {k: sorted(v) for k, v in got.items()} == want


def holes(g):
    (_, a, s), (_, b, _) = g.lines[:2]
    return a + sum(g.length[n] for n, _ in s), b


def squeezed(g, at):
    lo, hi = holes(g)
    return at - max(0, min(hi, at) - lo) if at > lo else at


def chain(g, tile):
    """Each path's placed steps with their piece and line, in the order of its lines."""
    out = {}
    for k, line in sorted(enumerate(g.lines), key=lambda x: x[1][1]):
        if not line[0].startswith("R#"):
            for p, (_, run) in enumerate(pieces(placed(g, line, tile, 0))):
                out.setdefault(line[0], []).extend((k, p, row) for row in run if row[3])
    return out


def ends(g, a, b):
    side = lambda row, leave: row[3][0] if (row[1] != row[3][1]) == leave else row[3][0] + g.length[row[0]]
    return side(a, True), a[1] != a[3][1], side(b, False), b[1] != b[3][1]


@pytest.mark.parametrize("seed", [5])
def test_departures_along_contigs(spark, seed):
    g, graph = small(spark, seed, lines=20)
    off = place.offset_steps(graph)
    tiled = written(walks.walk_steps(graph, "R", 50), "t")
    rows = walks.departures(tiled, "R", walks.reference_holes(off, "R"), walks.line_spans(off)).collect()
    got = sorted((r["name"], r.hap_start, r.own_bp, r.missing_bp, r.leave_pos, r.leave_rev, r.rejoin_pos, r.rejoin_rev) for r in rows)
    want = []
    for name, steps in chain(g, 50).items():
        covered = [range(s, s + sum(g.length[n] for n, _ in w)) for nm, s, w in g.lines if nm == name]
        for (k, p, a), (m, q, b) in zip(steps, steps[1:]):
            lp, lr, rp, rr = ends(g, a, b)
            begin = a[2] + g.length[a[0]]
            if (k, p) != (m, q) and not (b[2] == begin and lr == rr and squeezed(g, lp) == squeezed(g, rp)):
                missing = sum(not any(x in c for c in covered) for x in range(begin, b[2]))
                want.append((name, begin, b[2] - begin, missing, lp, lr, rp, rr))
    assert got == sorted(want) and any(w[3] for w in want)


def overlapping_tiles(g, lo, hi, tile):
    spans = {}
    for name, at, walk in g.lines[:2]:
        for n, _ in walk:
            spans.setdefault(at // tile * tile, []).append((at, at + g.length[n]))
            at += g.length[n]
    return {t for t, s in spans.items() if min(a for a, _ in s) < hi and max(b for _, b in s) > lo}


@pytest.mark.parametrize("seed", [7])
def test_windows(spark, seed):
    """Windows at any place, also inside a node longer than a tile."""
    g, graph = small(spark, seed)
    tiled = written(walks.walk_steps(graph, "R", 12), "t")
    rng = random.Random(seed)
    for lo, hi in [(0, 1), *[(a, a + rng.choice([1, 5, 40])) for a in rng.sample(range(250), 3)]]:
        near = windows.steps_over(tiled, "R", "R#0#x", lo, hi)
        got = sorted((r["name"], r.frag_start, r.hap_start, r.hap_end, r.bp_before, r.bp_after) for r in windows.fragments(near).collect())
        read, want, links, nodes = overlapping_tiles(g, lo, hi, 12), [], set(), {}
        for name, start, walk in g.lines:
            runs, last = [], None
            for p, (t, run) in enumerate(pieces(placed(g, (name, start, walk), 12, 0))):
                if t in read:
                    runs = [*runs, []] if last != p - 1 else runs
                    runs[-1].extend(run)
                    last = p
            for run in runs:
                at = [k for k, s in enumerate(run) if s[3] and s[3][0] < hi and s[3][0] + g.length[s[0]] > lo]
                if at:
                    bp = lambda some: sum(g.length[s[0]] for s in some)
                    a, b = at[0], at[-1]
                    want.append((name, start, run[a][2], run[b][2] + g.length[run[b][0]], bp(run[:a]), bp(run[b + 1 :])))
                    for x, y in zip(run[a : b + 1], run[a + 1 : b + 1]):
                        ways = [(x[0], x[1], y[0], y[1]), (y[0], not y[1], x[0], not x[1])]
                        links.add(min(ways, key=lambda w: (w[1] + w[3], w)))
                    for s in run[a : b + 1]:
                        nodes[s[0]] = None
        assert got == sorted(want)
        assert {(int(r.src), r.src_rev, int(r.tgt), r.tgt_rev) for r in windows.taken_links(near).collect()} == links
        passes = {n: [p for p in ps if p[0] // 12 * 12 in read] for n, ps in g.reference().items()}
        over = lambda n, p: p[0] < hi and p[0] + g.length[n] > lo
        known = set(nodes) | {n for n, ps in passes.items() if any(over(n, p) for p in ps)}
        drawn = {int(r.node): (r.rank, r.start_pos) for r in windows.drawn_nodes(near, [], tiled, "R", "R#0#x", lo, hi).collect()}
        assert set(drawn) == known
        index = spark.createDataFrame([(str(n),) for n in [*list(nodes)[1:], 999]], "node string")
        apart = {(r.node, r.in_walks) for r in windows.node_sets(near, index).collect()}
        assert apart == {("999", False), *((str(n), True) for n in list(nodes)[:1])}
        for n in known:
            if passes.get(n):
                assert drawn[n] == (0, min(passes[n], key=lambda p: (not over(n, p), p))[0])
            else:
                assert drawn[n][0] == 1


@pytest.mark.parametrize("seed", [9])
def test_printed_rows_come_back(spark, seed):
    """Rows of loops, turns and repeats are read back to the same steps; within budgets too."""
    g, graph = small(spark, seed, lines=14)
    tiled = written(walks.walk_steps(graph, "R", 40, 30), "t")
    rows = written(encode.encode(tiled, "R"), "t")
    assert encode.lost_steps(rows, tiled, "R").count() == 0
    assert files.faults(rows).count() == 0 and files.next_starts(rows).count() == 0
    lines = {}
    for r in encode.rebuild_lines(rows).collect():
        lines.setdefault((r.path, r.frag_start), []).append((r.i, r.node, r.rev))
    want = {(name, start): [(k, *s) for k, s in enumerate(walk)] for name, start, walk in g.lines if any(n in g.reference() for n, _ in walk)}
    assert {k: sorted(v) for k, v in lines.items()} == want
    for steps_budget, bytes_budget in ((10, 1 << 30), (40, 500)):
        short = written(encode.encode_within(tiled, "R", steps_budget, bytes_budget), "t")
        assert files.faults(short).count() == 0 and encode.lost_steps(short, tiled, "R").count() == 0
        check_budgets(short, rows, steps_budget, bytes_budget)
        check_blocks(short)
    with pytest.raises(place.Refusal):
        encode.encode(tiled, "R", graph.segments.select("node", "bases"))


def check_budgets(short, rows, steps_budget, bytes_budget):
    """What stays fits; and with one line fewer moved it would not."""
    size = lambda found: sum(len(r.line.split("\t", 3)[3]) + 1 for r in found)
    tiles = {}
    for r in short.where("unit = -1 and kind not in ('abridged', 'blocks')").collect():
        tiles.setdefault(r.tile, []).append(r)
    steps = written(encode.decode(short), "t")
    kept = {r.tile: r for r in steps.where("unit = -1").groupBy("tile").agg({"*": "count", "ref_offset": "count"}).collect()}
    moved = {r.tile for r in short.where("kind = 'abridged'").collect()}
    whole = {}
    for r in rows.collect():
        whole.setdefault(r.tile, []).append(r)
    for tile, found in tiles.items():
        if any(r.kind == "walk" for r in found):
            n, on = kept[tile]["count(1)"], kept[tile]["count(ref_offset)"]
            assert n + 4 * (n - on) <= 4 * steps_budget and size(found) <= bytes_budget
        if tile not in moved:
            assert sorted(r.line for r in found) == sorted(r.line for r in whole[tile])


def check_blocks(short):
    """Stretches and runs add up to the piece, and stretches lie where its steps do."""
    items = {}
    for r in encode.read_blocks(short).collect():
        items.setdefault((r.tile, r.path, r.frag_start, r.piece), []).append(r)
    steps = {}
    for r in encode.decode(short).where("unit >= 0").collect():
        steps.setdefault((r.tile, r.path, r.frag_start, r.piece), []).append(r)
    assert set(items) == set(steps)
    for key, rows in items.items():
        walk = sorted(steps[key], key=lambda r: r.k)
        rows.sort(key=lambda r: r.item)
        assert sum(r.bp for r in rows) == sum(s.length for s in walk)
        assert all(a.lo is not None or b.lo is not None for a, b in zip(rows, rows[1:]))
        x = 0
        for r in rows:
            bp, spots = 0, []
            while bp < r.bp:
                spots.append((walk[x].ref_offset, walk[x].length))
                bp += walk[x].length
                x += 1
            assert bp == r.bp
            if r.lo is None:
                assert all(a is None for a, _ in spots)
            else:
                spots = spots[::-1] if r.against else spots
                assert spots[0][0] == r.lo and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and spots[-1][0] + spots[-1][1] == r.hi


def test_bounds_of_bytes(spark, monkeypatch):
    """The bytes of a tile's rows lie within their bounds, and a budget above them asks for no encoding."""
    _, graph = small(spark, 3)
    tiled = written(walks.walk_steps(graph, "R", 50), "test-tiled")
    bounds = encode._line_costs(tiled, "R", True).groupBy("seq", "tile").agg({"least": "sum", "most": "sum", "ref_least": "first", "ref_most": "first"})
    got = encode._kept_bytes(encode.encode(tiled, "R")).join(bounds, ["seq", "tile"]).collect()
    assert len(got) > 1
    for r in got:
        assert r["first(ref_least)"] + r["sum(least)"] <= r["bytes"] <= r["first(ref_most)"] + r["sum(most)"]
    moved = encode.moved_lines(tiled, "R", 8, 1 << 40)
    whole = encode.encode_within(tiled, "R", 8, 1 << 40).where("kind in ('abridged', 'blocks')")
    monkeypatch.setattr(encode, "encode", None)
    assert moved.count() > 0 and encode.moved_lines(tiled, "R", 8, 1 << 40).exceptAll(moved).count() == 0
    alone = encode.abridged_within(tiled, "R", 8, 1 << 40)
    assert alone.exceptAll(whole).count() == whole.exceptAll(alone).count() == 0


def test_bases(spark):
    g, graph = small(spark, 12)
    bases = spark.createDataFrame([(str(n), "ACGT"[n % 4] * l) for n, l in g.length.items()], "node string, bases string")
    rows = encode.encode(written(walks.walk_steps(graph, "R", 40), "t"), "R", bases).where("kind in ('ref', 'nodes')").collect()
    for r in rows:
        c = r.line.split("\t")
        want = "".join("ACGT"[n % 4] * g.length[n] for n in ([h >> 1 for h in encode._unchained(c[9], 0)[0]] if c[3] == "ref" else __import__("itertools").accumulate(map(int, c[4].split(",")))))
        assert c[-1] == "SQ:Z:" + want


def test_saved_walks(spark, tmp_path):
    g, graph = small(spark, 13)
    path = str(tmp_path / "w")
    header = files.write_walks(graph, "R", path, 20, 10, 6, 500)
    reader = files.Walks(spark, path)
    assert header == reader.header and header["revisited"] == 1
    assert {r.haplotype for r in reader.haplotypes().collect()} == {"#".join(n.split("#")[:2]) for n, _, _ in g.lines[2:]}
    steps = [(name, start, p, row) for name, start, walk in g.lines for p, (t, run) in enumerate(pieces(placed(g, (name, start, walk), 20, 10))) for row in run if t in overlapping_tiles(g, 45, 90, 20)]
    rows = reader.rows("R#0#x", 45, 90)
    whole = {}
    for name, start, p, row in steps:
        whole[name, start, p] = whole.get((name, start, p), 0) + g.length[row[0]]
    for expand in (None, rows.select(__import__("pyspark").sql.functions.split("line", "\t")[4].alias("path")).distinct()):
        found = {}
        for r in windows.read_rows(rows, "R#0#x", 45, 90, expand).collect():
            found[r.path, r.frag_start, r.piece] = found.get((r.path, r.frag_start, r.piece), 0) + r.length
            assert expand is None or r.node is not None
        assert found == whole
    with pytest.raises(place.Refusal):
        files.Walks(spark, str(tmp_path))


def test_windows_that_the_last_tile_begins_behind(spark, tmp_path):
    """A node that reaches over the start of the next tile is read by windows before that tile's own first node."""
    lengths = [10, 25, 10, 70, 5]  # at 0, 10, 35, 45 and 115, in tiles 0, 0, 20, 40 and 100
    extents = [(0, 35), (35, 45), (45, 115), (115, 120)]
    text = "".join(f"S\t{n}\t*\tLN:i:{bp}\n" for n, bp in enumerate(lengths, 1)) + "".join(f"W\t{s}\t0\tx\t0\t120\t>1>2>3>4>5\n" for s in "RH")
    path = str(tmp_path / "w")
    files.write_walks(gfa_of_text(spark, text, walks=True), "R", path, 20, 0)
    reader = files.Walks(spark, path)
    for lo, hi in ((30, 34), (34, 36), (35, 36), (0, 1), (70, 71), (110, 112), (100, 116), (119, 120), (119, 500)):
        got = windows.read_rows(reader.rows("R#0#x", lo, hi), "R#0#x", lo, hi).groupBy("path", "piece").agg({"length": "sum"}).collect()
        want = [(f"{s}#0#x", p, b - a) for s in "HR" for p, (a, b) in enumerate(extents) if a < hi and b > lo]
        assert sorted(tuple(r) for r in got) == want


def test_frames_do_not_restart(spark):
    """No window sums what is left of its line anew for each step, at any setting of blocks and stays."""
    _, graph = small(spark, 2)
    offset = written(place.offset_steps(graph), "test-offsets")
    placed = written(walks.place_steps(offset, "R"), "test-places")
    for stay, block in ((0, None), (40, None), (40, 4)):
        plan = walks.tiled_steps(placed, "R", 50, stay, block)._jdf.queryExecution().analyzed().toString()
        assert "unboundedpreceding$()" in plan
        assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan


def test_cover(spark):
    from pyspark.sql import functions as F

    def greedy(lo, hi, tile):
        at, end, out = lo // tile * tile, -(-hi // tile) * tile, []
        while at < end:
            size = next(n * tile for n in (512, 64, 8, 1) if at % (n * tile) == 0 and at + n * tile <= end)
            out.append((at, size))
            at += size
        return out

    pairs = [(a, b) for a in (0, 5, 63, 64, 500, 511, 4000) for b in (1, 8, 65, 130, 512, 577, 1100, 5000) if b > a]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", intervals.cover(F.col("a"), F.col("b"), 2).alias("c")).collect()
    assert all([(x.start, x.size) for x in r.c] == greedy(r.a, r.b, 2) for r in rows)


def test_departures_saved_once(spark, tmp_path):
    """A saved departure is one row, and any window reads those that overlap it."""
    rng = random.Random(5)
    spans = [(a, a + rng.choice([1, 3, 20, 21, 159, 160, 161, 5000])) for a in (rng.randrange(6000) for _ in range(300))]
    rows = spark.createDataFrame([("s", a, b, k) for k, (a, b) in enumerate(spans)], "seq string, start_pos bigint, end_pos bigint, k int")
    binned = walks.binned_departures(rows, 20)
    assert binned.count() == len(spans) < walks.filed_departures(rows, 20).count()
    for lo, hi in ((0, 1), (45, 90), (3199, 3201), (2560, 5121), (10999, 12000)):
        got = sorted(r.k for r in walks.binned_departures_in(binned, "s", lo, hi, 20).collect())
        assert got == [k for k, (a, b) in enumerate(spans) if a < hi and b > lo]
    _, graph = small(spark, 13)
    path = str(tmp_path / "w")
    files.write_walks(graph, "R", path, 20, 10, 6, 500)
    saved = files.Walks(spark, path).table("departures")
    assert 0 < saved.count() == saved.drop("bin_start", "bin_size").distinct().count()


def test_offsets_of_short_lines(spark):
    """Where no line is longer than a block, one level of sums gives the offsets of two."""
    import dataclasses

    _, graph = small(spark, 3)
    two = place.offset_steps(graph, 6)
    known = dataclasses.replace(graph, longest=10_000)
    one = place.offset_steps(known)
    assert one.columns == two.columns and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(one).count("Join") < plan(place.offset_steps(known, 6)).count("Join")


def test_close_bounds_of_bytes(spark, monkeypatch):
    """A tile's bytes without its first lines lie within close bounds, and those leave little to encode."""
    from pyspark.sql import functions as F

    _, graph = small(spark, 6)
    tiled = written(walks.walk_steps(graph, "R", 50), "test-tiled")
    whole = encode.gathered(tiled, "R")
    ranks = whole.select("seq", "tile", "line").distinct().withColumn("unit", F.dense_rank().over(encode.Window.partitionBy("seq", "tile").orderBy("line")))
    ranked = written(whole.drop("unit").join(ranks, ["seq", "tile", "line"]), "test-ranked")
    bounds = {(r.tile, r.m): r for r in encode._byte_bounds(ranked, tiled, "R").collect()}
    sizes = {}
    for m in (0, 1, 4):
        kept = encode._printed(tiled, ranked.where(F.col("unit") > m).withColumn("unit", F.lit(encode.WHOLE)), "R")
        for r in encode._kept_bytes(kept).collect():
            if (r.tile, m) in bounds:
                b = bounds[r.tile, m]
                sizes[r.tile, m] = r.bytes
                assert b.least <= r.bytes <= b.most and b.most - b.least < 0.25 * r.bytes + 20
    assert len(sizes) > 10
    budget = sorted(size for (_, m), size in sizes.items() if m == 0)[2]
    rounds = []
    printed = encode._printed
    monkeypatch.setattr(encode, "_printed", lambda *a: rounds.append(1) or printed(*a))
    moved = {r.tile: r.n for r in encode.moved_lines(tiled, "R", 1 << 40, budget).groupBy("tile").agg(F.count("*").alias("n")).collect()}
    assert moved and len(rounds) <= 3
    for (tile, m), size in sizes.items():
        assert m or (tile in moved) == (size > budget)


def test_units_share_batches():
    """Units of few steps are read into common batches, not one for each."""
    unit = {"seq": "s", "tile": 0, "unit": 3, "refs": ["s\t0\t5\tref\tR#0#s\t0\t0\t0\t1\t4\t5\t."], "tables": [], "walks": ["s\t0\t5\twalk\tH#1#s\t0\t7\t2\t1\t4\t."]}
    got = list(encode._decoded([unit] * 100))
    assert [b.num_rows for b in got] == [100] and [b.num_rows for b in encode._decoded([unit] * 7, 3)] == [3, 3, 1]
    assert set(zip(*(c.to_pylist() for c in got[0].columns))) == {("s", 0, 3, "H#1#s", 0, 7, 2, 0, 2, False, 5, 0)}

"""Placement, indexes, reading, alleles, folds and calls: plain loops over graphs made here."""

import gzip
import random

import pytest

from pangrove.functions.handles import graph_hash
from pangrove.operators import alleles, bubbles, fold, index, metrics, place
from pangrove.plans import files
from pangrove.plans.build import build, default_prefix
from pangrove.sources.bed import read_bed, write_bgzf
from pangrove.sources.gfa import gfa_of_text, gfa_text, read_gfa, read_lines, read_walks
from tests.graphs import Small

#: A backbone of four segments on one sequence, an arm of two, a bridge, and a part that hangs on nothing.
SEGMENTS = [
    ("k1", 7, "seven", 0, 0), ("k2", 4, "seven", 7, 0), ("k3", 12, "seven", 11, 0), ("k4", 3, "seven", 23, 0),
    ("arm1", 2, "p#2#q", 40, 1), ("arm2", 6, "p#2#q", 42, 1), ("bridge", 20, "u#1#v", 5, 2), ("far1", 1, "w", 0, 1), ("far2", 1, "w", 1, 1),
]
LINKS = ["k1+ k2+", "k2+ k3+", "k3+ k4+", "k1+ arm1+", "arm1+ arm2-", "arm2- k3+", "k2+ bridge+", "bridge+ k4+", "far1+ far2+", "k1+ k3+"]


def tagged(segments, links):
    s = "".join(f"S\t{n}\t*\tLN:i:{l}\tSN:Z:{q}\tSO:i:{o}\tSR:i:{r}\n" for n, l, q, o, r in segments)
    return s + "".join(f"L\t{a[:-1]}\t{a[-1]}\t{b[:-1]}\t{b[-1]}\t0M\n" for a, b in map(str.split, links))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_tags_by_contig_and_anchored(spark):
    graph, placed = place.place(gfa_of_text(spark, tagged(SEGMENTS, LINKS)))
    assert placed.from_tags
    own = {n: (q, o, o + l) for n, l, q, o, _ in SEGMENTS}
    contig = index.by_contig(placed)
    assert rows_of(index.node_rows(placed, contig), "node", "seq", "start_pos", "end_pos") == sorted((n, *x) for n, x in own.items())
    assert index.link_rows(graph, placed, contig, "contig").count() == 2 * len(LINKS)
    # By hand: both arms hang from k1 to k3, the bridge from k2 to k4, the far part from itself.
    want = own | {"arm1": ("seven", 0, 23), "arm2": ("seven", 0, 23), "bridge": ("seven", 7, 26)}
    spans = index.anchored(graph, placed)
    assert rows_of(index.node_rows(placed, spans), "node", "seq", "start_pos", "end_pos") == sorted((n, *x) for n, x in want.items())
    small = index.anchored(graph, placed, 1)
    want |= {n: own[n] for n in ("arm1", "arm2")}
    assert rows_of(index.node_rows(placed, small), "node", "seq", "start_pos", "end_pos") == sorted((n, *x) for n, x in want.items())
    assert [(r.n_nodes, r["at"].start_pos) for r in small.moved.collect()] == [(2, 0)]


@pytest.mark.parametrize("seed", [21])
def test_paths_first_visits(spark, seed):
    g = Small(seed, revisits=False)
    graph = gfa_of_text(spark, g.text(p_lines=seed % 2 == 1))
    with pytest.raises(place.Refusal):
        place.place(graph)
    with pytest.raises(place.Refusal):
        place.place(graph, "nobody")
    visits = {}
    for name, start, steps in g.lines:
        at = start
        for n, r in steps:
            visits.setdefault(n, []).append((not name.startswith("R#"), name, start, at, r))
            at += g.length[n]
    turned, placed = place.place(graph, "R")
    got = {int(r.node): (r.seq, r.start_pos, r.rank, r.flipped, list(r.carriers)) for r in placed.nodes.collect()}
    want = {}
    for n, seen in visits.items():
        seen.sort()
        off, name, _, at, rev = seen[0]
        order = list(dict.fromkeys(".".join(x[1].split("#")[:2]) for x in seen))
        want[n] = (name, at, int(off), rev, order)
    assert got == want
    strands = {(int(r.node), r.i, r.line): r.rev for r in turned.steps.collect()}
    for r in graph.steps.collect():
        assert strands[int(r.node), r.i, r.line] == (r.rev != want[int(r.node)][3])
    names = sorted({".".join(n.split("#")[:2]) for n, _, _ in g.lines})
    for r in index.carrier_sets(placed).collect():
        mask = sum(1 << names.index(c) for c in want[int(r.node)][4])
        assert sum(int(x, 16) << 4 * k for k, x in enumerate(r.bits)) == mask
    traffic = metrics.link_traffic(graph.steps)
    assert metrics.unlinked(traffic, graph.links).count() == 0 and metrics.untraversed(graph.links, traffic).count() == 0


def test_reader(spark, tmp_path):
    """Byte ranges, gzip by its first bytes, folders; and the text of a graph read back."""
    text = Small(23, nodes=12, lines=3).text()
    plain, packed, folder = tmp_path / "g.gfa", tmp_path / "g.any", tmp_path / "parts"
    plain.write_text(text)
    packed.write_bytes(gzip.compress(text.encode()[:50]) + gzip.compress(text.encode()[50:]))
    folder.mkdir()
    lines = text.splitlines()
    (folder / "a").write_text("\n".join(lines[:5]) + "\n")
    (folder / "b").write_bytes(gzip.compress("\r\n".join(lines[5:]).encode()))
    (folder / "_SUCCESS").write_text("no line")
    for path, split in ((plain, 1 << 20), (plain, 1), (plain, 7), (packed, 64), (folder, 9)):
        assert [r.line for r in read_lines(spark, str(path), split).orderBy("pos").collect()] == lines
    a, b = read_gfa(spark, str(plain)), read_walks(spark, str(folder))
    assert rows_of(a.steps, "i", "node", "rev") == rows_of(b.steps, "i", "node", "rev")
    again = gfa_of_text(spark, "\n".join(r.line for r in gfa_text(a).orderBy("kind_rank", "key").collect()))
    assert rows_of(again.links, "src", "src_rev", "tgt", "tgt_rev") == rows_of(a.links, "src", "src_rev", "tgt", "tgt_rev")
    assert graph_hash(again.segments).first() == graph_hash(a.segments).first()


TWO = "S\t1\tACG\nS\t2\tTT\n"


@pytest.mark.parametrize("line,walks", [
    ("L\t1\t+\t2\t?\t0M", False), ("L\t1\t+\t2", False), ("L\t1\t+\t2\t+\t3M", False), ("P\tx\t1+,2\t*", False), ("P\tx\t1+;2+\t*", False), ("P\tx\t1+,2+\t2M", False), ("P\tx", False),
    ("P\tx[3-9]\t1+,2+\t*", False), ("P\t[4]\t1+\t*", False), ("W\ta\t1\tc\tx\t9\t>1", False), ("W\ta\t1\tc\t0\t5\t>1 >2", False), ("W\ta\t1\tc\t0\t5\t1>2", False), ("W\ta\t1\tc\t0", False),
    ("W\ta\t1\tc\t0\t6\t>1>2", True), ("W\ta#b\t1\tc\t0\t5\t>1>2", True), ("W\ta\t1\tc\t0\t*\t>1>2", True), ("W\ta\t1\tc d\t0\t5\t>1>2", True), ("P\t#x\t1+\t*", True),
    (f"W\ta\t1\tc\t{(1 << 53) + 1}\t{(1 << 53) + 6}\t>1>2", True), ("S\t1\tA", True), (f"S\t{1 << 31}\tA", True), ("S\tone\tA", True),
])
def test_refused_lines(spark, line, walks):
    gfa_of_text(spark, TWO + "W\tr\t1\tc\t0\t5\t>1>2\nP\tq\t2-,1+\t*,*\n", walks)
    with pytest.raises(place.Refusal):
        gfa_of_text(spark, TWO + line, walks)


@pytest.mark.parametrize("lines", ["W\tr\t1\tc\t0\t5\t>1>3\n", "W\tr\t1\tc\t0\t5\t>1>2\nW\tr\t1\tc\t4\t9\t>1>2\n", "W\tr\t1\tc\t0\t5\t>1>2\nW\tr\t1\tc\t0\t3\t>1\n"])
def test_refused_paths(spark, lines):
    """A step on an unknown node; lines of one path that overlap, or start alike."""
    from pangrove.operators import walks

    graph = gfa_of_text(spark, TWO + lines)
    with pytest.raises(place.Refusal):
        walks.walk_steps(graph, "r")
    with pytest.raises(place.Refusal):
        place.place(graph, "r")


def test_long_walks(spark):
    """A walk of many steps is checked without recursion, and one with more than steps is still refused."""
    n = 30_000
    text = "S\t1\t*\tLN:i:2\nW\tA\t1\tc\t0\t%d\t%s\n"
    assert gfa_of_text(spark, text % (2 * n, ">1" * n)).steps.count() == n
    for walk in (">1" * n + ">", "1" + ">1" * n, ">1" * n + ">>1", ">1" * n + " >1", "**"):
        with pytest.raises(place.Refusal, match="holds more than steps"):
            gfa_of_text(spark, text % (2 * n, walk))
    assert gfa_of_text(spark, text % (0, "*")).steps.count() == 0


def test_names(spark):
    """Names of every kind of ending, against the endings that they were made of."""
    from pyspark.sql import functions as F

    from pangrove.functions.names import path_name

    rng, rows, want = random.Random(24), [], {}
    for k in range(300):
        base, bp, start = rng.choice(["m", "m#1", "m#1#c", "m#1#c:x", "m#1#c#d"]), rng.randrange(1, 9), 0
        name = path = base
        if rng.random() < 0.4:
            n = rng.randrange(50)
            name += f"#{n}"
            if base.count("#") == 2:
                start += n
            else:
                path = name
        spans = rng.random() < 0.3
        if rng.random() < 0.4:
            n = rng.randrange(50)
            name += f"[{n}-{n + (bp if not spans or rng.random() < 0.5 else bp + 1)}]" if rng.random() < 0.5 else f"[{n}]"
            start += n
        if spans:
            n = rng.randrange(50)
            name += f":{n}-{n + bp}"
            start += n
        elif rng.random() < 0.2:
            name = path = f"{name}:{k}-{k + bp + 1}"
            start = 0
        rows.append((k, name, bp))
        want[k] = path, start
    rows += [(1000, "", 3), (1001, "[5]", 3), (1002, "c[2-4]", 3)]
    p = spark.createDataFrame(rows, "k int, n string, bp bigint").select("k", path_name(F.col("n"), F.col("bp")).alias("p"))
    got = {r.k: (r.p.path, r.p.start) if r.p.error is None else None for r in p.collect()}
    assert got == want | {1000: None, 1001: None, 1002: None}


def test_saved_graph(spark, tmp_path):
    graph, placed = place.place(gfa_of_text(spark, tagged(SEGMENTS, LINKS)))
    path = str(tmp_path / "g")
    header = files.write_graph(graph, placed, path)
    nodes, links, again = files.read_graph(spark, path)
    assert again == header and header["rows"] == {"node": len(SEGMENTS), "link": 2 * len(LINKS)} and header["skipped_links"] == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = index.region(nodes, "seven", 0, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(end_pos" in plan and "EqualTo(seq" in plan
    assert rows_of(files.alleles_of(spark, path), "segments", "start_pos", "delta") == rows_of(alleles.alleles(graph, placed), "segments", "start_pos", "delta")
    assert sum(r.n for r in files.class_counts(files.alleles_of(spark, path)).collect()) == files.alleles_of(spark, path).count()
    files.write_graph(graph, placed, path + "a", "anchored")
    with pytest.raises(place.Refusal):
        files.alleles_of(spark, path + "a")
    with pytest.raises(place.Refusal):
        files.read_graph(spark, str(tmp_path))


def test_alleles(spark):
    """Worked by hand on the graph above: an arm through two segments, a bridge, a skip."""
    graph, placed = place.place(gfa_of_text(spark, tagged(SEGMENTS, LINKS)))
    got = rows_of(alleles.alleles(graph, placed), "start_pos", "end_pos", "class", "delta", "alt_len", "ref_len", "cigar", "rank", "donor", "segments")
    assert got == [
        (7, 11, "del", -4, 0, 4, "4D", ".", ".", "."),  # k1 to k3
        (7, 11, "ins", 4, 8, 4, "4M4I", "1", "p", ">arm1<arm2"),  # in place of k2
        (11, 23, "ins", 8, 20, 12, "12M8I", "2", "u", ">bridge"),  # in place of k3
    ]


def test_fold(spark):
    """Two small bubbles fold away, a long insertion stays; the backbone between them is one segment."""
    graph = gfa_of_text(spark, tagged(
        [("a", 30, "s", 0, 0), ("b", 5, "s", 30, 0), ("c", 40, "s", 35, 0), ("d", 6, "s", 75, 0), ("e", 50, "s", 81, 0), ("f", 20, "s", 131, 0), ("x", 4, "t", 0, 1), ("y", 90, "t", 10, 1)],
        ["a+ b+", "b+ c+", "c+ d+", "d+ e+", "e+ f+", "a+ x+", "x+ c+", "c+ e+", "e+ y+", "y+ f+"],
    ))
    folded = fold.fold(graph, place.from_tags(graph), 15)
    assert rows_of(folded.segments, "sn", "so", "length") == [("s", 0, 131), ("s", 131, 20), ("t", 10, 90)]
    ends = rows_of(folded.links, "src", "tgt")
    first = folded.segments.where("so = 0").first().node
    assert ends == sorted([(first, "f"), (first, "y"), ("y", "f")])


def test_bubbles(spark):
    """Random records against a plain greedy choice of those that begin behind the last chosen."""
    rng, rows, want = random.Random(25), ["##head"], []
    records = []
    for k in range(60):
        at, ref = rng.randrange(1, 400), "A" * rng.choice([1, 4, 20])
        alts = ["C" * rng.choice([1, 2, 30]) for _ in range(rng.choice([1, 2]))]
        inner = [(rng.choice("<>"), 100 + rng.randrange(5)) for _ in range(2)]
        walk = [f">{k}>{k + 900}", f">{k}" + "".join(f"{s}{n}" for s, n in inner) + f">{k + 900}"][: rng.choice([1, 2, 2, 2])]
        level = rng.choice([0, 0, 0, 1])
        rows.append(f"z\t{at}\t>{k}>{k + 900}\t{ref}\t{','.join(alts)}\t.\t.\tLV={level};AT={','.join(walk)}")
        if level == 0 and len(walk) == 2:
            sizes = [len(x) for x in (ref, *alts)]
            records.append((at - 1, at - 1 + len(ref), k, 2 + len({n for _, n in inner}), 2, int(any(s == "<" for s, _ in inner)), min(sizes), max(sizes), f"{k}@{at - 1},{k + 900}"))
    end = -1
    for r in sorted(records):
        if r[0] >= end:
            want.append((r[0], r[1], *r[3:]))
            end = r[1]
    lines = spark.createDataFrame(list(enumerate(rows)), "pos bigint, line string")
    assert rows_of(bubbles.bubbles(lines), "start_pos", "end_pos", "segments", "walks", "inversion", "shortest", "longest", "ids") == want


def test_sample_paths(spark):
    calls = [
        ("ref", 0, "ref#0#z", 2, 12, ">a:10:+:t:0:10"), ("one", 0, "ref#0#z", 2, 12, ">b:7:-:t:0:7"), ("two", 0, "ref#0#z", 2, 12, "."),
        ("ref", 1, "z", 30, 30, "*:0:+:t:0:0"), ("one", 1, "z", 30, 30, "*:0:+:t:0:0"), ("two", 1, "z", 30, 30, ">q:2400:+:t:0:9"),
        ("ref", 2, "z", 50, 55, ">a:5:+:t:0:5"), ("one", 2, "z", 50, 55, ">c:5:+:t:0:5"), ("two", 2, "z", 50, 55, ">a:5:+:t:0:5"),
    ]
    df = spark.createDataFrame(calls, "sample string, bubble bigint, chrom string, start_pos bigint, end_pos bigint, field string")
    got = rows_of(bubbles.sample_paths(df, "ref"), "start_pos", "sample", "end_pos", "label", "class", "delta", "alleles", "non_ref")
    assert got == [
        (2, "one", 12, "-3", "del", -3, 2, 1), (2, "ref", 12, "ref", "ref", 0, 2, 1), (2, "two", 12, "no call", "nocall", 0, 2, 1),
        (30, "one", 31, "ref", "ref", 0, 2, 1), (30, "ref", 31, "ref", "ref", 0, 2, 1), (30, "two", 31, "+2,400", "ins", 2400, 2, 1),
        (50, "one", 55, "5 sub", "sub", 0, 2, 1), (50, "ref", 55, "ref", "ref", 0, 2, 1), (50, "two", 55, "ref", "ref", 0, 2, 1),
    ]


def test_bundle_and_bgzf(spark, tmp_path):
    text = tagged(SEGMENTS, LINKS)
    made = build(gfa_of_text(spark, text), str(tmp_path), below=0)
    assert made["coordinates"] == "tags" and default_prefix("in/here/y.gfa.gz") == "y"
    assert spark.read.parquet(made["tables"]["contig_links"]).count() == 2 * len(LINKS)
    _, placed = place.place(gfa_of_text(spark, text))
    rows = index.node_text(index.node_rows(placed, index.by_contig(placed)))
    write_bgzf(rows, str(tmp_path / "x.bed.gz"), "#head\n")
    want = [r.line for r in rows.orderBy("seq", "start_pos", "line").collect()]
    assert gzip.decompress((tmp_path / "x.bed.gz").read_bytes()).decode().splitlines() == ["#head", *want]
    back = read_bed(read_lines(spark, str(tmp_path / "x.bed.gz")), ["seq", "start", "end", "node", "rank"])
    assert [r.node for r in back.orderBy("pos").collect()] == [w.split("\t")[3] for w in want]


def test_text_read_back(spark):
    """Index rows as text, read again, give the same alleles."""
    graph, placed = place.place(gfa_of_text(spark, tagged(SEGMENTS, LINKS)))
    for layout, spans in (("contig", index.by_contig(placed)), ("anchored", index.anchored(graph, placed, 1))):
        nodes, links = index.node_rows(placed, spans), index.link_rows(graph, placed, spans, layout)
        lines = [r.line for r in index.node_text(nodes, layout == "anchored").collect()] + [r.line for r in index.link_text(links).collect()]
        read = index.read_text(spark.createDataFrame(list(enumerate(["#x", *lines])), "pos bigint, line string"), layout == "anchored")
        columns = ("node", "seq", "start_pos", "end_pos", "rank", "own_seq", "own_start", "own_end")
        assert rows_of(read[0], *columns) == rows_of(nodes, *columns) and rows_of(read[1], *links.columns) == rows_of(links, *links.columns)
        if layout == "contig":
            again = alleles.alleles(*files.graph_of(*read))
            assert rows_of(again, "segments", "start_pos") == rows_of(alleles.alleles(graph, placed), "segments", "start_pos")
        else:
            assert [(r.n_nodes, r.start_pos) for r in index.largest_moved(spans).collect()] == [(2, 0)]


def test_tabix(spark, tmp_path):
    """An index read by hand finds, for any region, the rows that overlap it; long sequences get the other format."""
    import struct
    import zlib

    rng = random.Random(26)
    for top, kind in ((400_000, "tbi"), (1 << 31, "csi")):
        rows = [(s, a, a + rng.choice([0, 1, 500, top // 3])) for s in ("one", "two") for a in rng.choices(range(top), k=3000)]
        df = spark.createDataFrame([(s, a, f"{s}\t{a}\t{b}\tx") for s, a, b in rows], "seq string, start_pos bigint, line string")
        path = str(tmp_path / f"{kind}.bed.gz")
        write_bgzf(df, path, "#chrom\n")
        from pangrove.sources.bed import write_tabix

        made = write_tabix(path)
        assert made.endswith(kind)
        data = gzip.decompress(open(made, "rb").read())
        shift, depth, at = (14, 5, 8) if kind == "tbi" else (*struct.unpack_from("<2i", data, 4), 16)
        size = struct.unpack_from("<i", data, at + 24)[0]
        names = data[at + 28 : at + 28 + size].rstrip(b"\0").split(b"\0")
        at += 28 + size + (4 if kind == "csi" else 0)
        tables = {}
        for name in names:
            bins, (n,) = {}, struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                number, = struct.unpack_from("<I", data, at)
                at += 4 + (8 if kind == "csi" else 0)
                m, = struct.unpack_from("<i", data, at)
                bins[number] = [struct.unpack_from("<2Q", data, at + 4 + 16 * k) for k in range(m)]
                at += 4 + 16 * m
            if kind == "tbi":
                at += 4 + 8 * struct.unpack_from("<i", data, at)[0]
            tables[name.decode()] = bins
        packed = open(path, "rb").read()

        def chunk(begin, end):
            text, block, inner = b"", begin >> 16, begin & 0xFFFF
            while block < end >> 16 or (block == end >> 16 and inner < end & 0xFFFF):
                length = struct.unpack_from("<H", packed, block + 16)[0] + 1
                whole = zlib.decompress(packed[block + 18 : block + length - 8], -15)
                text += whole[inner : end & 0xFFFF if block == end >> 16 else None]
                block, inner = block + length, 0
            return text.decode().splitlines()

        for seq in ("one", "two"):
            for _ in range(4):
                a = rng.randrange(top)
                b = a + rng.choice([1, 1000, top // 5])
                wanted = [k for d in range(depth + 1) for k in range(((1 << 3 * d) - 1) // 7 + (a >> shift + 3 * (depth - d)), ((1 << 3 * d) - 1) // 7 + (b - 1 >> shift + 3 * (depth - d)) + 1) if k in tables[seq]]
                lines = [x for k in wanted for c in tables[seq][k] for x in chunk(*c)]
                found = sorted((int(x.split("\t")[1]), int(x.split("\t")[2])) for x in lines if x.startswith(seq) and int(x.split("\t")[1]) < b and max(int(x.split("\t")[2]), int(x.split("\t")[1]) + 1) > a)
                assert found == sorted((x, y) for s, x, y in rows if s == seq and x < b and max(y, x + 1) > a)


def test_calls_alignments_and_scores(spark, tmp_path):
    from pangrove.sources.bed import as_text
    from pangrove.sources.paf import aligned_blocks, placement_score

    for name, field in (("ref", ">a:4:+:t:0:4"), ("one", ">b:9:-:t:0:9")):
        (tmp_path / f"{name}.bed").write_text(f"z\t5\t9\t>x\t>y\t{field}\nz\t20\t21\t>x\t>y\t.\n")
    calls = bubbles.read_calls(spark, [str(tmp_path / "ref.bed"), str(tmp_path / "one.bed")])
    assert rows_of(calls, "sample", "bubble", "start_pos", "field") == [("one", 0, 5, ">b:9:-:t:0:9"), ("one", 1, 20, "."), ("ref", 0, 5, ">a:4:+:t:0:4"), ("ref", 1, 20, ".")]
    lines = [r.line for r in as_text(bubbles.sample_paths(calls, "ref")).collect()]
    assert len(lines) == 4 and all(len(x.split("\t")) == 14 for x in lines)
    (tmp_path / "bad.bed").write_text("z\t5\t9\n")
    (tmp_path / "less.bed").write_text("z\t5\t9\t>x\t>y\t.\n")
    for name in ("bad", "less"):
        with pytest.raises(place.Refusal):
            bubbles.read_calls(spark, [str(tmp_path / "ref.bed"), str(tmp_path / f"{name}.bed")])

    def cut(q, qs, qe, sign, t, ts, cg, gap):
        """One alignment walked base by base."""
        import re

        out, block, x, y = [], None, 0, ts
        for n, op in re.findall(r"(\d+)([=XMIDN])", cg):
            n = int(n)
            a, b = x + (n if op in "=XMI" else 0), y + (n if op in "=XMDN" else 0)
            if op not in "=XM" and n >= gap:
                out, block = out + [block] if block else out, None
            elif op in "=XM" or block:
                block = [block[0], a, block[2], b] if block else [x, a, y, b]
            x, y = a, b
        out = out + [block] if block else out
        side = lambda a, b: (qs + a, qs + b) if sign == "+" else (qe - b, qe - a)
        return [(q, *side(a, b), t, c, d, sign == "+") for a, b, c, d in out if b > a]

    rng, lines, want = random.Random(27), [], []
    for k in range(40):
        ops = [f"{rng.randrange(1, 9)}{rng.choice('=XMIDN')}" for _ in range(12)]
        cg, sign = "".join(ops), rng.choice("+-")
        used = sum(int(o[:-1]) for o in ops if o[-1] in "=XMI")
        lines.append((k, "\t".join(map(str, [f"q{k}", 999, 7, 7 + used, sign, "tt", 999, 30, 999, 0, 0, 60, "tp:A:P", f"cg:Z:{cg}"]))))
        want += cut(f"q{k}", 7, 7 + used, sign, "tt", 30, cg, 5)
    got = aligned_blocks(spark.createDataFrame(lines + [(99, "\t".join(["q", "9", "0", "1", "+", "tt", "9", "0", "1", "1", "1", "1"]))], "pos bigint, line string"), 5, ["tt"])
    assert rows_of(got, *got.columns) == sorted(want)
    pieces = spark.createDataFrame([("h", 0, 10, "s", 0), ("h", 10, 10, "s", 20)], "name string, hap_offset bigint, bp bigint, seq string, tile bigint")
    hull = spark.createDataFrame([("s", 0, 0, 10), ("s", 10, 10, 20), ("s", 20, 20, 30)], "seq string, tile bigint, unit_start bigint, unit_end bigint")
    truth = spark.createDataFrame([("h", 0, 10, "s", 0, 10, True), ("h", 10, 20, "s", 10, 20, True)], got.schema)
    row = placement_score(pieces, truth, hull, 10).first()
    assert (row.aligned_bp, row.visible_bp, row.recall_pairs, row.recall_strict, row.recall_listed) == (20, 10, 2, 1, 1)


def test_made_graphs(spark):
    """A made graph has its sizes, is the same again, and its text reads as itself."""
    from pangrove.operators import intervals
    from pangrove.sources.synthetic import synthetic_graph, synthetic_text

    g = synthetic_graph(spark, 60, 3, sequences=2)
    assert g.segments.count() == 60 and {r["name"] for r in g.lines.collect()} == {f"{h}#s{k}" for h in ("R#0", "H1#1", "H2#1", "H3#1") for k in (0, 1)}
    read = gfa_of_text(spark, "\n".join(r.line for r in synthetic_text(spark, 60, 3, sequences=2).orderBy("kind_rank", "key").collect()), walks=True)
    steps = lambda x, n: sorted((r["name"], r.i, int(r.node), r.rev) for r in x.steps.join(x.lines.select("line", "name"), "line").collect())
    assert steps(g, 0) == steps(read, 1)
    _, placed = place.place(read, "R")
    bits = index.carrier_sets(placed)
    lines = [r.line for r in index.node_text(index.node_rows(placed, index.by_contig(placed)), bits=bits).collect()]
    known = {r.node: r.bits for r in bits.collect()}
    assert all(x.split("\t")[-1] == "SB:H:" + known[x.split("\t")[3]] for x in lines)
    ends = spark.createDataFrame([("a", 10), ("b", (1 << 53) + 1)], "seq string, end_pos bigint")
    assert {r.seq for r in intervals.beyond(ends, 1 << 20).collect()} == {"b", "all"} and intervals.beyond(ends.where("seq = 'a'"), 5).count() == 0


def test_command_line(spark, tmp_path):
    from pangrove.__main__ import main

    (tmp_path / "t.gfa").write_text(tagged(SEGMENTS, LINKS))
    (tmp_path / "w.gfa").write_text(Small(28, nodes=16, lines=3).text())
    made = main(["index", str(tmp_path / "t.gfa"), str(tmp_path / "i"), "--layout", "contig"], spark)
    assert made["rows"]["node"] == len(SEGMENTS)
    assert main(["alleles", str(tmp_path / "i"), str(tmp_path / "a")], spark) == {"ins": 2, "del": 1}
    assert main(["walks", str(tmp_path / "w.gfa"), str(tmp_path / "w"), "--reference", "R", "--tile", "30"], spark)["kinds"]["ref"] > 0
    with pytest.raises(place.Refusal):
        main(["walks", str(tmp_path / "w.gfa"), str(tmp_path / "w")], spark)


def test_append(spark, tmp_path):
    from pangrove.streaming.append import append_haplotypes, read_counts

    rows = [("L#1#t", 0, "8", False), ("L#1#t", 1, "8", True), ("L#1#t", 2, "5", True), ("M#2#t", 0, "5", False)]
    schema = "name string, i bigint, node string, rev boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    append_haplotypes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in read_counts(spark, str(tmp_path / "out")).collect()) == [("L#1", "5", 1), ("L#1", "8", 2), ("M#2", "5", 1)]

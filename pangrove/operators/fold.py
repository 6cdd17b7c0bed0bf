"""A coarse tier: small variants folded away, unbranched runs merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pangrove.graph import Graph
from pangrove.operators.components import connected_components
from pangrove.operators.place import Placed
from pangrove.plans.storage import checkpointed


def _at(side_end: Column, start: Column, length: Column) -> Column:
    return start + F.when(side_end, length).otherwise(0)


def _sided(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Links with the side each end uses (``a_end``: the segment's end) and what each end is."""
    side = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "seq", "start", "length", "rank")])
    e = graph.links.select("link", F.col("src").alias("a_node"), F.col("tgt").alias("b_node"), "src_rev", "tgt_rev", (~F.col("src_rev")).alias("a_end"), F.col("tgt_rev").alias("b_end"))
    e = e.join(side("a"), "a_node").join(side("b"), "b_node")
    one = (F.col("a_seq") == F.col("b_seq")) & (F.col("a_rank") == F.col("b_rank"))
    at_a, at_b = (_at(F.col(f"{p}_end"), F.col(f"{p}_start"), F.col(f"{p}_length")) for p in "ab")
    abuts = (F.col("a_end") & ~F.col("b_end") | ~F.col("a_end") & F.col("b_end")) & (at_a == at_b)
    e = e.withColumn("continues", one & abuts).withColumn("at_a", at_a).withColumn("at_b", at_b)
    return e.withColumn("skip", F.when(one & ~F.col("continues"), F.abs(F.col("at_b") - F.col("at_a"))).otherwise(0))


def _both_ways(e: DataFrame) -> DataFrame:
    """Each link from each of its ends: ``node, side, other, other_side, at_other``."""
    one = lambda x, y: e.select(
        F.col(f"{x}_node").alias("node"), F.col(f"{x}_end").alias("side"), F.col(f"{y}_node").alias("other"), F.col(f"{y}_end").alias("other_side"), F.col(f"at_{y}").alias("at_other")
    )
    return one("a", "b").union(one("b", "a"))


def distances(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """``(node, dist, pred)``: fewest bp back to the backbone and the neighbour that way, ties to the lesser name.

    Only what the last round improved goes on to its neighbours, and a round
    writes only what it improves; a node's best is the least of its rows.
    """
    length = nodes.where("rank <> 0").select("node", "length")
    into = checkpointed(both.select("node", "other").distinct().join(length, "node"))
    root = nodes.where("rank = 0").select("node", F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast(nodes.schema["node"].dataType).alias("pred"))
    front, found = root, None
    while True:
        near = into.join(front.select(F.col("node").alias("other"), F.col("dist").alias("d")), "other")
        best = near.groupBy("node").agg(F.min(F.struct((F.col("d") + F.col("length")).alias("dist"), F.col("other").alias("pred"))).alias("b"))
        if found is not None:
            known = found.groupBy("node").agg(F.min("b").alias("known"))
            best = best.join(known, "node", "left").where(F.col("known").isNull() | (F.col("b") < F.col("known"))).select("node", "b")
        better = checkpointed(best)
        if better.limit(1).count() == 0:
            break
        found = better if found is None else found.unionByName(better)
        front = better.select("node", "b.dist")
    if found is None:
        return root
    return root.unionByName(checkpointed(found.groupBy("node").agg(F.min("b").alias("b")).select("node", "b.dist", "b.pred")))


def fold(graph: Graph, placed: Placed, below: int) -> Graph:
    """The graph with alleles and skips under ``below`` bp dropped and unbranched runs merged.

    An allele is a component over links that read one sequence straight on; it
    counts its own bp, or the reference between the backbone nodes it hangs
    from where that is more.  Big alleles keep a way back to the backbone from
    each of their ends.  Without a backbone, or with ``below`` <= 0, all stays.
    """
    nodes = placed.nodes.select(
        "node", "seq", F.col("start_pos").alias("start"), (F.col("end_pos") - F.col("start_pos")).alias("length"), "rank"
    ).join(graph.segments.select("node", "ord"), "node")
    nodes = checkpointed(nodes)
    edges = checkpointed(_sided(graph, nodes))
    if below <= 0 or nodes.where("rank = 0").limit(1).count() == 0:
        kept, inside = nodes.withColumn("run", F.col("node")).withColumn("merged", F.col("length")), edges
        return _as_graph(kept.select("node", "seq", "start", "rank", "ord", F.col("merged").alias("length")), inside.select("link", F.col("a_node").alias("src"), "src_rev", F.col("b_node").alias("tgt"), "tgt_rev"), graph)
    both = _both_ways(edges)
    comp = connected_components(edges.where("continues").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    nodes = checkpointed(nodes.join(comp, "node", "left").withColumn("allele", F.coalesce("component", "node")).drop("component"))
    who = nodes.select("node", "allele", "rank", "seq")
    linked = both.join(who.select("node", "allele"), "node").join(
        who.select(F.col("node").alias("other"), F.col("allele").alias("other_allele"), F.col("rank").alias("other_rank"), F.col("seq").alias("other_seq")), "other"
    )
    hung = linked.where("allele <> other_allele and other_rank = 0").groupBy("allele").agg(
        F.min("at_other").alias("lo"), F.max("at_other").alias("hi"), (F.min("other_seq") == F.max("other_seq")).alias("one")
    )
    size = nodes.groupBy("allele", (F.col("rank") == 0).alias("backbone")).agg(F.sum("length").alias("bp")).join(hung, "allele", "left")
    span = F.when(F.col("one") & (F.col("hi") > F.col("lo")), F.col("hi") - F.col("lo")).otherwise(0)
    size = size.withColumn("content", F.greatest("bp", F.coalesce(span, F.lit(0))))
    big = size.where(~F.col("backbone") & (F.col("content") >= below)).select("allele")
    kept = nodes.where("rank = 0").select("node").union(nodes.join(big, "allele", "left_semi").select("node"))
    dist = distances(nodes, both)
    # The ends of big alleles: sides of their first and last segment that no own link uses.
    outer = nodes.join(big, "allele", "left_semi").groupBy("allele").agg(
        F.min(F.struct("start", "ord", "node")).alias("first"), F.min(F.struct((-F.col("start") - F.col("length")).alias("end"), "ord", "node")).alias("last")
    )
    tips = outer.select("allele", F.explode(F.array_distinct(F.array("first.node", "last.node"))).alias("node")).withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
    tips = tips.join(linked.where("allele = other_allele").select("node", "side").distinct(), ["node", "side"], "left_anti")
    out = tips.join(linked.where("allele <> other_allele").select("node", "side", "other"), ["node", "side"]).join(dist.select(F.col("node").alias("other"), "dist"), "other")
    front = out.groupBy("node", "side").agg(F.min(F.struct("dist", "other")).alias("b")).select(F.col("b.other").alias("node")).distinct()
    kept = checkpointed(kept.distinct())
    while True:
        front = checkpointed(front.join(kept, "node", "left_anti").distinct())
        if front.limit(1).count() == 0:
            break
        kept = checkpointed(kept.union(front))
        front = front.join(dist.where("pred is not null"), "node").select(F.col("pred").alias("node"))
    side = lambda p: edges.join(kept.withColumnRenamed("node", f"{p}_node"), f"{p}_node", "left_semi")
    left = side("a").join(kept.withColumnRenamed("node", "b_node"), "b_node", "left_semi").where(~((F.col("skip") > 0) & (F.col("skip") < below)))
    left = checkpointed(left)
    return _merge_runs(graph, nodes.join(kept, "node", "left_semi"), left)


def _merge_runs(graph: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Runs of one sequence that nothing branches into become one segment, named by their first."""
    degree = _both_ways(edges).groupBy("node", "side").agg(F.count("*").alias("n")).where("n = 1")
    single = lambda p: degree.select(F.col("node").alias(f"{p}_node"), F.col("side").alias(f"{p}_end"))
    inner = edges.where("continues and a_node <> b_node").join(single("a"), ["a_node", "a_end"], "left_semi").join(single("b"), ["b_node", "b_end"], "left_semi")
    inner = checkpointed(inner.select("link", "a_node", "b_node"))
    runs = connected_components(inner.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    members = nodes.join(runs, "node").select("component", "node", "start", "length", "ord")
    heads = members.groupBy("component").agg(
        F.min(F.struct("start", "ord", "node")).alias("h"), F.max(F.struct("start", "ord", "node")).alias("t"), F.sum("length").alias("bp")
    ).select("component", F.col("h.node").alias("head"), F.col("t.node").alias("tail"), F.col("bp").cast("bigint").alias("bp"))
    run = checkpointed(members.select("component", "node").join(heads, "component").select("node", "head", "tail", "bp"))
    kept = nodes.join(run, "node", "left").where("head is null or head = node").select(
        "node", "seq", "start", "rank", "ord", F.coalesce("bp", "length").alias("length")
    )
    outside = edges.join(inner.select("link"), "link", "left_anti").select("link", "a_node", "b_node", "src_rev", "tgt_rev", "a_end", "b_end")
    end = lambda p: run.select(F.col("node").alias(f"{p}_node"), F.col("head").alias(f"{p}_head"), F.col("tail").alias(f"{p}_tail"))
    e = outside.join(end("a"), "a_node", "left").join(end("b"), "b_node", "left")
    # Of a run's sides only the head's start and the tail's end are sides of the merged segment.
    is_end = lambda p: F.when(F.col(f"{p}_head").isNull(), F.col(f"{p}_end")).otherwise((F.col(f"{p}_node") == F.col(f"{p}_tail")) & F.col(f"{p}_end"))
    is_start = lambda p: F.when(F.col(f"{p}_head").isNull(), ~F.col(f"{p}_end")).otherwise((F.col(f"{p}_node") == F.col(f"{p}_head")) & ~F.col(f"{p}_end"))
    name = lambda p: F.coalesce(f"{p}_head", f"{p}_node")
    links = e.select("link", name("a").alias("src"), (~is_end("a")).alias("src_rev"), name("b").alias("tgt"), (~is_start("b")).alias("tgt_rev"))
    return _as_graph(kept, links, graph)


def _as_graph(nodes: DataFrame, links: DataFrame, graph: Graph) -> Graph:
    segments = nodes.select("node", "length", F.col("seq").alias("sn"), F.col("start").alias("so"), F.col("rank").alias("sr"), "ord")
    return Graph(segments, links, graph.lines.limit(0), graph.steps.limit(0))


def rgfa_text(folded: Graph) -> DataFrame:
    """A folded graph as ``(kind, ord, line)`` rGFA text: S lines in order, then L lines."""
    s = folded.segments.select(
        F.lit("S").alias("kind"), F.col("ord").cast("string").alias("ord"),
        F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), F.lit("*"), F.concat(F.lit("LN:i:"), "length"), F.concat(F.lit("SN:Z:"), "sn"), F.concat(F.lit("SO:i:"), "so"), F.concat(F.lit("SR:i:"), "sr")).alias("line"),
    )
    strand = lambda c: F.when(F.col(c), "-").otherwise("+")
    l = folded.links.select(
        F.lit("L").alias("kind"), F.col("link").cast("string").alias("ord"),
        F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), strand("src_rev"), F.col("tgt").cast("string"), strand("tgt_rev"), F.lit("0M")).alias("line"),
    )
    return s.unionByName(l)

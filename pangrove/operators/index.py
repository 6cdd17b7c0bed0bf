"""Node and link rows under genome intervals, and the queries that read them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pangrove.functions.handles import carrier_bits, strand
from pangrove.graph import Graph
from pangrove.operators.components import connected_components
from pangrove.operators.place import Placed
from pangrove.plans.storage import written

MAX_COMPONENT = 10_000


@dataclass
class Spans:
    """Intervals that nodes are filed under, those that their links reach, and components left in place."""

    nodes: DataFrame  # node, seq, start_pos, end_pos
    links: DataFrame
    moved: DataFrame | None = None


def by_contig(placed: Placed) -> Spans:
    own = placed.nodes.select("node", "seq", "start_pos", "end_pos")
    return Spans(own, own)


def off_reference_components(graph: Graph, placed: Placed) -> DataFrame:
    """``(node, component)`` of every node off the reference: joined without passing through the reference."""
    allele = placed.nodes.where("rank <> 0").select("node")
    inner = graph.links.select(F.col("src").alias("a"), F.col("tgt").alias("b"))
    inner = inner.join(allele.withColumnRenamed("node", "a"), "a", "left_semi").join(allele.withColumnRenamed("node", "b"), "b", "left_semi")
    found = connected_components(inner)
    return allele.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def anchored(graph: Graph, placed: Placed, max_component: int | None = MAX_COMPONENT) -> Spans:
    """Nodes off the reference under the reference interval that their component hangs from.

    A component's interval on a sequence runs over the reference nodes it links
    to; one that touches none, or holds more than ``max_component`` nodes, keeps
    its own coordinates.  A link reaches what both of its nodes reach.
    """
    own = placed.nodes.select("node", "seq", "start_pos", F.greatest("end_pos", F.col("start_pos") + 1).alias("end_pos"), (F.col("rank") == 0).alias("is_ref"))
    # Components, what they touch and their intervals are read by several branches: each is written once.
    component = written(off_reference_components(graph, placed), "index-components")
    ends = graph.links.select("src", "tgt").union(graph.links.select("tgt", "src")).distinct()
    ref = own.where("is_ref").drop("is_ref")
    attached = (
        ends.join(component.withColumnRenamed("node", "src"), "src")
        .join(ref.select(F.col("node").alias("tgt"), "seq", "start_pos", "end_pos"), "tgt")
        .select("component", F.col("tgt").alias("node"), "seq", "start_pos", "end_pos")
    )
    attached = written(attached, "index-attached")
    hull = lambda df, *keys: df.groupBy(*keys, "seq").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    anchors = written(hull(attached, "component"), "index-anchors")
    moved = None
    if max_component is not None:
        sizes = component.groupBy("component").agg(F.count("*").alias("n_nodes"))
        giants = sizes.where(F.col("n_nodes") > max_component)
        moved = anchors.join(giants, "component").groupBy("component", "n_nodes").agg(F.min(F.struct("seq", "start_pos", "end_pos")).alias("at"))
        anchors = anchors.join(giants, "component", "left_anti")
    filed = component.join(anchors, "component").select("node", "seq", "start_pos", "end_pos")
    stays = own.where("not is_ref").join(filed.select("node").distinct(), "node", "left_anti").drop("is_ref")
    nodes = ref.unionByName(filed).unionByName(stays)
    through = attached.select("component", "node").distinct().join(anchors, "component").select("node", "seq", "start_pos", "end_pos")
    is_ref = ref.select("node")
    beside = (
        ends.join(is_ref.withColumnRenamed("node", "src"), "src", "left_semi")
        .join(ref.withColumnRenamed("node", "tgt"), "tgt")
        .select(F.col("src").alias("node"), "seq", "start_pos", "end_pos")
    )
    nodes = written(nodes, "index-spans")
    return Spans(nodes, written(hull(nodes.unionByName(through).unionByName(beside), "node"), "index-reach"), moved)


def node_rows(placed: Placed, spans: Spans) -> DataFrame:
    """One row per node and interval it is filed under, with its own coordinate."""
    own = placed.nodes.select("node", "rank", F.col("seq").alias("own_seq"), F.col("start_pos").alias("own_start"), F.col("end_pos").alias("own_end"), "carriers")
    return spans.nodes.join(own, "node").select("seq", "start_pos", "end_pos", "node", "rank", "own_seq", "own_start", "own_end", "carriers")


def link_rows(graph: Graph, placed: Placed, spans: Spans, layout: str = "anchored") -> DataFrame:
    """Links under the intervals of their nodes; both nodes stated in full.

    By contig a link has a row under each of its ends; anchored, one row on
    each sequence, over what both ends reach there.  Links with an unplaced end
    are left out (``skipped_links`` counts them).
    """
    end = lambda p: placed.nodes.select(
        F.col("node").alias(p), F.col("seq").alias(f"{p}_seq"), F.col("start_pos").alias(f"{p}_start"), F.col("end_pos").alias(f"{p}_end"), F.col("rank").alias(f"{p}_rank")
    )
    links = graph.links.select("src", "src_rev", "tgt", "tgt_rev").join(end("src"), "src").join(end("tgt"), "tgt")
    at = lambda side: links.join(spans.links.withColumnRenamed("node", side), side)
    rows = at("src").unionByName(at("tgt"))
    keys = ["src", "src_rev", "tgt", "tgt_rev", "src_seq", "src_start", "src_end", "src_rank", "tgt_seq", "tgt_start", "tgt_end", "tgt_rank"]
    if layout == "anchored":
        rows = rows.groupBy(*keys, "seq").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return rows.select("seq", "start_pos", "end_pos", *keys)


def skipped_links(graph: Graph, placed: Placed) -> DataFrame:
    known = placed.nodes.select("node")
    lost = lambda side: graph.links.select("src", "src_rev", "tgt", "tgt_rev").join(known.withColumnRenamed("node", side), side, "left_anti")
    return lost("src").union(lost("tgt").select("src", "src_rev", "tgt", "tgt_rev")).distinct()


def samples(placed: Placed) -> DataFrame:
    """Assemblies in byte order with their bit numbers; a row for each assembly."""
    from pyspark.sql import Window

    names = placed.nodes.select(F.explode("carriers").alias("assembly")).distinct()
    # One window over all of them: assemblies are counted in thousands, not with the nodes.
    return names.select("assembly", (F.row_number().over(Window.orderBy("assembly")) - 1).cast("bigint").alias("bit"))


def carrier_sets(placed: Placed) -> DataFrame:
    """Each node's carriers, as names in first-visit order and as bits of the sample list."""
    each = placed.nodes.select("node", F.explode("carriers").alias("assembly")).join(samples(placed), "assembly")
    bits = each.groupBy("node").agg(carrier_bits(F.array_sort(F.collect_set("bit"))).alias("bits"))
    return placed.nodes.select("node", F.array_join("carriers", ",").alias("names")).join(bits, "node")


def largest_moved(spans: Spans, n: int = 10) -> DataFrame:
    """The largest components that keep their own coordinates, for a report: ``(component, n_nodes, seq, start_pos, end_pos)``."""
    rows = spans.moved.select("component", "n_nodes", "at.*")
    return rows.orderBy(F.desc("n_nodes"), "seq", "start_pos", "component").limit(n)


def read_text(lines: DataFrame, anchored_layout: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and link rows out of ``(pos, line)`` text that ``node_text`` and ``link_text`` made; the first row of a node counts."""
    c = F.split("line", "\t")
    text = lines.where(~F.startswith("line", F.lit("#")) & (F.col("line") != "")).withColumn("c", c)
    number = lambda k: F.col("c")[k].cast("bigint")
    is_link = F.size("c") >= 13
    own = (F.col("c")[5], number(6), number(7)) if anchored_layout else (F.col("c")[0], number(1), number(2))
    tag = F.element_at("c", -1)
    nodes = text.where(~is_link).select(
        "pos", F.col("c")[0].alias("seq"), number(1).alias("start_pos"), number(2).alias("end_pos"), F.col("c")[3].alias("node"), number(4).alias("rank"),
        own[0].alias("own_seq"), own[1].alias("own_start"), own[2].alias("own_end"), F.when(F.startswith(tag, F.lit("SM:Z:")), F.split(F.substring(tag, 6, 1 << 30), ",")).alias("carriers"),
    )
    if not anchored_layout:
        keep = [x for x in nodes.columns if x not in ("pos", "node")]
        nodes = nodes.groupBy("node").agg(F.min(F.struct("pos", *keep)).alias("r")).select("node", *[f"r.{x}" for x in keep])
    end = lambda k, p: (F.expr(f"left(c[{k}], length(c[{k}]) - 1)").alias(p), (F.expr(f"right(c[{k}], 1)") == "-").alias(f"{p}_rev"))
    whole = lambda k, p: (F.col("c")[k].alias(f"{p}_seq"), number(k + 1).alias(f"{p}_start"), number(k + 2).alias(f"{p}_end"), number(k + 3).alias(f"{p}_rank"))
    links = text.where(is_link).select(F.col("c")[0].alias("seq"), number(1).alias("start_pos"), number(2).alias("end_pos"), *end(3, "src"), *end(4, "tgt"), *whole(5, "src"), *whole(9, "tgt"))
    return nodes.drop("pos"), links


def node_text(rows: DataFrame, anchored_layout: bool = False, bits: DataFrame | None = None) -> DataFrame:
    """Node rows as tab-separated text, with the keys they sort by.

    With ``bits``, a row's carriers are the bits of ``carrier_sets``, else names.
    """
    own = [F.col("own_seq"), F.col("own_start").cast("string"), F.col("own_end").cast("string")] if anchored_layout else []
    tag = F.when(F.col("carriers").isNotNull(), F.concat(F.lit("SM:Z:"), F.array_join("carriers", ",")))
    if bits is not None:
        rows = rows.join(bits.select("node", "bits"), "node", "left")
        tag = F.concat(F.lit("SB:H:"), "bits")
    fields = ["seq", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), F.col("node").cast("string"), F.col("rank").cast("string"), *own, tag]
    return rows.select("seq", "start_pos", F.concat_ws("\t", *fields).alias("line"))


def link_text(rows: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    side = lambda p: F.concat(text(p), strand(F.col(f"{p}_rev")))
    fields = ["seq", text("start_pos"), text("end_pos"), side("src"), side("tgt")]
    fields += [text(f"{p}_{f}") for p in ("src", "tgt") for f in ("seq", "start", "end", "rank")]
    return rows.select("seq", "start_pos", F.concat_ws("\t", *fields).alias("line"))


def region(rows: DataFrame, seq: str, start: int, end: int) -> DataFrame:
    """Rows that overlap ``[start, end)`` of ``seq``; the filters reach a Parquet scan of a saved index."""
    return rows.where((F.col("seq") == seq) & (F.col("start_pos") < end) & (F.col("end_pos") > start))


def index_cut(nodes: DataFrame, links: DataFrame, seq: str, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """What a region query draws: its nodes, links with one of them, and links between those links' far ends."""
    inside = region(nodes, seq, start, end)
    names = inside.select("node").distinct()
    found = region(links, seq, start, end).select("src", "src_rev", "tgt", "tgt_rev").distinct()
    has = lambda df, side, known, how: df.join(known.withColumnRenamed("node", side), side, how)
    touching = has(found, "src", names, "left_semi").unionByName(has(found, "tgt", names, "left_semi")).distinct()
    far = touching.select(F.col("src").alias("node")).union(touching.select("tgt")).distinct().join(names, "node", "left_anti")
    between = has(has(found, "src", far, "left_semi"), "tgt", far, "left_semi")
    order = ["src", "src_rev", "tgt", "tgt_rev"]
    return inside, touching.select(order).union(between.select(order)).distinct()


def neighbours(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``(node, hop)`` of nodes within ``hops`` links of ``start``, by bounded iteration."""
    both = links.select(F.col("src").alias("node"), F.col("tgt").alias("to")).union(links.select("tgt", "src")).distinct()
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        edge = seen.where(F.col("hop") == hop - 1).join(both, "node").select(F.col("to").alias("node")).distinct()
        seen = seen.unionByName(edge.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
    return seen


def save(rows: DataFrame, path: str) -> None:
    """A saved index: sorted by range within files, so a region reads few row groups."""
    rows.repartitionByRange("seq", "start_pos").sortWithinPartitions("seq", "start_pos").write.mode("overwrite").parquet(path)

"""Saved graphs and walks: Parquet sorted for range reads, with a header beside it; and their readers."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pangrove.functions.handles import graph_hash
from pangrove.functions.names import haplotype, sample
from pangrove.graph import Graph
from pangrove.operators import alleles, encode, index, intervals, walks
from pangrove.operators.place import Placed, Refusal
from pangrove.plans.storage import written

#: Versions of what is written here; a reader refuses any other.
GRAPH_FORMAT, WALKS_FORMAT = "graph-1", "walks-2"


def _put(path: str, header: dict) -> None:
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    fs.create_dir(name, recursive=True)
    with fs.open_output_stream(f"{name}/header.json") as out:
        out.write(json.dumps(header, indent=2).encode())


def _header(path: str, wanted: str) -> dict:
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if fs.get_file_info(f"{name}/header.json").type == pafs.FileType.NotFound:
        raise Refusal(f"{path} has no header.json: it is no finished table of this kind")
    with fs.open_input_stream(f"{name}/header.json") as f:
        header = json.loads(f.read())
    if header.get("format") != wanted:
        raise Refusal(f"{path} is of format {header.get('format')}, not {wanted}")
    return header


# ---- graphs -----------------------------------------------------------------


def write_graph(graph: Graph, placed: Placed, path: str, layout: str = "contig", max_component: int | None = index.MAX_COMPONENT) -> dict:
    """Node and link rows of one graph in one table, sorted by range; the header is written last and returned."""
    spans = index.by_contig(placed) if layout == "contig" else index.anchored(graph, placed, max_component)
    nodes = index.node_rows(placed, spans).withColumn("kind", F.lit("node"))
    links = index.link_rows(graph, placed, spans, layout).withColumn("kind", F.lit("link"))
    index.save(nodes.unionByName(links, allowMissingColumns=True), f"{path}/rows")
    spark = graph.segments.sparkSession
    kept = spark.read.parquet(f"{path}/rows")
    counts = {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()}
    known = graph_hash(graph.segments).first()
    carried = placed.nodes.where(F.col("carriers").isNotNull()).limit(1).count() > 0
    if carried:
        index.samples(placed).write.mode("overwrite").parquet(f"{path}/samples")
    header = {
        "format": GRAPH_FORMAT, "layout": layout, "graph": known.graph_hash, "segments": known.n_segments, "coordinates": "tags" if placed.from_tags else "paths",
        "rows": counts, "placed": placed.nodes.count(), "skipped_links": index.skipped_links(graph, placed).count(), "samples": carried, "notes": placed.notes,
    }
    _put(path, header)
    return header


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Node rows, link rows and the header of a saved graph."""
    header = _header(path, GRAPH_FORMAT)
    rows = spark.read.parquet(f"{path}/rows")
    of = lambda kind, prefix: rows.where(F.col("kind") == kind).select("seq", "start_pos", "end_pos", *prefix)
    nodes = of("node", ["node", "rank", "own_seq", "own_start", "own_end", "carriers"])
    ends = [f"{p}_{c}" for p in ("src", "tgt") for c in ("seq", "start", "end", "rank")]
    return nodes, of("link", ["src", "src_rev", "tgt", "tgt_rev", *ends]), header


def graph_of(nodes: DataFrame, links: DataFrame) -> tuple[Graph, Placed]:
    """A graph and its places out of saved rows by contig; a node's or link's first row counts."""
    first = nodes.groupBy("node").agg(F.min(F.struct("own_seq", "own_start", "own_end", "rank")).alias("v"))
    placed = first.select(
        "node", F.col("v.own_seq").alias("seq"), F.col("v.own_start").alias("start_pos"), F.col("v.own_end").alias("end_pos"), F.col("v.rank").alias("rank"),
        F.lit(False).alias("flipped"), F.lit(None).cast("array<string>").alias("carriers"),
    )
    segments = placed.select(
        "node", (F.col("end_pos") - F.col("start_pos")).alias("length"), F.col("seq").alias("sn"), F.col("start_pos").alias("so"), F.col("rank").alias("sr"), F.col("node").alias("ord")
    )
    link = links.select("src", "src_rev", "tgt", "tgt_rev").distinct()
    spark = nodes.sparkSession
    lines = spark.createDataFrame([], "line string, name string, written string, start bigint, ord string")
    steps = spark.createDataFrame([], "line string, i bigint, node string, rev boolean")
    return Graph(segments, link.withColumn("link", F.struct("src", "src_rev", "tgt", "tgt_rev")), lines, steps), Placed(placed, False)


def alleles_of(spark: SparkSession, path: str) -> DataFrame:
    """The allele inventory of a saved graph; its rows must lie by contig."""
    nodes, links, header = read_graph(spark, path)
    if header["layout"] != "contig":
        raise Refusal(f"{path} has the {header['layout']} layout; alleles need nodes on their own contigs")
    return alleles.alleles(*graph_of(nodes, links))


def class_counts(rows: DataFrame) -> DataFrame:
    """Alleles of each class, for a report."""
    return rows.groupBy("class").agg(F.count("*").alias("n"))


# ---- walks --------------------------------------------------------------------


def haplotypes(graph: Graph, ref: str) -> DataFrame:
    """The haplotypes of all lines but the reference's, each once."""
    return graph.lines.where(sample(F.col("name")) != ref).select(haplotype(F.col("name")).alias("haplotype")).distinct()


def _departure_order(binned: DataFrame) -> DataFrame:
    binned = written(binned, "walks-binned")  # ranges are found from samples, so what they sort is read twice
    return binned.repartitionByRange("seq", "bin_size", "bin_start").sortWithinPartitions("seq", "bin_size", "bin_start")


def write_walks(
    graph: Graph, ref: str, path: str, tile: int = walks.TILE, stay: int = walks.STAY, steps_budget: int = encode.STEPS, bytes_budget: int = encode.BYTES, bases: DataFrame | None = None
) -> dict:
    """All tables of a walk file below ``path``; what it guarantees is checked, then the header is written and returned.

    ``rows`` and ``departures`` are sorted by sequence and place, so a window
    reads few row groups of each.  A departure is kept once, whatever its length.
    """
    offset = written(walks.offset_steps(graph), "walks-offsets")
    walks.check_steps(offset)
    placed = written(walks.place_steps(offset, ref), "walks-places")
    tiled = written(walks.tiled_steps(placed, ref, tile, stay), "walks-tiled")
    spark = graph.segments.sparkSession
    far = intervals.beyond(walks.reference_ends(offset, ref), tile).limit(1).collect()
    if far:
        raise Refusal(f"{far[0].seq} reaches {far[0].end_pos}, more than walks can state")
    rows = written(encode.encode_within(tiled, ref, steps_budget, bytes_budget, bases), "walks-rows")  # read twice, as ranges are found from samples
    rows.repartitionByRange("seq", "tile").sortWithinPartitions("seq", "tile", "unit", "kind_rank", "row").write.mode("overwrite").parquet(f"{path}/rows")
    gaps = walks.reference_holes(offset, ref)
    gaps.write.mode("overwrite").parquet(f"{path}/holes")
    left = walks.departures(tiled, ref, spark.read.parquet(f"{path}/holes"), walks.line_spans(offset.where("length > 0")))
    _departure_order(walks.binned_departures(left, tile)).write.mode("overwrite").parquet(f"{path}/departures")
    walks.reference_ends(offset, ref).write.mode("overwrite").parquet(f"{path}/references")
    haplotypes(graph, ref).orderBy("haplotype").write.mode("overwrite").parquet(f"{path}/haplotypes")
    kept = spark.read.parquet(f"{path}/rows")
    broken = faults(kept).limit(1).collect()
    if broken:
        raise AssertionError(f"{broken[0].what} of {broken[0].seq} tile {broken[0].tile}")
    header = {
        "format": WALKS_FORMAT, "tile": tile, "stay": stay, "steps_budget": steps_budget, "bytes_budget": bytes_budget, "graph": graph_hash(graph.segments).first().graph_hash,
        "revisited": walks.reference_visits(offset, ref).where("passes > 1").limit(1).count(), "left_out": walks.left_out(placed, ref).count(),
        "kinds": {r.kind: r["count"] for r in kept.groupBy("kind").count().collect()},
    }
    _put(path, header)
    return header


def faults(rows: DataFrame) -> DataFrame:
    """``(seq, tile, what)``: guarantees that rows break; none, if all is well.

    Each tile has a reference; each piece one row in its tile, walk or
    abridged; each abridged row a walk in its record; records count from 0.
    """
    f = rows.withColumn("c", F.split("line", "\t"))
    own = f.where(F.col("unit") == encode.WHOLE)
    bare = own.groupBy("seq", "tile").agg(F.count_if(F.col("kind") == "ref").alias("n")).where("n = 0").select("seq", "tile", F.lit("no reference").alias("what"))
    key = ["seq", "tile", F.col("c")[4].alias("path"), F.col("c")[5].alias("frag"), F.col("c")[7].alias("piece")]
    pieces = own.where("kind in ('walk', 'abridged', 'ref')").select(*key).groupBy("seq", "tile", "path", "frag", "piece").count().where("count > 1")
    twice = pieces.select("seq", "tile", F.lit("a piece has two rows").alias("what"))
    short = own.where("kind = 'abridged'").select(*key, F.col("c")[10].cast("int").alias("unit"))
    moved = f.where((F.col("unit") != encode.WHOLE) & (F.col("kind") == "walk")).select(*key, "unit")
    keys = ["seq", "tile", "path", "frag", "piece", "unit"]
    lost = short.join(moved, keys, "left_anti").unionByName(moved.join(short, keys, "left_anti")).select("seq", "tile", F.lit("an abridged piece and its record disagree").alias("what"))
    records = short.select("seq", "tile", "unit").distinct().groupBy("seq", "tile").agg(F.count("*").alias("n"), F.max("unit").alias("last")).where("n <> last + 1")
    return bare.unionByName(twice).unionByName(lost).unionByName(records.select("seq", "tile", F.lit("records don't count from 0").alias("what")))


@dataclass
class Walks:
    """A reader of ``write_walks``' tables: filters reach the scans."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.header = _header(self.path, WALKS_FORMAT)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rows(self, seq: str, lo: int, hi: int) -> DataFrame:
        """Rows of the tiles that can overlap a stretch: a tile begins at its start, or goes on from before."""
        # Nodes can be longer than a tile, and the last tile up to ``lo`` can have its first node behind ``lo``: then the
        # one before it reaches there.  Any earlier one ends before ``lo``, as stretches of the reference are disjoint.
        refs = self.table("rows").where((F.col("seq") == seq) & (F.col("kind") == "ref") & (F.col("tile") <= lo))
        last = refs.select("tile").distinct().orderBy(F.desc("tile")).limit(2).collect()
        begin = min([lo // self.header["tile"] * self.header["tile"], *(r.tile for r in last)])
        return self.table("rows").where((F.col("seq") == seq) & (F.col("tile") >= begin) & (F.col("tile") < hi))

    def departures(self, seq: str, lo: int, hi: int) -> DataFrame:
        return walks.binned_departures_in(self.table("departures"), seq, lo, hi, self.header["tile"])

    def haplotypes(self) -> DataFrame:
        return self.table("haplotypes")


def next_starts(rows: DataFrame) -> DataFrame:
    """Pieces whose bp do not lead to the next piece of their line: ``(path, frag, piece)``; none, if lines are whole."""
    steps = encode.decode(rows).unionByName(encode.decode_references(rows))
    pieces = steps.groupBy("path", "frag_start", "piece").agg(F.min("hap_offset").alias("at"), F.sum("length").alias("bp"))
    along = Window.partitionBy("path", "frag_start").orderBy("piece")
    goes = pieces.withColumn("next", F.lead("at").over(along))
    return goes.where(F.col("next").isNotNull() & (F.col("at") + F.col("bp") != F.col("next"))).select("path", "frag_start", "piece")

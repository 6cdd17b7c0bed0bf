"""The allele inventory: ways off the backbone and back, and skips along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pangrove.functions.names import commify, donor, length_cigar, reference_name
from pangrove.graph import Graph
from pangrove.operators.place import Placed
from pangrove.plans.storage import checkpointed


def _rows(df: DataFrame) -> DataFrame:
    """Allele columns from ``chrom, start, end, alt_len, strand, rank, donor, nested, segments``."""
    ref_len = F.col("end") - F.col("start")
    delta = F.col("alt_len") - ref_len
    kind = F.when(F.col("segments") == ".", "del").when(delta > 0, "ins").when(delta == 0, "sub").otherwise("del")
    label = F.when(kind == "ins", F.concat(F.lit("+"), commify(delta))).when(kind == "sub", F.concat(commify(F.col("alt_len")), F.lit(" sub"))).otherwise(commify(delta))
    rgb = F.when(kind == "ins", "192,0,192").when(kind == "sub", "0,154,138").otherwise("128,128,128")
    return df.select(
        reference_name(F.col("chrom")).alias("chrom"), F.col("start").alias("start_pos"),
        F.when((F.col("end") > F.col("start")) | (F.col("segments") == "."), F.col("end")).otherwise(F.col("start") + 1).alias("end_pos"),
        label.alias("label"), "strand", rgb.alias("rgb"), kind.alias("class"), delta.alias("delta"), "alt_len", ref_len.alias("ref_len"),
        length_cigar(F.col("alt_len"), ref_len).alias("cigar"), "rank", "donor", F.col("nested").cast("int").alias("nested"), "segments",
    )


def alleles(graph: Graph, placed: Placed) -> DataFrame:
    """A row for each way from the backbone through other segments back to the same sequence, and each direct skip.

    From each entry a walk takes, at a branch, the successor on its own contig
    (else the least segment) until one or more backbone segments of the
    entry's sequence follow; it never takes a state twice.  All walks go one
    step a round, as rows, so any number of alleles shares the cluster.  A way
    found from both sides is one allele.
    """
    n = placed.nodes.select("node", F.col("seq"), F.col("start_pos"), F.col("end_pos"), "rank").join(graph.segments.select("node", "ord"), "node")
    n = checkpointed(n)
    seg = lambda p: n.select(*[F.col(c).alias(f"{p}_{c}") for c in ("node", "seq", "start_pos", "end_pos", "rank", "ord")])
    both = graph.links.select("src", (~F.col("src_rev")).alias("src_fwd"), "tgt", (~F.col("tgt_rev")).alias("tgt_fwd"))
    arcs = both.union(both.select("tgt", ~F.col("tgt_fwd"), "src", ~F.col("src_fwd"))).toDF("a_node", "a_fwd", "b_node", "b_fwd").distinct()
    arcs = checkpointed(arcs.join(seg("a"), "a_node").join(seg("b"), "b_node"))
    leave = F.when(F.col("a_fwd"), F.col("a_end_pos")).otherwise(F.col("a_start_pos"))
    reach = F.when(F.col("b_fwd"), F.col("b_start_pos")).otherwise(F.col("b_end_pos"))
    arcs = arcs.withColumn("leave", leave).withColumn("reach", reach)

    direct = arcs.where("a_rank = 0 and b_rank = 0 and a_seq = b_seq and a_fwd and b_fwd and leave < reach")
    skips = direct.select(
        F.col("a_seq").alias("chrom"), F.col("leave").alias("start"), F.col("reach").alias("end"), F.lit(0).cast("bigint").alias("alt_len"), F.lit(".").alias("strand"),
        F.lit(".").alias("rank"), F.lit(".").alias("donor"), F.lit(False).alias("nested"), F.lit(".").alias("segments"),
    ).distinct()

    state = lambda p: F.struct(F.col(f"{p}_ord").alias("ord"), F.col(f"{p}_fwd").alias("fwd"), F.col(f"{p}_node").alias("node"), F.col(f"{p}_seq").alias("seq"), F.col(f"{p}_rank").alias("rank"), F.col(f"{p}_start_pos").alias("start_pos"), F.col(f"{p}_end_pos").alias("end_pos"))
    inner = arcs.where("a_rank > 0")
    nexts = checkpointed(inner.groupBy(F.col("a_node").alias("node"), F.col("a_fwd").alias("fwd")).agg(F.array_sort(F.collect_list(state("b"))).alias("next")))
    active = arcs.where("a_rank = 0 and b_rank > 0").select(
        F.monotonically_increasing_id().alias("walk"), F.col("a_seq").alias("chrom"), F.col("leave").alias("at"), F.col("a_fwd").alias("forward"),
        F.struct(F.col("a_ord").alias("ord"), F.col("a_fwd").alias("fwd")).alias("entry"), F.array(state("b")).alias("path"), F.lit(False).alias("nested"),
    )
    active, done = checkpointed(active), None
    while True:
        last = F.element_at("path", -1)
        step = active.join(nexts, (last["node"] == nexts["node"]) & (last["fwd"] == nexts["fwd"]), "left").drop("node", "fwd")
        off = F.filter("next", lambda s: s["rank"] > 0)
        same = F.filter(off, lambda s: s["seq"] == F.element_at(F.col("path"), -1)["seq"])
        step = step.withColumn("exits", F.filter("next", lambda s: (s["rank"] == 0) & (s["seq"] == F.col("chrom"))))
        step = step.withColumn("nested", F.col("nested") | (F.coalesce(F.size("next"), F.lit(0)) > 1)).withColumn("pick", F.coalesce(F.get(same, 0), F.get(off, 0)))
        step = checkpointed(step.drop("next").where(F.col("exits").isNotNull()))
        out = step.where(F.size("exits") > 0).drop("pick")
        done = out if done is None else done.unionByName(out)
        going = step.where((F.size("exits") == 0) & F.col("pick").isNotNull())
        going = going.where(~F.exists("path", lambda s: (s["node"] == F.col("pick")["node"]) & (s["fwd"] == F.col("pick")["fwd"])))
        active = checkpointed(going.withColumn("path", F.concat("path", F.array("pick"))).drop("pick", "exits"))
        if active.limit(1).count() == 0:
            break
    ways = done.withColumn("exit", F.explode("exits")).drop("exits")
    exit_at = F.when(F.col("exit.fwd"), F.col("exit.start_pos")).otherwise(F.col("exit.end_pos"))
    ways = ways.withColumn("exit_at", exit_at)
    behind = (F.col("exit.fwd") == F.col("forward")) & F.when(F.col("forward"), F.col("exit_at") < F.col("at")).otherwise(F.col("exit_at") > F.col("at"))
    ways = ways.where(~behind)
    short = lambda arr, flip: F.transform(arr, lambda s: F.struct(s["ord"].alias("ord"), (s["fwd"] != flip).alias("fwd")))
    end = lambda o, f: F.struct(o.alias("ord"), f.alias("fwd"))
    there = F.struct(F.col("entry").alias("a"), short("path", F.lit(False)).alias("p"), end(F.col("exit.ord"), F.col("exit.fwd")).alias("b"))
    back = F.struct(end(F.col("exit.ord"), ~F.col("exit.fwd")).alias("a"), short(F.reverse("path"), F.lit(True)).alias("p"), end(F.col("entry.ord"), ~F.col("entry.fwd")).alias("b"))
    ways = ways.withColumn("key", F.least(there, back)).withColumn("turned", back < there)
    keyed = F.when(F.col("turned"), F.transform(F.reverse("path"), lambda s: s.withField("fwd", ~s["fwd"]))).otherwise(F.col("path"))
    ways = ways.withColumn("shown", keyed)
    low = F.array_min(F.transform("shown", lambda s: s["rank"]))
    first_low = F.get(F.filter("shown", lambda s: s["rank"] == low), 0)["seq"]
    alt = F.aggregate("path", F.lit(0).cast("bigint"), lambda t, s: t + s["end_pos"] - s["start_pos"])
    ways = ways.select(
        "key", "chrom", F.least("at", "exit_at").alias("start"), F.greatest("at", "exit_at").alias("end"), alt.alias("alt_len"),
        F.when(F.get("shown", 0)["fwd"], "+").otherwise("-").alias("strand"), low.cast("string").alias("rank"), donor(first_low).alias("donor"), "nested",
        F.array_join(F.transform("shown", lambda s: F.concat(F.when(s["fwd"], ">").otherwise("<"), s["node"].cast("string"))), "").alias("segments"),
    )
    row = F.struct("chrom", "start", "end", "alt_len", "strand", "rank", "donor", "nested", "segments")
    ways = ways.groupBy("key").agg(F.min(row).alias("r")).select("r.*")
    return _rows(skips.unionByName(ways))

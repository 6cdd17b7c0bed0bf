"""Bubbles from a snarl VCF, and sample paths from call tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pangrove.functions.names import commify


def _info(field, key: str):
    """The first value of a key in an INFO field."""
    return F.regexp_extract(F.concat(F.lit(";"), field), f";{key}=([^;]*)", 1)


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """The first of each overlap: a bubble stays if it starts behind the last that stayed."""
    keep, end = [], None
    rows = rows.sort_values(["start_pos", "end_pos", "ord"], kind="stable")
    for start, stop in zip(rows["start_pos"], rows["end_pos"]):
        stays = end is None or start >= end
        keep.append(stays)
        if stays:
            end = stop
    return rows[keep]


def bubbles(lines: DataFrame, min_alleles: int = 2, flipped: DataFrame | None = None) -> DataFrame:
    """Top-level bubbles of ``(pos, line)`` VCF text, greedily without overlaps.

    ``(chrom, start_pos, end_pos, segments, walks, inversion, shortest,
    longest, ids)``.  A reverse step on an inner segment (forward, on a
    ``flipped`` one) marks an inversion.  Only what overlaps another bubble is
    chosen one after the other: bubbles fall into clusters of overlapping
    ones, and each cluster is a group of its own.
    """
    c = F.split("line", "\t")
    v = lines.where(~F.startswith("line", F.lit("#")) & (F.col("line") != "")).select(
        F.col("pos").alias("ord"), c[0].alias("chrom"), F.get(c, 1).cast("bigint").alias("vcf_pos"), F.get(c, 2).alias("id"), F.get(c, 3).alias("ref"), F.get(c, 4).alias("alt"), F.get(c, 7).alias("info")
    )
    v = v.where(_info(F.col("info"), "LV") == "0")
    v = v.withColumn("walked", F.filter(F.split(_info(F.col("info"), "AT"), ","), lambda t: t != "")).where(F.size("walked") >= min_alleles)
    v = v.withColumn("boundary", F.transform(F.regexp_extract_all("id", F.lit("[<>][0-9]+"), 0), lambda s: F.regexp_replace(s, "^.", "")))
    steps = v.select("ord", "boundary", F.explode(F.flatten(F.transform("walked", lambda t: F.regexp_extract_all(t, F.lit("[<>][0-9]+"), 0)))).alias("step"))
    steps = steps.select("ord", "boundary", F.startswith("step", F.lit("<")).alias("back"), F.regexp_replace("step", "^.", "").alias("node"))
    if flipped is not None:
        turned = flipped.select(F.col("node").cast("string").alias("turned"))
        steps = steps.join(turned, F.col("node") == F.col("turned"), "left").withColumn("back", F.col("back") != F.col("turned").isNotNull())
    inner = F.col("back") & ~F.array_contains("boundary", F.col("node"))
    counts = steps.groupBy("ord").agg(F.countDistinct("node").alias("segments"), F.max(inner).cast("int").alias("inversion"))
    lengths = F.concat(F.array(F.length("ref")), F.transform(F.filter(F.split("alt", ","), lambda a: a != "."), lambda a: F.length(a)))
    start = F.col("vcf_pos") - 1
    ids = F.when(F.size("boundary") > 0, F.concat(F.array(F.concat(F.get("boundary", 0), F.lit("@"), start.cast("string"))), F.slice("boundary", 2, F.greatest(F.size("boundary") - 1, F.lit(0))))).otherwise(F.col("boundary"))
    rows = v.join(counts, "ord", "left").select(
        "ord", "chrom", start.alias("start_pos"), (start + F.length("ref")).alias("end_pos"), F.coalesce("segments", F.lit(0)).cast("bigint").alias("segments"),
        F.size("walked").cast("bigint").alias("walks"), F.coalesce("inversion", F.lit(0)).alias("inversion"), F.array_min(lengths).alias("shortest"), F.array_max(lengths).alias("longest"), F.array_join(ids, ",").alias("ids"),
    )
    by_chrom = Window.partitionBy("chrom").orderBy("start_pos", "end_pos", "ord")
    reached = F.max("end_pos").over(by_chrom.rowsBetween(Window.unboundedPreceding, -1))
    clusters = rows.withColumn("cluster", F.sum(F.when(F.col("start_pos") < reached, 0).otherwise(1)).over(by_chrom))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in clusters.schema.fields)
    return clusters.groupBy("chrom", "cluster").applyInPandas(_greedy, schema).drop("ord", "cluster")


def sample_name(path: str) -> str:
    """A call file's sample: its name less folders and endings."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for ending in (".gz", ".bed", ".call", ".txt"):
        name = name.removesuffix(ending)
    return name


def read_calls(spark, paths: list[str]) -> DataFrame:
    """``(sample, bubble, chrom, start_pos, end_pos, field)`` of call files, one for each sample.

    ``bubble`` is the number of the line in its file, by which the samples'
    lines belong together, so files of unlike length are refused, as is a line
    of fewer than six columns.
    """
    from pangrove.operators.place import Refusal
    from pangrove.sources.gfa import read_lines

    files = [read_lines(spark, p).withColumn("sample", F.lit(sample_name(p))) for p in paths]
    lines = files[0]
    for more in files[1:]:
        lines = lines.unionByName(more)
    c = F.split("line", "\t")
    lines = lines.where("line <> ''")
    bad = lines.where(F.size(c) < 6).limit(1).collect()
    if bad:
        raise Refusal(f"the call of {bad[0]['sample']} at byte {bad[0].pos} has fewer than six columns")
    sizes = lines.groupBy("sample").count().groupBy("count").agg(F.min("sample").alias("sample")).limit(2).collect()
    if len(sizes) > 1:
        raise Refusal("call files differ in length: " + ", ".join(f"{r['sample']} has {r['count']} lines" for r in sizes))
    number = (F.row_number().over(Window.partitionBy("sample").orderBy("pos")) - 1).cast("bigint")
    return lines.select("sample", number.alias("bubble"), c[0].alias("chrom"), c[1].cast("bigint").alias("start_pos"), c[2].cast("bigint").alias("end_pos"), c[5].alias("field"))


def sample_paths(calls: DataFrame, reference: str) -> DataFrame:
    """A row for each bubble and sample of ``(sample, bubble, chrom, start_pos, end_pos, field)`` calls.

    ``field`` is ``path:length:strand:…``, or ``.`` for no call; ``bubble`` is
    the line's number, the same in every sample's table.
    """
    part = lambda k: F.get(F.split("field", ":"), k)
    calls = calls.withColumn("path", part(0))
    ref = calls.where(F.col("sample") == reference).select("bubble", F.col("path").alias("ref_path"))
    calls = calls.join(ref, "bubble")
    called = F.col("path") != "."
    counts = calls.where(called).groupBy("bubble").agg(F.countDistinct("path").alias("alleles"), F.count_if(F.col("path") != F.col("ref_path")).alias("non_ref"))
    rows = calls.join(counts, "bubble", "left")
    nocall = F.col("field") == "."
    span = (F.col("end_pos") - F.col("start_pos")).cast("bigint")
    length = F.when(nocall, F.lit(-1)).otherwise(part(1).cast("bigint"))
    delta = F.when(nocall, F.lit(0)).otherwise(length - span).cast("bigint")
    kind = F.when(nocall, "nocall").when(F.col("path") == F.col("ref_path"), "ref").when(delta > 0, "ins").when(delta < 0, "del").otherwise("sub")
    label = (
        F.when(kind == "nocall", "no call").when(kind == "ref", "ref").when(kind == "ins", F.concat(F.lit("+"), commify(delta)))
        .when(kind == "del", commify(delta)).otherwise(F.concat(commify(length), F.lit(" sub")))
    )
    rgb = F.when(kind == "nocall", "191,170,64").when(kind == "ref", "204,204,204").when(kind == "ins", "192,0,192").when(kind == "del", "128,128,128").otherwise("0,154,138")
    strand = F.when(nocall | (F.coalesce(part(2), F.lit("")) == ""), ".").otherwise(part(2))
    prefix = f"{reference}#"
    rest = F.substring("chrom", F.lit(len(prefix) + 1), F.lit(1 << 30))
    chrom = F.when(F.startswith("chrom", F.lit(prefix)) & F.contains(rest, F.lit("#")), F.regexp_replace(rest, "^[^#]*#", "")).otherwise(F.col("chrom"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return rows.select(
        chrom.alias("chrom"), "start_pos", F.greatest("end_pos", F.col("start_pos") + 1).alias("end_pos"), label.alias("label"), strand.alias("strand"), rgb.alias("rgb"),
        "sample", kind.alias("class"), delta.alias("delta"), length.cast("bigint").alias("path_len"), span.alias("ref_span"), zero("alleles").alias("alleles"), zero("non_ref").alias("non_ref"), "path",
    )

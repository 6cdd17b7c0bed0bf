"""Made graphs of any size, from numbers alone: for trials of scale, and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pangrove.graph import Graph
from pangrove.sources.derived import links_of


def _draw(seed: int, *columns: str | Column) -> Column:
    """A number from 0 to below 1000 that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1000))


def synthetic_graph(spark: SparkSession, nodes: int, haplotypes: int, longest: int = 60, seed: int = 1, sequences: int = 1) -> Graph:
    """A reference ``R`` of ``sequences`` sequences, and haplotypes that skip, add and turn nodes of it.

    Four nodes of five are the reference's.  A haplotype keeps nine of ten of
    these, takes a third of the others, and reads one in fifty backward.  Steps
    are made where they are needed, so their number is bounded by the cluster.
    """
    base = spark.range(1, nodes + 1).select(
        F.col("id").alias("node"), (1 + F.pmod(_draw(seed, "id") * 7, F.lit(longest))).cast("bigint").alias("length"),
        F.pmod("id", F.lit(sequences)).alias("part"), (F.col("id") % 5 == 4).alias("alt"),
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    segments = base.select("node", "length", none("string", "sn"), none("bigint", "so"), none("bigint", "sr"), F.col("node").alias("ord"))
    each = base.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(haplotypes))))
    own = F.col("h") == 0
    kept = (own & ~F.col("alt")) | (~own & F.when(F.col("alt"), _draw(seed + 1, "node", "h") < 333).otherwise(_draw(seed + 1, "node", "h") < 900))
    name = F.when(own, F.concat(F.lit("R#0#s"), F.col("part").cast("string"))).otherwise(F.concat(F.lit("H"), F.col("h").cast("string"), F.lit("#1#s"), F.col("part").cast("string")))
    walked = each.where(kept).select(name.alias("line"), "node", (~own & (_draw(seed + 2, "node", "h") < 20)).alias("rev"))
    steps = walked.select("line", (F.row_number().over(Window.partitionBy("line").orderBy("node")) - 1).cast("bigint").alias("i"), "node", "rev")
    lines = steps.select("line").distinct().select("line", F.col("line").alias("name"), F.col("line").alias("written"), F.lit(0).cast("bigint").alias("start"), F.col("line").alias("ord"))
    return Graph(segments, links_of(steps), lines, steps)


def synthetic_text(spark: SparkSession, nodes: int, haplotypes: int, **kind) -> DataFrame:
    """The same graph as GFA lines."""
    from pangrove.sources.gfa import gfa_text

    return gfa_text(synthetic_graph(spark, nodes, haplotypes, **kind))

"""Coverage, cost and copy-number measures over placed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pangrove.functions.handles import canonical_link
from pangrove.functions.names import haplotype


def copy_number(tiled: DataFrame) -> DataFrame:
    """Visits of each node by each haplotype in each tile."""
    return tiled.groupBy(F.col("t_seq").alias("seq"), F.col("t_tile").alias("tile"), haplotype(F.col("name")).alias("hap"), "node").agg(F.count("*").alias("visits"))


def link_traffic(steps: DataFrame) -> DataFrame:
    """Lines that take each link, by direction: the lesser way round and against it."""
    along = Window.partitionBy("line").orderBy("i")
    pairs = steps.select(
        "line", F.col("node").alias("a"), F.col("rev").alias("ar"), F.lead("node").over(along).alias("b"), F.lead("rev").over(along).alias("br")
    ).where(F.col("b").isNotNull())
    link = canonical_link(F.col("a"), F.col("ar"), F.col("b"), F.col("br"))
    pairs = pairs.withColumn("link", link)
    same = (F.col("link.src.node") == F.col("a")) & (F.col("link.src.rev") == F.col("ar")) & (F.col("link.tgt.node") == F.col("b")) & (F.col("link.tgt.rev") == F.col("br"))
    return pairs.groupBy(
        F.col("link.src.node").alias("src"), F.col("link.src.rev").alias("src_rev"), F.col("link.tgt.node").alias("tgt"), F.col("link.tgt.rev").alias("tgt_rev")
    ).agg(F.count_if(same).alias("forward"), F.count_if(~same).alias("backward"), F.countDistinct("line").alias("n_lines"))


def _one_way(links: DataFrame) -> DataFrame:
    """Links with ``way``, the lesser way round, by which either way of a link is the same."""
    return links.withColumn("way", canonical_link(F.col("src"), F.col("src_rev"), F.col("tgt"), F.col("tgt_rev")))


def untraversed(links: DataFrame, traffic: DataFrame) -> DataFrame:
    """Links that no line takes, either way round."""
    return _one_way(links).join(_one_way(traffic).select("way"), "way", "left_anti").select("src", "src_rev", "tgt", "tgt_rev")


def unlinked(traffic: DataFrame, links: DataFrame) -> DataFrame:
    """Links that lines take and ``links`` has neither way round."""
    return untraversed(traffic, links)


def window_cost(tiled: DataFrame) -> DataFrame:
    """Steps, lines and bp of each tile."""
    return tiled.groupBy(F.col("t_seq").alias("seq"), F.col("t_tile").alias("tile")).agg(
        F.count("*").alias("n_steps"), F.countDistinct("line").alias("n_lines"), F.sum("length").cast("bigint").alias("bp")
    )


def cost_quantiles(cost: DataFrame) -> DataFrame:
    """Exact discrete quantiles of the steps in a tile."""
    at = lambda q: F.expr(f"cast(percentile_disc({q}) WITHIN GROUP (ORDER BY n_steps) as bigint)")
    return cost.agg(F.count("*").alias("n_tiles"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("n_steps").alias("max"))


def costliest(cost: DataFrame, n: int) -> DataFrame:
    """The ``n`` tiles of most steps, ties by place."""
    return cost.orderBy(F.desc("n_steps"), "seq", "tile").limit(n)


def width_histogram(rows: DataFrame) -> DataFrame:
    """Rows and nodes off the reference by the width of the interval they are filed under."""
    width = F.col("end_pos") - F.col("start_pos")
    bin = F.when(width < 10, "a <10").when(width < 100, "b 10-100").when(width < 1000, "c 100-1k").when(width < 10000, "d 1k-10k").otherwise("e 10k+")
    return rows.where("rank <> 0").groupBy(bin.alias("width")).agg(F.count("*").alias("n_rows"), F.countDistinct("node").alias("n_nodes"))


def path_lengths(offset: DataFrame) -> DataFrame:
    return offset.groupBy("name").agg(F.sum("length").cast("bigint").alias("bp"), F.count("*").alias("n_steps"), F.countDistinct("node").alias("n_nodes"))

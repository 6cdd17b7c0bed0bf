"""A pangenome derived from the star-schema tables, the same way on every run."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from pangrove.functions.handles import canonical_link
from pangrove.graph import Graph
from pangrove.plans.storage import written

HAPLOTYPES = 16

#: The same graph as SQL, the prefix of every oracle.
SQL = f"""
segments AS (
  SELECT p_partkey + 1 AS node, p_size::BIGINT AS length, p_brand AS brand, p_partkey % 5 = 4 AS alt FROM part),
walked AS (
  SELECT 'R#0#' || brand AS line, node, false AS rev FROM segments WHERE NOT alt
  UNION ALL
  SELECT 'H' || s_suppkey || '#1#' || brand, node, (node * 7 + s_suppkey) % 17 = 0
  FROM segments, supplier
  WHERE s_suppkey < {HAPLOTYPES}
    AND ((NOT alt AND (node * 31 + s_suppkey * 7) % 11 <> 0) OR (alt AND (node + s_suppkey) % 3 = 0))),
steps AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY node) - 1 AS i, node, rev FROM walked),
followed AS (
  SELECT line, i, node, rev, lead(node) OVER w AS next_node, lead(rev) OVER w AS next_rev
  FROM steps WINDOW w AS (PARTITION BY line ORDER BY i)),
links AS (
  SELECT DISTINCT
    CASE WHEN (node, rev) <= (next_node, NOT next_rev) THEN node ELSE next_node END AS src,
    CASE WHEN (node, rev) <= (next_node, NOT next_rev) THEN rev ELSE NOT next_rev END AS src_rev,
    CASE WHEN (node, rev) <= (next_node, NOT next_rev) THEN next_node ELSE node END AS tgt,
    CASE WHEN (node, rev) <= (next_node, NOT next_rev) THEN next_rev ELSE NOT rev END AS tgt_rev
  FROM followed WHERE next_node IS NOT NULL)"""


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as segments, brands as sequences, the first suppliers as haplotypes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").where(F.col("s_suppkey") < HAPLOTYPES)
    base = part.select(
        (F.col("p_partkey") + 1).alias("node"), F.col("p_size").cast("bigint").alias("length"), F.col("p_brand").alias("brand"),
        (F.col("p_partkey") % 5 == 4).alias("alt"),
    )
    segments = base.select("node", "length", F.lit(None).cast("string").alias("sn"), F.lit(None).cast("bigint").alias("so"), F.lit(None).cast("bigint").alias("sr"), F.col("node").alias("ord"))
    reference = base.where(~F.col("alt")).select(F.concat(F.lit("R#0#"), "brand").alias("line"), "node", F.lit(False).alias("rev"))
    # Sixteen haplotypes at most, whatever the tables: numbers to explode, kept where the supplier exists.
    haps = base.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(HAPLOTYPES - 1)))).join(
        F.broadcast(supplier.limit(HAPLOTYPES)), F.col("h") == F.col("s_suppkey"), "left_semi"
    )
    keeps = (~F.col("alt") & ((F.col("node") * 31 + F.col("h") * 7) % 11 != 0)) | (F.col("alt") & ((F.col("node") + F.col("h")) % 3 == 0))
    walked = reference.union(
        haps.where(keeps).select(
            F.concat(F.lit("H"), F.col("h").cast("string"), F.lit("#1#"), F.col("brand")), "node", ((F.col("node") * 7 + F.col("h")) % 17 == 0)
        )
    )
    along = Window.partitionBy("line").orderBy("node")
    steps = walked.select("line", (F.row_number().over(along) - 1).cast("bigint").alias("i"), "node", "rev")
    lines = steps.select("line").distinct().select("line", F.col("line").alias("name"), F.col("line").alias("written"), F.lit(0).cast("bigint").alias("start"), F.col("line").alias("ord"))
    return Graph(segments, links_of(steps), lines, steps)


def links_of(steps):
    """The distinct links that consecutive steps take, the lesser way round."""
    along = Window.partitionBy("line").orderBy("i")
    pairs = steps.select(
        F.col("node").alias("a"), F.col("rev").alias("ar"), F.lead("node").over(along).alias("b"), F.lead("rev").over(along).alias("br")
    ).where(F.col("b").isNotNull())
    link = pairs.select(canonical_link(F.col("a"), F.col("ar"), F.col("b"), F.col("br")).alias("link")).distinct()
    return link.select(
        "link", F.col("link.src.node").alias("src"), F.col("link.src.rev").alias("src_rev"), F.col("link.tgt.node").alias("tgt"), F.col("link.tgt.rev").alias("tgt_rev")
    )


#: A second graph, whose haplotypes are all suppliers and grow with the tables; nodes are longer than its tiles.
SUPPLY_TILE = 32
#: Between the starts of a path's three lines.
APART = 1_000_000_000_000

SUPPLY_SQL = f"""
segments AS (
  SELECT p_partkey + 1 AS node, p_size::BIGINT AS length, p_brand AS brand, p_partkey % 5 = 4 AS alt FROM part),
walked AS (
  SELECT 'R#0#' || brand AS name, 0 AS f, node, false AS rev FROM segments WHERE NOT alt
  UNION ALL
  SELECT 'S' || h || '#1#' || brand, CASE WHEN alt AND node % 3 = 0 THEN 1 WHEN (node // 200) % 2 = 0 THEN 0 ELSE 2 END, node, (node * 7 + h) % 17 = 0
  FROM (SELECT DISTINCT l_suppkey AS h, l_partkey + 1 AS node FROM lineitem) JOIN segments USING (node)),
steps AS (
  SELECT name || '@' || f AS line, name, f * {APART} AS start, row_number() OVER (PARTITION BY name, f ORDER BY node) - 1 AS i, node, rev FROM walked)"""


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts as segments, brands as sequences, each supplier a haplotype that visits the parts it sold.

    A path has three lines: the second holds no step on the reference.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", "p_brand")
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("h"), (F.col("l_partkey") + 1).alias("node")).distinct()
    base = part.select(
        (F.col("p_partkey") + 1).alias("node"), F.col("p_size").cast("bigint").alias("length"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 5 == 4).alias("alt")
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    segments = base.select("node", "length", none("string", "sn"), none("bigint", "so"), none("bigint", "sr"), F.col("node").alias("ord"))
    reference = base.where(~F.col("alt")).select(F.concat(F.lit("R#0#"), "brand").alias("name"), F.lit(0).alias("f"), "node", F.lit(False).alias("rev"))
    f = F.when(F.col("alt") & (F.col("node") % 3 == 0), 1).when(F.floor(F.col("node") / 200) % 2 == 0, 0).otherwise(2)
    walked = reference.union(
        sold.join(base, "node").select(F.concat(F.lit("S"), F.col("h").cast("string"), F.lit("#1#"), "brand"), f, "node", (F.col("node") * 7 + F.col("h")) % 17 == 0)
    )
    line = F.concat("name", F.lit("@"), F.col("f").cast("string"))
    along = Window.partitionBy("name", "f").orderBy("node")
    steps = walked.select(line.alias("line"), "name", "f", (F.row_number().over(along) - 1).cast("bigint").alias("i"), "node", "rev")
    steps = written(steps, "supply-steps")  # for steps and lines, each read several times
    longest = steps.agg(F.max("i")).first()[0]
    lines = steps.select("line", "name", F.col("name").alias("written"), (F.col("f").cast("bigint") * APART).alias("start"), F.col("line").alias("ord")).distinct()
    steps = steps.select("line", "i", "node", "rev")
    return Graph(segments, links_of(steps), lines, steps, 0 if longest is None else longest + 1)

"""Alignments as a truth to hold placements against: PAF lines cut at long gaps, and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pangrove.operators.intervals import tile_of


def aligned_blocks(lines: DataFrame, gap: int, targets: list[str] | None = None) -> DataFrame:
    """``(query, query_start, query_end, target, target_start, target_end, forward)`` of ``(pos, line)`` PAF text.

    A line's ``cg:Z:`` operations become rows, whose ends are running sums; a
    gap of ``gap`` bp or more ends a block, a shorter one is part of it.  Blocks
    begin at an aligned stretch; those without query bp are left out.
    """
    c = F.split("line", "\t")
    rows = lines.select(
        "pos", c[0].alias("query"), c[2].cast("bigint").alias("qs"), c[3].cast("bigint").alias("qe"), (c[4] == "+").alias("forward"), c[5].alias("target"),
        c[7].cast("bigint").alias("ts"), F.regexp_extract("line", "\tcg:Z:([^\t]*)", 1).alias("cg"),
    ).where("cg <> ''")
    if targets is not None:
        rows = rows.where(F.col("target").isin(*targets))
    part = F.posexplode(F.regexp_extract_all("cg", F.lit("[0-9]+[=XMIDN]"), 0)).alias("k", "op")
    ops = rows.select(*[x for x in rows.columns if x != "cg"], part)
    n, kind = F.regexp_extract("op", "^[0-9]+", 0).cast("bigint"), F.substring("op", -1, 1)
    ops = ops.withColumns({"n": n, "kind": kind})
    in_query, in_target = F.when(F.col("kind").isin("D", "N"), 0).otherwise(F.col("n")), F.when(F.col("kind") == "I", 0).otherwise(F.col("n"))
    match = F.col("kind").isin("=", "X", "M")
    along = Window.partitionBy("pos").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ops = ops.withColumns({
        "q1": F.sum(in_query).over(along), "t1": F.sum(in_target).over(along), "q": in_query, "t": in_target, "match": match,
        "cut": F.sum((~match & (F.col("n") >= gap)).cast("int")).over(along),
    }).where(F.col("match") | (F.col("n") < gap))
    began = F.max(F.col("match").cast("int")).over(Window.partitionBy("pos", "cut").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    ops = ops.withColumn("began", began).where("began = 1")
    blocks = ops.groupBy("pos", "cut", "query", "target", "forward", "qs", "qe", "ts").agg(
        F.min(F.col("q1") - F.col("q")).alias("a"), F.max("q1").alias("b"), F.min(F.col("t1") - F.col("t")).alias("ta"), F.max("t1").alias("tb")
    ).where("b > a")
    low = F.when(F.col("forward"), F.col("qs") + F.col("a")).otherwise(F.col("qe") - F.col("b"))
    return blocks.select(
        "query", low.alias("query_start"), (low + F.col("b") - F.col("a")).alias("query_end"), "target",
        (F.col("ts") + F.col("ta")).alias("target_start"), (F.col("ts") + F.col("tb")).alias("target_end"), "forward",
    )


def placement_score(pieces: DataFrame, blocks: DataFrame, hull: DataFrame, tile: int, least: int = 1) -> DataFrame:
    """How pieces agree with alignments: a row of sums.

    ``pieces`` is ``(name, hap_offset, bp, seq, tile)``, ``blocks`` what
    ``aligned_blocks`` gives with the names of paths as queries, ``hull`` the
    tiles' extents.  Aligned bp are seen where their tile of the target overlaps
    the extent of the piece's tile.  A path with ``least`` aligned bp in a tile
    is a pair; it is listed where the path has a piece whose extent overlaps the
    tile, and strict where such a piece holds some of those bp.
    """
    p = pieces.select("name", "hap_offset", (F.col("hap_offset") + F.col("bp")).alias("hap_end"), "seq", F.col("tile").alias("filed"), "bp")
    p = p.join(hull.select("seq", F.col("tile").alias("filed"), "unit_start", "unit_end"), ["seq", "filed"])
    own = p["name"] == blocks["query"]
    both = p.join(blocks, own & (F.col("hap_offset") < F.col("query_end")) & (F.col("hap_end") > F.col("query_start")))
    lo, hi = F.greatest("hap_offset", "query_start"), F.least("hap_end", "query_end")
    share = lambda x: F.floor((F.col("target_end") - F.col("target_start")) * (x - F.col("query_start")) / (F.col("query_end") - F.col("query_start")))
    cut_lo = F.when(F.col("forward"), F.col("target_start") + share(lo)).otherwise(F.col("target_end") - share(hi))
    cut_hi = F.when(F.col("forward"), F.col("target_start") + share(hi)).otherwise(F.col("target_end") - share(lo))
    both = both.select("name", "hap_offset", "seq", "filed", "unit_start", "unit_end", "target", cut_lo.alias("a"), cut_hi.alias("b")).where("b > a")
    tiles = F.explode(F.sequence(tile_of(F.col("a"), tile), tile_of(F.col("b") - 1, tile), F.lit(tile).cast("bigint"))).alias("at")
    both = both.select("*", tiles).withColumn("n", F.least("b", F.col("at") + tile) - F.greatest("a", "at"))
    seen = (F.col("seq") == F.col("target")) & (F.col("unit_start") < F.col("at") + tile) & (F.col("unit_end") > F.col("at"))
    both = both.withColumn("seen", F.when(seen, F.col("n")).otherwise(0))
    bp = both.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("aligned_bp"), F.coalesce(F.sum("seen"), F.lit(0)).cast("bigint").alias("visible_bp"))
    pairs = both.groupBy("name", "target", "at").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).where(F.col("n") >= least)
    over = (pairs["name"] == p["name"]) & (pairs["target"] == p["seq"]) & (F.col("unit_start") < F.col("at") + tile) & (F.col("unit_end") > F.col("at"))
    listed = pairs.join(p.select("name", "seq", "unit_start", "unit_end").distinct(), over, "left_semi").agg(F.count("*").alias("recall_listed"))
    strict = pairs.agg(F.count("*").alias("recall_pairs"), F.count_if(F.col("seen") > 0).alias("recall_strict"))
    # Three tables of one row each.
    return bp.join(strict).join(listed)

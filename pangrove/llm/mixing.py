"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pangrove.llm.common import checkpointed, written


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``(source, source_size, target)``: weighted shares of all sizes, none above ``most`` times its source.

    ``sizes`` has a row for each source.  The excess of a source at its limit
    goes to the others by weight, until none is above: sources are taken by
    limit over weight, and all from the first that stays below share one level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # over a row for each source
    ranked = sizes.select("source", "source_size", F.row_number().over(by_name).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("bigint")
    ranked = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.col("source_size") * most).alias("limit"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    left = (F.sum("source_size").over(every).cast("bigint") - full("limit")).cast("double")
    level = left / (F.sum("weight").over(every).cast("bigint") - full("weight")).cast("double")
    leveled = ranked.withColumn("level", level)
    stays_below = F.col("level") * F.col("weight") <= F.col("limit")
    water = F.first(F.when(stays_below, F.col("level")), ignorenulls=True).over(every)
    return leveled.withColumn("water", water).select(
        "source", "source_size", F.least(F.col("limit").cast("double"), F.col("water") * F.col("weight")).alias("target")
    )


def _offset(source: Column, seed: int) -> Column:
    """A source's random offset: odd multiples of 1/8192, exact in sums below 2**39."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 3), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4096.0)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``(id, size, source_size, target, taken, source, copies)`` for every row of ``docs``.

    ``size`` is the text's words (null: 0).  Sources, by code point with null
    last, weigh ``weights`` in turn and share all words; none exceeds ``most``
    times its own.  Within a source, documents stand by size and id; each
    expects ``target / source_size`` copies, prefix sums of these start from
    one random offset, and a document is taken once for each integer that its
    own step crosses.  As neighbours in that order are alike in size, a
    source's taken words differ from its target by about one document.

    The order is made by a range sort over (source, size, id), so one source,
    whatever its share, spreads over many tasks; ranks come from the sorted
    partitions' row numbers and their counts.  Null ids come first among equal
    sizes, repeated rows count each, an empty table gives an empty table, and
    sources without words have target 0.  Reruns agree.
    """
    sizes = written(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")),
        "mix-sizes",
    )
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    placed = checkpointed(
        sizes.repartitionByRange("source", "size", "id").sortWithinPartitions("source", "size", "id")
    ).withColumn("at", F.monotonically_increasing_id())
    placed = placed.select("*", F.shiftright("at", 33).alias("part"))
    runs = placed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("part", "source", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from")).alias("shift"))
    runs = runs.join(targets, runs["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rows = placed.join(runs, (placed["part"] == runs["part"]) & placed["source"].eqNullSafe(runs["source"])).drop(runs["source"]).drop(runs["part"])
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = (F.col("at") + F.col("shift")).cast("double")
    crossed = lambda k: F.floor(_offset(F.col("source"), seed) + step * k)
    rows = rows.withColumn("copies", (crossed(rank + 1) - crossed(rank)).cast("bigint"))
    return rows.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col), "copies"
    )

"""Tiles, blocks and holes on a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The block sizes of a cover, in tiles, largest first.
BLOCK_TILES = (512, 64, 8, 1)


def tile_of(position: Column, tile: int) -> Column:
    return (F.floor(position / tile) * tile).cast("bigint")


def tiles(ends: DataFrame, tile: int) -> DataFrame:
    """``(seq, tile_start, tile_end)`` of ``(seq, end_pos)``: the last tile ends with its sequence."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end_pos") - 1, F.lit(tile).cast("bigint"))).alias("tile_start")
    each = ends.where("end_pos > 0").select("seq", "end_pos", starts)
    return each.select("seq", "tile_start", F.least(F.col("tile_start") + tile, "end_pos").alias("tile_end"))


#: The greatest coordinate and the number of tiles that a walk file states.
MOST_BP, MOST_TILES = 1 << 53, 1 << 32


def beyond(ends: DataFrame, tile: int) -> DataFrame:
    """Of ``(seq, end_pos)``, sequences that end beyond 2^53; one row more where all have 2^32 tiles or more."""
    far = ends.where(F.col("end_pos") > MOST_BP).select("seq", "end_pos")
    n = ends.agg(F.sum(F.ceil(F.col("end_pos") / tile)).alias("n")).where(F.col("n") >= MOST_TILES)
    return far.unionByName(n.select(F.lit("all").alias("seq"), F.col("n").cast("bigint").alias("end_pos")))


def cover(lo: Column, hi: Column, tile: int) -> Column:
    """The largest aligned blocks that tile ``[lo, hi)``, widened to whole tiles: ``array<struct<start, size>>``.

    Closed form, no loop over tiles: on the way up each block size fills up to
    the next boundary of a larger one, on the way down what is left.
    """
    begin, end = F.floor(lo / tile).cast("bigint"), F.ceil(hi / tile).cast("bigint")
    none = F.expr("cast(array() as array<struct<start: bigint, size: bigint>>)")

    def stretch(a: Column, b: Column, n: int) -> Column:
        steps = F.transform(
            F.sequence(a, b - n, F.lit(n).cast("bigint")),
            lambda x: F.struct((x * tile).alias("start"), F.lit(n * tile).cast("bigint").alias("size")),
        )
        return F.when(b - a >= n, steps).otherwise(none)

    up = lambda x, n: F.ceil(x / n).cast("bigint") * n
    down = lambda x, n: F.floor(x / n).cast("bigint") * n
    sizes = BLOCK_TILES[::-1]
    at, rising, top = begin, [], end
    for n, larger in zip(sizes, sizes[1:]):
        stop = F.least(up(at, larger), down(end, n))
        stop = F.greatest(stop, at)
        rising.append(stretch(at, stop, n))
        at = stop
    largest = F.greatest(down(end, sizes[-1]), at)
    rising.append(stretch(at, largest, sizes[-1]))
    at, falling = largest, []
    for n in BLOCK_TILES[1:]:
        stop = F.greatest(down(top, n), at)
        falling.append(stretch(at, stop, n))
        at = stop
    return F.concat(*rising, *falling)


def holes(stretches: DataFrame) -> DataFrame:
    """``(seq, start_pos, end_pos, before)``: stretches that no line covers, and the holes' bp before each."""
    by_seq = Window.partitionBy("seq").orderBy("start_pos", "end_pos")
    reached = F.coalesce(F.max("end_pos").over(by_seq.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = stretches.select("seq", reached.alias("hole_start"), F.col("start_pos").alias("hole_end")).where("hole_end > hole_start")
    earlier = Window.partitionBy("seq").orderBy("hole_start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("hole_end") - F.col("hole_start")).over(earlier), F.lit(0)).cast("bigint")
    return gaps.select("seq", F.col("hole_start").alias("start_pos"), F.col("hole_end").cast("bigint").alias("end_pos"), before.alias("before"))


def overlapping(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of ``(seq, start_pos, end_pos, …)`` rows that overlap, by an equality join on bins.

    Each side is filed in every bin of ``width`` it touches; a pair counts in
    the first bin that both touch, so none is doubled.  Right columns get the
    prefix ``r_``.
    """
    bins = lambda df: df.where("end_pos > start_pos").withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor((F.col("end_pos") - 1) / width)))
    )
    r = bins(right)
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in r.columns])
    pairs = bins(left).join(r, (F.col("seq") == F.col("r_seq")) & (F.col("bin") == F.col("r_bin")))
    first = F.floor(F.greatest("start_pos", "r_start_pos") / width)
    return pairs.where((F.col("start_pos") < F.col("r_end_pos")) & (F.col("end_pos") > F.col("r_start_pos")) & (F.col("bin") == first)).drop("bin", "r_bin")

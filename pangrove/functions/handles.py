"""Strands, links and carrier sets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strand(rev: Column) -> Column:
    return F.when(rev, "-").otherwise("+")


def canonical_link(src: Column, src_rev: Column, tgt: Column, tgt_rev: Column) -> Column:
    """The lesser of a link and the same link read the other way."""
    end = lambda n, r: F.struct(n.alias("node"), r.alias("rev"))
    forward = F.struct(end(src, src_rev).alias("src"), end(tgt, tgt_rev).alias("tgt"))
    back = F.struct(end(tgt, ~tgt_rev).alias("src"), end(src, ~src_rev).alias("tgt"))
    return F.least(forward, back)


def carrier_bits(bits: Column) -> Column:
    """Numbers as a set: hex digit ``i / 4``, counted from the left, holds number ``i`` as bit ``i % 4``."""
    nibble = lambda k: F.aggregate(
        F.filter(bits, lambda b: F.floor(b / 4) == k), F.lit(0), lambda s, b: s + F.pow(F.lit(2), b % 4).cast("int")
    )
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.array_max(bits) / 4).cast("int")), lambda k: F.lower(F.hex(nibble(k)))), "")


#: Fixed values of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def graph_hash(segments: DataFrame, node: str = "node", length: str = "length") -> DataFrame:
    """``(graph_hash, n_segments)``: FNV-1a of each id, a byte 255 and the length's 8 bytes, summed modulo 2**64.

    A hash is two halves of 32 bits, so no product overflows: the prime is
    2**40 + 435, so a round is small products and the low half, moved by 8
    bits, added to the high one.  Rows are dealt anew, as many fit in one file.
    """
    wide, mask = "decimal(38,0)", (1 << 32) - 1
    hexed = F.hex(F.col("id"))
    id_bytes = F.transform(
        F.sequence(F.lit(0), F.octet_length("id") - 1), lambda k: F.conv(F.substring(hexed, 2 * k + 1, F.lit(2)), 16, 10).cast("bigint")
    )
    # No length counts as 2**64 - 1.
    size = F.when(F.col("n").isNull(), F.array_repeat(F.lit(255).cast("bigint"), 8)).otherwise(
        F.array(*[F.shiftright(F.col("n"), 8 * k).bitwiseAND(F.lit(255).cast("bigint")) for k in range(8)])
    )
    all_bytes = F.concat(id_bytes, F.array(F.lit(255).cast("bigint")), size)
    half = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))
    start = half(F.lit(FNV_START >> 32).cast("bigint"), F.lit(FNV_START & mask).cast("bigint"))

    def step(h: Column, b: Column) -> Column:
        low = h["lo"].bitwiseXOR(b)
        high = h["hi"] * 435 + F.shiftright(low * 435, 32) + F.shiftleft(low, 8)
        return half(high.bitwiseAND(F.lit(mask)), (low * 435).bitwiseAND(F.lit(mask)))

    rows = segments.select(F.col(node).cast("string").cast("binary").alias("id"), F.col(length).cast("bigint").alias("n"))
    rows = rows.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    rows = rows.select(F.aggregate(all_bytes, start, step).alias("h")).select("h.hi", "h.lo")
    low = F.sum(F.col("lo").cast(wide))
    carry = F.floor(low / F.lit(str(1 << 32)).cast(wide)).cast(wide)
    over = F.lit(str(1 << 32)).cast(wide)
    high, low = ((F.sum(F.col("hi").cast(wide)) + carry) % over).cast("bigint"), (low % over).cast("bigint")
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return rows.agg(F.coalesce(F.concat(digits(high), digits(low)), F.lit("0" * 16)).alias("graph_hash"), F.count("*").alias("n_segments"))

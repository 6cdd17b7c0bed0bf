"""Appending haplotypes to saved tables, a batch of new steps at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pangrove.functions.names import haplotype


def visit_counts(steps: DataFrame) -> DataFrame:
    """Visits of each node by each haplotype of ``(name, node)`` rows; works on streams and tables alike."""
    return steps.groupBy(haplotype(F.col("name")).alias("hap"), "node").agg(F.count("*").alias("visits"))


def append_haplotypes(steps: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run over a stream of ``(name, i, node, rev)`` steps until what is there is taken.

    Each batch's counts are written under its number, so a batch that runs
    twice overwrites itself; ``read_counts`` sums them.
    """

    def write(batch: DataFrame, number: int) -> None:
        visit_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("hap", "node").agg(F.sum("visits").alias("visits"))

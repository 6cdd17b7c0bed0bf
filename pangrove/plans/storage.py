"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables written here that nothing has removed yet.
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary one; on a cluster,
    whose executors would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pangrove-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: cuts the lineage and survives lost executors."""
    shared_dir(df.sparkSession, "any")
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage, survives lost executors, and makes what follows read
    the same rows even where the plan above is not deterministic.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    _LEFT.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    _LEFT.discard(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan will read again."""
    for table in tables:
        remove(table.sparkSession, table.written_at)


def release(spark: SparkSession, *still_read: DataFrame) -> None:
    """Delete every table of ``written`` that is left, but for those that ``still_read`` read.

    For a caller whose earlier results are written elsewhere by now.
    """
    if _LEFT:
        used = [f for df in still_read for f in df.inputFiles()]
        for path in list(_LEFT):
            tail = path.rsplit("/", 1)[1]
            if not any(f"/{tail}/" in f for f in used):
                remove(spark, path)

"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One whitespace character, and one character of a word, as Java and RE2 regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session makes a temporary folder once; a cluster is told
    to set it, because a folder of the driver's machine would not be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from that copy.

    Spark deletes the files once the returned DataFrame is no longer referenced, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``rank``: their places, from 1, in the order of ``by``.

    Rows are put in order by range partitions, and a partition's ranks start after the
    counts of those before it, so no task sees all rows.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = checkpointed(ordered.withColumn("__p", F.shiftright("__at", 33)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))  # one row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    return placed.join(offsets, "__p").withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__at", "__p", "__before")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds.

    Its cleaner acts when the driver's JVM collects garbage, which a loop of small jobs does
    not bring about by itself while its files pile up on the executors.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

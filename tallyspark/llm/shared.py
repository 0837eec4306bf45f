"""Tables written to the folder that driver and executors share, to cut a lineage without recomputing it."""

from __future__ import annotations

import gc
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; it is deleted when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there; it survives the loss of executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of jobs that have ended.

    It does so once the driver's garbage collector finds their plans unused; between the rounds of a long operator that
    need not happen by itself, and the files of all rounds would stay until the end.
    """
    gc.collect()
    spark._jvm.System.gc()


def heaviest(df: DataFrame, weight: Column, most: int) -> DataFrame:
    """The rows of the greatest positive weights, about ``most`` of them and not more, without sorting them in one task.

    Weights are counted by level (an eighth of a power of two), and the levels are taken from above while their rows fit.
    Of the first level that does not fit, rows are taken by hash for the room that is left.
    """
    hashed = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))
    levelled = df.withColumn("__level", F.floor(8 * F.log2(weight)).cast("int")).withColumn("__draw", hashed)
    chosen, room = F.lit(False), most
    for row in levelled.where("__level IS NOT NULL").groupBy("__level").count().orderBy(F.desc("__level")).collect():
        level, count = row["__level"], row["count"]
        if count > room:
            share = max(0.0, room - 4 * math.sqrt(room)) / count  # four deviations below the room
            chosen = chosen | ((F.col("__level") == level) & (F.col("__draw") < int((1 << 31) * share)))
            break
        chosen, room = F.col("__level") >= level, room - count
    return levelled.where(F.coalesce(chosen, F.lit(False))).drop("__level", "__draw")


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All rows if they are at most ``most``, else the ``most`` or somewhat fewer with the smallest hash of their keys."""
    draw = F.pmod(F.xxhash64(*keys), F.lit(1 << 31))
    rows = df.count()
    return df if rows <= most else df.where(draw < int((1 << 31) * 0.9 * most / rows)).orderBy(draw, *keys).limit(most)

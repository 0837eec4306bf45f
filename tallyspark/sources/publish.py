"""Checks and publication-safe records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.ordered import numbered

L1 = ("ex", "em", "sf1", "sc", "ves", "rves")  # fixed value: published quality metrics
CHUNK = 200_000  # ids hashed together at one level of a fingerprint
DIGEST = 16  # fixed value: hex digits of a short fingerprint


def verify_benchmark(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Actual against declared rows per split (``split, declared``)."""
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    joined = counts.join(manifest, "split", "full_outer").fillna(0, ["actual"])
    return joined.withColumn("ok", F.coalesce(F.col("actual") == F.col("declared"), F.lit(False)))


def missing_files(present: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths that are not in the listing."""
    return required.select("path").join(present.select("path"), "path", "left_anti")


def public_diagnostics(samples: DataFrame) -> DataFrame:
    """Publication-safe record per sample: metrics, status, error category, latency, token usage."""
    pairs = [F.struct(F.lit(m).alias("key"), F.col(m).cast("double").alias("value")) for m in L1 if m in samples.columns]
    metrics = F.map_filter(F.map_from_entries(F.array(*pairs)), lambda k, v: v.isNotNull())
    columns = [
        "instance_id", metrics.alias("metrics"),
        F.when(F.col("exec_error").isNull(), "completed").otherwise("exec_error").alias("stage_status"),
        F.nullif("error_root", F.lit("")).alias("error_category"),
        F.round(F.col("act_elapsed_s") * 1000, 3).alias("latency_ms"),
    ]
    if "error_sub" in samples.columns:
        columns.append(F.when(F.col("error_sub") != "", F.array("error_sub")).alias("error_categories"))
    if "tokens" in samples.columns:
        columns.append(F.when(F.size("tokens") > 0, F.col("tokens")).alias("token_usage"))
    return samples.select(*columns)


def dataset_fingerprint(df: DataFrame, order: Column, key: str = "instance_id", chunk: int = CHUNK) -> DataFrame:
    """Short sha256 tree over the ids in order, the same definition for every number of ids.

    The ids are cut into leaves of ``chunk``, each the sha256 of its ids joined by
    line breaks; branches hash ``chunk`` leaf digests the same way, and the root
    hashes the branches, so no task holds all ids.  The leaf size is part of the
    format: fingerprints compare only at the same ``chunk``.
    """
    level = numbered(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), order.alias("_o")), [], [F.col("_o")], out="pos").select("pos", "id")
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "id")))["id"], "\n"), 256)
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("pos") / chunk).alias("pos")).agg(joined.alias("id"))
    return level.agg(joined.alias("id")).select(F.substring("id", 1, DIGEST).alias("fingerprint"))


def file_digests(files: DataFrame) -> DataFrame:
    """sha256 of each file of a ``binaryFile`` listing."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))

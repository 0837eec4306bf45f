"""The evaluation store: six long tables partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.metrics import Registry, default_registry
from tallyspark.operators.aggregate import has_path, numeric_path
from tallyspark.operators.sqltext import FEATURES
from tallyspark.sources.readers import path_exists

# Descriptive and raw text fields of a sample, version of the layout.
META_FIELDS = ("db_id", "db_type", "hardness", "error_root", "error_sub", "exec_error")
TEXT_FIELDS = ("question", "gold_sql", "pred_sql")
STORE_VERSION = 1
TABLES = ("runs", "sample_metrics", "sample_meta", "sample_text", "sql_features", "stage_metrics")


def metric_sources(registry: Registry) -> dict[str, str]:
    """Stored metric id → source path, one per distinct leaf."""
    sources: dict[str, str] = {}
    for metric in registry.folded():
        sources.setdefault(metric.source.split(".")[-1], metric.source)
    return sources


def sample_metrics(samples: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Numeric metrics per (run, instance), long form, with the token total."""
    sources = {k: v for k, v in metric_sources(registry or default_registry()).items() if has_path(samples, v)}
    cells = [F.struct(F.lit(k).alias("metric_id"), numeric_path(samples, v).alias("value")) for k, v in sources.items()]
    if has_path(samples, "tokens"):
        total = F.aggregate(F.map_values("tokens"), F.lit(0.0), lambda a, x: a + x.cast("double"))
        cells.append(F.struct(F.lit("tokens_total").alias("metric_id"), F.when(F.size("tokens") > 0, total).alias("value")))
    long = samples.select("run_id", "instance_id", F.explode(F.array(*cells)).alias("c")).select("run_id", "instance_id", "c.*")
    return long.where(F.col("value").isNotNull())


def _text_cells(samples: DataFrame, fields: tuple[str, ...], extra: dict[str, str] | None = None) -> DataFrame:
    named = {f: f for f in fields if f in samples.columns} | (extra or {})
    cells = [F.struct(F.lit(k).alias("field"), F.col(v).cast("string").alias("value")) for k, v in named.items()]
    if not cells:
        cells = [F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value"))]
    return samples.select("run_id", "instance_id", F.explode(F.array(*cells)).alias("c")).select("run_id", "instance_id", "c.*").where(
        F.col("value").isNotNull())


def sample_meta(samples: DataFrame) -> DataFrame:
    extra = {"workflow_root_stage": "root_stage"} if "root_stage" in samples.columns else {}
    return _text_cells(samples, META_FIELDS, extra)


def sample_text(samples: DataFrame) -> DataFrame:
    return _text_cells(samples, TEXT_FIELDS).where(F.col("value") != "")


def sql_feature_rows(samples: DataFrame) -> DataFrame:
    """Gold, predicted and delta value per feature, when both structs are present."""
    cells = [
        F.struct(F.lit(n).alias("feature"), F.col(f"gold_features.{n}").cast("double").alias("gold_value"),
                 F.col(f"pred_features.{n}").cast("double").alias("pred_value"))
        for n in FEATURES if has_path(samples, f"gold_features.{n}") and has_path(samples, f"pred_features.{n}")
    ]
    long = samples.select("run_id", "instance_id", F.explode(F.array(*cells)).alias("c")).select("run_id", "instance_id", "c.*")
    return long.withColumn("delta_value", F.col("pred_value") - F.col("gold_value"))


def stage_metric_rows(stages: DataFrame) -> DataFrame:
    """One row per stage metric; a stage without metrics keeps a status row."""
    none = F.create_map(F.lit("__status__"), F.lit(None).cast("double"))
    metrics = F.when(F.coalesce(F.size("metrics"), F.lit(0)) > 0, F.col("metrics")).otherwise(none)
    kept = [c for c in ("run_id", "instance_id", "stage_id", "task_type", "actor_class", "status") if c in stages.columns]
    return stages.select(*kept, F.explode(metrics).alias("metric_name", "metric_value"))


def _write(df: DataFrame, path: str) -> None:
    """Replace only the runs present in ``df``; files are balanced, also for one very large run."""
    (
        df.hint("rebalance", "run_id").write.partitionBy("run_id")
        .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    )


def write_eval_store(
    path: str, runs: DataFrame, samples: DataFrame, stages: DataFrame | None = None,
    registry: Registry | None = None, include_text: bool = False,
) -> None:
    """Write the store tables; a run written again replaces its rows.  Raw text only on request."""
    _write(runs.withColumn("store_schema_version", F.lit(STORE_VERSION)), f"{path}/runs")
    _write(sample_metrics(samples, registry), f"{path}/sample_metrics")
    _write(sample_meta(samples), f"{path}/sample_meta")
    if include_text:
        _write(sample_text(samples), f"{path}/sample_text")
    if has_path(samples, "gold_features") and has_path(samples, "pred_features"):
        _write(sql_feature_rows(samples), f"{path}/sql_features")
    if stages is not None:
        _write(stage_metric_rows(stages), f"{path}/stage_metrics")


def load_sample_metric(
    spark: SparkSession, path: str, metric: str, dataset: str | None = None, split: str | None = None
) -> DataFrame:
    """Value per (method, instance) of one metric; the latest run wins.

    Run partitions that the filters rule out are not read.
    """
    runs = spark.read.parquet(f"{path}/runs").select("run_id", "method", "dataset", "split", "timestamp")
    for name, value in (("dataset", dataset), ("split", split)):
        if value is not None:
            runs = runs.where(F.col(name) == value)
    cells = spark.read.parquet(f"{path}/sample_metrics").where(F.col("metric_id") == metric).withColumn("run_id", F.col("run_id").cast("string"))
    runs = runs.withColumn("run_id", F.col("run_id").cast("string"))
    return cells.join(runs, "run_id").groupBy("method", "instance_id").agg(
        F.max_by("value", F.struct("timestamp", "run_id")).alias("value"))


def append_predictions(cumulative_path: str, batch: DataFrame, key: str = "instance_id") -> tuple[int, int]:
    """Append a batch; fail when an id is already present or repeated.  Returns (total, added)."""
    spark = batch.sparkSession
    repeated = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).take(1)
    total = 0
    if path_exists(spark, f"{cumulative_path}/_SUCCESS"):
        seen = spark.read.parquet(cumulative_path)
        total = seen.count()
        repeated = repeated or batch.join(seen.select(key), key, "left_semi").take(1)
    if repeated:
        raise ValueError(f"sample already present: {repeated[0][key]}")
    added = batch.count()
    batch.write.mode("append").parquet(cumulative_path)
    return total + added, added

"""Resumable and incremental scoring, batch by batch or as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.functions.ordered import running
from tallyspark.functions.stats import ratio
from tallyspark.operators.aggregate import parse_tag

# Log line shapes of a run.
STARTED = r"开始处理样本\s+(\S+)"
FINISHED = r"样本\s+(\S+)\s+处理完成"
ENTERED = r"样本\s+(\S+)\s+@\s+(\S+)"
REPORT, REPORTED = "评估结果", r"^\s*样本\s+(\d+)\s*条"
FIRST_STAGE, LAST_STAGE = "准备中", "评估完成"


def pending(df: DataFrame, completed: DataFrame, stage: str) -> DataFrame:
    """Rows a stage has not completed yet.  ``completed``: ``stage, instance_id``."""
    done = completed.where(F.col("stage") == stage).select(F.col("instance_id").cast("string").alias("_id")).distinct()
    return df.join(done, df["instance_id"].cast("string") == done["_id"], "left_anti")


def completed_counts(completed: DataFrame) -> DataFrame:
    return completed.groupBy("stage").agg(F.count_distinct("instance_id").alias("completed"))


def batch_totals(scores: DataFrame, metrics: Sequence[str], batch: str = "batch") -> DataFrame:
    """Sums and counts per batch: all that cumulative averages need."""
    folds = [F.count(F.lit(1)).alias("samples")]
    for m in metrics:
        folds += [F.sum(m).cast("double").alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    return scores.groupBy(batch).agg(*folds)


def cumulative_metrics(totals: DataFrame, metrics: Sequence[str], batch: str = "batch") -> DataFrame:
    """Cumulative sample count and metric averages after each batch."""
    sums = {"samples_seen": "samples"}
    for m in metrics:
        sums |= {f"_{m}_s": f"{m}_sum", f"_{m}_n": f"{m}_n"}
    rolled = running(totals, [], [F.col(batch)], sums=sums)
    averages = [ratio(F.col(f"_{m}_s"), F.col(f"_{m}_n")).alias(f"{m}_avg") for m in metrics]
    return rolled.select(batch, "samples", "samples_seen", *averages)


def is_converged(history: DataFrame, value: str, delta: float, patience: int, step: str = "step") -> DataFrame:
    """Mark steps where the last ``patience`` changes all stay below ``delta``.

    ``history`` holds one row per evaluation step.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(step)
    recent = order.rowsBetween(-(patience - 1), 0)
    changed = history.withColumn("change", F.abs(F.col(value) - F.lag(value).over(order)))
    stable = (F.count("change").over(recent) == patience) & (F.max("change").over(recent) < delta)
    return changed.withColumn("converged", F.coalesce(stable, F.lit(False)) if patience > 0 else F.lit(False))


def seen_keys(stream: DataFrame, key: str) -> DataFrame:
    """The rows of each micro-batch with ``_times``: how often their key has come in the whole stream, this time included.

    The ids seen so far are the state of a streaming aggregate, held by key in the state store, so no stored sample is read
    again.  For update mode; a key that comes twice in a micro-batch gives one row.
    """
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*rest)).alias("_row")).select(key, "_times", "_row.*")


def incremental_score(stream: DataFrame, store: str, checkpoint: str, metrics: Sequence[str], key: str = "instance_id"):
    """Score a stream: each micro-batch is appended once and its totals are kept by batch id.

    Both writes are keyed by the batch id, so a batch that is replayed after a
    failure replaces itself.  A sample that is present already, in the same
    micro-batch too, ends the query; which ids are present is keyed state of
    the stream (``seen_keys``; use the RocksDB state store where ids outgrow
    the executors' memory).  Returns the started query.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("batch", F.lit(batch_id)).persist()
        try:
            clash = kept.where("_times > 1").select(key).take(1)
            if clash:
                raise ValueError(f"sample already present: {clash[0][key]}")
            kept = kept.drop("_times")
            for name, rows in (("samples", kept), ("totals", batch_totals(kept, metrics))):
                rows.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{store}/{name}")
        finally:
            batch.unpersist()
            kept.unpersist()

    counted = seen_keys(stream, key).writeStream.outputMode("update")
    return counted.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(lines: DataFrame, target: int = 0, finished_job: bool = False) -> DataFrame:
    """Started and finished samples, latest stage, total and percent from log lines ``(line_no, line)``.

    Entering a stage starts a sample but does not finish it.  A result line
    followed by the line with its number of samples gives the total, unless a
    target is given, and means that all of them are done.
    """
    counts = lines.select((F.col("line_no") - 1).alias("line_no"), F.regexp_extract("line", REPORTED, 1).alias("n")).where("n <> ''")
    titles = lines.where(F.col("line").contains(REPORT)).select("line_no")
    reported = titles.join(counts, "line_no").agg(F.min_by(F.col("n").cast("bigint"), "line_no").alias("reported"))
    entered = F.regexp_extract("line", ENTERED, 1)
    cells = F.array_compact(F.array(*[
        F.when(F.regexp_extract("line", p, 1) != "", F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("id")))
        for k, p in (("started", STARTED), ("finished", FINISHED), ("started", ENTERED))]))
    hits = lines.select("line_no", "line", F.explode_outer(cells).alias("c"), F.when(entered != "", F.regexp_extract("line", ENTERED, 2)).alias("stage"))
    folded = hits.agg(
        F.count_distinct(F.when(F.col("c.kind") == "started", F.col("c.id"))).alias("begun"),
        F.count_distinct(F.when(F.col("c.kind") == "finished", F.col("c.id"))).alias("done"),
        F.max_by(F.when(F.col("stage").isNotNull(), F.col("stage")), F.when(F.col("stage").isNotNull(), F.col("line_no"))).alias("current_stage"))
    folded = folded.crossJoin(F.broadcast(reported))  # one row with one row
    total = F.lit(target) if target else F.coalesce("reported", F.greatest("begun", "done", F.lit(1)))
    told = F.lit(finished_job) | F.col("reported").isNotNull()
    done = F.when(told, F.greatest(F.col("done"), F.coalesce("reported", total))).otherwise(F.col("done"))
    completed = F.least(done, total)
    percent = F.lit(100) if finished_job else F.least(F.lit(100), F.bround(100 * completed / total).cast("int"))
    return folded.select(
        F.when(told, LAST_STAGE).otherwise(F.coalesce("current_stage", F.lit(FIRST_STAGE))).alias("current_stage"), F.greatest(F.col("begun"), completed).cast("bigint").alias("started"),
        completed.cast("bigint").alias("completed"), total.cast("bigint").alias("total"), percent.cast("int").alias("percent"))


def token_usage(records: DataFrame) -> DataFrame:
    """Running totals by model and step; records without tokens are dropped.  Works on streams."""
    total = F.when(F.coalesce("total_tokens", F.lit(0)) > 0, F.col("total_tokens")).otherwise(
        F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    _, step = parse_tag(F.col("tag"))
    rows = records.withColumn("total_tokens", total).where(F.col("total_tokens") > 0).withColumn("step", step)
    return rows.groupBy("model", "step").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("total_tokens").alias("total_tokens"))


def token_usage_windows(
    records: DataFrame, time: str, width: str, slide: str | None = None, lateness: str = "1 hour", unique: Sequence[str] = ()
) -> DataFrame:
    """Tokens per event-time window and step with a watermark; repeats within it are dropped."""
    rows = records.withColumn("_t", F.col(time).cast("timestamp")).where(F.col("total_tokens") > 0).withWatermark("_t", lateness)
    if unique:
        rows = rows.dropDuplicatesWithinWatermark(list(unique)) if records.isStreaming else rows.dropDuplicates(list(unique))
    _, step = parse_tag(F.col("tag"))
    span = F.window("_t", width, slide) if slide else F.window("_t", width)
    return rows.groupBy(span.alias("w"), step.alias("step")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "step", "calls", "total_tokens")


SNAPSHOT_ROWS = "instance_id string, pos bigint, actor_name string, before string"


def stream_snapshots(log: DataFrame) -> DataFrame:
    """Prediction that stood before each output row, per instance, over a stream.

    ``log``: ``instance_id string, pos bigint, actor_name, pred_sql``.  The
    state of an instance is its last prediction; rows of a micro-batch are
    taken in order of ``pos``.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("pos")
        current = rows["pred_sql"]
        shifted = current.where(current.notna(), None).ffill().shift(1)
        before = shifted.where(shifted.notna(), last)
        newest = current.dropna()
        if len(newest):
            last = newest.iloc[-1]
        state.update((last,))
        out = pd.DataFrame({"instance_id": key[0], "pos": rows["pos"], "actor_name": rows["actor_name"], "before": before})
        yield out[out["before"].notna()]

    return log.groupBy("instance_id").applyInPandasWithState(
        step, SNAPSHOT_ROWS, "last string", "append", GroupStateTimeout.NoTimeout)

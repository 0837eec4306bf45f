"""Folding scored samples into metric rows: overall, per slice, with intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tallyspark.functions.hashing import draw_pair
from tallyspark.functions.ordered import percentiles
from tallyspark.functions.stats import ratio, wilson
from tallyspark.metrics import COMPONENTS, HARDNESS, Metric, Registry

# Metrics compared between two runs.
LATENCY_POINTS = {"p50_s": 50.0, "p95_s": 95.0}


def has_path(df: DataFrame, path: str) -> bool:
    """Does a dot path resolve in the schema?"""
    schema = df.schema
    for part in path.split("."):
        if not hasattr(schema, "fieldNames") or part not in schema.fieldNames():
            return False
        schema = schema[part].dataType
    return True


def numeric_path(df: DataFrame, path: str) -> Column:
    """Numbers found at a dot path (booleans count as 0/1), else NULL."""
    if not has_path(df, path):
        return F.lit(None).cast("double")
    return F.col(path).try_cast("double")


def _present(df: DataFrame, metrics: Sequence[Metric]) -> list[Metric]:
    return [m for m in metrics if has_path(df, m.source)]


def aggregate_metrics(df: DataFrame, registry: Registry, layer: str | None = None) -> DataFrame:
    """One row per declared metric: n, total, value and Wilson bounds for rates.

    All means, rates and sums come from one pass; exact percentiles share one
    ordered pass per source column.  Bootstrap bounds: ``bootstrap_interval``.
    """
    return slice_metrics(df, registry, axes=None, layer=layer).drop("axis", "label", "count")


def slice_metrics(
    df: DataFrame,
    registry: Registry,
    axes: Sequence[str] | None = (),
    layer: str | None = None,
    min_samples: int | None = None,
) -> DataFrame:
    """Every sliceable metric on every axis, long form.

    Fixed labels keep empty groups; discovered labels map NULL, '' and 0 to
    ``unknown``.  Groups below the axis minimum report their count only.
    ``axes=None`` folds all rows as a single group.
    """
    chosen = [m for m in registry.folded(layer) if axes is None or m.sliceable]
    chosen = _present(df, chosen)
    points = [m for m in chosen if m.kind == "percentile"]
    plain = [m for m in chosen if m.kind in ("mean", "rate", "sum")]
    specs = [s for s in registry.slices() if axes is not None and (not axes or s.id in axes)]

    sources = sorted({m.source for m in chosen if m.kind != "distribution"})
    slot = {source: f"s{i}" for i, source in enumerate(sources)}
    values = [numeric_path(df, source).alias(slot[source]) for source in sources]
    if axes is None:
        keyed = df.select(F.lit("all").alias("axis"), F.lit("all").alias("label"), *values)
    else:
        pairs = [F.struct(F.lit(s.id).alias("axis"), _label(s).alias("label")) for s in specs]
        keyed = (
            df.select(F.explode(F.array(*pairs)).alias("p"), *values)
            .select("p.axis", "p.label", *slot.values())
            .where(F.col("label").isNotNull())
        )
    folds = [F.count(F.lit(1)).alias("count")]
    for source in sources:
        folds += [F.count(slot[source]).alias(f"n_{slot[source]}"), F.sum(slot[source]).alias(f"t_{slot[source]}")]
    cells = keyed.groupBy("axis", "label").agg(*folds)
    minimums = {s.id: max(1, min_samples if min_samples is not None else s.min_samples) for s in specs}
    if axes is not None:
        cells = _keep_fixed_labels(cells, specs, [f.name for f in cells.schema.fields[2:]])
    if points:
        by_source: dict[str, dict[str, float]] = {}
        for m in points:
            by_source.setdefault(m.source, {})[m.id] = m.point
        for source, wanted in by_source.items():
            tail = percentiles(keyed, ["axis", "label"], slot[source], wanted).drop("value_count")
            cells = cells.join(tail, ["axis", "label"], "left")

    rows = []
    for m in plain + points:
        n, total = F.col(f"n_{slot[m.source]}"), F.col(f"t_{slot[m.source]}")
        value = {"sum": F.when(n > 0, total), "percentile": F.col(m.id) if m in points else None}.get(
            m.kind, ratio(total, n)
        )
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        if m.interval == "wilson" and axes is None:
            low, high = wilson(total, n)
        rows.append(
            F.struct(
                F.lit(m.id).alias("metric_id"), n.alias("n"), F.col("count").alias("total"),
                value.cast("double").alias("value"), low.alias("low"), high.alias("high"),
            )
        )
    large_enough = F.lit(True)
    for axis, minimum in minimums.items():
        large_enough = large_enough & ((F.col("axis") != axis) | (F.col("count") >= minimum))
    count_only = F.array(
        F.struct(
            F.lit(None).cast("string").alias("metric_id"), F.lit(None).cast("bigint").alias("n"),
            F.col("count").alias("total"), *[F.lit(None).cast("double").alias(c) for c in ("value", "low", "high")],
        )
    )
    body = F.when(large_enough, F.array(*rows)).otherwise(count_only)
    return cells.select("axis", "label", "count", F.explode(body).alias("m")).select("axis", "label", "count", "m.*")


def _label(axis) -> Column:
    value = F.col(axis.field).cast("string")
    if axis.labels:
        return F.when(value.isin(*axis.labels), value)
    return F.when(value.isNull() | value.isin("", "0", "0.0", "false"), F.lit("unknown")).otherwise(value)


def _keep_fixed_labels(cells: DataFrame, specs, counts: list[str]) -> DataFrame:
    fixed = [(s.id, label) for s in specs for label in s.labels]
    if not fixed:
        return cells
    wanted = cells.sparkSession.createDataFrame(fixed, "axis string, label string")
    full = cells.join(wanted, ["axis", "label"], "full_outer")
    zero = [c for c in counts if c == "count" or c.startswith("n_")]
    return full.fillna(0, subset=zero)


def bootstrap_interval(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    unit: Sequence[str],
    resamples: int = 1000,
    confidence: float = 0.95,
    seed: int = 42,
) -> DataFrame:
    """Percentile-bootstrap bounds of the mean per key.

    Each row gets a Poisson(1) weight per resample, derived from a hash of its
    unit id.  Every task turns its Arrow batches into sums per (key, resample);
    only those sums are exchanged.  A single value gives (value, value).
    """
    first, second = draw_pair(F.concat_ws("|", *[F.col(c).cast("string") for c in unit]), seed)
    named = df if keys else df.withColumn("_all", F.lit(0))
    keys_ = list(keys) or ["_all"]
    rows = named.where(F.col(value).isNotNull()).select(
        *keys_, F.col(value).cast("double").alias("_v"), first.alias("_h1"), second.alias("_h2"))
    schema = StructType([*[rows.schema[k] for k in keys_], *[StructField(n, t) for n, t in (
        ("_b", IntegerType()), ("_s", DoubleType()), ("_n", LongType()), ("_rows", LongType()), ("_only", DoubleType()))]])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Resample sums of each batch: one row per (key, resample)."""
        for batch in batches:
            for key, part in batch.groupby(keys_, dropna=False, sort=False):
                v, sums, weights = part["_v"].to_numpy(), np.zeros(resamples), np.zeros(resamples, dtype=np.int64)
                for at in range(0, len(part), DRAW_ROWS):
                    w = _poisson(part["_h1"].to_numpy()[at:at + DRAW_ROWS], part["_h2"].to_numpy()[at:at + DRAW_ROWS], resamples)
                    sums += v[at:at + DRAW_ROWS] @ w
                    weights += w.sum(axis=0)
                out = pd.DataFrame({"_b": np.arange(resamples), "_s": sums, "_n": weights, "_rows": len(part), "_only": v.max()})
                for name, item in zip(keys_, key if isinstance(key, tuple) else (key,), strict=True):
                    out.insert(0, name, item)
                yield out[[f.name for f in schema.fields]]

    drawn = rows.mapInPandas(partial, schema)
    means = drawn.groupBy(*keys_, "_b").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"), F.max("_only").alias("_only"),
    ).select(
        *keys_,
        F.when(F.col("_rows") == 1, F.col("_only")).otherwise(F.col("_s") / F.nullif("_n", F.lit(0))).alias("_mean"),
    )
    tail = (1 - confidence) / 2 * 100
    bounds = percentiles(means, keys_, "_mean", {"low": tail, "high": 100 - tail})
    return bounds.select(*keys, "low", "high")


# Cumulative Poisson(1) probabilities; a prime below 2^28 for the draws.
POISSON = (0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589)
PRIME = 268435399
DRAW_ROWS = 2048  # rows whose weights are drawn at once


def _poisson(first: np.ndarray, second: np.ndarray, resamples: int) -> np.ndarray:
    """Poisson(1) weights of each row in each resample, from its two hash draws."""
    drawn = (first[:, None].astype(np.int64) + np.arange(resamples) * second[:, None].astype(np.int64)) % PRIME
    return np.searchsorted(np.asarray(POISSON), drawn / float(PRIME), side="left")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Label counts and shares of the non-NULL labels."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).count()
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("n", total).select("label", "count", (F.col("count") / F.col("n")).alias("pct"), "n")


def error_distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of each root cause over failed samples; ids: ``error_samples``."""
    failed = df.where(F.col("ex") == 0)
    by_root = failed.groupBy(*keys, "error_root").agg(F.count(F.lit(1)).alias("count"))
    # At most one row per (key, label) is left, so the totals are a window over the summary.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counted = by_root.withColumn("failed", F.sum("count").over(group))
    named = counted.where(F.col("error_root").isNotNull() & (F.col("error_root") != ""))
    return named.withColumn("pct", F.col("count") / F.col("failed"))


def error_samples(df: DataFrame) -> DataFrame:
    """Failed samples with their root cause, one row each."""
    return df.where((F.col("ex") == 0) & F.col("error_root").isNotNull() & (F.col("error_root") != "")).select(
        "error_root", "instance_id"
    )


def component_means(df: DataFrame) -> DataFrame:
    """Mean component F1, one row per component."""
    folds = [F.avg(f"cf1.cf1_{c}").alias(f"cf1_{c}") for c in COMPONENTS]
    wide = df.agg(*folds)
    return wide.unpivot([], [f"cf1_{c}" for c in COMPONENTS], "component", "avg")


def feature_delta_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each feature delta."""
    cells = [F.struct(F.lit(f"delta_{f}").alias("feature"), F.col(f"fd.delta_{f}").alias("v")) for f in features]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("v").isNotNull())
    return long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def by_slice_cell(df: DataFrame, axis) -> DataFrame:
    """Count, EX, EM and join/where F1 per label of one axis."""
    cells = df.withColumn("label", _label(axis)).where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("count"), F.avg("ex").alias("ex"), F.avg("em").alias("em"),
        F.avg(numeric_path(df, "cf1.cf1_join")).alias("cf1_join"),
        F.avg(numeric_path(df, "cf1.cf1_where")).alias("cf1_where"),
    )
    if not axis.labels:
        return cells
    wanted = df.sparkSession.createDataFrame([(x,) for x in axis.labels], "label string")
    return wanted.join(cells, "label", "left").fillna(0, subset=["count"])


def component_by_hardness(df: DataFrame) -> DataFrame:
    """Mean component F1 per hardness: one row per component, one column per label."""
    cells = [F.struct(F.lit(f"cf1_{c}").alias("component"), F.col(f"cf1.cf1_{c}").alias("v")) for c in COMPONENTS]
    long = df.select("hardness", F.explode(F.array(*cells)).alias("c")).select("hardness", "c.*")
    return long.groupBy("component").pivot("hardness", list(HARDNESS)).agg(F.avg("v"))


def latency_summary(df: DataFrame, keys: Sequence[str] = (), value: str = "act_elapsed_s") -> DataFrame:
    """Count, mean, median and 95th percentile of elapsed seconds."""
    keys_ = list(keys) or ["_all"]
    named = df if keys else df.withColumn("_all", F.lit(0))
    base = named.groupBy(*keys_).agg(F.count(value).alias("sample_count"), F.avg(value).alias("avg_s"))
    tail = percentiles(named, keys_, value, LATENCY_POINTS).drop("value_count")
    return base.join(tail, keys_, "left").select(*keys, "sample_count", "avg_s", "p50_s", "p95_s")


def linking_recall_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("sl_recall").alias("avg"), F.count("sl_recall").alias("valid"), F.count(F.lit(1)).alias("total")
    )


def stage_metric_summary(df: DataFrame) -> DataFrame:
    """avg / valid / total per (stage, metric) from rows ``(stage_id, task_type, metric, value)``."""
    return df.groupBy("stage_id", "task_type", "metric").agg(
        F.avg("value").alias("avg"), F.count("value").alias("valid"), F.count(F.lit(1)).alias("total")
    )


# Predicates on gold features, and their AND/OR combinations.
FEATURE_SLICES = {
    "join>0": "join > 0",
    "subquery>0": "subquery > 0",
    "set_operation>0": "set_operation > 0",
    "aggregation>0": "aggregation > 0",
    "group_by>0": "group_by > 0",
    "order_by>0": "order_by > 0",
    "predicate>2": "predicate > 2",
    "like>0": "`like` > 0",
    "distinct>0": "`distinct` > 0",
    "window>0": "window > 0",
    "control_flow>0": "control_flow > 0",
}
SCENARIOS = {
    "join_and_group": "join > 0 AND group_by > 0",
    "nested_or_set": "subquery > 0 OR set_operation > 0",
    "complex_predicate": "predicate > 2 AND logical_connector > 0",
}


def condition_slices(df: DataFrame, conditions: dict[str, str], features: str | None = "gold_features") -> DataFrame:
    """Count and mean EX/EM/SF1/VES over the rows that satisfy each condition.

    Every condition is a conditional aggregate in the same single pass.
    """
    flat = df.select("*", f"{features}.*") if features else df
    metrics = [m for m in ("ex", "em", "sf1", "ves") if has_path(df, m)]
    hits = [
        F.struct(F.lit(name).alias("slice"), F.coalesce(F.expr(text), F.lit(False)).alias("hit"))
        for name, text in conditions.items()
    ]
    long = flat.select(F.explode(F.array(*hits)).alias("s"), *metrics).select("s.*", *metrics)
    return long.groupBy("slice").agg(
        F.count_if("hit").alias("count"), *[F.avg(F.when(F.col("hit"), F.col(m))).alias(m) for m in metrics]
    )


def condition_bottlenecks(df: DataFrame, conditions: dict[str, str], features: str | None = "gold_features") -> DataFrame:
    """Root-stage counts inside each condition slice."""
    flat = df.select("*", f"{features}.*") if features else df
    named = F.array_compact(F.array(*[F.when(F.expr(t), F.lit(n)) for n, t in conditions.items()]))
    return (
        flat.where(F.col("root_stage").isNotNull())
        .select(F.explode(named).alias("slice"), "root_stage")
        .groupBy("slice", "root_stage").count()
    )


def query_variance_groups(df: DataFrame) -> DataFrame:
    """Accuracy, stability and flips per identical gold SQL with at least two rows."""
    groups = df.where(F.trim("gold_sql") != "").groupBy(F.trim("gold_sql").alias("gold_sql")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("ex").alias("exec_acc"),
        F.coalesce(F.bool_or(F.col("ex") == 1), F.lit(False)).alias("_pass"),
        F.coalesce(F.bool_or(F.col("ex") == 0), F.lit(False)).alias("_fail"),
    )
    flip = F.col("_pass") & F.col("_fail")
    return groups.where((F.col("sample_count") >= 2) & F.col("exec_acc").isNotNull()).select(
        "gold_sql", "sample_count", "exec_acc", (~flip).alias("stable"), flip.alias("flip")
    )


def query_variance(df: DataFrame) -> DataFrame:
    return query_variance_groups(df).agg(
        F.count(F.lit(1)).alias("eligible_groups"), F.coalesce(F.sum("sample_count"), F.lit(0)).alias("sample_count"),
        F.avg("exec_acc").alias("avg_group_exec_acc"), F.avg(F.col("stable").cast("int")).alias("stable_group_rate"),
        F.avg(F.col("flip").cast("int")).alias("flip_rate"),
    )


def stage_block_summary(df: DataFrame) -> DataFrame:
    """Scaler, optimizer, selector and decomposer blocks from nested before/after deltas.

    ``net_gain`` is a sum while its siblings are means.
    """
    on = {b: F.col(f"{b}.has_{b}") for b in ("scaler", "optimizer", "selector", "decomposer")}

    def mean(block: str, field: str, name: str) -> Column:
        return F.avg(F.when(on[block], F.col(f"{block}.{field}").cast("double"))).alias(name)

    has_optimizer = F.count_if(on["optimizer"])
    gain = F.sum(F.when(on["optimizer"], F.col("optimizer.ex_after") - F.col("optimizer.ex_before")))
    return df.agg(
        F.count_if(on["scaler"]).alias("samples_with_scaler"),
        mean("scaler", "candidate_count", "avg_candidate_count"),
        mean("scaler", "candidate_diversity", "avg_candidate_diversity"),
        mean("scaler", "pass_1", "pass_1"),
        mean("scaler", "pass_k", "pass_k"),
        mean("scaler", "scaler_gain", "scaler_gain"),
        has_optimizer.alias("samples_with_optimizer"),
        F.avg(F.when(on["optimizer"], F.col("optimizer.fix_success").cast("int"))).alias("fix_success_rate"),
        F.avg(F.when(on["optimizer"], F.col("optimizer.degradation").cast("int"))).alias("degradation_rate"),
        F.when(has_optimizer > 0, F.coalesce(gain, F.lit(0))).alias("net_gain"),
        mean("optimizer", "debug_turns", "avg_debug_turns"),
        F.count_if(on["selector"]).alias("samples_with_selector"),
        mean("selector", "oracle_ex", "oracle_rate"),
        mean("selector", "selected_ex", "selection_accuracy"),
        mean("selector", "selection_gain", "selection_gain"),
        mean("selector", "selection_loss", "selection_loss"),
        F.count_if(on["decomposer"]).alias("samples_with_decomposer"),
        ratio(F.count_if(on["decomposer"]), F.count(F.lit(1))).alias("trigger_rate"),
        F.avg(F.when(on["decomposer"], F.col("ex"))).alias("trigger_accuracy"),
        F.avg("decomposer.sub_question_count").alias("avg_sub_question_count"),
    )


def parse_tag(tag: Column) -> tuple[Column, Column]:
    """``sample:<id>|<step>`` → (sample id or NULL, step)."""
    parts = F.split(tag, r"\|")
    sample = F.when(tag.startswith("sample:"), F.regexp_replace(F.element_at(parts, 1), "^sample:", ""))
    step = F.when(F.coalesce(tag, F.lit("")) == "", F.lit("unknown")).otherwise(F.element_at(parts, -1))
    return sample, step


def token_totals(tokens: DataFrame, samples: int | Column) -> DataFrame:
    count = F.lit(samples) if isinstance(samples, int) else samples
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}" if c != "total_tokens" else c)
            for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return tokens.agg(F.count(F.lit(1)).alias("total_calls"), *sums).withColumn(
        "avg_per_sample", ratio(F.col("total_tokens"), count)
    )


def token_steps(tokens: DataFrame) -> DataFrame:
    """Calls, tokens, mean and linear 95th percentile per call for each step."""
    _, step = parse_tag(F.col("tag"))
    stepped = tokens.withColumn("step", step)
    base = stepped.groupBy("step").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"))
    tail = percentiles(stepped, ["step"], "total_tokens", {"per_call_p95": 95.0}).drop("value_count")
    return base.join(tail, "step", "left").withColumn("per_call_mean", ratio(F.col("total_tokens"), F.col("calls")))


def sample_step_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens per (sample, step); the map form is ``sample_token_map``."""
    sample, _ = parse_tag(F.col("tag"))
    parts = F.split("tag", r"\|")
    step = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("unknown"))
    return (
        tokens.withColumn("instance_id", sample).withColumn("step", step)
        .where(F.col("instance_id").isNotNull())
        .groupBy("instance_id", "step").agg(F.sum("total_tokens").alias("total_tokens"))
    )


def sample_token_map(tokens: DataFrame) -> DataFrame:
    """Step → tokens map per sample; a map is as wide as the workflow has steps."""
    return sample_step_tokens(tokens).groupBy("instance_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "total_tokens")))).alias("tokens")
    )


def value_distribution(df: DataFrame, keys: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """mean, median, nearest-rank p95, min and max per key."""
    base = df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}mean"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max")
    )
    tail = percentiles(
        df, keys, value, {f"{prefix}median": 50.0, f"{prefix}p95": 95.0}, nearest=(f"{prefix}p95",)
    ).drop("value_count")
    return base.join(tail, list(keys))


def token_by_tag(tokens: DataFrame) -> DataFrame:
    named = tokens.withColumn("tag", F.coalesce("tag", F.lit("")))
    base = named.groupBy("tag").agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )
    return base.join(value_distribution(named, ["tag"], "total_tokens"), "tag")


def token_by_step_and_sample(tokens: DataFrame) -> DataFrame:
    """Distribution over samples of the tokens spent per step."""
    per_sample = sample_step_tokens(tokens)
    base = per_sample.groupBy("step").agg(F.count(F.lit(1)).alias("samples"))
    return base.join(value_distribution(per_sample, ["step"], "total_tokens", "per_sample_"), "step")


def iteration_summary(df: DataFrame) -> DataFrame:
    """Per metric: mean over iterations of the iteration mean, largest valid and total counts.

    Input rows ``(iteration, metric, instance_id, value)``.
    """
    per_iteration = df.groupBy("metric", "iteration").agg(
        F.avg("value").alias("a"), F.count("value").alias("v"), F.count(F.lit(1)).alias("t")
    )
    return per_iteration.groupBy("metric").agg(
        F.avg("a").alias("avg"), F.max("v").alias("valid_num"), F.max("t").alias("total_items"),
        F.count("a").alias("iterations"),
    ).where(F.col("avg").isNotNull())


def iteration_samples(df: DataFrame) -> DataFrame:
    """Per sample and metric: mean over iterations."""
    return df.groupBy("instance_id", "metric").agg(F.avg("value").alias("avg"))


def timing_summary(df: DataFrame, value: str = "act_elapsed_s", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("sample_count"), F.round(F.sum(value), 2).alias("total_s"),
        F.round(F.avg(value), 3).alias("mean_s"), F.round(F.max(value), 3).alias("max_s"),
        F.round(F.min(value), 3).alias("min_s"),
    ).withColumn("available", F.col("sample_count") > 0)


def top_errors(df: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent execution errors (report limit ``n``), ties by text."""
    return (
        df.where(F.col("exec_error").isNotNull() & (F.col("exec_error") != ""))
        .groupBy("exec_error").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "exec_error").limit(n)
    )


def weakness_ranking(df: DataFrame, n: int = 10) -> DataFrame:
    """Root causes by count with their share of failures."""
    return error_distribution(df).orderBy(F.desc("count"), "error_root").limit(n).select("error_root", "count", "pct")


def batch_average(df: DataFrame, column: str = "ex") -> DataFrame:
    """Average over valid samples; 0.0 with a warning when none is valid."""
    folded = df.agg(F.avg(column).alias("a"), F.count(column).alias("valid_num"), F.count(F.lit(1)).alias("total_items"))
    none = F.col("valid_num") == 0
    return folded.select(
        F.coalesce("a", F.lit(0.0)).alias("avg"), "valid_num", "total_items",
        F.when(none, F.lit("no valid results")).alias("warning"),
    )


def accuracy_by_hardness(df: DataFrame) -> DataFrame:
    """Execution accuracy with Wilson bounds for each hardness label."""
    cells = df.where(F.col("hardness").isNotNull()).groupBy("hardness").agg(
        F.count(F.lit(1)).alias("count"), F.count("ex").alias("valid"), F.sum("ex").alias("passed")
    )
    low, high = wilson(F.col("passed"), F.col("valid"))
    return cells.select(
        "hardness", "count", "valid", ratio(F.col("passed"), F.col("valid")).alias("ex"), low.alias("low"), high.alias("high")
    )

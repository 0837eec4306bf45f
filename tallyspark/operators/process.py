"""Stage traces: gates, funnels, status rules, attribution and error classes.

Stage rows: ``instance_id, stage_id, stage_no, task_type, metrics map,
signals struct, error, elapsed_s`` (and ``status`` where a rule needs it).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stats import ratio

# Canonical role of each task type, gate order, timeout markers.
ROLES = {
    "ReduceTask": "linking",
    "ParseTask": "linking",
    "GenerateTask": "generation",
    "ScaleTask": "generation",
    "OptimizeTask": "refinement",
    "SelectTask": "selection",
    "DecomposeTask": "decomposition",
}
GATES = ("parseable", "timely", "executable", "correct", "efficient")
TIMEOUT_MARKERS = ("timeout", "timed out")
ERROR_ROOTS = (
    "execution_error", "schema_linking_miss", "classification_error", "model_missing_join",
    "model_extra_join", "model_missing_predicates", "model_extra_predicates", "model_missing_group_by",
    "model_extra_group_by", "model_missing_columns", "model_extra_columns", "model_avoids_subquery",
    "model_substitutes_set_op", "model_wrong_order", "model_wrong_keywords", "generation_error",
)


def role(task_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*ROLES.items())])[task_type]


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def gate_outcome(samples: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """Ordered gates of each sample and the first one that failed."""
    message = F.lower("exec_error")
    timed_out = _is(message.contains(TIMEOUT_MARKERS[0]) | message.contains(TIMEOUT_MARKERS[1]))
    efficient = F.lit(None).cast("boolean")
    if timeout_s is not None:
        efficient = F.when(F.col("correct"), F.col("act_elapsed_s") <= timeout_s)
    gated = (
        samples.withColumn("parseable", _is(F.col("pred_sql") != ""))
        .withColumn("timely", F.col("parseable") & ~timed_out)
        .withColumn("executable", F.col("timely") & F.col("exec_error").isNull())
        .withColumn("correct", F.col("executable") & _is(F.col("ex") == 1))
        .withColumn("efficient", efficient)
    )
    failed = F.coalesce(*[F.when(~F.col(g), F.lit(g)) for g in GATES])
    return gated.withColumn("failed_at", failed)


def gate_funnel(samples: DataFrame, timeout_s: float | None = None) -> DataFrame:
    """Survival rate and failure count of every gate."""
    gated = gate_outcome(samples, timeout_s)
    cells = []
    for g in GATES:
        rate = ratio(F.count_if(F.col(g)), F.count(F.lit(1)))
        if g == "efficient" and timeout_s is None:
            rate = F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(g).alias("gate"), rate.alias("survival"), F.count_if(F.col("failed_at") == g).alias("failed"),
                F.count(F.lit(1)).alias("sample_count"),
            )
        )
    return gated.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def stage_survival_funnel(samples: DataFrame, stages: DataFrame) -> DataFrame:
    """Share of samples still solvable after linking, generation and selection, and finally correct."""
    r = role(F.col("task_type"))
    per_sample = stages.groupBy("instance_id").agg(
        F.bool_or((r == "linking") & _is(F.col("signals.fatal_schema_miss"))).alias("fatal"),
        F.max(F.when(r == "generation", F.col("signals.oracle_ex"))).alias("oracle"),
        F.bool_or((r == "selection") & _is(F.col("signals.missed_correct_candidate"))).alias("missed"),
    )
    joined = samples.select("instance_id", "ex").join(per_sample, "instance_id", "left")
    linking = ~_is(F.col("fatal"))
    generation = linking & ~_is(F.col("oracle") == 0)
    selection = generation & ~_is(F.col("missed"))
    alive = {"linking": linking, "generation": generation, "selection": selection, "final": _is(F.col("ex") == 1)}
    cells = [
        F.struct(F.lit(k).alias("stage"), ratio(F.count_if(v), F.count(F.lit(1))).alias("survival"),
                 F.count(F.lit(1)).alias("sample_count"))
        for k, v in alive.items()
    ]
    return joined.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def stage_process_metrics(stages: DataFrame) -> DataFrame:
    """Linking, generation and selection metrics read from stage rows, one record."""
    r = role(F.col("task_type"))
    linking, generation, selection = r == "linking", r == "generation", r == "selection"

    def linked(kind: str) -> Column:
        both = F.array_compact(F.array(F.col("metrics")[f"reduce_{kind}"], F.col("metrics")[f"parse_{kind}"]))
        return F.when(linking, both)

    def total(kind: str) -> Column:
        return F.sum(F.aggregate(linked(kind), F.lit(0.0), lambda a, x: a + x))

    valid = F.when(
        generation & (F.col("signals.candidate_count") > 0),
        F.col("signals.valid_sql_count") / F.col("signals.candidate_count"),
    )
    per_sample = stages.groupBy("instance_id").agg(
        F.bool_or(linking).alias("observed"), F.bool_or(linking & _is(F.col("signals.fatal_schema_miss"))).alias("fatal"),
        total("recall").alias("recall_t"), F.sum(F.size(linked("recall"))).alias("recall_n"),
        total("precision").alias("precision_t"), F.sum(F.size(linked("precision"))).alias("precision_n"),
        F.sum(F.when(generation, F.col("signals.first_ex"))).alias("first_t"),
        F.count(F.when(generation, F.col("signals.first_ex"))).alias("first_n"),
        F.sum(F.when(generation, F.col("signals.oracle_ex"))).alias("oracle_t"),
        F.count(F.when(generation, F.col("signals.oracle_ex"))).alias("oracle_n"),
        F.sum(valid).alias("valid_t"), F.count(valid).alias("valid_n"),
        F.count_if(selection & _is(F.col("signals.missed_correct_candidate"))).alias("missed_t"),
        F.count(F.when(selection, F.col("signals.missed_correct_candidate"))).alias("missed_n"),
    )

    def mean(name: str) -> Column:
        return ratio(F.sum(f"{name}_t"), F.sum(f"{name}_n"))

    return per_sample.agg(
        mean("recall").alias("linking_recall"), mean("precision").alias("linking_precision"),
        ratio(F.count_if("fatal"), F.count_if("observed")).alias("linking_fatal_miss_rate"),
        mean("first").alias("stage_pass1"), mean("oracle").alias("stage_oracle_k"),
        mean("valid").alias("generation_exec_validity"), mean("missed").alias("selection_missed_correct_rate"),
    )


def process_summary(blocks: DataFrame, stages: DataFrame) -> DataFrame:
    """The sixteen process metrics, long form.

    ``blocks`` is the one-row result of ``stage_block_summary``; generation
    rates fall back to stage signals only when both block rates are missing.
    """
    from_stages = stage_process_metrics(stages)
    names = from_stages.columns
    both = blocks.withColumn("_s", from_stages.select(F.struct(*names)).scalar()).select("*", "_s.*")
    fall_back = F.col("pass_1").isNull() & F.col("pass_k").isNull()
    values = {
        "linking_recall": F.col("linking_recall"),
        "linking_precision": F.col("linking_precision"),
        "linking_fatal_miss_rate": F.col("linking_fatal_miss_rate"),
        "generation_pass1": F.when(fall_back, F.col("stage_pass1")).otherwise(F.col("pass_1")),
        "generation_oracle_k": F.when(fall_back, F.col("stage_oracle_k")).otherwise(F.col("pass_k")),
        "generation_exec_validity": F.col("generation_exec_validity"),
        "generation_candidate_diversity": F.col("avg_candidate_diversity"),
        "refinement_fix_rate": F.col("fix_success_rate"),
        "refinement_degradation_rate": F.col("degradation_rate"),
        "refinement_net_gain": F.col("net_gain"),
        "refinement_debug_turns": F.col("avg_debug_turns"),
        "selection_accuracy": F.col("selection_accuracy"),
        "selection_regret": F.col("selection_loss"),
        "selection_missed_correct_rate": F.col("selection_missed_correct_rate"),
        "decomposition_trigger_rate": F.col("trigger_rate"),
        "decomposition_trigger_accuracy": F.col("trigger_accuracy"),
    }
    cells = [F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]
    return both.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def stage_status(stages: DataFrame, finals: DataFrame) -> DataFrame:
    """``pass`` / ``fail`` / ``observed`` per stage row, by task type."""
    joined = stages.join(finals.select("instance_id", F.col("ex").alias("final_ex")), "instance_id", "left")
    recall = F.when(F.col("task_type") == "ReduceTask", F.col("metrics")["reduce_recall"]).otherwise(
        F.col("metrics")["parse_recall"]
    )
    by_recall = F.when(recall >= 1, "pass").when(recall < 1, "fail").otherwise("observed")
    exact = F.col("signals.exact_links")
    parse = F.when(exact, "pass").when(~exact, "fail").otherwise(by_recall)
    sql = F.when(F.col("signals.oracle_ex") == 1, "pass").when(
        (F.col("signals.oracle_ex") == 0) | (F.col("final_ex") == 0), "fail"
    ).otherwise("observed")
    chosen = F.col("signals.selected_ex")
    select = F.when(F.col("signals.missed_correct_candidate"), "fail").when(
        (chosen == 1) | (F.col("final_ex") == 1), "pass"
    ).when(chosen == 0, "fail").otherwise("observed")
    task = F.col("task_type")
    rule = (
        F.when(_is(F.col("error") != ""), "fail").when(task == "ReduceTask", by_recall).when(task == "ParseTask", parse)
        .when(task.isin("GenerateTask", "ScaleTask", "OptimizeTask"), sql).when(task == "SelectTask", select)
        .otherwise("observed")
    )
    return joined.withColumn("status", rule).drop("final_ex")


def runtime_signals(traces: DataFrame) -> DataFrame:
    """Calls, elapsed seconds, error count and touched keys per (instance, stage).

    Touched keys are a set over a fixed row schema, so its size is bounded.
    """
    return traces.groupBy("instance_id", "stage_id").agg(
        F.count(F.lit(1)).alias("call_count"), F.sum("elapsed_s").alias("elapsed_s"),
        F.count_if(F.col("error") != "").alias("error_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("touched_keys")))).alias("row_delta_keys"),
    )


def attribute_stage(stages: DataFrame, finals: DataFrame) -> DataFrame:
    """First failing stage in workflow order, with its reason."""
    task, signals = F.col("task_type"), F.col("signals")
    reason = (
        F.when(task.isin("ReduceTask", "ParseTask") & signals["fatal_schema_miss"], "schema_recall_miss")
        .when((task == "GenerateTask") & (signals["oracle_ex"] == 0), "no_correct_generated_candidate")
        .when((task == "SelectTask") & signals["missed_correct_candidate"], "selector_missed_correct_candidate")
        .when((F.col("status") == "fail") & (F.col("error") != ""), "stage_runtime_error")
    )
    first = (
        stages.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("instance_id")
        .agg(F.min(F.struct("stage_no", "stage_id", "reason")).alias("hit"))
    )
    won = _is(F.col("ex") == 1)
    rest = F.coalesce(F.nullif("error_root", F.lit("")), F.nullif("exec_error", F.lit("")), F.lit("unattributed"))
    return finals.join(first, "instance_id", "left").select(
        "instance_id",
        F.when(won, "success").otherwise(F.coalesce("hit.stage_id", F.lit("unknown"))).alias("root_stage"),
        F.when(won, "final_ex_pass").otherwise(F.coalesce(F.col("hit.reason"), rest)).alias("reason"),
    )


def bottlenecks(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("root_stage").agg(F.count(F.lit(1)).alias("count"))


def stage_status_counts(stages: DataFrame, finals: DataFrame) -> DataFrame:
    """Status counts per stage; samples without the stage count as ``unknown``."""
    counts = stages.groupBy("stage_id", F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = finals.agg(F.count(F.lit(1))).scalar()
    absent = (
        counts.groupBy("stage_id").agg(F.sum("count").alias("seen")).withColumn("total", total)
        .where(F.col("seen") < F.col("total"))
        .select("stage_id", F.lit("unknown").alias("status"), (F.col("total") - F.col("seen")).alias("count"))
    )
    return counts.unionByName(absent).groupBy("stage_id", "status").agg(F.sum("count").alias("count"))


def stage_signal_means(stages: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Means of numeric metrics and signals per stage, long form."""
    metric = stages.select("stage_id", F.explode("metrics").alias("name", "value"))
    cells = [F.struct(F.lit(s).alias("name"), F.col(f"signals.{s}").cast("double").alias("value")) for s in signals]
    signal = stages.select("stage_id", F.explode(F.array(*cells)).alias("c")).select("stage_id", "c.*")
    return (
        metric.withColumn("kind", F.lit("metric")).unionByName(signal.withColumn("kind", F.lit("signal")))
        .where(F.col("value").isNotNull()).groupBy("stage_id", "kind", "name").agg(F.avg("value").alias("mean"))
    )


def exec_error_class(message: Column) -> Column:
    """Class of an execution error; the first matching rule wins."""
    m = F.lower(message)
    return (
        F.when(m.contains("syntax"), "syntax_error").when(m.contains("column"), "column_not_found")
        .when(m.contains("table"), "table_not_found").when(m.contains("ambiguous"), "ambiguous_column")
        .when(m.contains("timeout") | m.contains("timed out"), "timeout").otherwise("other_exec_error")
    )


def classify_error(samples: DataFrame) -> DataFrame:
    """Root cause and detail of failed samples (``ex = 0``), NULL elsewhere.

    Reads ``exec_error, cf1, fd, sl_recall`` and, when present,
    ``gold_features, pred_features, pred_classification, gold_classification``.
    """
    have = set(samples.columns)
    failed_run = _is(F.col("exec_error") != "")

    def f1(component: str) -> Column:
        return F.when(F.col("cf1").isNotNull(), F.coalesce(F.col(f"cf1.cf1_{component}"), F.lit(1.0)))

    def below(component: str) -> Column:
        return f1(component) < 1.0

    def delta(feature: str) -> Column:
        return F.coalesce(F.col(f"fd.delta_{feature}"), F.lit(0))

    def feature(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}_features.{name}"), F.lit(0)) if f"{side}_features" in have else F.lit(0)

    def extra_or_missing(name: str, what: str) -> Column:
        return F.when(delta(name) > 0, f"model_extra_{what}").otherwise(f"model_missing_{what}")

    group = F.when(feature("gold", "group_by") > 0, "model_missing_group_by").otherwise("model_extra_group_by")
    nested = (
        F.when((feature("gold", "subquery") > 0) & (feature("pred", "subquery") == 0), "model_avoids_subquery")
        .when(feature("gold", "set_operation") > 0, "model_substitutes_set_op").otherwise("model_avoids_subquery")
    )
    classes = {"pred_classification", "gold_classification"} <= have
    other_class = _is(F.col("pred_classification") != F.col("gold_classification")) if classes else F.lit(False)
    component_rules = [
        ("join", extra_or_missing("join", "join")),
        ("select", extra_or_missing("query_fields", "columns")),
        ("where", extra_or_missing("predicate", "predicates")),
        ("group", group),
        ("order", F.lit("model_wrong_order")),
        ("iuen", nested),
        ("keywords", F.lit("model_wrong_keywords")),
    ]
    root = F.when(failed_run, "execution_error")
    sub = F.when(failed_run, exec_error_class(F.col("exec_error")))
    for component, label in component_rules:
        root = root.when(below(component), label)
        sub = sub.when(below(component), F.format_string(f"cf1_{component}=%.2f", F.bround(f1(component), 2)))
    low_recall = F.col("sl_recall") < 0.5
    root = root.when(low_recall, "schema_linking_miss").when(other_class, "classification_error").otherwise("generation_error")
    sub = sub.when(low_recall, F.format_string("sl_recall=%.2f", F.bround("sl_recall", 2)))
    if classes:
        sub = sub.when(other_class, F.concat_ws(" vs ", "pred_classification", "gold_classification"))
    sub = sub.otherwise("unknown")
    lost = F.col("ex") == 0
    return samples.withColumn("error_root", F.when(lost, root)).withColumn("error_sub", F.when(lost, sub))

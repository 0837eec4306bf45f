"""Aggregation, matrix, process and search-statistics queries over the eval and stage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.metrics import COMPONENTS, default_registry
from tallyspark.operators import aggregate as A
from tallyspark.operators import evolve as V
from tallyspark.operators import matrix as M
from tallyspark.operators import process as P
from tallyspark.plans.registry import query

ORDER = ("ts", "event_id")


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round every double, so both engines agree on the last digits."""
    return df.select(
        *[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" and f.name not in skip else F.col(f.name)
          for f in df.schema.fields]
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Scored samples with nested component F1 and feature deltas."""
    flat = view(spark, sf, "scored")
    cf1 = F.when(F.col("cf1_join").isNotNull(), F.struct(*[f"cf1_{c}" for c in COMPONENTS]))
    fd = F.struct("delta_join", "delta_query_fields", "delta_predicate")
    gold = F.struct(
        F.col("f_join").alias("join"), F.col("f_group_by").alias("group_by"), F.col("f_predicate").alias("predicate"),
        F.col("f_logical").alias("logical_connector"), F.col("f_subquery").alias("subquery"), F.col("f_set").alias("set_operation"),
    )
    return flat.withColumn("cf1", cf1).withColumn("fd", fd).withColumn("gold_features", gold)


def stage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Stage rows with a metric map and a signal struct."""
    flat = view(spark, sf, "stage_rows")
    reduce = F.when(F.col("task_type") == "ReduceTask", F.create_map(
        F.lit("reduce_recall"), "recall", F.lit("reduce_precision"), "link_precision"))
    parse = F.when(F.col("task_type") == "ParseTask", F.create_map(
        F.lit("parse_recall"), "recall", F.lit("parse_precision"), "link_precision"))
    signals = F.struct(
        F.coalesce(F.col("recall") < 1, F.lit(False)).alias("fatal_schema_miss"), "exact_links", "oracle_ex", "first_ex",
        "candidate_count", "valid_sql_count", F.col("missed_correct").alias("missed_correct_candidate"), "selected_ex",
    )
    return flat.select(
        "instance_id", "stage_id", "stage_no", "task_type", "part_no", "supp_no", "error", "elapsed_s", "link_precision",
        F.coalesce(reduce, parse, F.create_map().cast("map<string,double>")).alias("metrics"), signals.alias("signals"),
    )


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    return M.matrix_from_log(view(spark, sf, "eval_log"), ORDER)


# --- flagship and L1/L2 folds ------------------------------------------------

LATEST = """
ec AS (SELECT method, instance_id, arg_max(ex, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS ex FROM eval_log WHERE ex IS NOT NULL GROUP BY ALL),
el AS (SELECT method, instance_id, arg_max(act_elapsed_s, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS t FROM eval_log WHERE act_elapsed_s IS NOT NULL GROUP BY ALL),
nm AS (SELECT count(DISTINCT method) AS n FROM ec),
cq AS (SELECT instance_id FROM ec GROUP BY instance_id HAVING count(*) = (SELECT n FROM nm)),
mx AS (SELECT ec.method, ec.instance_id, CASE WHEN ec.ex <> 0 THEN 1 ELSE 0 END AS c, el.t FROM ec JOIN cq USING (instance_id) LEFT JOIN el USING (method, instance_id))"""


def with_latest(body: str) -> str:
    return f"WITH {LATEST.strip()}, {body.strip()[5:]}" if body.strip()[:5].upper() == "WITH " else f"WITH {LATEST.strip()}\n{body}"


GAP = """
WITH acc AS (SELECT method, avg(c) AS ex FROM mx GROUP BY method),
best AS (SELECT method, ex FROM acc ORDER BY ex DESC, method LIMIT 1),
dyn AS (SELECT avg(m) AS d, count(*) AS n FROM (SELECT max(c) AS m FROM mx GROUP BY instance_id))
SELECT round(best.ex, 6) AS ex_static, round(d, 6) AS ex_dynamic, round(d - best.ex, 6) AS gap, best.method AS best_static_method, n AS query_count
FROM best, dyn"""


@query("oracle_gap", with_latest(GAP), ("eval_log",))
def oracle_gap(spark, sf):
    return rounded(M.oracle_gap_of_log(view(spark, sf, "eval_log"), ORDER))


@query("oracle_gap_matrix", with_latest(GAP), ("eval_log",))
def oracle_gap_matrix(spark, sf):
    return rounded(M.oracle_gap(matrix(spark, sf)))


@query("accuracy_by_hardness", """
SELECT hardness, count(*) AS count, count(ex) AS valid, round(avg(ex), 6) AS ex,
  round(greatest(0, (p + z*z/(2*n) - z*sqrt(n*p*(1-p)/n + z*z/4) / sqrt(n)) / (1 + z*z/n)), 6) AS low,
  round(least(1, (p + z*z/(2*n) + z*sqrt(n*p*(1-p)/n + z*z/4) / sqrt(n)) / (1 + z*z/n)), 6) AS high
FROM (SELECT hardness, ex, avg(ex) OVER w AS p, CAST(count(ex) OVER w AS DOUBLE) AS n, 1.959963984540054::DOUBLE AS z
      FROM eval_log WHERE hardness IS NOT NULL WINDOW w AS (PARTITION BY hardness))
GROUP BY hardness, p, n, z""".replace("z*sqrt(n*p*(1-p)/n + z*z/4) / sqrt(n)", "z*sqrt(p*(1-p)/n + z*z/(4*n*n))"), ("eval_log",))
def accuracy_by_hardness(spark, sf):
    return rounded(A.accuracy_by_hardness(view(spark, sf, "eval_log")))


@query("aggregate_metrics", """
WITH base AS (SELECT * FROM scored),
cells AS (
 SELECT 'ex' AS metric_id, count(ex) AS n, count(*) AS total, avg(ex) AS value, TRUE AS w FROM base
 UNION ALL SELECT 'em', count(em), count(*), avg(em), TRUE FROM base
 UNION ALL SELECT 'sf1', count(sf1), count(*), avg(sf1), FALSE FROM base
 UNION ALL SELECT 'ves', count(ves), count(*), avg(ves), FALSE FROM base
 UNION ALL SELECT 'latency_avg', count(act_elapsed_s), count(*), avg(act_elapsed_s), FALSE FROM base
 UNION ALL SELECT 'latency_p50', count(act_elapsed_s), count(*), quantile_cont(act_elapsed_s, 0.5), FALSE FROM base
 UNION ALL SELECT 'latency_p95', count(act_elapsed_s), count(*), quantile_cont(act_elapsed_s, 0.95), FALSE FROM base
 UNION ALL SELECT 'sl_recall', count(sl_recall), count(*), avg(sl_recall), FALSE FROM base
""" + "".join(f" UNION ALL SELECT 'cf1_{c}', count(cf1_{c}), count(*), avg(cf1_{c}), FALSE FROM base\n" for c in COMPONENTS) + """)
SELECT metric_id, n, total, round(value, 6) AS value,
  CASE WHEN w THEN round(greatest(0, (value + z*z/(2*n) - z*sqrt(value*(1-value)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) END AS low,
  CASE WHEN w THEN round(least(1, (value + z*z/(2*n) + z*sqrt(value*(1-value)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) END AS high
FROM cells, (SELECT 1.959963984540054::DOUBLE AS z)""", ("scored",))
def aggregate_metrics(spark, sf):
    return rounded(A.aggregate_metrics(scored(spark, sf), default_registry()))


_SLICED = "".join(
    f" UNION ALL SELECT axis, label, count(label) AS count, '{m}', count({c}), count(label), {f} FROM lab GROUP BY axis, label\n"
    for m, c, f in (
        [("em", "em", "avg(em)"), ("sf1", "sf1", "avg(sf1)"), ("ves", "ves", "avg(ves)"),
         ("latency_avg", "act_elapsed_s", "avg(act_elapsed_s)"),
         ("latency_p50", "act_elapsed_s", "quantile_cont(act_elapsed_s, 0.5)"),
         ("latency_p95", "act_elapsed_s", "quantile_cont(act_elapsed_s, 0.95)"), ("sl_recall", "sl_recall", "avg(sl_recall)")]
        + [(f"cf1_{c}", f"cf1_{c}", f"avg(cf1_{c})") for c in COMPONENTS]
    )
)


@query("slice_metrics", f"""
WITH lab AS (SELECT 'hardness' AS axis, hardness AS label, * FROM scored WHERE hardness IS NOT NULL
             UNION ALL SELECT 'db_type', coalesce(db_type, 'unknown'), * FROM scored),
cells AS (SELECT axis, label, count(label) AS count, 'ex' AS metric_id, count(ex) AS n, count(label) AS total, avg(ex) AS value FROM lab GROUP BY axis, label
{_SLICED})
SELECT axis, label, count, metric_id, n, total, round(value, 6) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM cells""", ("scored",))
def slice_metrics(spark, sf):
    return rounded(A.slice_metrics(scored(spark, sf), default_registry()))


@query("wilson_by_method", """
SELECT method, passed, n, round(greatest(0, (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low,
  round(least(1, (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high
FROM (SELECT method, CAST(sum(ex) AS BIGINT) AS passed, count(ex) AS n, avg(ex) AS p, 1.959963984540054::DOUBLE AS z FROM eval_log GROUP BY method)""",
       ("eval_log",))
def wilson_by_method(spark, sf):
    from tallyspark.functions.stats import wilson

    cells = view(spark, sf, "eval_log").groupBy("method").agg(F.sum("ex").cast("bigint").alias("passed"), F.count("ex").alias("n"))
    low, high = wilson(F.col("passed"), F.col("n"))
    return rounded(cells.select("method", "passed", "n", low.alias("low"), high.alias("high")))


@query("bootstrap_interval", """
WITH d AS (SELECT method, sf1 AS v, md5(concat(CAST(event_id AS VARCHAR), '#42')) AS h FROM scored WHERE sf1 IS NOT NULL),
k AS (SELECT method, v, ('0x' || substr(h, 1, 7))::BIGINT AS h1, ('0x' || substr(h, 8, 7))::BIGINT AS h2 FROM d),
u AS (SELECT method, v, b, ((h1 + b * h2) % 268435399) / 268435399.0::DOUBLE AS x FROM k, range(0, 1000) r(b)),
w AS (SELECT method, v, b, (x > 0.3678794412)::INT + (x > 0.7357588823)::INT + (x > 0.9196986029)::INT + (x > 0.9810118431)::INT
      + (x > 0.9963401532)::INT + (x > 0.9994058152)::INT + (x > 0.9999167589)::INT AS wt FROM u),
m AS (SELECT method, b, sum(wt * v) / nullif(sum(wt), 0) AS mean FROM w GROUP BY method, b)
SELECT method, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m GROUP BY method""", ("scored",))
def bootstrap_interval(spark, sf):
    return rounded(A.bootstrap_interval(view(spark, sf, "scored"), ["method"], "sf1", ["event_id"]))


@query("percentile_linear", """
SELECT method, count(act_elapsed_s) AS value_count, round(quantile_cont(act_elapsed_s, 0.5), 6) AS p50,
  round(quantile_cont(act_elapsed_s, 0.95), 6) AS p95 FROM eval_log GROUP BY method""", ("eval_log",))
def percentile_linear(spark, sf):
    from tallyspark.functions.ordered import percentiles

    return rounded(percentiles(view(spark, sf, "eval_log"), ["method"], "act_elapsed_s", {"p50": 50.0, "p95": 95.0}))


@query("percentile_nearest_rank", """
SELECT task_type, count(*) AS value_count, CAST(quantile_disc(total_tokens, 0.95) AS DOUBLE) AS p95 FROM stage_log GROUP BY task_type""", ("stage_log",))
def percentile_nearest_rank(spark, sf):
    from tallyspark.functions.ordered import percentiles

    return percentiles(view(spark, sf, "stage_log"), ["task_type"], "total_tokens", {"p95": 95.0}, nearest=("p95",))


@query("hardness_distribution", """
SELECT hardness AS label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS pct, CAST(sum(count(*)) OVER () AS BIGINT) AS n
FROM eval_log WHERE hardness IS NOT NULL GROUP BY hardness""", ("eval_log",))
def hardness_distribution(spark, sf):
    return rounded(A.distribution(view(spark, sf, "eval_log"), "hardness"))


ROOT_CASE = """
CASE WHEN ex = 0 THEN CASE WHEN exec_error IS NOT NULL THEN 'execution_error'
  WHEN cf1_join < 1 THEN CASE WHEN delta_join > 0 THEN 'model_extra_join' ELSE 'model_missing_join' END
  WHEN cf1_select < 1 THEN CASE WHEN delta_query_fields > 0 THEN 'model_extra_columns' ELSE 'model_missing_columns' END
  WHEN cf1_where < 1 THEN CASE WHEN delta_predicate > 0 THEN 'model_extra_predicates' ELSE 'model_missing_predicates' END
  WHEN cf1_group < 1 THEN CASE WHEN f_group_by > 0 THEN 'model_missing_group_by' ELSE 'model_extra_group_by' END
  WHEN cf1_order < 1 THEN 'model_wrong_order'
  WHEN cf1_iuen < 1 THEN CASE WHEN f_subquery > 0 THEN 'model_avoids_subquery' WHEN f_set > 0 THEN 'model_substitutes_set_op' ELSE 'model_avoids_subquery' END
  WHEN cf1_keywords < 1 THEN 'model_wrong_keywords' WHEN sl_recall < 0.5 THEN 'schema_linking_miss' ELSE 'generation_error' END END"""
SUB_CASE = """
CASE WHEN ex = 0 THEN CASE WHEN exec_error LIKE '%syntax%' THEN 'syntax_error' WHEN exec_error LIKE '%column%' THEN 'column_not_found'
  WHEN exec_error LIKE '%timed out%' THEN 'timeout'
""" + "".join(f"  WHEN cf1_{c} < 1 THEN printf('cf1_{c}=%.2f', cf1_{c})\n" for c in ("join", "select", "where", "group", "order", "iuen", "keywords")) + """
  WHEN sl_recall < 0.5 THEN printf('sl_recall=%.2f', sl_recall) ELSE 'unknown' END END"""


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return P.classify_error(scored(spark, sf))


@query("classify_error", f"SELECT event_id, {ROOT_CASE} AS error_root, {SUB_CASE} AS error_sub FROM scored", ("scored",))
def classify_error(spark, sf):
    return classified(spark, sf).select("event_id", "error_root", "error_sub")


@query("error_distribution", f"""
SELECT error_root, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS pct
FROM (SELECT {ROOT_CASE} AS error_root FROM scored WHERE ex = 0) GROUP BY error_root""", ("scored",))
def error_distribution(spark, sf):
    return rounded(A.error_distribution(classified(spark, sf)).select("error_root", "count", "pct"))


@query("error_samples", f"SELECT * FROM (SELECT {ROOT_CASE} AS error_root, instance_id FROM scored WHERE ex = 0) WHERE error_root IS NOT NULL", ("scored",))
def error_samples(spark, sf):
    return A.error_samples(classified(spark, sf))


@query("exec_error_class", """
SELECT exec_error, CASE WHEN lower(exec_error) LIKE '%syntax%' THEN 'syntax_error' WHEN lower(exec_error) LIKE '%column%' THEN 'column_not_found'
  WHEN lower(exec_error) LIKE '%timed out%' THEN 'timeout' ELSE 'other_exec_error' END AS class, count(*) AS count
FROM eval_log WHERE exec_error IS NOT NULL GROUP BY exec_error""", ("eval_log",))
def exec_error_class(spark, sf):
    rows = view(spark, sf, "eval_log").where(F.col("exec_error").isNotNull())
    return rows.groupBy("exec_error").count().withColumn("class", P.exec_error_class(F.col("exec_error")))


@query("component_means", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'cf1_{c}' AS component, round(avg(cf1_{c}), 6) AS avg FROM scored" for c in COMPONENTS) + ")", ("scored",))
def component_means(spark, sf):
    return rounded(A.component_means(scored(spark, sf)))


@query("feature_delta_stats", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'delta_{f}' AS feature, round(avg(delta_{f}), 6) AS mean, round(stddev_pop(delta_{f}), 6) AS std FROM scored"
    for f in ("join", "query_fields", "predicate")) + ")", ("scored",))
def feature_delta_stats(spark, sf):
    return rounded(A.feature_delta_stats(scored(spark, sf), ("join", "query_fields", "predicate")))


_CELL = "count(*) AS count, round(avg(ex), 6) AS ex, round(avg(em), 6) AS em, round(avg(cf1_join), 6) AS cf1_join, round(avg(cf1_where), 6) AS cf1_where"


@query("by_hardness", f"SELECT hardness AS label, {_CELL} FROM scored WHERE hardness IS NOT NULL GROUP BY hardness", ("scored",))
def by_hardness(spark, sf):
    return rounded(A.by_slice_cell(scored(spark, sf), default_registry().slices()[0]))


@query("by_db_type", f"SELECT coalesce(db_type, 'unknown') AS label, {_CELL} FROM scored GROUP BY 1", ("scored",))
def by_db_type(spark, sf):
    return rounded(A.by_slice_cell(scored(spark, sf), default_registry().slices()[1]))


@query("errors_by_hardness", f"""
SELECT hardness, error_root, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY hardness) AS BIGINT) AS failed,
  round(count(*) / sum(count(*)) OVER (PARTITION BY hardness), 6) AS pct
FROM (SELECT hardness, {ROOT_CASE} AS error_root FROM scored WHERE ex = 0 AND hardness IS NOT NULL) GROUP BY hardness, error_root""", ("scored",))
def errors_by_hardness(spark, sf):
    return rounded(A.error_distribution(classified(spark, sf).where(F.col("hardness").isNotNull()), ["hardness"]))


@query("component_by_hardness", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT 'cf1_{c}' AS component, " + ", ".join(
        f"round(avg(cf1_{c}) FILTER (WHERE hardness = '{h}'), 6) AS {h}" for h in ("easy", "medium", "hard", "extra")) + " FROM scored"
    for c in COMPONENTS) + ")", ("scored",))
def component_by_hardness(spark, sf):
    return rounded(A.component_by_hardness(scored(spark, sf)))


@query("latency_summary", """
SELECT method, count(act_elapsed_s) AS sample_count, round(avg(act_elapsed_s), 6) AS avg_s, round(quantile_cont(act_elapsed_s, 0.5), 6) AS p50_s,
  round(quantile_cont(act_elapsed_s, 0.95), 6) AS p95_s FROM eval_log GROUP BY method""", ("eval_log",))
def latency_summary(spark, sf):
    return rounded(A.latency_summary(view(spark, sf, "eval_log"), ["method"]))


@query("latency_by_stage", """
SELECT stage_id, count(elapsed_s) AS sample_count, round(avg(elapsed_s), 6) AS avg_s, round(quantile_cont(elapsed_s, 0.5), 6) AS p50_s,
  round(quantile_cont(elapsed_s, 0.95), 6) AS p95_s FROM stage_rows GROUP BY stage_id""", ("stage_rows",))
def latency_by_stage(spark, sf):
    return rounded(A.latency_summary(view(spark, sf, "stage_rows"), ["stage_id"], "elapsed_s"))


@query("linking_recall_summary", "SELECT round(avg(sl_recall), 6) AS avg, count(sl_recall) AS valid, count(*) AS total FROM scored", ("scored",))
def linking_recall_summary(spark, sf):
    return rounded(A.linking_recall_summary(view(spark, sf, "scored")))


@query("stage_metric_summary", """
SELECT stage_id, task_type, metric, round(avg(value), 6) AS avg, count(value) AS valid, count(*) AS total FROM (
 SELECT stage_id, task_type, CASE task_type WHEN 'ReduceTask' THEN 'reduce' ELSE 'parse' END || '_recall' AS metric, recall AS value FROM stage_rows WHERE stage_no <= 2
 UNION ALL SELECT stage_id, task_type, CASE task_type WHEN 'ReduceTask' THEN 'reduce' ELSE 'parse' END || '_precision', link_precision FROM stage_rows WHERE stage_no <= 2)
GROUP BY ALL""", ("stage_rows",))
def stage_metric_summary(spark, sf):
    long = stage_rows(spark, sf).select("stage_id", "task_type", F.explode("metrics").alias("metric", "value"))
    return rounded(A.stage_metric_summary(long))


_CONDITIONS = {
    "join>0": "join > 0", "subquery>0": "subquery > 0", "set_operation>0": "set_operation > 0",
    "group_by>0": "group_by > 0", "predicate>2": "predicate > 2",
}
_SQL_NAMES = {"join": "f_join", "group_by": "f_group_by", "predicate": "f_predicate", "logical_connector": "f_logical",
              "subquery": "f_subquery", "set_operation": "f_set"}


def _renamed(text: str) -> str:
    import re

    return re.sub("|".join(rf"\b{k}\b" for k in _SQL_NAMES), lambda m: _SQL_NAMES[m.group(0)], text)


def _slice_sql(conditions: dict[str, str]) -> str:
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS slice, count(*) AS count, round(avg(ex), 6) AS ex, round(avg(em), 6) AS em, round(avg(sf1), 6) AS sf1, "
        f"round(avg(ves), 6) AS ves FROM scored WHERE {_renamed(c)}" for n, c in conditions.items()) + ")"


@query("feature_slices", _slice_sql(_CONDITIONS), ("scored",))
def feature_slices(spark, sf):
    return rounded(A.condition_slices(scored(spark, sf), {k: A.FEATURE_SLICES[k] for k in _CONDITIONS}))


@query("scenario_slices", _slice_sql(A.SCENARIOS), ("scored",))
def scenario_slices(spark, sf):
    return rounded(A.condition_slices(scored(spark, sf), A.SCENARIOS))


@query("scenario_bottlenecks", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS slice, exec_error AS root_stage, count(*) AS count FROM scored WHERE exec_error IS NOT NULL AND ({_renamed(c)}) GROUP BY exec_error"
    for n, c in A.SCENARIOS.items()) + ")", ("scored",))
def scenario_bottlenecks(spark, sf):
    rows = scored(spark, sf).withColumn("root_stage", F.col("exec_error"))
    return A.condition_bottlenecks(rows, A.SCENARIOS)


_GROUPS = """(SELECT gold_sql, count(*) AS sample_count, avg(ex) AS exec_acc, count(*) FILTER (WHERE ex = 1) > 0 AND count(*) FILTER (WHERE ex = 0) > 0 AS flip
 FROM (SELECT 'SELECT ' || (event_id % 997) AS gold_sql, ex FROM eval_log) GROUP BY gold_sql HAVING count(*) >= 2 AND avg(ex) IS NOT NULL)"""


def variance_rows(spark, sf):
    return view(spark, sf, "eval_log").select(F.concat(F.lit("SELECT "), F.col("event_id") % 997).alias("gold_sql"), "ex")


@query("query_variance_groups", f"SELECT gold_sql, sample_count, round(exec_acc, 6) AS exec_acc, NOT flip AS stable, flip FROM {_GROUPS}", ("eval_log",))
def query_variance_groups(spark, sf):
    return rounded(A.query_variance_groups(variance_rows(spark, sf)))


@query("query_variance", f"""
SELECT count(*) AS eligible_groups, CAST(sum(sample_count) AS BIGINT) AS sample_count, round(avg(exec_acc), 6) AS avg_group_exec_acc,
 round(avg((NOT flip)::INT), 6) AS stable_group_rate, round(avg(flip::INT), 6) AS flip_rate FROM {_GROUPS}""", ("eval_log",))
def query_variance(spark, sf):
    return rounded(A.query_variance(variance_rows(spark, sf)))


# --- tokens ------------------------------------------------------------------

@query("token_totals", """
SELECT count(*) AS total_calls, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_tokens) / count(DISTINCT instance_id), 6) AS avg_per_sample FROM stage_log""", ("stage_log",))
def token_totals(spark, sf):
    log = view(spark, sf, "stage_log")
    return rounded(A.token_totals(log, log.agg(F.count_distinct("instance_id")).scalar()))


@query("token_steps", """
SELECT split_part(tag, '|', 2) AS step, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
 round(quantile_cont(total_tokens, 0.95), 6) AS per_call_p95, round(avg(total_tokens), 6) AS per_call_mean FROM stage_log GROUP BY 1""", ("stage_log",))
def token_steps(spark, sf):
    return rounded(A.token_steps(view(spark, sf, "stage_log")))


@query("sample_step_tokens", """
SELECT instance_id, split_part(tag, '|', 2) AS step, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM stage_log GROUP BY 1, 2""", ("stage_log",))
def sample_step_tokens(spark, sf):
    return A.sample_step_tokens(view(spark, sf, "stage_log"))


@query("sample_token_map", """
WITH t AS (SELECT instance_id, split_part(tag, '|', 2) AS step, CAST(sum(total_tokens) AS BIGINT) AS n FROM stage_log GROUP BY 1, 2)
SELECT instance_id, string_agg(step || '=' || n, ',' ORDER BY step) AS tokens FROM t GROUP BY 1""", ("stage_log",))
def sample_token_map(spark, sf):
    maps = A.sample_token_map(view(spark, sf, "stage_log"))
    pairs = F.transform(F.map_entries("tokens"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("instance_id", F.array_join(pairs, ",").alias("tokens"))


@query("token_by_tag", """
SELECT tag, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(total_tokens), 6) AS mean, round(quantile_cont(total_tokens, 0.5), 6) AS median,
 CAST(quantile_disc(total_tokens, 0.95) AS DOUBLE) AS p95, min(total_tokens) AS min, max(total_tokens) AS max FROM stage_log GROUP BY tag""", ("stage_log",))
def token_by_tag(spark, sf):
    return rounded(A.token_by_tag(view(spark, sf, "stage_log")))


@query("token_by_step_and_sample", """
WITH s AS (SELECT instance_id, split_part(tag, '|', 2) AS step, CAST(sum(total_tokens) AS BIGINT) AS t FROM stage_log GROUP BY 1, 2)
SELECT step, count(*) AS samples, round(avg(t), 6) AS per_sample_mean, round(quantile_cont(t, 0.5), 6) AS per_sample_median,
 CAST(quantile_disc(t, 0.95) AS DOUBLE) AS per_sample_p95, min(t) AS per_sample_min, max(t) AS per_sample_max FROM s GROUP BY step""", ("stage_log",))
def token_by_step_and_sample(spark, sf):
    return rounded(A.token_by_step_and_sample(view(spark, sf, "stage_log")))


@query("stage_iterations", """
WITH r AS (SELECT stage_id AS metric, supp_no % 3 AS iteration, instance_id, link_precision AS value FROM stage_rows),
p AS (SELECT metric, iteration, avg(value) AS a, count(value) AS v, count(*) AS t FROM r GROUP BY 1, 2)
SELECT metric, round(avg(a), 6) AS avg, max(v) AS valid_num, max(t) AS total_items, count(a) AS iterations FROM p GROUP BY metric HAVING count(a) > 0""", ("stage_rows",))
def stage_iterations(spark, sf):
    rows = view(spark, sf, "stage_rows").select(
        F.col("stage_id").alias("metric"), (F.col("supp_no") % 3).alias("iteration"), "instance_id", F.col("link_precision").alias("value"))
    return rounded(A.iteration_summary(rows))


@query("iteration_samples", """
SELECT instance_id, stage_id AS metric, round(avg(link_precision), 6) AS avg FROM stage_rows GROUP BY 1, 2""", ("stage_rows",))
def iteration_samples(spark, sf):
    rows = view(spark, sf, "stage_rows").select(
        "instance_id", F.col("stage_id").alias("metric"), F.col("link_precision").alias("value"))
    return rounded(A.iteration_samples(rows))


@query("timing_summary", """
SELECT method, count(act_elapsed_s) AS sample_count, round(sum(act_elapsed_s), 2) AS total_s, round(avg(act_elapsed_s), 3) AS mean_s,
 round(max(act_elapsed_s), 3) AS max_s, round(min(act_elapsed_s), 3) AS min_s, count(act_elapsed_s) > 0 AS available FROM eval_log GROUP BY method""", ("eval_log",))
def timing_summary(spark, sf):
    return A.timing_summary(view(spark, sf, "eval_log"), keys=["method"])


@query("top_errors", """
SELECT exec_error, count(*) AS count FROM eval_log WHERE exec_error IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", ("eval_log",))
def top_errors(spark, sf):
    return A.top_errors(view(spark, sf, "eval_log"))


@query("weakness_ranking", f"""
SELECT error_root, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS pct FROM (SELECT {ROOT_CASE} AS error_root FROM scored WHERE ex = 0)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", ("scored",))
def weakness_ranking(spark, sf):
    return rounded(A.weakness_ranking(classified(spark, sf)))


@query("batch_average", "SELECT round(avg(ex), 6) AS avg, count(ex) AS valid_num, count(*) AS total_items, CAST(NULL AS VARCHAR) AS warning FROM eval_log", ("eval_log",))
def batch_average(spark, sf):
    return rounded(A.batch_average(view(spark, sf, "eval_log")))


# --- before/after blocks, gates, funnels ------------------------------------

def stage_blocks(spark: SparkSession, sf: str) -> DataFrame:
    e, rows = F.col("event_id"), view(spark, sf, "eval_log")
    return rows.select(
        "event_id", "ex",
        F.struct((e % 2 == 0).alias("has_scaler"), (e % 6).alias("candidate_count"), ((e % 5) / 4).alias("candidate_diversity"),
                 (e % 2).alias("pass_1"), (e % 4 > 0).cast("int").alias("pass_k"), (e % 3 - 1).alias("scaler_gain")).alias("scaler"),
        F.struct((e % 3 == 0).alias("has_optimizer"), (e % 2).alias("ex_before"), (e % 5 > 1).cast("int").alias("ex_after"),
                 ((e % 2 == 0) & (e % 5 > 1)).alias("fix_success"), ((e % 2 == 1) & (e % 5 <= 1)).alias("degradation"),
                 (e % 4).alias("debug_turns")).alias("optimizer"),
        F.struct((e % 5 == 0).alias("has_selector"), (e % 2).alias("oracle_ex"), (e % 3 == 0).cast("int").alias("selected_ex"),
                 (e % 3 - 1).alias("selection_gain"), (e % 2).alias("selection_loss")).alias("selector"),
        F.struct((e % 7 == 0).alias("has_decomposer"), (e % 7).alias("sub_question_count")).alias("decomposer"),
    )


BLOCKS = """
SELECT count(*) FILTER (WHERE e%2=0) AS samples_with_scaler, round(avg(e%6) FILTER (WHERE e%2=0), 6) AS avg_candidate_count,
 round(avg((e%5)/4) FILTER (WHERE e%2=0), 6) AS avg_candidate_diversity, round(avg(e%2) FILTER (WHERE e%2=0), 6) AS pass_1,
 round(avg((e%4>0)::INT) FILTER (WHERE e%2=0), 6) AS pass_k, round(avg(e%3-1) FILTER (WHERE e%2=0), 6) AS scaler_gain,
 count(*) FILTER (WHERE e%3=0) AS samples_with_optimizer, round(avg((e%2=0 AND e%5>1)::INT) FILTER (WHERE e%3=0), 6) AS fix_success_rate,
 round(avg((e%2=1 AND e%5<=1)::INT) FILTER (WHERE e%3=0), 6) AS degradation_rate, CAST(sum((e%5>1)::INT - e%2) FILTER (WHERE e%3=0) AS BIGINT) AS net_gain,
 round(avg(e%4) FILTER (WHERE e%3=0), 6) AS avg_debug_turns, count(*) FILTER (WHERE e%5=0) AS samples_with_selector,
 round(avg(e%2) FILTER (WHERE e%5=0), 6) AS oracle_rate, round(avg((e%3=0)::INT) FILTER (WHERE e%5=0), 6) AS selection_accuracy,
 round(avg(e%3-1) FILTER (WHERE e%5=0), 6) AS selection_gain, round(avg(e%2) FILTER (WHERE e%5=0), 6) AS selection_loss,
 count(*) FILTER (WHERE e%7=0) AS samples_with_decomposer, round(count(*) FILTER (WHERE e%7=0) / count(*), 6) AS trigger_rate,
 round(avg(ex) FILTER (WHERE e%7=0), 6) AS trigger_accuracy, round(avg(e%7), 6) AS avg_sub_question_count
FROM (SELECT event_id AS e, ex FROM eval_log)"""


@query("stage_block_summary", BLOCKS, ("eval_log",))
def stage_block_summary(spark, sf):
    return rounded(A.stage_block_summary(stage_blocks(spark, sf)))


_GATES = """
g AS (SELECT *, pred_sql IS NOT NULL AS parseable, exec_error IS NOT NULL AND (lower(exec_error) LIKE '%timeout%' OR lower(exec_error) LIKE '%timed out%') AS late FROM base),
h AS (SELECT *, parseable AND NOT late AS timely, parseable AND NOT late AND exec_error IS NULL AS executable,
  parseable AND NOT late AND exec_error IS NULL AND coalesce(ex = 1, FALSE) AS correct FROM g),
i AS (SELECT *, CASE WHEN correct THEN act_elapsed_s <= 20 END AS efficient FROM h),
j AS (SELECT *, CASE WHEN NOT parseable THEN 'parseable' WHEN NOT timely THEN 'timely' WHEN NOT executable THEN 'executable' WHEN NOT correct THEN 'correct'
  WHEN NOT efficient THEN 'efficient' END AS failed_at FROM i)"""


def gated(spark, sf):
    return view(spark, sf, "eval_log").withColumn("pred_sql", F.when(F.col("event_id") % 29 != 0, "SELECT 1"))


_GBASE = "base AS (SELECT *, CASE WHEN event_id % 29 <> 0 THEN 'SELECT 1' END AS pred_sql FROM eval_log)"


@query("gate_outcome", f"WITH {_GBASE}, {_GATES} SELECT event_id, parseable, timely, executable, correct, efficient, failed_at FROM j", ("eval_log",))
def gate_outcome(spark, sf):
    return P.gate_outcome(gated(spark, sf), 20.0).select("event_id", *P.GATES, "failed_at")


@query("gate_funnel", f"WITH {_GBASE}, {_GATES} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{g}' AS gate, round(count(*) FILTER (WHERE {g}) / count(*), 6) AS survival, count(*) FILTER (WHERE failed_at = '{g}') AS failed, count(*) AS sample_count FROM j"
    for g in P.GATES) + ")", ("eval_log",))
def gate_funnel(spark, sf):
    return rounded(P.gate_funnel(gated(spark, sf), 20.0))


@query("stage_survival_funnel", """
WITH s AS (SELECT instance_id, bool_or(stage_no <= 2 AND coalesce(recall < 1, FALSE)) AS fatal, max(CASE WHEN stage_no IN (3, 4) THEN oracle_ex END) AS o,
  bool_or(stage_no = 6 AND coalesce(missed_correct, FALSE)) AS m FROM stage_rows GROUP BY 1),
j AS (SELECT f.ex, coalesce(fatal, FALSE) AS fatal, o, coalesce(m, FALSE) AS m FROM stage_finals f LEFT JOIN s USING (instance_id))
SELECT 'linking' AS stage, round(avg((NOT fatal)::INT), 6) AS survival, count(*) AS sample_count FROM j
UNION ALL SELECT 'generation', round(avg((NOT fatal AND coalesce(o <> 0, TRUE))::INT), 6), count(*) FROM j
UNION ALL SELECT 'selection', round(avg((NOT fatal AND coalesce(o <> 0, TRUE) AND NOT m)::INT), 6), count(*) FROM j
UNION ALL SELECT 'final', round(avg(coalesce(ex = 1, FALSE)::INT), 6), count(*) FROM j""", ("stage_rows", "stage_finals"))
def stage_survival_funnel(spark, sf):
    return rounded(P.stage_survival_funnel(view(spark, sf, "stage_finals"), stage_rows(spark, sf)))


@query("process_summary", f"""
WITH b AS ({BLOCKS}),
l AS (SELECT avg(recall) AS r, avg(link_precision) AS p FROM stage_rows WHERE stage_no <= 2),
f AS (SELECT avg(x::INT) AS fatal FROM (SELECT bool_or(coalesce(recall < 1, FALSE)) AS x FROM stage_rows WHERE stage_no <= 2 GROUP BY instance_id)),
v AS (SELECT avg(valid_sql_count / candidate_count) AS v FROM stage_rows WHERE stage_no IN (3, 4)),
m AS (SELECT avg(missed_correct::INT) AS m FROM stage_rows WHERE stage_no = 6)
SELECT metric, round(CAST(value AS DOUBLE), 6) AS value FROM (
 SELECT 'linking_recall' AS metric, r AS value FROM l UNION ALL SELECT 'linking_precision', p FROM l
 UNION ALL SELECT 'linking_fatal_miss_rate', fatal FROM f UNION ALL SELECT 'generation_pass1', pass_1 FROM b
 UNION ALL SELECT 'generation_oracle_k', pass_k FROM b UNION ALL SELECT 'generation_exec_validity', v FROM v
 UNION ALL SELECT 'generation_candidate_diversity', avg_candidate_diversity FROM b UNION ALL SELECT 'refinement_fix_rate', fix_success_rate FROM b
 UNION ALL SELECT 'refinement_degradation_rate', degradation_rate FROM b UNION ALL SELECT 'refinement_net_gain', net_gain FROM b
 UNION ALL SELECT 'refinement_debug_turns', avg_debug_turns FROM b UNION ALL SELECT 'selection_accuracy', selection_accuracy FROM b
 UNION ALL SELECT 'selection_regret', selection_loss FROM b UNION ALL SELECT 'selection_missed_correct_rate', m FROM m
 UNION ALL SELECT 'decomposition_trigger_rate', trigger_rate FROM b UNION ALL SELECT 'decomposition_trigger_accuracy', trigger_accuracy FROM b)""",
       ("eval_log", "stage_rows"))
def process_summary(spark, sf):
    return rounded(P.process_summary(A.stage_block_summary(stage_blocks(spark, sf)), stage_rows(spark, sf)))


STATUS = """
CASE WHEN s.error IS NOT NULL THEN 'fail'
 WHEN task_type = 'ReduceTask' THEN CASE WHEN recall >= 1 THEN 'pass' WHEN recall < 1 THEN 'fail' ELSE 'observed' END
 WHEN task_type = 'ParseTask' THEN CASE WHEN exact_links THEN 'pass' WHEN NOT exact_links THEN 'fail' WHEN recall >= 1 THEN 'pass' WHEN recall < 1 THEN 'fail' ELSE 'observed' END
 WHEN task_type IN ('GenerateTask', 'ScaleTask', 'OptimizeTask') THEN CASE WHEN oracle_ex = 1 THEN 'pass' WHEN oracle_ex = 0 OR f.ex = 0 THEN 'fail' ELSE 'observed' END
 WHEN task_type = 'SelectTask' THEN CASE WHEN missed_correct THEN 'fail' WHEN selected_ex = 1 OR f.ex = 1 THEN 'pass' WHEN selected_ex = 0 THEN 'fail' ELSE 'observed' END
 ELSE 'observed' END"""
STATUS_CTE = f"st AS (SELECT s.*, {STATUS} AS status FROM stage_rows s LEFT JOIN stage_finals f USING (instance_id))"


def with_status(spark, sf):
    return P.stage_status(stage_rows(spark, sf), view(spark, sf, "stage_finals"))


@query("stage_status", f"WITH {STATUS_CTE} SELECT instance_id, stage_id, part_no, status FROM st", ("stage_rows", "stage_finals"))
def stage_status(spark, sf):
    return with_status(spark, sf).select("instance_id", "stage_id", "part_no", "status")


_ATTRIBUTION = f"""
{STATUS_CTE},
hit AS (SELECT instance_id, arg_min(stage_id, stage_no) AS stage_id, arg_min(reason, stage_no) AS reason FROM (
  SELECT instance_id, stage_id, stage_no, min(reason) AS reason FROM (
   SELECT *, CASE WHEN stage_no <= 2 AND recall < 1 THEN 'schema_recall_miss' WHEN stage_no = 3 AND oracle_ex = 0 THEN 'no_correct_generated_candidate'
    WHEN stage_no = 6 AND missed_correct THEN 'selector_missed_correct_candidate' WHEN status = 'fail' AND error IS NOT NULL THEN 'stage_runtime_error' END AS reason FROM st)
  WHERE reason IS NOT NULL GROUP BY 1, 2, 3) GROUP BY instance_id),
att AS (SELECT f.instance_id, CASE WHEN f.ex = 1 THEN 'success' ELSE coalesce(hit.stage_id, 'unknown') END AS root_stage,
  CASE WHEN f.ex = 1 THEN 'final_ex_pass' ELSE coalesce(hit.reason, error_root, exec_error, 'unattributed') END AS reason
  FROM stage_finals f LEFT JOIN hit USING (instance_id))"""


@query("attribute_stage", f"WITH {_ATTRIBUTION} SELECT * FROM att", ("stage_rows", "stage_finals"))
def attribute_stage(spark, sf):
    return P.attribute_stage(with_status(spark, sf), view(spark, sf, "stage_finals"))


@query("bottlenecks", f"WITH {_ATTRIBUTION} SELECT root_stage, count(*) AS count FROM att GROUP BY 1", ("stage_rows", "stage_finals"))
def bottlenecks(spark, sf):
    return P.bottlenecks(P.attribute_stage(with_status(spark, sf), view(spark, sf, "stage_finals")))


@query("stage_status_counts", f"""
WITH {STATUS_CTE}, c AS (SELECT stage_id, status, count(*) AS count FROM st GROUP BY 1, 2),
u AS (SELECT stage_id, 'unknown' AS status, (SELECT count(*) FROM stage_finals) - sum(count) AS count FROM c GROUP BY 1)
SELECT stage_id, status, CAST(count AS BIGINT) AS count FROM (SELECT * FROM c UNION ALL SELECT * FROM u WHERE count > 0)""", ("stage_rows", "stage_finals"))
def stage_status_counts(spark, sf):
    return P.stage_status_counts(with_status(spark, sf), view(spark, sf, "stage_finals"))


@query("stage_signal_means", """
SELECT stage_id, kind, name, round(avg(value), 6) AS mean FROM (
 SELECT stage_id, 'metric' AS kind, CASE stage_no WHEN 1 THEN 'reduce_recall' ELSE 'parse_recall' END AS name, recall AS value FROM stage_rows WHERE stage_no <= 2
 UNION ALL SELECT stage_id, 'metric', CASE stage_no WHEN 1 THEN 'reduce_precision' ELSE 'parse_precision' END, link_precision FROM stage_rows WHERE stage_no <= 2
 UNION ALL SELECT stage_id, 'signal', 'oracle_ex', oracle_ex FROM stage_rows UNION ALL SELECT stage_id, 'signal', 'valid_sql_count', valid_sql_count FROM stage_rows)
WHERE value IS NOT NULL GROUP BY 1, 2, 3""", ("stage_rows",))
def stage_signal_means(spark, sf):
    return rounded(P.stage_signal_means(stage_rows(spark, sf), ["oracle_ex", "valid_sql_count"]))


@query("runtime_signals", """
SELECT instance_id, stage_id, count(*) AS call_count, round(sum(elapsed_s), 6) AS elapsed_s, count(*) FILTER (WHERE error <> '') AS error_count,
  array_to_string(list_sort(list_distinct(list('k' || (supp_no % 4)))), ',') AS row_delta_keys FROM stage_rows GROUP BY 1, 2""", ("stage_rows",))
def runtime_signals(spark, sf):
    traces = view(spark, sf, "stage_rows").withColumn("touched_keys", F.array(F.concat(F.lit("k"), F.col("supp_no") % 4)))
    return rounded(P.runtime_signals(traces)).withColumn("row_delta_keys", F.array_join("row_delta_keys", ","))


# --- cross-method ------------------------------------------------------------

@query("latest_sample_metric", with_latest("SELECT method, instance_id, ex AS value FROM ec"), ("eval_log",))
def latest_sample_metric(spark, sf):
    return M.latest_metric(view(spark, sf, "eval_log"), "ex", ORDER)


@query("common_queries", with_latest("SELECT instance_id FROM cq"), ("eval_log",))
def common_queries(spark, sf):
    return M.common_queries(M.latest_metric(view(spark, sf, "eval_log"), "ex", ORDER))


@query("method_accuracy", with_latest("SELECT method, round(avg(c), 6) AS ex FROM mx GROUP BY method"), ("eval_log",))
def method_accuracy(spark, sf):
    return rounded(M.method_accuracy(matrix(spark, sf)))


@query("pairwise_methods", with_latest("""
SELECT a.instance_id, a.method AS method_a, b.method AS method_b, a.c AS correct_a, b.c AS correct_b, a.t AS latency_a, b.t AS latency_b
FROM mx a JOIN mx b ON a.instance_id = b.instance_id AND a.method < b.method"""), ("eval_log",))
def pairwise_methods(spark, sf):
    return M.pairwise_methods(matrix(spark, sf))


_DISAGREE = """
SELECT a.method AS method_a, b.method AS method_b, avg((a.c <> b.c)::INT) AS sample,
 avg(CASE WHEN a.t + b.t > 0 THEN abs(a.t - b.t) / (a.t + b.t) END) AS efficiency
FROM mx a JOIN mx b ON a.instance_id = b.instance_id AND a.method < b.method GROUP BY 1, 2"""


@query("disagreement", with_latest(f"""
SELECT method_a, method_b, round(sample, 6) AS sample, round(efficiency, 6) AS efficiency, round((sample + efficiency) / 2, 6) AS combined FROM ({_DISAGREE})"""), ("eval_log",))
def disagreement(spark, sf):
    return rounded(M.disagreement(matrix(spark, sf)))


@query("empirical_difficulty", with_latest("SELECT instance_id, CAST(sum(c) AS INT) AS solved_by FROM mx GROUP BY 1"), ("eval_log",))
def empirical_difficulty(spark, sf):
    return M.empirical_difficulty(matrix(spark, sf))


_HIST = "SELECT solved_by, count(*) AS queries FROM (SELECT CAST(sum(c) AS INT) AS solved_by FROM mx GROUP BY instance_id) GROUP BY 1"


@query("difficulty_histogram", with_latest(_HIST), ("eval_log",))
def difficulty_histogram(spark, sf):
    return M.difficulty_histogram(matrix(spark, sf))


@query("uniquely_solved", with_latest("""
SELECT max(method) FILTER (WHERE c = 1) AS method, instance_id FROM mx GROUP BY instance_id HAVING sum(c) = 1"""), ("eval_log",))
def uniquely_solved(spark, sf):
    return M.uniquely_solved(matrix(spark, sf))


_ALONE = """
SELECT m.method, count(u.instance_id) AS queries FROM (SELECT DISTINCT method FROM mx) m
LEFT JOIN (SELECT max(method) FILTER (WHERE c = 1) AS method, instance_id FROM mx GROUP BY instance_id HAVING sum(c) = 1) u ON u.method = m.method GROUP BY 1"""


@query("uniquely_solved_counts", with_latest(_ALONE), ("eval_log",))
def uniquely_solved_counts(spark, sf):
    return M.uniquely_solved_counts(matrix(spark, sf))


_ROOM = """
SELECT solved_by, count(*) AS query_count, avg(hi) AS mean_t_max, avg(lo) AS mean_t_min, (avg(hi) - avg(lo)) / avg(hi) AS headroom
FROM (SELECT CAST(sum(c) AS INT) AS solved_by, max(t) FILTER (WHERE c = 1) AS hi, min(t) FILTER (WHERE c = 1) AS lo FROM mx GROUP BY instance_id)
WHERE hi IS NOT NULL GROUP BY 1"""


@query("efficiency_headroom", with_latest(f"""
SELECT solved_by, query_count, round(mean_t_max, 6) AS mean_t_max, round(mean_t_min, 6) AS mean_t_min, round(headroom, 6) AS headroom FROM ({_ROOM})"""), ("eval_log",))
def efficiency_headroom(spark, sf):
    return rounded(M.efficiency_headroom(matrix(spark, sf)))


@query("matrix_report", with_latest(f"""
WITH gap AS ({GAP.replace('WITH acc', 'WITH acc')})
SELECT section, item, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'oracle_gap' AS section, 'ex_static' AS item, ex_static AS value FROM gap UNION ALL SELECT 'oracle_gap', 'ex_dynamic', ex_dynamic FROM gap
UNION ALL SELECT 'oracle_gap', 'gap', gap FROM gap UNION ALL SELECT 'oracle_gap', 'query_count', query_count FROM gap
UNION ALL SELECT 'method_disagreement', method_a || '|' || method_b, (sample + efficiency) / 2 FROM ({_DISAGREE})
UNION ALL SELECT 'empirical_difficulty', CAST(solved_by AS VARCHAR), queries FROM ({_HIST})
UNION ALL SELECT 'uniquely_solved', method, queries FROM ({_ALONE})
UNION ALL SELECT 'efficiency_headroom', CAST(solved_by AS VARCHAR), headroom FROM ({_ROOM}))"""), ("eval_log",))
def matrix_report(spark, sf):
    return rounded(M.matrix_report(M.packed_cells(view(spark, sf, "eval_log"), ORDER)))


def latest_of(spark, sf, method):
    rows = view(spark, sf, "scored").where(F.col("method") == method)
    fields = F.struct("ex", "em", "sf1", "ves", "act_elapsed_s")
    return rows.groupBy("instance_id").agg(F.max_by(fields, F.struct(*ORDER)).alias("r")).select("instance_id", "r.*")


_TWO = """
lt AS (SELECT method, instance_id, max_by({'ex': ex, 'em': em, 'sf1': sf1, 'ves': ves, 't': act_elapsed_s}, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS r FROM scored GROUP BY 1, 2),
pv AS (SELECT instance_id, r.ex, r.em, r.sf1, r.ves, r.t FROM lt WHERE method = 'm0'), cu AS (SELECT instance_id, r.ex, r.em, r.sf1, r.ves, r.t FROM lt WHERE method = 'm1')"""


@query("compare_runs", f"WITH {_TWO} SELECT metric, round(previous, 6) AS previous, round(current, 6) AS current, round(current - previous, 6) AS delta FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, (SELECT avg({c}) FROM pv) AS previous, (SELECT avg({c}) FROM cu) AS current"
    for n, c in (("ex", "ex"), ("em", "em"), ("sf1", "sf1"), ("ves", "ves"), ("act_elapsed_s", "t"))) + ")", ("scored",))
def compare_runs(spark, sf):
    return rounded(M.compare_runs(latest_of(spark, sf, "m0"), latest_of(spark, sf, "m1")))


@query("changed_outcomes", f"""WITH {_TWO} SELECT instance_id, CASE WHEN pv.ex = 1 THEN 'regression' ELSE 'improvement' END AS kind
FROM pv JOIN cu USING (instance_id) WHERE (pv.ex = 1 AND cu.ex = 0) OR (pv.ex = 0 AND cu.ex = 1)""", ("scored",))
def changed_outcomes(spark, sf):
    return M.changed_outcomes(latest_of(spark, sf, "m0"), latest_of(spark, sf, "m1"))


RUNS = """
SELECT run_id, method, 'events' AS dataset, CASE WHEN min(event_id) % 2 = 0 THEN 'dev' ELSE 'test' END AS split, 'full' AS scope,
 count(*) % 2 AS sample_hash, count(*) AS sample_count, CAST(max(ts) AS STRING) AS timestamp FROM eval_log GROUP BY run_id, method"""


def runs(spark, sf):
    log = view(spark, sf, "eval_log")
    return spark.sql(RUNS.replace("eval_log", "{eval_log}"), eval_log=log)


_GROUP = f"""
rr AS ({RUNS}), la AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY dataset, split, scope, sample_hash, method ORDER BY timestamp DESC, run_id DESC) = 1),
gr AS (SELECT dataset, split, scope, sample_hash FROM la GROUP BY ALL ORDER BY count(*) DESC, max(timestamp) DESC, dataset, split, scope, sample_hash LIMIT 1),
ch AS (SELECT la.* FROM la JOIN gr USING (dataset, split, scope, sample_hash))"""


@query("comparable_runs", f"WITH {_GROUP} SELECT dataset, split, scope, sample_hash, method, run_id, sample_count FROM ch", ("eval_log",))
def comparable_runs(spark, sf):
    return M.comparable_runs(runs(spark, sf)).select("dataset", "split", "scope", "sample_hash", "method", "run_id", "sample_count")


@query("comparison_summary", f"""WITH {_GROUP} SELECT string_agg(method, ',' ORDER BY method) AS methods,
 (SELECT coalesce(string_agg(m, ',' ORDER BY m), '') FROM (VALUES ('m0'), ('m1'), ('m7')) v(m) WHERE m NOT IN (SELECT method FROM ch)) AS missing_methods,
 FALSE AS complete, FALSE AS aligned, CASE WHEN min(sample_count) = max(sample_count) THEN min(sample_count) END AS sample_count FROM ch""", ("eval_log",))
def comparison_summary(spark, sf):
    return M.comparison_summary(M.comparable_runs(runs(spark, sf)), ["m0", "m1", "m7"])


@query("cost_per_correct", """
SELECT t AS token_total, p AS pass_count, round(t / p, 6) AS cost_per_correct
FROM (SELECT CAST(sum(total_tokens) AS BIGINT) AS t FROM stage_log), (SELECT count(*) FILTER (WHERE ex = 1) AS p FROM eval_log)""", ("eval_log", "stage_log"))
def cost_per_correct(spark, sf):
    return rounded(M.cost_per_correct(view(spark, sf, "eval_log"), view(spark, sf, "stage_log")))


@query("metric_value", "SELECT 'latency_p95' AS metric_id, round(quantile_cont(act_elapsed_s, 0.95), 6) AS value FROM scored", ("scored",))
def metric_value(spark, sf):
    return rounded(M.metric_value(A.aggregate_metrics(scored(spark, sf), default_registry(), "L2"), "latency_p95"))


@query("publication_completeness", """
SELECT m.metric_id FROM (VALUES ('rves')) m(metric_id) WHERE (SELECT count(*) FROM scored) > 0
UNION ALL SELECT 'error_root_distribution' WHERE (SELECT count(*) FROM scored WHERE ex = 0) > 0""", ("scored",))
def publication_completeness(spark, sf):
    rows = scored(spark, sf)
    return M.publication_completeness(A.aggregate_metrics(rows, default_registry()), rows, default_registry())


@query("publication_completeness_derived", """
SELECT m.metric_id FROM (VALUES ('rves'), ('token_avg_per_sample'), ('cost_per_correct')) m(metric_id) WHERE (SELECT count(*) FROM scored) > 0 AND (SELECT count(*) FROM stage_log) > 0""", ("scored", "stage_log"))
def publication_completeness_derived(spark, sf):
    """Token metrics are expected where calls were logged; of the wrong samples none is left here."""
    rows = scored(spark, sf).where("ex = 1 OR ex IS NULL")
    tokens = view(spark, sf, "stage_log")
    cells = A.aggregate_metrics(rows, default_registry()).select("metric_id", "value")
    given = tokens.agg(F.sum("total_tokens").cast("double").alias("value")).select(F.lit("token_total").alias("metric_id"), "value")
    return M.publication_completeness(cells.unionByName(given), rows, default_registry(), tokens)


_KEYS = ("run_id", "method", "dataset", "split")


@query("validate_bundle", """
SELECT run_id, CASE WHEN k % 3 = 0 THEN 'split' ELSE '' END AS missing, CASE WHEN k % 2 = 0 THEN 'extra' ELSE '' END AS unknown
FROM (SELECT run_id, min(event_id) AS k FROM eval_log GROUP BY run_id)""", ("eval_log",))
def validate_bundle(spark, sf):
    keyed = view(spark, sf, "eval_log").groupBy("run_id").agg(F.min("event_id").alias("k")).select(
        "run_id", F.array_compact(F.array(
            F.lit("run_id"), F.lit("method"), F.lit("dataset"), F.when(F.col("k") % 3 != 0, "split"),
            F.when(F.col("k") % 2 == 0, "extra"))).alias("keys"))
    checked = M.validate_bundle(keyed, _KEYS)
    return checked.select("run_id", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))


# --- search statistics -------------------------------------------------------

_Q = """
qu AS (SELECT method, avg(ex) AS ex, avg(em) AS em, avg(ves) AS ves, avg(act_elapsed_s) AS latency,
 (avg(ex) FILTER (WHERE hardness = 'hard') + avg(ex) FILTER (WHERE hardness = 'extra')) / 2 AS hard FROM scored GROUP BY method),
ba AS (SELECT * FROM qu WHERE method = 'm0'),
fi AS (SELECT qu.method, round(0.45*qu.ex + 0.10*qu.em + 0.10*least(1, qu.ves) + 0.20*qu.hard
  + 0.05*greatest(-1, least(1, -((qu.latency - ba.latency) / abs(ba.latency)))), 6) AS fitness, qu.em FROM qu, ba),
bf AS (SELECT round(0.45*ex + 0.10*em + 0.10*least(1, ves) + 0.20*hard, 6) AS fitness, em FROM ba)"""


def qualities(spark, sf):
    quality = V.run_quality(view(spark, sf, "scored"), ["method"])
    base = quality.where(F.col("method") == "m0")
    before = base.select("latency").scalar()
    return quality.withColumn("latency_delta", V.relative_delta(before, F.col("latency"))), base


@query("run_fitness", f"WITH {_Q} SELECT method, round(fitness, 5) AS fitness FROM fi", ("scored",))
def run_fitness(spark, sf):
    return V.run_fitness(qualities(spark, sf)[0]).select("method", F.round("fitness", 5).alias("fitness"))


@query("run_improvement", f"WITH {_Q} SELECT fi.method, round(fi.fitness - bf.fitness + 0.15 * (fi.em - bf.em), 4) AS reward FROM fi, bf", ("scored",))
def run_improvement(spark, sf):
    quality, base = qualities(spark, sf)
    return V.improvement(quality, base, "em").select("method", F.round("reward", 4).alias("reward"))


NODES = """
SELECT event_id AS node_no, concat('n', CAST(event_id AS STRING)) AS node_id, user_id % 7 AS branch_id,
 CASE WHEN event_type = 'error' THEN 'buggy' ELSE 'pass' END AS status, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS fitness FROM events"""


def nodes(spark, sf):
    return spark.sql(NODES.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query("promote_top_k", f"""
SELECT node_id, branch_id, fitness FROM ({NODES}) WHERE status = 'pass' AND fitness > 10 ORDER BY fitness DESC, branch_id, node_id LIMIT 5""")
def promote_top_k(spark, sf):
    return V.promote_top_k(nodes(spark, sf), 5, 10.0).select("node_id", "branch_id", "fitness")


@query("best_node", f"SELECT arg_max(node_id, fitness * 1000000000 - node_no) AS best_node, max(fitness) AS fitness FROM ({NODES}) WHERE fitness IS NOT NULL")
def best_node(spark, sf):
    return V.best_node(nodes(spark, sf))


@query("top_k_diverse", f"""
SELECT node_id, branch_id, fitness FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY fitness DESC, node_no) AS r FROM ({NODES})
 WHERE status = 'pass' AND fitness IS NOT NULL) WHERE r <= 2 ORDER BY fitness DESC, node_no LIMIT 6""")
def top_k_diverse(spark, sf):
    return V.top_k_diverse(nodes(spark, sf), 6, 2).select("node_id", "branch_id", "fitness")


@query("stagnation", f"""
SELECT branch_id, max(fitness) FILTER (WHERE r > 3) AS best_before, max(fitness) FILTER (WHERE r <= 3) AS recent_best,
 count(*) > 3 AND max(fitness) FILTER (WHERE r <= 3) <= max(fitness) FILTER (WHERE r > 3) AS stagnant
FROM (SELECT *, row_number() OVER (PARTITION BY branch_id ORDER BY node_no DESC) AS r FROM ({NODES}) WHERE fitness IS NOT NULL) GROUP BY 1""")
def stagnation(spark, sf):
    return V.stagnation(nodes(spark, sf), ["branch_id"], 3)


@query("rollout_verdict", """
SELECT method, instance_id, round(b, 6) AS baseline, round(c, 6) AS current, round(c - b, 6) AS delta,
 CASE WHEN b IS NULL OR c IS NULL THEN 'STOP' WHEN c - b <= -0.02 THEN 'REGRESSION' WHEN c - b < 0.01 THEN 'DRY' ELSE 'CONTINUE' END AS verdict
FROM (SELECT method, instance_id, avg(em) FILTER (WHERE event_id % 2 = 0) AS b, avg(ex) AS c FROM eval_log GROUP BY 1, 2)""", ("eval_log",))
def rollout_verdict(spark, sf):
    pairs = view(spark, sf, "eval_log").groupBy("method", "instance_id").agg(
        F.avg(F.when(F.col("event_id") % 2 == 0, F.col("em"))).alias("baseline"), F.avg("ex").alias("current"))
    return rounded(V.verdict(pairs))


_ACTIONS = """
SELECT event_type AS action_id, round(sum(w), 6) AS visits, round(sum(w * r), 4) AS total_reward, round(sum(w * r) / sum(w), 6) AS average_reward FROM (
 SELECT event_type, 1.0::DOUBLE AS w, value AS r FROM events WHERE user_id % 2 = 0
 UNION ALL SELECT event_type, 0.3::DOUBLE, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END FROM events WHERE user_id % 2 = 1) GROUP BY 1"""


def stats_of(spark, sf):
    events = table(spark, sf, "events")
    results = events.where("user_id % 2 = 0").select(F.col("event_type").alias("action_id"), F.col("value").alias("reward"))
    priors = events.where("user_id % 2 = 1").select(
        F.col("event_type").alias("action_id"), F.col("value").alias("fitness"), (F.col("event_id") % 5 == 0).alias("failed"))
    return V.action_stats(results, priors)


@query("action_stats", _ACTIONS)
def action_stats(spark, sf):
    return stats_of(spark, sf).select(
        "action_id", F.round("visits", 6).alias("visits"), F.round("total_reward", 4).alias("total_reward"),
        F.round("average_reward", 6).alias("average_reward"))


@query("action_scores", f"SELECT action_id, round(average_reward + 1.41421356237 * sqrt(ln(1000) / visits), 5) AS score FROM ({_ACTIONS})")
def action_scores(spark, sf):
    return V.action_scores(stats_of(spark, sf), 1000).select("action_id", F.round("score", 5).alias("score"))

"""Comparisons across methods and runs over the eval log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.stats import ratio


def latest_metric(samples: DataFrame, metric: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Latest recorded value per (method, instance).  ``max_by`` combines map-side, so no sort."""
    return (
        samples.where(F.col(metric).isNotNull())
        .groupBy("method", "instance_id")
        .agg(F.max_by(metric, F.struct(*order)).alias("value"))
    )


def common_queries(df: DataFrame) -> DataFrame:
    """Instances present for every method; input has one row per (method, instance)."""
    methods = df.agg(F.count_distinct("method")).scalar()
    return df.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") == methods).select("instance_id")


def method_matrix(correct: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """``(instance_id, cells)``: one row per common instance, cells sorted by method.

    ``cells`` is as wide as there are methods; every later report reads it
    without another shuffle of sample rows.
    """
    rows = correct.select("method", "instance_id", (F.col("value") != 0).cast("int").alias("correct"))
    if latency is not None:
        rows = rows.join(
            latency.select("method", "instance_id", F.col("value").cast("double").alias("latency")),
            ["method", "instance_id"], "left",
        )
    else:
        rows = rows.withColumn("latency", F.lit(None).cast("double"))
    methods = correct.agg(F.count_distinct("method")).scalar()
    return (
        rows.groupBy("instance_id")
        .agg(F.array_sort(F.collect_list(F.struct("method", "correct", "latency"))).alias("cells"))
        .where(F.size("cells") == methods)
    )


def matrix_from_log(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    return method_matrix(latest_metric(samples, "ex", order), latest_metric(samples, "act_elapsed_s", order))


def method_accuracy(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.explode("cells").alias("c")).groupBy("c.method").agg(F.avg("c.correct").alias("ex"))


def oracle_gap(matrix: DataFrame) -> DataFrame:
    """Best single method against choosing the best method per query; name order breaks ties."""
    best = method_accuracy(matrix).agg(
        F.max("ex").alias("ex_static"), F.min_by("method", F.struct(-F.col("ex"), "method")).alias("best_static_method")
    )
    solved = F.exists("cells", lambda c: c["correct"] == 1).cast("int")
    dynamic = matrix.agg(F.avg(solved).alias("ex_dynamic"), F.count(F.lit(1)).alias("query_count"))
    return (
        dynamic.withColumn("b", best.select(F.struct("ex_static", "best_static_method")).scalar())
        .select("b.ex_static", "ex_dynamic", (F.col("ex_dynamic") - F.col("b.ex_static")).alias("gap"),
                "b.best_static_method", "query_count")
    )


def _pairs() -> Column:
    later = F.expr(
        "flatten(transform(cells, (x, i) -> transform(slice(cells, i + 2, size(cells)), y -> struct(x AS a, y AS b))))"
    )
    return F.explode(later)


def pairwise_methods(matrix: DataFrame) -> DataFrame:
    """One row per query and unordered method pair, cut from the row's own cells (no self-join)."""
    return matrix.select("instance_id", _pairs().alias("p")).select(
        "instance_id", F.col("p.a.method").alias("method_a"), F.col("p.b.method").alias("method_b"),
        F.col("p.a.correct").alias("correct_a"), F.col("p.b.correct").alias("correct_b"),
        F.col("p.a.latency").alias("latency_a"), F.col("p.b.latency").alias("latency_b"),
    )


def disagreement(matrix: DataFrame) -> DataFrame:
    """Correctness, latency and combined disagreement per method pair."""
    total = F.col("latency_a") + F.col("latency_b")
    spread = F.when(total > 0, F.abs(F.col("latency_a") - F.col("latency_b")) / total)
    return (
        pairwise_methods(matrix).groupBy("method_a", "method_b")
        .agg(F.avg((F.col("correct_a") != F.col("correct_b")).cast("int")).alias("sample"), F.avg(spread).alias("efficiency"))
        .withColumn("combined", (F.col("sample") + F.col("efficiency")) / 2)
    )


def _solvers() -> Column:
    return F.filter("cells", lambda c: c["correct"] == 1)


def empirical_difficulty(matrix: DataFrame) -> DataFrame:
    """Number of methods that solve each query."""
    return matrix.select("instance_id", F.size(_solvers()).alias("solved_by"))


def difficulty_histogram(matrix: DataFrame) -> DataFrame:
    return empirical_difficulty(matrix).groupBy("solved_by").agg(F.count(F.lit(1)).alias("queries"))


def uniquely_solved(matrix: DataFrame) -> DataFrame:
    """Queries solved by exactly one method."""
    return matrix.where(F.size(_solvers()) == 1).select(_solvers()[0]["method"].alias("method"), "instance_id")


def uniquely_solved_counts(matrix: DataFrame) -> DataFrame:
    """Count per method, zero included."""
    alone = F.when(F.size(_solvers()) == 1, _solvers()[0]["method"])
    return (
        matrix.select(alone.alias("alone"), F.explode("cells.method").alias("method"))
        .groupBy("method").agg(F.count_if(F.col("alone") == F.col("method")).alias("queries"))
    )


def efficiency_headroom(matrix: DataFrame) -> DataFrame:
    """Latency headroom among correct methods, per number of solvers."""
    times = F.array_compact(F.transform(_solvers(), lambda c: c["latency"]))
    per_query = matrix.select(
        F.size(_solvers()).alias("solved_by"), F.array_max(times).alias("t_max"), F.array_min(times).alias("t_min")
    ).where(F.col("t_max").isNotNull())
    return per_query.groupBy("solved_by").agg(
        F.count(F.lit(1)).alias("query_count"), F.avg("t_max").alias("mean_t_max"), F.avg("t_min").alias("mean_t_min")
    ).withColumn("headroom", ratio(F.col("mean_t_max") - F.col("mean_t_min"), F.col("mean_t_max")))


def packed_cells(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``(instance_id, cells)`` for every instance, from one pass over the log; not yet cut to the common ones."""
    def latest(metric: str) -> Column:
        return F.max_by(metric, F.when(F.col(metric).isNotNull(), F.struct(*order)))

    last = samples.groupBy("method", "instance_id").agg(latest("ex").alias("ex"), latest("act_elapsed_s").cast("double").alias("latency"))
    cell = F.struct("method", (F.col("ex") != 0).cast("int").alias("correct"), "latency")
    return last.where(F.col("ex").isNotNull()).groupBy("instance_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def _facts() -> Column:
    """What one instance adds to the reports: (kind, item, x, y) by method, by pair of methods, by number of solvers, and once."""
    def fact(kind: str, item: Column, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.cast("string").alias("item"), x.cast("double").alias("x"), y.cast("double").alias("y"))

    def pairs(a: Column, i: Column) -> Column:
        def pair(b: Column) -> Column:
            total = a["latency"] + b["latency"]
            spread = F.when(total > 0, F.abs(a["latency"] - b["latency"]) / total)
            return fact("pair", F.concat_ws("|", a["method"], b["method"]), a["correct"] != b["correct"], spread)

        return F.transform(F.slice("cells", i + 2, F.size("cells")), pair)

    solvers = F.size(_solvers())
    times = F.array_compact(F.transform(_solvers(), lambda c: c["latency"]))
    methods = F.transform("cells", lambda c: fact("method", c["method"], c["correct"], (solvers == 1) & (c["correct"] == 1)))
    return F.concat(methods, F.flatten(F.transform("cells", pairs)),
                    F.array(fact("solvers", solvers, F.array_max(times), F.array_min(times)), fact("all", F.lit(""), solvers > 0, F.lit(None))))


def matrix_facts(cells: DataFrame) -> DataFrame:
    """``kind, item, n, x, y, y_sum`` over the common instances, with the best method in every row: one aggregation of all facts.

    Instances are told apart by how many methods they have.  Only those with all methods count, and how many there are
    shows in the aggregate itself, which has a row per pair of methods and number of methods.
    """
    facts = cells.select(F.size("cells").alias("width"), F.explode(_facts()).alias("f")).select("width", "f.*")
    folded = facts.groupBy("width", "kind", "item").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("y").alias("y_sum"))
    everything = Window.partitionBy(F.lit(0))
    known = folded.withColumn("methods", F.size(F.collect_set(F.when(F.col("kind") == "method", F.col("item"))).over(everything)))
    method = F.when(F.col("kind") == "method", F.struct(-F.col("x"), "item"))
    return known.where(F.col("width") == F.col("methods")).select(
        "kind", "item", "n", "x", "y", "y_sum", F.max(F.when(F.col("kind") == "method", F.col("x"))).over(everything).alias("best"),
        F.min_by("item", method).over(everything).alias("best_method"))


def oracle_gap_of_log(samples: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``oracle_gap`` from one pass over the log; no row without a common instance."""
    return matrix_facts(packed_cells(samples, order)).where("kind = 'all'").select(
        F.col("best").alias("ex_static"), F.col("x").alias("ex_dynamic"), (F.col("x") - F.col("best")).alias("gap"),
        F.col("best_method").alias("best_static_method"), F.col("n").alias("query_count"))


def matrix_report(cells: DataFrame) -> DataFrame:
    """All cross-method results as ``(section, item, value)`` rows, from ``packed_cells`` or a matrix; none without a common instance."""
    def row(section: str, item: Column, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), value.cast("double").alias("value"))

    kind, item, x, y, n, best = (F.col(c) for c in ("kind", "item", "x", "y", "n", "best"))
    gap = F.array(*[row("oracle_gap", F.lit(name), value) for name, value in (("ex_static", best), ("ex_dynamic", x), ("gap", x - best), ("query_count", n))])
    solvers = F.array(row("empirical_difficulty", item, n), F.when(x.isNotNull(), row("efficiency_headroom", item, ratio(x - y, x))))
    rows = (F.when(kind == "all", gap).when(kind == "pair", F.array(row("method_disagreement", item, (x + y) / 2)))
            .when(kind == "solvers", F.array_compact(solvers)).otherwise(F.array(row("uniquely_solved", item, F.col("y_sum")))))
    return matrix_facts(cells).select(F.explode(rows).alias("r")).select("r.*")


# Metrics whose means are compared between two runs.
COMPARED = ("ex", "em", "sf1", "ves", "act_elapsed_s")


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Mean of each shared metric before and after, with the delta."""
    shared = [m for m in COMPARED if m in previous.columns and m in current.columns]
    both = previous.select(F.lit("p").alias("side"), *shared).unionByName(
        current.select(F.lit("c").alias("side"), *shared)
    )
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in shared]
    long = both.select("side", F.explode(F.array(*cells)).alias("x")).select("side", "x.*")
    return long.groupBy("metric").agg(
        F.avg(F.when(F.col("side") == "p", F.col("v"))).alias("previous"),
        F.avg(F.when(F.col("side") == "c", F.col("v"))).alias("current"),
    ).withColumn("delta", F.col("current") - F.col("previous"))


def changed_outcomes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Samples that flipped: ``regression`` (1→0) or ``improvement`` (0→1)."""
    joined = previous.select("instance_id", F.col("ex").alias("old")).join(
        current.select("instance_id", F.col("ex").alias("new")), "instance_id"
    )
    kind = F.when((F.col("old") == 1) & (F.col("new") == 0), "regression").when(
        (F.col("old") == 0) & (F.col("new") == 1), "improvement"
    )
    return joined.select("instance_id", kind.alias("kind")).where(F.col("kind").isNotNull())


SIGNATURE = ("dataset", "split", "scope", "sample_mode", "sample_limit", "sample_seed", "sample_hash")


def comparable_runs(runs: DataFrame, signature: Sequence[str] = SIGNATURE) -> DataFrame:
    """Latest run per method inside the signature group with most methods, then latest.

    Only (signature, method) summaries reach the choice of the group.
    """
    used = [c for c in signature if c in runs.columns]
    rest = [c for c in runs.columns if c not in (*used, "method")]
    latest = runs.groupBy(*used, "method").agg(F.max_by(F.struct(*rest), F.struct("timestamp", "run_id")).alias("r"))
    groups = latest.groupBy(*used).agg(
        F.count(F.lit(1)).alias("methods"), F.max("r.timestamp").alias("last")
    )
    best = groups.orderBy(F.desc("methods"), F.desc("last"), *used).limit(1)
    match = [latest[c].eqNullSafe(best[c]) for c in used]
    condition = match[0]
    for part in match[1:]:
        condition = condition & part
    return latest.join(best.select(*used), condition, "left_semi").select(*used, "method", "r.*")


def comparison_summary(chosen: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing methods and whether the chosen runs are aligned."""
    wanted = F.array(*[F.lit(m) for m in expected])
    folded = chosen.agg(
        F.array_sort(F.collect_set("method")).alias("methods"), F.min("sample_count").alias("_lo"),
        F.max("sample_count").alias("_hi"), F.count_distinct("sample_hash").alias("_hashes"),
    )
    missing = F.array_except(wanted, F.col("methods"))
    same_count = F.col("_lo") == F.col("_hi")
    complete = F.size(missing) == 0
    return folded.select(
        F.array_join("methods", ",").alias("methods"), F.array_join(missing, ",").alias("missing_methods"),
        complete.alias("complete"), (complete & same_count & (F.col("_hashes") == 1)).alias("aligned"),
        F.when(same_count, F.col("_lo")).alias("sample_count"),
    )


def cost_per_correct(samples: DataFrame, tokens: DataFrame) -> DataFrame:
    """Total tokens over the number of correct samples; NULL without any."""
    spent = tokens.agg(F.sum("total_tokens")).scalar()
    return samples.agg(F.count_if(F.col("ex") == 1).alias("pass_count")).withColumn("token_total", spent).select(
        "token_total", "pass_count", ratio(F.col("token_total"), F.col("pass_count")).alias("cost_per_correct")
    )


def metric_value(cells: DataFrame, metric_id: str) -> DataFrame:
    """Aggregate value of one registry metric from ``aggregate_metrics`` rows."""
    return cells.where(F.col("metric_id") == metric_id).select("metric_id", "value")


#: Derived metrics that a publication has to give when there is something to derive them from.
FROM_TOKENS, FROM_ERRORS = ("token_total", "token_avg_per_sample", "cost_per_correct"), "error_root_distribution"


def publication_completeness(cells: DataFrame, samples: DataFrame, registry, tokens: DataFrame | None = None) -> DataFrame:
    """Declared publishable metrics without a value although their raw signal was captured.

    The raw signal of token and cost metrics is a row of ``tokens``, that of the error distribution a wrong sample.
    """
    declared = [
        m for m in registry.metrics()
        if (m.kind != "derived" or m.id in (*FROM_TOKENS, FROM_ERRORS)) and m.publication in ("public", "aggregate_only") and m.layer in ("L1", "L2", "L3", "L4") and m.id != "sc"
    ]
    from tallyspark.operators.aggregate import numeric_path

    always = {"ex", "em", "sf1", "ves", "rves"}
    calls = F.lit(False) if tokens is None else tokens.agg(F.count(F.lit(1)) > 0).scalar()

    def captured(m) -> Column:
        if m.id in always:
            return F.lit(True)
        if m.id in FROM_TOKENS:
            return calls
        return F.count_if(F.col("ex") == 0) > 0 if m.id == FROM_ERRORS else F.count(numeric_path(samples, m.source)) > 0

    raw = F.array(
        *[
            F.struct(
                F.lit(m.id).alias("metric_id"),
                captured(m).alias("expected"),
            )
            for m in declared
        ]
    )
    expected = samples.agg(raw.alias("m")).select(F.explode("m").alias("m")).select("m.*").where("expected")
    provided = cells.where(F.col("value").isNotNull()).select("metric_id")
    return expected.select("metric_id").join(provided, "metric_id", "left_anti")


def validate_bundle(bundles: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """Missing and unknown keys of each bundle, from ``(run_id, keys array)``."""
    need = F.array(*[F.lit(k) for k in required])
    known = F.array(*[F.lit(k) for k in (*required, *optional)])
    return bundles.select(
        "run_id",
        F.array_sort(F.array_except(need, F.col("keys"))).alias("missing"),
        F.array_sort(F.array_except(F.col("keys"), known)).alias("unknown"),
    )

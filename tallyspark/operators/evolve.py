"""Statistics over candidate evaluations: fitness, promotion, stagnation, action values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.ordered import numbered

# Fitness weights, reward of an unusable run, exploration constant.
WEIGHTS = {"ex": 0.45, "em": 0.10, "ves": 0.10, "hard_slice": 0.20, "cost": 0.10, "latency": 0.05, "regression": 0.15}
UNUSABLE = -2.0
TARGET_BONUS = 0.15
EXPLORATION = 1.41421356237
HARD_LABELS = ("hard", "extra", "challenging")


def _unit(value: Column) -> Column:
    v = value.cast("double")
    return F.when(v.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def _saving(delta: Column) -> Column:
    d = delta.cast("double")
    return F.when(d.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -d)))


def fitness(
    ex: Column, em: Column, ves: Column, hard: Column, cost_delta: Column, latency_delta: Column,
    regression_rate: Column, weights: dict[str, float] | None = None,
) -> Column:
    """Weighted score in which quality terms are clamped to 0..1 and savings to -1..1."""
    w = {**WEIGHTS, **(weights or {})}
    score = (
        w["ex"] * _unit(ex) + w["em"] * _unit(em) + w["ves"] * _unit(ves) + w["hard_slice"] * _unit(hard)
        + w["cost"] * _saving(cost_delta) + w["latency"] * _saving(latency_delta) - w["regression"] * _unit(regression_rate)
    )
    return F.round(score, 6)


def relative_delta(previous: Column, current: Column) -> Column:
    """Change as a fraction of the previous value; the plain change when that is zero."""
    change = current - previous
    return F.when(F.coalesce(previous, F.lit(0)) != 0, change / F.abs(previous)).otherwise(change)


def run_quality(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """EX, EM, VES, hard-slice mean and mean latency per run."""
    per_label = [F.avg(F.when(F.col("hardness") == x, F.col("ex"))).alias(f"_{x}") for x in HARD_LABELS]
    folded = samples.groupBy(*keys).agg(
        F.avg("ex").alias("ex"), F.avg("em").alias("em"), F.avg("ves").alias("ves"),
        F.avg("act_elapsed_s").alias("latency"), F.count(F.lit(1)).alias("sample_count"), *per_label,
    )
    known = F.array_compact(F.array(*[F.col(f"_{x}") for x in HARD_LABELS]))
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return folded.withColumn("hard_slice_score", mean).drop(*[f"_{x}" for x in HARD_LABELS])


def run_fitness(quality: DataFrame) -> DataFrame:
    """Fitness of each run row; delta columns that are absent count as zero."""
    def column(name: str) -> Column:
        return F.col(name) if name in quality.columns else F.lit(None).cast("double")

    return quality.withColumn(
        "fitness",
        fitness(*[column(c) for c in ("ex", "em", "ves", "hard_slice_score", "cost_delta", "latency_delta", "regression_rate")]),
    )


def improvement(candidates: DataFrame, baseline: DataFrame, target: str | None = None) -> DataFrame:
    """Candidate fitness minus baseline fitness, plus a share of the target metric's change.

    ``baseline`` is a single run row.  A run without ``ex`` gets ``UNUSABLE``.
    """
    base = run_fitness(baseline.select("ex", "em", "ves", "hard_slice_score"))
    wanted = ["fitness"] + ([target] if target else [])
    joined = run_fitness(candidates).withColumn(
        "_b", base.select(F.struct(*dict.fromkeys(wanted))).scalar()
    )
    gain = F.round(F.col("fitness") - F.col("_b.fitness"), 6)
    if target:
        gain = F.round(gain + TARGET_BONUS * F.coalesce(F.col(target) - F.col(f"_b.{target}"), F.lit(0.0)), 6)
    return joined.withColumn("reward", F.when(F.col("ex").isNull(), F.lit(UNUSABLE)).otherwise(gain)).drop("_b")


def promote_top_k(nodes: DataFrame, k: int = 1, min_fitness: float = 0.0) -> DataFrame:
    """The k best passing nodes strictly above the threshold; lower branch first on ties."""
    return nodes.where((F.col("status") == "pass") & (F.col("fitness") > min_fitness)).orderBy(
        F.desc("fitness"), "branch_id", "node_id"
    ).limit(k)


def best_node(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("fitness").isNotNull()).agg(
        F.max_by("node_id", F.struct("fitness", -F.col("node_no"))).alias("best_node"), F.max("fitness").alias("fitness")
    )


def top_k_diverse(nodes: DataFrame, k: int, per_branch: int = 1) -> DataFrame:
    """The k best passing nodes with at most ``per_branch`` from one branch."""
    rank = Window.partitionBy("branch_id").orderBy(F.desc("fitness"), "node_no")
    return (
        nodes.where((F.col("status") == "pass") & F.col("fitness").isNotNull())
        .withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= per_branch).drop("_r")
        .orderBy(F.desc("fitness"), "node_no").limit(k)
    )


def stagnation(nodes: DataFrame, keys: Sequence[str], window: int, epsilon: float = 0.0) -> DataFrame:
    """Is the best of the last ``window`` nodes no better than the best before them?"""
    named = nodes if keys else nodes.withColumn("_all", F.lit(0))
    keys_ = list(keys) or ["_all"]
    scored = named.where(F.col("fitness").isNotNull())
    recent = numbered(scored, keys_, [-F.col("node_no")], out="_age")
    folded = recent.groupBy(*keys_).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_age") >= window, F.col("fitness"))).alias("best_before"),
        F.max(F.when(F.col("_age") < window, F.col("fitness"))).alias("recent_best"),
    )
    stuck = (F.col("_n") > window) & (F.col("recent_best") <= F.col("best_before") + epsilon)
    return folded.select(*keys, "best_before", "recent_best", F.coalesce(stuck, F.lit(False)).alias("stagnant"))


def verdict(df: DataFrame, dry: float = 0.01, regression: float = 0.02) -> DataFrame:
    """STOP, REGRESSION, DRY or CONTINUE for each (baseline, current) row."""
    delta = F.col("current") - F.col("baseline")
    label = F.when(delta.isNull(), "STOP").when(delta <= -regression, "REGRESSION").when(delta < dry, "DRY").otherwise("CONTINUE")
    return df.withColumn("delta", delta).withColumn("verdict", label)


def action_stats(
    results: DataFrame, priors: DataFrame | None = None, discount: float = 0.3, failed_reward: float = -1.0
) -> DataFrame:
    """Visits and mean reward per action; earlier runs count with a discount.

    ``results``: ``action_id, reward``.  ``priors``: ``action_id, fitness, failed``.
    """
    weighted = results.select("action_id", F.lit(1.0).alias("w"), F.col("reward").cast("double").alias("r"))
    if priors is not None:
        earlier = priors.where(F.col("action_id").isNotNull()).select(
            "action_id", F.lit(discount).alias("w"),
            F.when(F.col("failed"), F.lit(failed_reward)).otherwise(F.col("fitness").cast("double")).alias("r"),
        ).where(F.col("r").isNotNull())
        weighted = weighted.unionByName(earlier)
    return weighted.groupBy("action_id").agg(
        F.sum("w").alias("visits"), F.sum(F.col("w") * F.col("r")).alias("total_reward")
    ).withColumn("average_reward", F.col("total_reward") / F.col("visits"))


def failed_prior(status: Column, decision: Column, outcome: Column) -> Column:
    """Did an earlier node fail: buggy, reverted, rolled back, or a REGRESSION / STOP verdict?"""
    return (
        F.coalesce(status.isin("buggy", "reverted"), F.lit(False)) | F.coalesce(decision == "rolled_back", F.lit(False))
        | F.coalesce(F.upper(outcome).isin("REGRESSION", "STOP"), F.lit(False))
    )


def explore_weight(progress: float, floor: float = 0.2) -> float:
    """Share of the exploration constant left at a point of the search budget (0..1)."""
    done = min(1.0, max(0.0, progress))
    return max(floor, min(1.0, 1.0 - (done - 0.5) * (1.0 - floor) / 0.2))


def action_scores(stats: DataFrame, parent_visits: int, exploration: float = EXPLORATION) -> DataFrame:
    """Upper confidence score of each visited action."""
    bonus = F.sqrt(F.log(F.lit(float(max(parent_visits, 1)))) / F.col("visits"))
    return stats.withColumn("score", F.col("average_reward") + exploration * bonus)

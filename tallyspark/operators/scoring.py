"""Per-question scores from candidate outcomes, timings and schema links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stats import ratio

SNAPSHOT = "pred_sql_before_"  # fixed value: prefix of before-stage snapshots
NEEDLES = {"scaler": ("scale", "scaler"), "optimizer": ("optimiz", "optimizer"), "selector": ("select", "selector")}


def efficiency_score(timings: DataFrame, correct: DataFrame) -> DataFrame:
    """Root of the mean gold/predicted time ratio, outliers dropped; 0 when the result is wrong.

    ``timings``: ``instance_id, repeat, gold_s, pred_s``; ``correct``:
    ``instance_id, correct``.  Timings of wrong answers are dropped first.
    """
    right = correct.where("correct").select("instance_id")
    rows = timings.where(F.col("pred_s") > 1e-6).join(right, "instance_id", "left_semi").select(
        "instance_id", (F.col("gold_s") / F.col("pred_s")).alias("r")
    )
    spread = rows.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s")
    )
    kept = rows.join(spread, "instance_id").where(
        (F.col("n") < 3) | (F.col("s") == 0) | (F.abs(F.col("r") - F.col("m")) <= 2 * F.col("s"))
    )
    means = kept.groupBy("instance_id").agg(F.sqrt(F.avg("r")).alias("v"))
    return correct.join(means, "instance_id", "left").select(
        "instance_id", F.when(F.col("correct").isNotNull(), F.coalesce("v", F.lit(0.0))).alias("ves"),
        F.when(F.col("correct").isNotNull(), F.least(F.lit(1.0), F.coalesce("v", F.lit(0.0)))).alias("rves"),
    )


def candidate_outcomes(candidates: DataFrame) -> DataFrame:
    """First, best and valid counts over the candidates of a question.

    ``candidates``: ``instance_id, candidate, ex, exec_error``.
    """
    known = F.col("ex").isNotNull()
    clean = F.col("exec_error").isNull()
    return candidates.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(clean).alias("valid_sql_count"),
        F.min_by(F.when(known, F.col("ex")), F.when(known, F.col("candidate"))).alias("first_ex"), F.max("ex").alias("oracle_ex"),
        F.min(F.when(F.col("ex") == 1, F.col("candidate"))).alias("best_candidate"),
        F.count_if(~clean).alias("exec_error_count"),
        ratio(F.count_if(clean), F.count(F.lit(1))).alias("valid_rate"),
    )


def pass_at_k(candidates: DataFrame, k: int) -> DataFrame:
    """1 when one of the first k candidates is correct, NULL when none was scored."""
    return candidates.where(F.col("candidate") <= k).groupBy("instance_id").agg(F.max("ex").alias("pass_at_k"))


def selection_outcome(oracle: Column, first: Column, selected: Column) -> Column:
    return F.struct(
        oracle.alias("oracle_ex"), first.alias("first_ex"), selected.alias("selected_ex"),
        (selected - first).alias("selection_gain"), (oracle - selected).alias("selection_loss"),
        F.coalesce((oracle == 1) & (selected == 0), F.lit(False)).alias("missed_correct"),
    )


def refinement_outcome(before: Column, after: Column) -> Column:
    return F.struct(
        before.alias("ex_before"), after.alias("ex_after"),
        F.coalesce((before == 0) & (after == 1), F.lit(False)).alias("fix_success"),
        F.coalesce((before == 1) & (after == 0), F.lit(False)).alias("degradation"),
    )


def before_key(snapshots: Column, needles: tuple[str, ...], stage_id: str | None = None) -> Column:
    """Key of the snapshot taken before a stage: exact name first, else a name that contains a needle."""
    keys = F.map_keys(snapshots)

    def fits(key: Column) -> Column:
        suffix = F.lower(F.substring(key, len(SNAPSHOT) + 1, 10_000))
        hit = F.lit(False)
        for needle in needles:
            hit = hit | suffix.contains(needle)
        return key.startswith(SNAPSHOT) & hit

    loose = F.get(F.filter(keys, fits), F.lit(0))
    if not stage_id:
        return loose
    exact = F.lit(f"{SNAPSHOT}{stage_id}")
    return F.when(F.array_contains(keys, exact), exact).otherwise(loose)


def stage_deltas(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Before/after blocks per sample for the scaler, optimizer, selector and decomposer.

    ``samples``: ``instance_id, pred_sql array, snapshots map<string, array>,
    sub_questions array, debug_turns``; ``scores``: ``instance_id, sql, ex``.
    """
    lists = samples.select(
        "instance_id", F.col("pred_sql").alias("final"),
        *[F.try_element_at("snapshots", before_key(F.col("snapshots"), n)).alias(k) for k, n in NEEDLES.items()],
    )
    named = F.array(*[F.struct(F.lit(k).alias("list"), F.col(k).alias("sqls")) for k in ("final", *NEEDLES)])
    rows = (
        lists.select("instance_id", F.explode(named).alias("l"))
        .select("instance_id", "l.list", F.posexplode("l.sqls").alias("pos", "sql")).where(F.col("sql") != "")
        .join(scores, ["instance_id", "sql"], "left")
    )
    folds = []
    for k in ("final", *NEEDLES):
        mine = F.col("list") == k
        folds += [
            F.min_by(F.struct("ex"), F.when(mine, F.col("pos"))).alias(f"{k}_head"),
            F.min_by(F.when(mine, F.col("ex")), F.when(mine & F.col("ex").isNotNull(), F.col("pos"))).alias(f"{k}_first"),
            F.max(F.when(mine, F.col("ex"))).alias(f"{k}_max"),
        ]
    folded = rows.groupBy("instance_id").agg(*folds)
    joined = samples.join(lists.drop("final"), "instance_id").join(folded, "instance_id", "left")
    sqls = F.filter("pred_sql", lambda x: x != "")
    has = {k: F.col(k).isNotNull() for k in NEEDLES}
    pass_1, pass_k = F.col("scaler_head.ex"), F.col("final_max")

    def block(name: str, **fields: Column) -> Column:
        cells = [F.when(has[name], c).alias(f) for f, c in fields.items()]
        return F.struct(has[name].alias(f"has_{name}"), *cells)

    before, after = F.col("optimizer_head.ex"), F.col("final_max")
    oracle, first, chosen = F.col("selector_max"), F.col("selector_first"), F.col("final_head.ex")
    asked = F.coalesce(F.size("sub_questions"), F.lit(0))
    asked = F.when(asked > 0, asked).otherwise(0)
    return joined.select(
        "instance_id",
        block("scaler", candidate_count=F.size(sqls), candidate_diversity=ratio(F.size(F.array_distinct(sqls)), F.size(sqls)),
              pass_1=pass_1, pass_k=pass_k, scaler_gain=pass_k - pass_1).alias("scaler"),
        block("optimizer", ex_before=before, ex_after=after, fix_success=refinement_outcome(before, after)["fix_success"],
              degradation=refinement_outcome(before, after)["degradation"], debug_turns=F.col("debug_turns")).alias("optimizer"),
        block("selector", candidate_count=F.size("selector"), oracle_ex=oracle, first_ex=first, selected_ex=chosen,
              selection_gain=chosen - first, selection_loss=oracle - chosen).alias("selector"),
        F.struct((asked > 0).alias("has_decomposer"), asked.alias("sub_question_count")).alias("decomposer"),
    )


def reliability(df: DataFrame) -> DataFrame:
    """+1 / 0 / −1 per answer; ``null`` marks an abstention on either side."""
    gold, pred = F.col("gold_answer"), F.col("pred_answer")
    score = F.when(gold == pred, 1).when((gold != "null") & (pred == "null"), 0).otherwise(-1)
    return df.withColumn("score", score)


def reliability_score(df: DataFrame) -> DataFrame:
    """Mean score ×100 with wrong answers weighted 0, 5, 10 and N."""
    scored = reliability(df)
    right, wrong, n = F.count_if(F.col("score") == 1), F.count_if(F.col("score") == -1), F.count(F.lit(1))
    cells = {f"accuracy{p}": 100.0 * (right - wrong * (n if p == "N" else p)) / n for p in (0, 5, 10, "N")}
    return scored.agg(*[c.alias(name) for name, c in cells.items()])


def _covers(gold: Column, pred: Column, substring: bool) -> Column:
    return F.instr(gold, pred) > 0 if substring else gold == pred


def linking_scores(df: DataFrame, gold: str = "gold_schemas", pred: str = "pred_schemas", substring: bool = True) -> DataFrame:
    """Link recall, precision and the two exactness variants.

    A predicted link covers a gold link when it is contained in its text
    (``substring=False`` asks for equality).  NULL without gold or prediction.
    """
    links = F.array_distinct(pred)
    covered = F.size(F.filter(gold, lambda g: F.exists(links, lambda p: _covers(g, p, substring))))
    useful = F.size(F.filter(links, lambda p: F.exists(gold, lambda g: _covers(g, p, substring))))
    known = (F.size(gold) > 0) & F.col(pred).isNotNull()
    recall = F.when(known, covered / F.size(gold))
    precision = F.when(known, F.coalesce(ratio(useful, F.size(links)), F.lit(0.0)))
    same = (F.size(F.array_except(gold, pred)) == 0) & (F.size(F.array_except(pred, gold)) == 0)
    return df.withColumn("link_recall", recall).withColumn("link_precision", precision).withColumn(
        "link_exact_ref", recall == precision
    ).withColumn("link_exact", F.when(known, same))


def reduce_rate(df: DataFrame, pred: str = "pred_schemas") -> DataFrame:
    """Selected columns over database size, NULL when either is missing."""
    return df.withColumn("reduce_rate", F.when(F.col("db_size") > 0, F.size(F.array_distinct(pred)) / F.col("db_size")))


def missing_and_extra(df: DataFrame, gold: str = "gold_schemas", pred: str = "pred_schemas") -> DataFrame:
    """Gold links not covered by any prediction, and predictions outside gold, sorted."""
    uncovered = F.filter(F.array_distinct(gold), lambda g: ~F.exists(pred, lambda p: F.instr(g, p) > 0))
    return df.withColumn("missing", F.array_sort(uncovered)).withColumn(
        "extra", F.array_sort(F.array_except(pred, gold))
    )

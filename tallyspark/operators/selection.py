"""Clustering of candidates by result or structure, voting and selection.

Everything is an aggregate per (question, cluster) followed by an aggregate per
question; ordering ties fall back to the candidate number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.hashing import draw
from tallyspark.functions.ordered import numbered
from tallyspark.operators import compare

FIRST_BONUS = 0.4  # fixed value: bonus of the first candidate
RANKED_COLUMNS = 4  # fixed value: columns of one ranking that may vote


def cluster_by_result(cells: DataFrame, tolerant: bool = False) -> DataFrame:
    """``cluster`` = first candidate with the same result; failed candidates have no cells.

    Exact mode groups order-free digests.  Tolerant mode lets a result join
    the first earlier cluster whose leader's columns it covers.
    """
    digests = compare.rowset_digest(cells, 2 if not tolerant else None)
    leaders = digests.groupBy("instance_id", "digest").agg(F.min("candidate").alias("cluster"))
    exact = digests.join(leaders, ["instance_id", "digest"]).drop("digest")
    return _merge_tolerant(cells, exact) if tolerant else exact


def _merge_tolerant(cells: DataFrame, exact: DataFrame) -> DataFrame:
    """Merge exact clusters whose leaders agree within tolerance, earliest leader first.

    Copies are collapsed before, so only leaders of equal length are compared.
    """
    leaders = exact.where(F.col("candidate") == F.col("cluster")).select("instance_id", "candidate")
    columns = cells.groupBy("instance_id", "candidate", "col_no").agg(F.count(F.lit(1)).alias("n"))
    shapes = columns.groupBy("instance_id", "candidate").agg(F.max("n").alias("n_rows"), (F.max("col_no") + 1).cast("bigint").alias("n_cols"))
    # Joined by instance alone, as the cells are dealt, and met by aggregates, cells are not shuffled again.
    wanted = leaders.join(shapes, ["instance_id", "candidate"]).groupBy("instance_id").agg(F.collect_list(F.struct("candidate", "n_rows", "n_cols")).alias("_w"))
    kept = cells.join(wanted, "instance_id").withColumn("_w", F.expr("filter(_w, w -> w.candidate = candidate)")).where(F.size("_w") > 0)
    sized = compare._sorted_values(kept, cells).select("*", F.col("_w")[0]["n_rows"].alias("n_rows"), F.col("_w")[0]["n_cols"].alias("r_cols"))
    rows = sized.groupBy("instance_id", "n_rows", "row_no").agg(
        F.collect_list(F.struct("candidate", "col_no", "num_value", "str_value", "r_cols")).alias("cs"))
    joined = rows.select("instance_id", "n_rows", "cs", F.explode("cs").alias("l")).select(
        "instance_id", "n_rows", "l", F.explode(F.expr("filter(cs, c -> c.candidate < l.candidate)")).alias("r"))
    agree = (
        joined.groupBy("instance_id", F.col("l.candidate").alias("left_id"), F.col("r.candidate").alias("right_id"), "n_rows", "r.r_cols",
                       F.col("l.col_no"), F.col("r.col_no").alias("r_col"))
        .agg(F.count_if(compare._same_cell("l", "r")).alias("same"))
        .where(F.col("same") == F.col("n_rows"))
        .groupBy("instance_id", "left_id", "right_id", "r_cols").agg(F.count_distinct("r_col").alias("covered"))
        .where(F.col("covered") == F.col("r_cols"))
        .groupBy("instance_id", "left_id").agg(F.collect_list("right_id").alias("fits"))
    )
    chain = (
        leaders.join(agree.withColumnRenamed("left_id", "candidate"), ["instance_id", "candidate"], "left")
        .groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct(
            F.col("candidate").cast("bigint").alias("c"),
            F.coalesce(F.col("fits").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("fits")))).alias("cs"))
    )
    placed = F.expr(
        "aggregate(cs, CAST(array() AS array<struct<c: bigint, cluster: bigint>>), (done, x) -> concat(done, array(struct(x.c AS c, "
        "coalesce(get(filter(transform(filter(done, d -> d.c = d.cluster), d -> d.c), d -> array_contains(x.fits, d)), 0), x.c) AS cluster))))"
    )
    merged = chain.select("instance_id", F.explode(placed).alias("p")).select(
        "instance_id", F.col("p.c").alias("cluster"), F.col("p.cluster").alias("merged")
    )
    return exact.join(merged, ["instance_id", "cluster"]).select("instance_id", "candidate", F.col("merged").alias("cluster"))


def _clusters(clustered: DataFrame, *extra) -> DataFrame:
    return clustered.groupBy("instance_id", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min("candidate").alias("first"), *extra
    )


def select_majority_fastest(clustered: DataFrame) -> DataFrame:
    """Fastest run of the biggest cluster; when no two agree, the fastest overall."""
    fastest = F.min(F.struct("elapsed", "candidate")).alias("fastest")
    per = _clusters(clustered, fastest).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("runs"), F.max("size").alias("votes"),
        F.max_by("fastest", F.struct("size", -F.col("first"))).alias("in_best"), F.min("fastest").alias("overall"),
    )
    alone = F.col("clusters") == F.col("runs")
    chosen = F.when(alone, F.col("overall.candidate")).otherwise(F.col("in_best.candidate"))
    return per.select("instance_id", chosen.alias("chosen"), "votes", "runs")


def select_majority_first(clustered: DataFrame, tie: str = "first", seed: int = 42) -> DataFrame:
    """First candidate of the biggest cluster; ties by earliest cluster or a seeded draw."""
    last = F.struct("size", -F.col("first"))
    if tie == "random":
        last = F.struct(F.col("size"), draw(F.concat_ws("|", F.col("instance_id").cast("string"), F.col("first").cast("string")), seed), -F.col("first"))
    return _clusters(clustered).groupBy("instance_id").agg(
        F.max_by("first", last).alias("chosen"), F.max("size").alias("votes"), F.sum("size").alias("runs")
    )


def select_cluster_then_structure(clustered: DataFrame) -> DataFrame:
    """Biggest cluster, then its best structure score, then the best member."""
    best = F.max(F.struct("score", (-F.col("candidate")).alias("neg"))).alias("best")
    return _clusters(clustered, best).groupBy("instance_id").agg(
        F.max_by(-F.col("best.neg"), F.struct("size", "best.score", -F.col("first"))).alias("chosen"),
        F.max("size").alias("votes"),
    )


def cluster_by_structure(components: DataFrame) -> DataFrame:
    """Equal table, select, where, group and order sets; biggest cluster first.

    Input: ``instance_id, candidate`` and the set columns of ``sql_components``.
    """
    parts = [F.array_join(F.array_sort(F.array_distinct(c)), compare.SEPARATOR) for c in
             ("c_join", "c_select", "c_where", "c_group", "c_order")]
    keyed = components.withColumn("_k", F.concat_ws("\x1e", *parts))
    leaders = keyed.groupBy("instance_id", "_k").agg(F.min("candidate").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return keyed.join(leaders, ["instance_id", "_k"]).select("instance_id", "candidate", "cluster", "size")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Executable candidates by score (first one gets a bonus), one row per distinct SQL."""
    score = F.col("score") + F.when(F.col("candidate") == 1, FIRST_BONUS).otherwise(0.0)
    distinct = (
        candidates.where("ok").withColumn("score", score).groupBy("instance_id", "sql")
        .agg(F.max(F.struct("score", (-F.col("candidate")).alias("neg"))).alias("b"))
        .select("instance_id", "sql", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("candidate"))
    )
    return numbered(distinct, ["instance_id"], [-F.col("score"), F.col("candidate"), F.col("sql")], out="rank", start=1)


def tournament_score(outcomes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each won comparison adds the loser's cluster size; highest total wins.

    ``outcomes``: ``instance_id, left_id, right_id, left_wins, left_size, right_size``.
    """
    wins = outcomes.where(F.col("left_wins").isNotNull()).select(
        "instance_id", F.when(F.col("left_wins"), F.col("left_id")).otherwise(F.col("right_id")).alias("candidate"),
        F.when(F.col("left_wins"), F.col("right_size")).otherwise(F.col("left_size")).alias("gain"),
    ).groupBy("instance_id", "candidate").agg(F.sum("gain").alias("gain"))
    return candidates.join(wins, ["instance_id", "candidate"], "left").withColumn(
        "score", F.col("score") + F.coalesce("gain", F.lit(0))
    ).drop("gain")


def best_by_score(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("instance_id").agg(
        F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("chosen"), F.max("score").alias("score")
    )


def vote_tables(rankings: DataFrame, catalogs: DataFrame, top_k: int) -> DataFrame:
    """Most common table set over all growing prefixes of the rankings, padded to ``top_k``.

    ``rankings``: ``instance_id, ranking_no, tables array``; ``catalogs``:
    ``instance_id, known array``.  Arrays are as long as a catalog has tables.
    """
    known = rankings.join(catalogs, "instance_id").withColumn("low", F.transform("known", F.lower))
    prefixes = F.expr(
        "transform(sequence(1, size(tables)), i -> array_distinct(filter(transform(slice(tables, 1, i), t -> lower(t)), t -> array_contains(low, t))))"
    )
    cut = F.expr(f"filter(prefixes, (p, i) -> i = 0 OR size(prefixes[i - 1]) < {int(top_k)})")
    votes = (
        known.where(F.size("tables") > 0).withColumn("prefixes", prefixes)
        .select("instance_id", "ranking_no", F.posexplode(cut).alias("pos", "selected"))
        .groupBy("instance_id", F.array_sort("selected").alias("_set"))
        .agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("ranking_no", "pos", "selected")).alias("first"))
        .groupBy("instance_id")
        .agg(F.max_by(F.struct("first.selected", "votes"),
                      F.struct("votes", -F.col("first.ranking_no"), -F.col("first.pos"))).alias("w"))
    )
    named = F.expr("transform(w.selected, s -> element_at(known, CAST(array_position(transform(known, t -> lower(t)), s) AS INT)))")
    padded = F.slice(F.concat(F.col("named"), F.array_except("known", "named")), 1, top_k)
    return (
        catalogs.join(votes, "instance_id", "left")
        .withColumn("named", F.coalesce(named, F.array().cast("array<string>")))
        .select("instance_id", padded.alias("tables"), F.col("w.votes").alias("votes"))
    )


def vote_columns(results: DataFrame, catalogs: DataFrame, top_k: int) -> DataFrame:
    """Most voted columns per table; each ranking gives its first four known columns.

    ``results``: ``instance_id, ranking_no, table_name, columns array``;
    ``catalogs``: ``instance_id, table_name, known array``.
    """
    joined = results.join(catalogs, ["instance_id", "table_name"])
    existing = F.expr(
        f"slice(filter(transform(columns, c -> get(filter(known, k -> lower(k) = lower(c)), 0)), k -> k IS NOT NULL), 1, {RANKED_COLUMNS})"
    )
    votes = (
        joined.select("instance_id", "table_name", "ranking_no", F.posexplode(existing).alias("pos", "column_name"))
        .groupBy("instance_id", "table_name", "column_name")
        .agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("ranking_no", "pos")).alias("seen"))
    )
    order = Window.partitionBy("instance_id", "table_name").orderBy(F.desc("votes"), "seen")
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("seen")


def vote_database(votes: DataFrame, seed: int = 42) -> DataFrame:
    """Database with the largest total weight; a seeded draw breaks ties."""
    weights = votes.groupBy("instance_id", "db_id").agg(F.sum("weight").alias("weight"))
    tie = draw(F.concat_ws("|", F.col("instance_id").cast("string"), "db_id"), seed)
    return weights.groupBy("instance_id").agg(
        F.max_by("db_id", F.struct("weight", tie, "db_id")).alias("db_id"), F.max("weight").alias("weight")
    )


def merge_outputs(outputs: DataFrame, strategy: str = "overwrite", executable_only: bool = False) -> DataFrame:
    """Merge the values of several producers of one key.

    ``overwrite`` keeps the last; ``append`` and ``extend`` give the ordered
    list (``extend`` takes array values).  Lists hold one entry per producer.
    """
    rows = outputs.where("ok") if executable_only else outputs
    if strategy == "overwrite":
        return rows.groupBy("instance_id", "key").agg(F.max_by("value", "producer_no").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("producer_no", "value")))["value"]
    if strategy == "append":
        return rows.groupBy("instance_id", "key").agg(ordered.alias("value"))
    if strategy == "extend":
        return rows.groupBy("instance_id", "key").agg(F.flatten(ordered).alias("value"))
    raise ValueError(f"unknown merge strategy {strategy!r}")

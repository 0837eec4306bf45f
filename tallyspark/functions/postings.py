"""Exact top-k by weighted terms over an inverted index.

Postings (term, item, weight) meet the terms that are asked for by an equi-join, partial scores are added up before the
shuffle, and a bound per term says when to stop: a query's terms are taken from the rarest on, and once the terms that are
left cannot lift an item to the k-th best score so far, items that hold none of the others are out.  The left terms, the
most frequent ones, are then looked up for the few items that may still win.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written

#: Postings of a term that meet in one task; a more frequent term is dealt into parts by item.
PART_ROWS = 1 << 18
#: Share of a query's postings that is read to find a first score to beat.
HEAD = 0.1


def _part(item: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(item), parts).cast("int")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """query_id, kth: the k-th best score of each query that has as many items."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    ranked = scores.select("query_id", "score", F.row_number().over(best).alias("_r")).where(F.col("_r") <= k)
    return ranked.where(F.col("_r") == k).select("query_id", F.col("score").alias("kth"))


def _total(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "item_id").agg(F.sum("score").alias("score"))


def top_items(asked: DataFrame, postings: DataFrame, k: int, group: Sequence[str] = (), digits: int = 6, part_rows: int | None = None, head: float = HEAD) -> DataFrame:
    """Best ``k`` items per query by the sum of query weight × item weight over shared terms: ``query_id, item_id, score, rank``.

    ``asked``: ``query_id, term, weight``; ``postings``: ``item_id, term, weight``; both with the ``group`` columns, and
    one row per id and term.  Scores are rounded before ranking, ties go to the smaller item; an item without a shared
    term is not returned.  Item weights may be negative, query weights not.  With a ``head`` of 1 all terms are scored at
    once, which is cheaper where weights are alike and bounds can rule out little.
    """
    keys = [*group, "term"]
    part_rows = part_rows or PART_ROWS
    # The postings, the terms with their bounds and the scores of each round are read several times and written once.
    postings = written(postings.select(*keys, "item_id", "weight").repartition(*keys, "item_id"), "postings")
    stats = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("peak"), F.min("weight").alias("low"))
    stats = stats.withColumn("parts", F.ceil(F.col("df") / part_rows).cast("int"))
    frequent = stats.where(F.col("parts") > 1).select(*keys, "parts")  # at most one term per ``part_rows`` postings
    dealt = postings.join(frequent, keys, "left").withColumn("part", F.coalesce(_part(F.col("item_id"), F.col("parts")), F.lit(0)))
    index = dealt.select(*keys, "part", "item_id", F.col("weight").alias("held"))

    rarest = Window.partitionBy("query_id").orderBy("df", *keys)
    bound = F.col("weight") * F.greatest("peak", F.lit(0.0))
    plan = asked.join(stats, keys).select(
        "query_id", *keys, "weight", "parts",
        F.sum(bound).over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("from_here"),
        F.sum(F.col("weight") * F.least("low", F.lit(0.0))).over(Window.partitionBy("query_id")).alias("loss"),
        ((F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= head * F.sum("df").over(Window.partitionBy("query_id")))
         | (F.row_number().over(rarest) == 1)).alias("first"))

    def scores(terms: DataFrame) -> DataFrame:
        spread = terms.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = spread.join(index, [*keys, "part"]).select("query_id", "item_id", (F.col("weight") * F.col("held")).alias("score"))
        return _total(met)

    def best(total: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        rounded = total.withColumn("score", F.round("score", digits) + 0.0)
        return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    if head >= 1:
        return best(scores(plan))
    plan = written(plan, "plan")
    error = 10.0 ** -digits
    begun = written(scores(plan.where("first")), "begun")
    staged = plan.join(_kth(begun, k), "query_id", "left").withColumn(
        "needed", F.col("first") | F.col("kth").isNull() | (F.col("from_here") >= F.col("kth") + F.col("loss") - error))
    further = scores(staged.where("needed AND NOT first"))
    partial = written(_total(begun.unionByName(further)), "partial")
    tail = staged.where("NOT needed").select("query_id", *keys, "weight", "parts", "from_here")
    open_rest = staged.groupBy("query_id").agg(F.max("loss").alias("loss"), F.coalesce(F.max(F.when(~F.col("needed"), F.col("from_here"))), F.lit(0.0)).alias("rest"))
    limits = open_rest.join(_kth(partial, k), "query_id", "left")
    alive = partial.join(limits, "query_id").where(F.col("kth").isNull() | (F.col("score") + F.col("rest") >= F.col("kth") + F.col("loss") - error)).select("query_id", "item_id", "score")
    missing = alive.select("query_id", "item_id").join(tail, "query_id").withColumn("part", _part(F.col("item_id"), F.col("parts")))
    rest = missing.join(index, [*keys, "part", "item_id"]).select("query_id", "item_id", (F.col("weight") * F.col("held")).alias("score"))
    return best(_total(alive.unionByName(rest)))

"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common prefix of turns is rendered once as the prompt.  The rest of either side is its completion; its mask is
the character ranges that a trainer learns from: what the assistant says, with the mark that ends the turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table

BEGIN, END, LEARNT = "<|im_start|>", "<|im_end|>", "assistant"
SAFE = "<​|"  # what "<|" in a text becomes, so that no text can pose as a mark


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turns: each conversation's turns (role, text) by turn number; one shuffle by conversation.

    Rows without a conversation id belong to none and are left out; equal rows count once; rows with one turn number are
    ordered by role and text; a null turn number comes first; null roles and texts are empty.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    found = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_set(row)).alias("__rows"))
    return found.select("conv_id", F.transform("__rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns both conversations begin with."""
    differs = F.transform(F.arrays_zip(chosen.alias("c"), rejected.alias("r")), lambda z: ~z["c"].eqNullSafe(z["r"]))
    return F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)) - 1, F.size(differs)).cast("int")


def rendered(turns: Column) -> Column:
    """The text of each turn with its marks."""
    return F.transform(turns, lambda t: F.concat(F.lit(BEGIN), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(END + "\n")))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit(SAFE))


def learnt_ranges(turns: Column) -> Column:
    """(start, stop) character ranges, in the rendered turns behind each other, of what assistants say with the end mark."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("ranges"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(BEGIN) + F.length(_safe(t["role"])) + 1
        stop = start + F.length(_safe(t["text"])) + len(END)
        one = F.array(F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop")))
        return F.struct((stop + 1).cast("bigint").alias("at"), F.when(t["role"] == LEARNT, F.concat(acc["ranges"], one)).otherwise(acc["ranges"]).alias("ranges"))

    return F.aggregate(turns, zero, add, lambda acc: acc["ranges"])


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """``pairs`` with n_common, prompt, chosen, rejected (texts) and chosen_mask, rejected_mask (learnt ranges) instead of the turns.

    Both sides are arrays of (role, text).  A null side is one without turns.  When one side is the beginning of the other,
    its completion is empty and has no ranges; equal sides have two empty completions.  Row-local; extra columns stay.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.withColumn("__c", F.coalesce(chosen_col, none)).withColumn("__r", F.coalesce(rejected_col, none))
    sides = sides.withColumn("__n", common_turns(F.col("__c"), F.col("__r")))
    parts = sides.withColumn("__prompt", F.slice("__c", F.lit(1), F.col("__n")))
    for side in ("__c", "__r"):
        parts = parts.withColumn(side, F.slice(side, F.col("__n") + 1, F.greatest(F.size(side) - F.col("__n"), F.lit(0))))
    made = ("n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    kept = [c for c in pairs.columns if c not in (chosen_col, rejected_col, *made)]
    text = {c: F.array_join(rendered(F.col(c)), "") for c in ("__prompt", "__c", "__r")}
    return parts.select(*kept, F.col("__n").alias("n_common"), text["__prompt"].alias("prompt"), text["__c"].alias("chosen"), text["__r"].alias("rejected"),
                        learnt_ranges(F.col("__c")).alias("chosen_mask"), learnt_ranges(F.col("__r")).alias("rejected_mask"))


def last_reply(turns: Column) -> Column:
    """Place of the last assistant turn, counted from 1; null without one."""
    roles = F.reverse(F.transform(turns, lambda t: t["role"]))
    return F.size(turns) + 1 - F.nullif(F.array_position(roles, LEARNT), F.lit(0))


def next_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """``ids`` (distinct ``id_col``, and ``__part``, its range) with ``__next``: the next larger id, for the last one the first.

    Neighbours within a range come from the sorted range; the first ids of the ranges, one row each, tell what follows a range.
    """
    first = ids.groupBy("__part").agg(F.min(id_col).alias("__first"))
    of_ranges = Window.orderBy("__part")  # as many rows as there are ranges
    beyond = first.select("__part", F.coalesce(F.lead("__first").over(of_ranges), F.min("__first").over(Window.partitionBy())).alias("__beyond"))
    inside = F.lead(id_col).over(Window.partitionBy("__part").orderBy(id_col))
    return ids.withColumn("__inside", inside).join(beyond, "__part").select(id_col, F.coalesce("__inside", "__beyond").alias("__next"))


def reply_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """pair_id, chosen, rejected from plain conversations: the rejected side ends in the last reply of the next conversation.

    Chosen is the whole conversation; rejected has the turns before its last assistant turn and then the last assistant turn
    of the conversation with the next larger id that has one, the last conversation that of the first.  A conversation
    without a reply makes no pair, nor does the only one that has a reply.
    """
    own = conversations_of(turns, id_col).withColumn("__at", last_reply(F.col("turns"))).where("__at IS NOT NULL")
    # Written once by range of ids, so a range means the same to all that read it.
    own = shared_table(own.repartitionByRange("conv_id").withColumn("__part", F.spark_partition_id()), "conversations")
    follows = next_ids(own.select("conv_id", "__part"), "conv_id").where("conv_id <> __next")
    given = own.select(F.col("conv_id").alias("__next"), F.element_at("turns", F.col("__at").cast("int")).alias("__other"))
    return own.join(follows, "conv_id").join(given, "__next").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("__at") - 1), F.array("__other")).alias("rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = format_preferences(reply_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def ranges(column: str) -> Column:
        return F.array_join(F.transform(column, lambda r: F.concat_ws("-", r["start"], r["stop"])), ",").alias(column)

    return made.select("pair_id", "n_common", "prompt", "chosen", "rejected", ranges("chosen_mask"), ranges("rejected_mask"))


def _sql_text(turns: str) -> str:
    safe = "replace({}, '<|', '<' || chr(8203) || '|')"
    one = f"'{BEGIN}' || {safe.format('x.role')} || chr(10) || {safe.format('x.text')} || '{END}' || chr(10)"
    return f"array_to_string([{one} FOR x IN {turns}], '')"


def _sql_mask(turns: str) -> str:
    safe = "replace({}, '<|', '<' || chr(8203) || '|')"
    size = f"(length({safe.format('y.role')}) + length({safe.format('y.text')}) + {len(BEGIN) + len(END) + 2})"
    before = f"coalesce(list_sum([{size} FOR y IN {turns}[:k - 1]]), 0)"
    start = f"({before} + {len(BEGIN) + 1} + length({safe.format(turns + '[k].role')}))"
    stop = f"({start} + length({safe.format(turns + '[k].text')}) + {len(END)})"
    return f"array_to_string([CAST({start} AS BIGINT) || '-' || CAST({stop} AS BIGINT) FOR k IN range(1, len({turns}) + 1) IF {turns}[k].role = '{LEARNT}'], ',')"


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
o AS (SELECT conv_id, turns, len(turns) + 1 - list_position(list_reverse([x.role FOR x IN turns]), '{LEARNT}') AS pos FROM c
      WHERE list_contains([x.role FOR x IN turns], '{LEARNT}')),
f AS (SELECT conv_id, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS follower FROM o),
p AS (SELECT a.conv_id AS pair_id, a.turns AS ch, list_append(a.turns[:a.pos - 1], b.turns[b.pos]) AS re FROM o a JOIN f USING (conv_id) JOIN o b ON b.conv_id = f.follower AND b.conv_id <> a.conv_id),
n AS (SELECT *, coalesce(list_position([ch[k] IS DISTINCT FROM re[k] FOR k IN range(1, greatest(len(ch), len(re)) + 1)], true) - 1, greatest(len(ch), len(re))) AS n_common FROM p),
s AS (SELECT pair_id, CAST(n_common AS INT) AS n_common, ch[:n_common] AS pr, ch[n_common + 1:] AS ch, re[n_common + 1:] AS re FROM n)
SELECT pair_id, n_common, {_sql_text('pr')} AS prompt, {_sql_text('ch')} AS chosen, {_sql_text('re')} AS rejected,
       {_sql_mask('ch')} AS chosen_mask, {_sql_mask('re')} AS rejected_mask
FROM s"""

"""Exact similarity join on edit distance.

A text of length n with at most d edits, cut into d + 1 segments, must keep one
segment unchanged near its place.  Segments meet by an equi-join, and only the
pairs that share one are verified.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.words import edit_ratio


def _segments(cutoff: float) -> str:
    """SQL of the segment count for a text of length ``n``: allowed edits + 1."""
    return f"CAST(floor({1 - cutoff} * floor(n / {cutoff} + 1e-9) + 1e-9) AS INT) + 1"


def edit_join(left: DataFrame, right: DataFrame, cutoff: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs ``(left_text, right_text, ratio)`` with edit ratio ≥ ``cutoff``, within equal keys.

    ``left`` has ``left_text``, ``right`` has ``right_text``; both are made
    distinct first, so repeated texts cost nothing.
    """
    if not 0.5 < cutoff <= 1:
        raise ValueError("cutoff must lie in (0.5, 1]")
    keys = list(keys)
    lefts = left.select(*keys, "left_text").where(F.length("left_text") > 0).distinct()
    rights = right.select(*keys, "right_text").where(F.length("right_text") > 0).distinct()
    count = _segments(cutoff)
    pieces = F.expr(
        f"transform(sequence(0, {count} - 1), i -> struct(n AS n, i AS i, "
        f"substring(right_text, CAST(floor(i * n / ({count})) AS INT) + 1, "
        f"CAST(floor((i + 1) * n / ({count})) AS INT) - CAST(floor(i * n / ({count})) AS INT)) AS seg))"
    )
    index = rights.withColumn("n", F.length("right_text")).select(*keys, "right_text", F.explode(pieces).alias("s")).select(
        *keys, "right_text", "s.*")
    lengths = F.expr(
        f"sequence(CAST(ceil(length(left_text) * {cutoff} - 1e-9) AS INT), CAST(floor(length(left_text) / {cutoff} + 1e-9) AS INT))"
    )
    # A kept segment i lies at most i places before or after its own place, and leaves
    # at most (edits - i) for the rest of the text (multi-match-aware windows of Pass-Join).
    at = f"CAST(floor(i * n / ({count})) AS INT)"
    low = f"greatest(0, {at} + greatest(-i, length(left_text) - n - ({count} - 1 - i)))"
    high = f"least(length(left_text) - 1, {at} + least(i, length(left_text) - n + ({count} - 1 - i)))"
    probes = F.expr(
        f"flatten(transform(sequence(0, {count} - 1), i -> CASE WHEN {low} <= {high} THEN transform(sequence({low}, {high}), "
        f"p -> struct(i AS i, substring(left_text, p + 1, CAST(floor((i + 1) * n / ({count})) AS INT) - {at}) AS seg)) "
        "ELSE CAST(array() AS array<struct<i: int, seg: string>>) END))"
    )
    sizes = rights.select(*keys, F.length("right_text").alias("n")).distinct()
    probe = (
        lefts.withColumn("n", F.explode(lengths)).where("n > 0").join(sizes, [*keys, "n"])
        .select(*keys, "left_text", "n", F.explode(F.array_distinct(probes)).alias("s")).select(*keys, "left_text", "n", "s.*")
    )
    pairs = probe.join(index, [*keys, "n", "i", "seg"]).select(*keys, "left_text", "right_text").distinct()
    edits = F.floor((1 - cutoff) * F.greatest(F.length("left_text"), F.length("right_text")) + 1e-9)
    return pairs.where(F.levenshtein("left_text", "right_text") <= edits).withColumn(
        "ratio", edit_ratio(F.col("left_text"), F.col("right_text")))


def max_edits(length: int, cutoff: float) -> int:
    """Edits allowed between a text of this length and its longest partner."""
    return math.floor((1 - cutoff) * math.floor(length / cutoff + 1e-9) + 1e-9)

"""Ordered computations per key (row numbers, previous value, running totals,
exact percentiles) that stay parallel when one key owns a large part of the rows.

A plain window sorts a whole key in one task.  One map-side combined count
first asks whether any key exceeds ``hot_rows``; usually none does and a plain
window is planned.  Otherwise the large keys are cut into ordered pieces at
edges taken from their own order values, the window runs per (key, piece), and
a small table of per-piece totals carries the state across pieces.  Edges only
decide where the cut lies, never which rows are used, so results are exact.
Numbers over all rows need no edges: Spark's range partitions are the pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written

HOT_ROWS = 2_000_000
MAX_PIECES = 1000  # the planner cuts a ranking before its shuffle up to this many rows
EDGE_ROWS = 8  # rows looked at for each edge
ROW_BITS = 33  # of monotonically_increasing_id, the row in its partition
PERCENTILE_ROWS = 200_000  # up to here a key's values fit one aggregation buffer


def _named(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_ord_all", F.lit(0)), ["_ord_all"]


def _lookup(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Side of a lookup join.  Without keys it holds at most ``MAX_PIECES`` rows, so it
    is broadcast; with keys its size depends on the data and the planner decides."""
    return F.broadcast(small) if list(keys) == ["_ord_all"] else small


def has_hot_key(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> bool:
    """Does any key own more than ``hot_rows`` rows?  Only the key columns are read."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ord_n")).where(F.col("_ord_n") > limit)
    return bool(sizes.select("_ord_n").take(1))


def cut_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``_ord_piece`` (0 for ordinary keys) and ``_ord_hot``.  ``order`` should be unique per key."""
    limit = HOT_ROWS if hot_rows is None else hot_rows
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    sizes = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_ord_n"))
        .where(F.col("_ord_n") > limit)
        .withColumn("_ord_edges", F.least(F.lit(MAX_PIECES), F.ceil(F.col("_ord_n") * 4 / limit)))
        .withColumn("_ord_most", F.col("_ord_edges") * (EDGE_ROWS * 2.0**53) / F.col("_ord_n"))
        .drop("_ord_n")
    )
    by_hash = Window.partitionBy(*keys).orderBy(F.xxhash64("_ord_o"), "_ord_o")
    edges = (
        df.select(*keys, position.alias("_ord_o"))
        .join(_lookup(sizes, keys), list(keys))
        .where(F.shiftrightunsigned(F.xxhash64("_ord_o"), 11) <= F.col("_ord_most"))
        .withColumn("_ord_r", F.row_number().over(by_hash))
        .where((F.col("_ord_r") <= MAX_PIECES) & (F.col("_ord_r") <= F.col("_ord_edges")))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_ord_o")).alias("_ord_edges"))
    )
    return (
        df.withColumn("_ord_o", position)
        .join(_lookup(edges, keys), list(keys), "left")
        .withColumn("_ord_hot", F.col("_ord_edges").isNotNull())
        .withColumn(
            "_ord_piece",
            F.when(F.col("_ord_hot"), F.expr("size(filter(_ord_edges, e -> e < _ord_o))")).otherwise(F.lit(0)),
        )
        .drop("_ord_edges", "_ord_o")
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "row_no",
    start: int = 0,
    hot_rows: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Position of each row inside its key, counted from ``start``.

    ``counted`` has the keys too, and for each at least as many rows; give it where it is cheaper to count than ``df``.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    named, keys_ = _named(df, keys)
    in_ranges = not keys and _can_be_written(df)
    rows = (df if counted is None else counted).count() if in_ranges else 0
    if not (rows > limit if in_ranges else has_hot_key(named if counted is None else _named(counted, keys)[0], keys_, hot_rows)):
        inside = Window.partitionBy(*keys_).orderBy(*order)
        return named.withColumn(out, F.row_number().over(inside).cast("bigint") + (start - 1)).select(*df.columns, out)
    if in_ranges:
        return _numbered_ranges(df, order, out, start, -(-rows // limit))
    cut = cut_hot_keys(named, keys_, order, hot_rows)
    before = (
        cut.where("_ord_hot")
        .groupBy(*keys_, "_ord_piece")
        .agg(F.count(F.lit(1)).alias("_ord_c"))
        .withColumn("_ord_before", F.sum("_ord_c").over(_earlier(keys_)))
        .drop("_ord_c")
    )
    inside = Window.partitionBy(*keys_, "_ord_piece").orderBy(*order)
    return (
        cut.withColumn("_ord_r", F.row_number().over(inside))
        .join(_lookup(before, keys_), [*keys_, "_ord_piece"], "left")
        .withColumn(out, F.col("_ord_r") - 1 + start + F.coalesce("_ord_before", F.lit(0)))
        .select(*df.columns, out)
    )


def _can_be_written(df: DataFrame) -> bool:
    """Parquet has no columns without a type, none of calendar intervals, and no two names that differ by case only."""
    names = {c.lower() for c in df.columns}
    return len(names) == len(df.columns) and not any(t in f.dataType.simpleString() for f in df.schema for t in ("void", "interval", "variant"))


def _numbered_ranges(df: DataFrame, order: Sequence[Column], out: str, start: int, least: int) -> DataFrame:
    """Position of each row among all: its place in its range partition, of ``least`` or more, and the rows of the partitions before.

    The sorted rows are written once, as another run could draw other ranges; counts and numbers are read from the same rows.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)
    position = [c.alias(f"_ord_o{i}") for i, c in enumerate(order)]
    by = [f"_ord_o{i}" for i in range(len(order))]
    ranges = df.select("*", *position).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    held = written(ranges.select(*df.columns, F.monotonically_increasing_id().alias("_ord_place")), "ranges")
    piece, row = F.shiftright("_ord_place", ROW_BITS), F.col("_ord_place").bitwiseAND((1 << ROW_BITS) - 1)
    before = (
        held.groupBy(piece.alias("_ord_piece"))
        .agg(F.count(F.lit(1)).alias("_ord_c"))
        .withColumn("_ord_before", F.coalesce(F.sum("_ord_c").over(Window.orderBy("_ord_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_ord_c")
    )
    placed = held.withColumn("_ord_piece", piece).join(F.broadcast(before), "_ord_piece")
    return placed.withColumn(out, row + start + F.col("_ord_before")).select(*df.columns, out)


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_ord_piece").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    column: str,
    out: str,
    hot_rows: int | None = None,
) -> DataFrame:
    """Value of ``column`` in the row before, per key."""
    named, keys_ = _named(df, keys)
    if not has_hot_key(named, keys_, hot_rows):
        inside = Window.partitionBy(*keys_).orderBy(*order)
        return named.withColumn(out, F.lag(column).over(inside)).select(*df.columns, out)
    cut = cut_hot_keys(named, keys_, order, hot_rows)
    position = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    carry = (
        cut.where("_ord_hot")
        .groupBy(*keys_, "_ord_piece")
        .agg(F.max_by(F.struct(F.col(column).alias("v")), position).alias("_ord_last"))
        .withColumn("_ord_carry", F.lag("_ord_last").over(Window.partitionBy(*keys_).orderBy("_ord_piece")))
        .drop("_ord_last")
    )
    inside = Window.partitionBy(*keys_, "_ord_piece").orderBy(*order)
    return (
        cut.withColumn("_ord_prev", F.lag(F.struct(F.col(column).alias("v"))).over(inside))
        .join(_lookup(carry, keys_), [*keys_, "_ord_piece"], "left")
        .withColumn(out, F.coalesce("_ord_prev", "_ord_carry")["v"])
        .select(*df.columns, out)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Running sums / maxima up to and including each row: ``{out: column}``."""
    sums, maxima = sums or {}, maxima or {}
    named, keys_ = _named(df, keys)
    folds = [(out, F.sum, col) for out, col in sums.items()]
    folds += [(out, F.max, col) for out, col in maxima.items()]
    outs = [out for out, _, _ in folds]
    hot = has_hot_key(named, keys_, hot_rows)
    cut = cut_hot_keys(named, keys_, order, hot_rows) if hot else named
    inside = (
        Window.partitionBy(*keys_, *(["_ord_piece"] if hot else [])).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    result = cut
    for out, fold, col in folds:
        result = result.withColumn(out, fold(col).over(inside))
    if not hot:
        return result.select(*df.columns, *outs)
    carry = cut.where("_ord_hot").groupBy(*keys_, "_ord_piece").agg(
        *[fold(col).alias(f"_t_{out}") for out, fold, col in folds]
    )
    for out, fold, _ in folds:
        carry = carry.withColumn(f"_c_{out}", fold(f"_t_{out}").over(_earlier(keys_))).drop(f"_t_{out}")
    result = result.join(_lookup(carry, keys_), [*keys_, "_ord_piece"], "left")
    for out in sums:
        both_null = F.col(out).isNull() & F.col(f"_c_{out}").isNull()
        total = F.coalesce(F.col(out), F.lit(0)) + F.coalesce(F.col(f"_c_{out}"), F.lit(0))
        result = result.withColumn(out, F.when(~both_null, total))
    for out in maxima:
        result = result.withColumn(out, F.greatest(F.col(out), F.col(f"_c_{out}")))
    return result.select(*df.columns, *outs)


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: dict[str, float],
    nearest: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact percentiles per key: ``{out: p in 0..100}``.

    Linear interpolation between closest ranks, except for names in ``nearest``
    (value at 1-based rank ceil(p/100*n)).  Keys of moderate size use the
    built-in exact aggregates; otherwise equal values are pre-aggregated and
    ranked in an ordered pass that a large key shares among many tasks.
    """
    named, keys_ = _named(df, keys)
    limit = min(PERCENTILE_ROWS, HOT_ROWS) if hot_rows is None else hot_rows
    if not has_hot_key(named, keys_, limit):
        values = named.where(F.col(value).isNotNull()).select(*keys_, F.col(value).cast("double").alias("_ord_v"))
        folds = [
            F.expr(f"percentile_disc({p / 100!r}D) WITHIN GROUP (ORDER BY _ord_v)").alias(out) if out in nearest
            else F.percentile("_ord_v", F.lit(p / 100)).alias(out)
            for out, p in points.items()
        ]
        return values.groupBy(*keys_).agg(F.count(F.lit(1)).alias("value_count"), *folds).select(
            *keys, "value_count", *points)
    counted = (
        named.where(F.col(value).isNotNull())
        .groupBy(*keys_, F.col(value).cast("double").alias("_ord_v"))
        .agg(F.count(F.lit(1)).alias("_ord_c"))
    )
    totals = counted.groupBy(*keys_).agg(F.sum("_ord_c").alias("_ord_n"))
    ordered = running(counted, keys_, [F.col("_ord_v")], sums={"_ord_cum": "_ord_c"}, hot_rows=hot_rows)
    ranked = ordered.join(_lookup(totals, keys_), keys_)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_ord_cum") - F.col("_ord_c") <= rank) & (rank < F.col("_ord_cum")), F.col("_ord_v")))

    folds = [F.max("_ord_n").alias("_ord_n")]
    for out, p in points.items():
        if out in nearest:
            rank = F.greatest(F.lit(0), F.ceil(F.lit(p) / 100 * F.col("_ord_n")) - 1)
            folds.append(at(rank).alias(out))
        else:
            rank = F.lit(p / 100) * (F.col("_ord_n") - 1)
            folds.append(at(F.floor(rank)).alias(f"_lo_{out}"))
            folds.append(at(F.ceil(rank)).alias(f"_hi_{out}"))
    result = ranked.groupBy(*keys_).agg(*folds)
    outs = []
    for out, p in points.items():
        if out in nearest:
            outs.append(F.col(out))
            continue
        rank = F.lit(p / 100) * (F.col("_ord_n") - 1)
        weight = rank - F.floor(rank)
        outs.append(
            F.when(weight == 0, F.col(f"_lo_{out}"))
            .otherwise(F.col(f"_lo_{out}") * (1 - weight) + F.col(f"_hi_{out}") * weight)
            .alias(out)
        )
    return result.select(*keys, F.col("_ord_n").alias("value_count"), *outs)

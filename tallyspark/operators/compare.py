"""Result-set comparison over a long table of cells.

``cells``: ``instance_id, candidate (0 = gold), row_no, col_no, num_value,
str_value``; both values NULL stand for SQL NULL.  All comparisons join on
(instance, row) or on row content and aggregate counts, so one huge result set
spreads over many tasks; only arrays as wide as a result has columns are built.
``shapes`` (``instance_id, candidate, n_rows, n_cols``) is derived from the
cells unless given; give it when results may be empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import ordered
from tallyspark.functions.ordered import numbered
from tallyspark.functions.stats import ABS_TOL, REL_TOL, close, ratio

ID = ["instance_id", "candidate"]
ANSWER_ROWS = 100  # fixed value: rows that take part in a canonical answer
SEPARATOR = "\x1f"
TASK_CELLS = 250_000  # about as many are dealt to a task


def number_rows(cells: DataFrame, row_key: str) -> DataFrame:
    """Add ``row_no`` from an ordering key of the result rows.

    Instances of moderate size are dealt whole, so grouping by instance, result, row or column takes no further shuffle;
    the number of tasks grows with the cells.
    """
    sizes = cells.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).collect()[0]
    if (sizes["most"] or 0) <= ordered.HOT_ROWS:
        tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((sizes["all"] or 0) / TASK_CELLS))
        inside = Window.partitionBy(*ID, "col_no").orderBy(row_key)
        return cells.repartition(tasks, "instance_id").withColumn("row_no", F.row_number().over(inside).cast("bigint") - 1)
    return numbered(cells, [*ID, "col_no"], [F.col(row_key)])


def result_shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*ID).agg(
        (F.max("row_no") + 1).cast("bigint").alias("n_rows"), (F.max("col_no") + 1).cast("bigint").alias("n_cols")
    )


def encode(digits: int | None) -> Column:
    """Canonical text of a cell: NULL, number (rounded when asked) or string."""
    number = F.col("num_value") + F.lit(0.0)
    if digits is not None:
        number = F.round(number, digits) + F.lit(0.0)
    return (
        F.when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string")))
        .when(F.col("str_value").isNotNull(), F.concat(F.lit("s"), F.col("str_value"))).otherwise(F.lit("0"))
    )


def result_rows(cells: DataFrame, digits: int | None = 2, sort_values: bool = False) -> DataFrame:
    """One row per result row with its canonical values (as wide as the result)."""
    packed = cells.groupBy(*ID, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", encode(digits).alias("v")))).alias("_c")
    )
    values = F.col("_c.v")
    return packed.select(*ID, "row_no", (F.array_sort(values) if sort_values else values).alias("values"))


def _pairs(shapes: DataFrame) -> DataFrame:
    """Shape of every candidate next to the gold shape of its instance."""
    gold = shapes.where(F.col("candidate") == 0).select(
        "instance_id", F.col("n_rows").alias("g_rows"), F.col("n_cols").alias("g_cols")
    )
    return shapes.where(F.col("candidate") != 0).join(gold, "instance_id")


def _sorted_values(cells: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Re-number each column by its values: NULL last, then type, then text; ``counted`` as in ``numbered``."""
    missing = F.col("num_value").isNull() & F.col("str_value").isNull()
    text = F.coalesce(F.col("num_value").cast("string"), F.col("str_value"), F.lit(""))
    plain = cells.withColumnRenamed("row_no", "_row")
    return numbered(plain, [*ID, "col_no"], [missing, F.col("num_value").isNull(), text, F.col("_row")], counted=counted).drop("_row")


def _same_cell(left: str, right: str) -> Column:
    ln, ls = F.col(f"{left}.num_value"), F.col(f"{left}.str_value")
    rn, rs = F.col(f"{right}.num_value"), F.col(f"{right}.str_value")
    nulls = ln.isNull() & ls.isNull() & rn.isNull() & rs.isNull()
    return F.coalesce(nulls | close(ln.cast("double"), rn.cast("double")) | (ls == rs), F.lit(False))


SIGNED = 3  # sums of a column's numbers with signs drawn by row


def column_prints(cells: DataFrame) -> DataFrame:
    """One row per column: what columns that agree cell by cell must have in common.

    ``kinds`` covers the place and the text of every cell that is no number, so it has to be equal.  Numbers agree within a
    tolerance, so their sums, plain and with signs drawn by row, may differ by the tolerances' sum at most.
    """
    number = F.col("num_value").cast("double")
    kind = F.when(number.isNotNull(), "n").when(F.col("str_value").isNotNull(), "s").otherwise("0")
    text = F.when(number.isNull(), F.col("str_value"))

    def signed(k: int) -> Column:
        return F.sum(F.when(F.getbit(F.xxhash64(F.lit(k), "row_no"), F.lit(0)) == 0, number).otherwise(-number)).alias(f"signed_{k}")

    return cells.groupBy(*ID, "col_no").agg(
        F.bit_xor(F.xxhash64("row_no", kind, text)).alias("kinds"), (F.max("row_no") + 1).cast("bigint").alias("length"), F.sum(number).alias("plain"),
        *[signed(k) for k in range(SIGNED)], F.sum(F.abs(number)).alias("weight"))


def alike_columns(prints: DataFrame) -> DataFrame:
    """``instance_id, candidate, l_col, r_col``: a candidate's columns and the gold columns that they may agree with."""
    sums = ["plain", *[f"signed_{k}" for k in range(SIGNED)]]
    gold = prints.where(F.col("candidate") == 0).select(
        "instance_id", F.col("col_no").alias("r_col"), "kinds", "length", *[F.col(c).alias(f"_{c}") for c in (*sums, "weight")])
    met = prints.where(F.col("candidate") != 0).withColumnRenamed("col_no", "l_col").join(gold, ["instance_id", "kinds", "length"])
    # Tolerances of all cells, relative and absolute, and what adding up many numbers may lose.
    weight = F.coalesce(F.col("weight") + F.col("_weight"), F.lit(0.0))
    room = ABS_TOL * 1.01 * F.col("length") + weight * F.greatest(F.lit(3 * REL_TOL), F.col("length") * 1e-15)
    near = F.lit(True)
    for c in sums:
        gap = F.abs(F.col(c) - F.col(f"_{c}"))
        near = near & F.coalesce(F.isnan(gap) | (gap <= room), F.lit(True))
    return met.where(near).select(*ID, "l_col", "r_col")


def column_matches(left: DataFrame, right: DataFrame, alike: DataFrame) -> DataFrame:
    """Number of equal cells per pair of columns that may agree, joined row by row."""
    asked = left.withColumnRenamed("col_no", "l_col").join(alike, [*ID, "l_col"]).alias("l")
    joined = asked.join(right.withColumnRenamed("col_no", "r_col").alias("r"), ["instance_id", "row_no", "r_col"])
    return joined.groupBy(*ID, "l_col", "r_col").agg(F.count_if(_same_cell("l", "r")).alias("same"))


def execution_match(
    cells: DataFrame,
    ignore_order: bool = False,
    strict_columns: bool = False,
    condition_cols: Sequence[int] | None = None,
    reuse_columns: bool = False,
    shapes: DataFrame | None = None,
) -> DataFrame:
    """1 when every gold column is found among the candidate's columns.

    Columns agree when they have equal length and equal values position by
    position (tolerant on numbers).  Gold columns take the first unused
    matching column in order; ``reuse_columns`` lets several share one.  Cells
    are only compared for columns whose prints agree.
    """
    body = _sorted_values(cells) if ignore_order else cells
    prints = column_prints(body)
    if shapes is None and not ignore_order:
        shapes = prints.groupBy(*ID).agg(F.max("length").alias("n_rows"), (F.max("col_no") + 1).cast("bigint").alias("n_cols"))
    shapes = result_shapes(cells) if shapes is None else shapes
    pairs = _pairs(shapes)
    gold = body.where(F.col("candidate") == 0).drop("candidate")
    if condition_cols:
        gold = gold.where(F.col("col_no").isin(*condition_cols))
        wanted = F.lit(len(set(condition_cols))).cast("bigint")
    else:
        wanted = F.col("g_cols")
    same = column_matches(body.where(F.col("candidate") != 0), gold, alike_columns(prints))
    options = (
        same.join(pairs, ID)
        .where((F.col("same") == F.col("g_rows")) & (F.col("same") == F.col("n_rows")))
        .groupBy(*ID, "r_col").agg(F.array_sort(F.collect_list("l_col")).alias("o"))
        .groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("r_col", "o"))).alias("options"))
    )
    taken = F.expr(
        "aggregate(options, CAST(array() AS array<int>), (used, x) -> CASE WHEN size(array_except(x.o, used)) > 0 "
        "THEN concat(used, array(element_at(filter(x.o, c -> NOT array_contains(used, c)), 1))) ELSE used END)"
    )
    covered = F.size("options") if reuse_columns else F.size(taken)
    empty_rows = (F.col("n_rows") == 0) & (F.col("g_rows") == 0)
    enough = (F.col("n_cols") >= 1) if reuse_columns else (F.col("n_cols") >= wanted)
    hit = (wanted == 0) | (empty_rows & enough) | F.coalesce(covered == wanted, F.lit(False))
    options = options.withColumn("options", F.expr("transform(options, x -> struct(CAST(x.r_col AS INT) AS r_col, CAST(x.o AS array<int>) AS o))"))
    scored = pairs.join(options, ID, "left").withColumn("score", hit.cast("int"))
    if strict_columns:
        rejected = quick_reject(cells, ignore_order, shapes)
        scored = scored.join(rejected, ID).withColumn(
            "score", F.when(F.col("rejected"), 0).otherwise(F.col("score"))
        )
    return scored.select(*ID, "score")


def _common_rows(pred: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of the multiset intersection of row contents per key."""
    left = pred.groupBy(*keys, "values").agg(F.count(F.lit(1)).alias("_l"))
    right = gold.groupBy("instance_id", "values").agg(F.count(F.lit(1)).alias("_r"))
    return left.join(right, ["instance_id", "values"]).groupBy(*keys).agg(
        F.sum(F.least("_l", "_r")).alias("common"), F.count(F.lit(1)).alias("common_distinct")
    )


def quick_reject(cells: DataFrame, ignore_order: bool, shapes: DataFrame | None = None) -> DataFrame:
    """``rejected`` where shapes differ or rows, with values sorted inside, differ."""
    pairs = _pairs(result_shapes(cells) if shapes is None else shapes)
    rows = result_rows(cells, 2, sort_values=True)
    pred, gold = rows.where(F.col("candidate") != 0), rows.where(F.col("candidate") == 0).drop("candidate")
    if ignore_order:
        equal = _common_rows(pred, gold, ID)
    else:
        equal = pred.join(gold, ["instance_id", "row_no", "values"]).groupBy(*ID).agg(F.count(F.lit(1)).alias("common"))
    same = (F.col("n_rows") == F.col("g_rows")) & (F.col("n_cols") == F.col("g_cols")) & (
        F.coalesce("common", F.lit(0)) == F.col("g_rows")
    )
    return pairs.join(equal, ID, "left").select(*ID, (~same).alias("rejected"))


def rowset_equal(cells: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Same shape and the same set of rows after rounding floats to 2 places.

    Every distinct row of an instance is met once, with the results that hold it; shapes come from the same rows.
    """
    packed = cells.groupBy(*ID, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", encode(2).alias("v")))).alias("_c"))
    rows = packed.select(*ID, "row_no", F.col("_c.v").alias("values"), F.array_max("_c.col_no").alias("_last"))
    distinct = rows.groupBy(*ID, "values").agg(F.max("row_no").alias("_row"), F.max("_last").alias("_last"))
    held = distinct.groupBy("instance_id", "values").agg(F.collect_list(F.struct("candidate", "_row", "_last")).alias("_h"))
    each = held.select("instance_id", F.exists("_h", lambda h: h["candidate"] == 0).alias("_gold"), F.explode("_h").alias("h")).select("instance_id", "_gold", "h.*")
    sizes = each.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("_d"), F.count_if("_gold").alias("_common"), (F.max("_row") + 1).cast("bigint").alias("n_rows"),
        (F.max("_last") + 1).cast("bigint").alias("n_cols"))
    if shapes is not None:
        sizes = shapes.join(sizes.drop("n_rows", "n_cols"), ID, "left")
    gold = sizes.where(F.col("candidate") == 0).select(
        "instance_id", F.col("_d").alias("_gd"), F.col("n_rows").alias("g_rows"), F.col("n_cols").alias("g_cols"))
    joined = sizes.where(F.col("candidate") != 0).join(gold, "instance_id")
    shape = (F.col("n_rows") == F.col("g_rows")) & (F.col("n_cols") == F.col("g_cols"))
    none = F.col("n_rows") == 0
    equal = (F.col("_d") == F.col("_gd")) & (F.col("_common") == F.col("_d"))
    return joined.select(*ID, (shape & (none | F.coalesce(equal, F.lit(False)))).cast("int").alias("score"))


def rowset_digest(cells: DataFrame, digits: int | None = 2) -> DataFrame:
    """128-bit order-free digest of the row set with the shape, one row per result."""
    rows = result_rows(cells, digits)
    text = F.array_join("values", SEPARATOR)
    distinct = rows.groupBy(*ID, text.alias("_t")).agg(
        F.max("row_no").alias("_row"), F.max(F.size("values")).alias("_w")
    )
    return distinct.groupBy(*ID).agg(
        F.concat_ws(
            ":", F.max("_row") + 1, F.max("_w"), F.count(F.lit(1)),
            F.bit_xor(F.xxhash64("_t")), F.sum(F.xxhash64(F.lit(SEPARATOR), F.col("_t")).cast("decimal(38,0)")),
        ).alias("digest")
    )


def multiset_equal_any_column_order(
    cells: DataFrame, ordered: bool = False, shapes: DataFrame | None = None
) -> DataFrame:
    """1 when the rows agree as a multiset (or in order) under some column permutation.

    Only columns with equal value multisets may map to each other; each
    remaining permutation is verified exactly by counting rows.  Candidate
    columns with the same values row by row are interchangeable, so they are
    taken in their order only.
    """
    pairs = _pairs(result_shapes(cells) if shapes is None else shapes)
    exact = encode(None)
    columns = cells.groupBy(*ID, "col_no").agg(
        F.bit_xor(F.xxhash64(exact, F.lit(1))).alias("_x"), F.sum(F.xxhash64(exact).cast("decimal(38,0)")).alias("_s"),
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("row_no", exact).cast("decimal(38,0)")).alias("_same"),
    )
    gold_cols = columns.where(F.col("candidate") == 0).select(
        "instance_id", F.col("col_no").alias("g_col"), "_x", "_s", "_n"
    )
    options = (
        columns.where(F.col("candidate") != 0).join(gold_cols, ["instance_id", "_x", "_s", "_n"])
        .groupBy(*ID, "g_col").agg(F.array_sort(F.collect_list(F.struct(F.col("col_no").cast("int").alias("c"), "_same"))).alias("o"))
        .groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("g_col", "o"))).alias("options"))
    )
    permutations = F.expr(
        "aggregate(options, array(CAST(array() AS array<int>)), (done, x) -> flatten(transform(done, p -> "
        "transform(filter(x.o, a -> NOT array_contains(p, a.c) AND NOT exists(x.o, b -> b._same = a._same AND b.c < a.c AND NOT array_contains(p, b.c))), "
        "a -> concat(p, array(a.c))))))"
    )
    perms = (
        pairs.where((F.col("n_rows") == F.col("g_rows")) & (F.col("n_cols") == F.col("g_cols"))).join(options, ID)
        .where(F.size("options") == F.col("g_cols")).select(*ID, F.explode(permutations).alias("perm"))
    )
    rows = result_rows(cells, None)
    permuted = rows.where(F.col("candidate") != 0).join(perms, ID).select(
        *ID, "perm", "row_no", F.transform("perm", lambda c: F.element_at("values", c + 1)).alias("values")
    )
    gold = rows.where(F.col("candidate") == 0).drop("candidate")
    if ordered:
        counted = permuted.join(gold, ["instance_id", "row_no", "values"]).groupBy(*ID, "perm").agg(
            F.count(F.lit(1)).alias("common")
        )
    else:
        counted = _common_rows(permuted, gold, [*ID, "perm"])
    best = counted.groupBy(*ID).agg(F.max("common").alias("common"))
    equal = (F.col("n_rows") == F.col("g_rows")) & (
        (F.col("n_rows") == 0) | F.coalesce(F.col("common") == F.col("g_rows"), F.lit(False))
    )
    return pairs.join(best, ID, "left").select(*ID, equal.cast("int").alias("score"))


def canonical_answer(cells: DataFrame) -> DataFrame:
    """Answer text: numbers rounded to 3 places, rows sorted, first hundred rows."""
    number = F.coalesce(F.col("num_value"), F.col("str_value").try_cast("double"))
    text = F.coalesce((F.round(number, 3) + F.lit(0.0)).cast("string"), F.col("str_value"), F.lit("None"))
    rows = cells.groupBy(*ID, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", text.alias("v")))).alias("_c")
    ).select(*ID, "row_no", F.col("_c.v").alias("row"))
    order = Window.partitionBy(*ID).orderBy("row", "row_no")
    return (
        rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ANSWER_ROWS)
        .groupBy(*ID).agg(F.to_json(F.array_sort(F.collect_list("row"))).alias("answer"))
    )


def canonical_answer_equal(cells: DataFrame) -> DataFrame:
    answers = canonical_answer(cells)
    gold = answers.where(F.col("candidate") == 0).select("instance_id", F.col("answer").alias("gold"))
    return answers.where(F.col("candidate") != 0).join(gold, "instance_id").select(
        *ID, (F.col("answer") == F.col("gold")).cast("int").alias("score")
    )


def soft_f1(cells: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Soft F1 of the result sets with the true/false positive and negative mass.

    Distinct rows of both sides are paired by their rank in canonical order
    (the pairing of unordered sets is made deterministic this way).
    """
    pairs = _pairs(result_shapes(cells) if shapes is None else shapes)
    packed = cells.groupBy(*ID, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("col_no", encode(None).alias("t"), "num_value", "str_value"))).alias("_c")
    )
    cell = F.transform("_c", lambda c: F.struct(c["num_value"].alias("n"), c["str_value"].alias("s")))
    rows = packed.groupBy(*ID, F.array_join("_c.t", SEPARATOR).alias("_t")).agg(F.first(cell).alias("v"))
    # Distinct rows of a result are at most its rows, and those can be counted without packing them.
    ranked = numbered(rows, ID, [F.col("_t")], out="rank", counted=cells.where("col_no = 0")).drop("_t")
    gold = (
        ranked.where(F.col("candidate") == 0).drop("candidate")
        .join(pairs.select(*ID), "instance_id").select(*ID, "rank", F.col("v").alias("g"))
    )
    pred = ranked.where(F.col("candidate") != 0).select(*ID, "rank", F.col("v").alias("p"))
    both = gold.join(pred, [*ID, "rank"], "full_outer")
    equal = (
        "(x.n IS NULL AND x.s IS NULL AND y.n IS NULL AND y.s IS NULL) OR coalesce(x.s = y.s, false) OR "
        "coalesce(abs(x.n - y.n) <= greatest(1e-9 * greatest(abs(x.n), abs(y.n)), 0.01), false)"
    )
    width = F.size("g")
    hits = F.expr(f"size(filter(p, x -> exists(g, y -> {equal})))")
    misses = F.expr(f"size(filter(g, x -> NOT exists(p, y -> {equal})))")
    row = both.select(
        *ID,
        F.when(F.col("g").isNull() | F.col("p").isNull(), 0.0).otherwise(hits / width).alias("tp"),
        F.when(F.col("g").isNull(), 1.0).when(F.col("p").isNull(), 0.0).otherwise((F.size("p") - hits) / width).alias("fp"),
        F.when(F.col("g").isNull(), 0.0).when(F.col("p").isNull(), 1.0).otherwise(misses / width).alias("fn"),
    )
    sums = row.groupBy(*ID).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    f1 = F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0))
    score = (
        F.when((F.col("n_rows") == 0) & (F.col("g_rows") == 0), 1.0)
        .when((F.col("n_rows") == 0) | (F.col("g_rows") == 0), 0.0).otherwise(f1)
    )
    return pairs.join(sums, ID, "left").select(*ID, "tp", "fp", "fn", score.alias("score"))


def self_consistency(cells: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Share of candidate pairs with equal row sets.

    ``attempts`` (``instance_id, n``) counts every candidate, also the failed
    ones, which agree with nothing.  Fewer than two → NULL; fewer than two
    valid → 0.
    """
    digests = rowset_digest(cells.where(F.col("candidate") != 0))
    groups = digests.groupBy("instance_id", "digest").agg(F.count(F.lit(1)).alias("_k"))
    valid = groups.groupBy("instance_id").agg(
        F.sum("_k").alias("valid"), F.sum(F.col("_k") * (F.col("_k") - 1) / 2).alias("agree")
    )
    if attempts is None:
        attempts = valid.select("instance_id", F.col("valid").alias("n"))
    joined = attempts.join(valid, "instance_id", "left")
    n = F.col("n")
    score = F.when(n >= 2, F.when(F.coalesce("valid", F.lit(0)) < 2, 0.0).otherwise(F.col("agree") / (n * (n - 1) / 2)))
    return joined.select("instance_id", "n", score.alias("sc"))

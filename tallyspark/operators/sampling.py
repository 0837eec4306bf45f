"""Filters, samples, batches and row normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.hashing import draw
from tallyspark.functions.ordered import numbered

# Operators and defaults of the filter language.
COMPARE = {
    "l": lambda x, y: x < y,
    "e": lambda x, y: x == y,
    "m": lambda x, y: x > y,
    "le": lambda x, y: x <= y,
    "me": lambda x, y: x >= y,
}
SMALL_LIMIT = 10_000  # up to here a distributed top-n is cheaper than ranking all rows


def parse_filter(spec: str) -> dict[str, tuple[str | None, str | None]]:
    """``name[-value]`` or ``name-operator-value`` parts joined by dots; a bare number is a head limit."""
    parts = [p for p in spec.split(".") if p]
    if len(parts) == 1 and parts[0].isdigit():
        return {"limit": (None, parts[0])}
    parsed: dict[str, tuple[str | None, str | None]] = {}
    for part in parts:
        words = part.split("-")
        if len(words) > 3:
            raise ValueError(f"invalid filter condition: {part}")
        operator = words[1] if len(words) == 3 else None
        parsed[words[0]] = (operator, words[-1] if len(words) > 1 else None)
    return parsed


def filter_samples(df: DataFrame, spec: str, order: Sequence[Column], key: str = "instance_id") -> DataFrame:
    """Apply a filter text.  Row filters come first, then ``limit``, then ``random``."""
    wanted = parse_filter(spec)

    def number(name: str, value: Column) -> Column:
        operator, bound = wanted[name]
        if (operator or "l") not in COMPARE:
            raise ValueError(f"unsupported operator: {operator}")
        return COMPARE[operator or "l"](value, int(bound or 100))

    if "db_size" in wanted:
        df = df.where(number("db_size", F.coalesce("db_size", F.lit(0))))
    for name, default in (("difficulty", "easy"), ("db_type", "sqlite")):
        if name in wanted:
            df = df.where(F.coalesce(name, F.lit(default)) == (wanted[name][1] or default))
    for name, column in (("ques_length", "question"), ("query_length", "query")):
        if name in wanted:
            df = df.where(number(name, F.length(F.coalesce(column, F.lit("")))))
    if "has_label" in wanted:
        label = wanted["has_label"][1] or "query"
        df = df.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "")) if label in df.columns else df.limit(0)
    limit = int((wanted.get("limit") or (None, "0"))[1] or 0)
    if limit > 0:
        df = head(df, limit, order)
    size = int((wanted.get("random") or (None, "0"))[1] or 0)
    if size > 0:
        df = sample_rows(df, key, n=size, seed=int((wanted.get("seed") or (None, "42"))[1] or 42))
    return df


def head(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First n rows in order; a large n is cut by rank, so rows stay distributed."""
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    return numbered(df, [], order, out="_rank").where(F.col("_rank") < n).drop("_rank")


def sample_rows(
    df: DataFrame, key: str, n: int | None = None, fraction: float | None = None, seed: int = 42
) -> DataFrame:
    """Sample without replacement: the n rows with the smallest seeded hash of their key."""
    if n is None:
        n = int(df.count() * float(fraction or 0.0))
    return head(df, n, [draw(F.col(key), seed), F.col(key)])


def stratified_round_robin(df: DataFrame, limit: int, fields: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each stratum in turn until ``limit``; strata sorted with NULL as ''."""
    named = df.select("*", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"_s{i}") for i, f in enumerate(fields)])
    strata = [f"_s{i}" for i in range(len(fields))]
    if limit <= 1000:  # the planner keeps only ``limit`` rows per stratum before the shuffle
        turn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order)) - 1
        ranked = named.withColumn("turn", turn)
    else:
        ranked = numbered(named, strata, order, out="turn")
    kept = ranked.where(F.col("turn") < limit)
    return head(kept, limit, [F.col("turn"), *[F.col(s) for s in strata]]).drop(*strata)


def stratified_few_shot(
    targets: DataFrame, pool: DataFrame, n: int, level: str = "level", seed: int = 42
) -> DataFrame:
    """n pool rows per level for each target, never from the target's own database.

    At most n rows per (level, database) and 2n per level can ever be chosen,
    whatever database is excluded, so targets read one small bounded list.
    """
    order = [draw(F.col("pool_id"), seed), F.col("pool_id")]
    by_db = Window.partitionBy(level, "db_id").orderBy(*order)
    by_level = Window.partitionBy(level).orderBy(*order)
    short = (
        pool.select("pool_id", "db_id", level)
        .withColumn("_r", F.row_number().over(by_db)).where(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(by_level)).where(F.col("_r") <= 2 * n)
    )
    lists = short.groupBy(level).agg(F.array_sort(F.collect_list(F.struct("_r", "pool_id", "db_id"))).alias("rows"))
    choices = lists.agg(F.collect_list(F.struct(F.col(level).alias("level"), "rows"))).scalar()
    chosen = F.expr(
        f"flatten(transform(_all, l -> transform(slice(filter(l.rows, r -> r.db_id <> db_id), 1, {int(n)}), "
        "(r, i) -> struct(l.level AS level, i + 1 AS rank, r.pool_id AS pool_id))))"
    )
    return targets.withColumn("_all", choices).select("instance_id", F.explode(chosen).alias("c")).select("instance_id", "c.*")


def random_few_shot(targets: DataFrame, pool: DataFrame, k: int, cross_domain: bool = False, seed: int = 42) -> DataFrame:
    """k distinct pool rows per target by a systematic draw with a seeded start.

    The pool is numbered by (database, id); a target's own database is one
    contiguous range, which the drawn positions step over when it is excluded.
    Targets meet the pool by an equi-join on the drawn positions only.
    """
    placed = numbered(pool.select("pool_id", "db_id"), [], [F.col("db_id"), F.col("pool_id")], out="pos")
    total = placed.agg(F.count(F.lit(1))).scalar()
    ranges = placed.groupBy("db_id").agg(F.min("pos").alias("lo"), F.count(F.lit(1)).alias("own"))
    aimed = targets.select("instance_id", "db_id").withColumn("n", total)
    if cross_domain:
        aimed = aimed.join(ranges, "db_id", "left").fillna(0, ["lo", "own"])
    else:
        aimed = aimed.withColumn("lo", F.lit(0)).withColumn("own", F.lit(0))
    aimed = aimed.withColumn("m", F.col("n") - F.col("own")).where(F.col("m") > 0)
    take = F.least(F.lit(k), F.col("m")).cast("int")
    start = draw(F.col("instance_id"), seed)
    drawn = aimed.withColumn("rank", F.explode(F.sequence(F.lit(1), take))).withColumn(
        "q", F.pmod(start + F.floor((F.col("rank") - 1) * F.col("m") / take), F.col("m"))
    )
    position = F.col("q") + F.when(F.col("q") >= F.col("lo"), F.col("own")).otherwise(0)
    return drawn.withColumn("pos", position).join(placed.select("pos", "pool_id"), "pos").select("instance_id", "rank", "pool_id")


def decayed_sample(df: DataFrame, key: str, init_rate: float, decay: float, turn: str = "turn_n", seed: int = 42) -> DataFrame:
    """Keep int(n·init·decay^turn) rows of each turn; turns at or below a tenth are dropped."""
    rate = F.lit(init_rate) * F.pow(F.lit(decay), F.col(turn))
    alive = df.where(rate > 0.1)
    sizes = alive.groupBy(turn).agg(F.count(F.lit(1)).alias("_n"))
    ranked = numbered(alive, [turn], [draw(F.col(key), seed), F.col(key)], out="_r").join(sizes, turn)
    return ranked.where(F.col("_r") < F.floor(F.col("_n") * rate)).select(*df.columns)


def is_bare_select(sql: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(sql, F.lit("")), ";+$", ""))) == "SELECT"


def repair_candidates(df: DataFrame, scores: DataFrame, execution_errors: bool = True) -> DataFrame:
    """Rows whose prediction is a bare SELECT, or that failed with an execution or generation error."""
    joined = df.join(scores.select("instance_id", "ex", "error_root", "exec_error"), "instance_id", "left")
    bare = is_bare_select(F.col("pred_sql"))
    broken = (F.coalesce("exec_error", F.lit("")) != "") | F.coalesce(
        F.col("error_root").isin("execution_error", "generation_error"), F.lit(False))
    failed = F.coalesce(F.col("ex") == 0, F.lit(True)) & broken & F.lit(execution_errors)
    return joined.withColumn("bare_select", bare).where(bare | failed)


def natural_key(column: Column) -> Column:
    """Sort key (prefix, number, id): ``dev_2`` before ``dev_10``; ids without a number sort first."""
    number = F.regexp_extract(column, r"(\d+)$", 1)
    return F.struct(
        F.regexp_replace(column, r"\d+$", "").alias("prefix"),
        F.when(number == "", F.lit(-1)).otherwise(F.nullif(number, F.lit("")).cast("decimal(38,0)")).alias("number"),
        column.alias("id"),
    )


def split_batches(df: DataFrame, size: int, order: Sequence[Column]) -> DataFrame:
    """Consecutive batches of ``size`` rows in order."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    ranked = numbered(df, [], order, out="_r")
    return ranked.withColumn("batch", F.floor(F.col("_r") / size)).drop("_r")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def assert_disjoint(batches: DataFrame, key: str = "instance_id") -> None:
    """Fail when two batches share an id."""
    shared = batches.groupBy(key).agg(F.min("batch").alias("a"), F.max("batch").alias("b")).where("a < b").take(1)
    if shared:
        raise ValueError(f"batch {shared[0]['b']} repeats sample {shared[0][key]}")


def chunk_catalog(df: DataFrame, order: Sequence[Column], size: int = 200, num: int = 10, keys: Sequence[str] = ("db_id",)) -> DataFrame:
    """Contiguous chunks per database; ``size`` has priority over ``num``."""
    ranked = numbered(df, keys, order, out="_r")
    if size > 0:
        return ranked.withColumn("chunk", F.floor(F.col("_r") / size)).drop("_r")
    if num <= 1:
        return ranked.withColumn("chunk", F.lit(0).cast("bigint")).drop("_r")
    sizes = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / num).alias("_size"))
    return ranked.join(sizes, list(keys)).withColumn("chunk", F.floor(F.col("_r") / F.col("_size"))).drop("_r", "_size")


# Retrieval parameters by database size.
TOP_K = ((200, 40), (400, 50), (1000, 60), (2500, 70), (None, 80))
TURNS = ((200, 2), (350, 3), (1000, 6), (2500, 8), (None, 10))
POST_K = ((200, 5), (500, 10), (1000, 15), (2000, 15), (None, 20))
POST_TURNS = ((200, 1), (500, 1), (1000, 1), (2000, 2), (None, 1))


def _ladder(value: Column, steps) -> Column:
    result = None
    for bound, answer in steps[:-1]:
        result = F.when(value <= bound, answer) if result is None else result.when(value <= bound, answer)
    return result.otherwise(steps[-1][1])


def params_by_size(df: DataFrame, size: str = "db_size") -> DataFrame:
    """Top-k, turns and second-pass parameters from the number of columns."""
    value = F.col(size)
    return df.select(
        "*", _ladder(value, TOP_K).alias("top_k"), _ladder(value, TURNS).alias("turn_n"),
        _ladder(value, POST_K).alias("post_k"), _ladder(value, POST_TURNS).alias("post_turn_n"),
    )


def needs_pruning(catalog: DataFrame) -> DataFrame:
    """Databases with more than 3 tables, unless they average ≤ 6 columns and have ≤ 30 in total."""
    sizes = catalog.groupBy("db_id").agg(
        F.count_distinct("table_name").alias("tables"), F.count(F.lit(1)).alias("columns")
    )
    small = (F.col("columns") / F.col("tables") <= 6) & (F.col("columns") <= 30)
    return sizes.withColumn("needs_pruning", (F.col("tables") > 3) & ~small)


def first_present(df: DataFrame, columns: Sequence[str], type_name: str | None = None) -> Column:
    """First non-NULL of the columns that exist; NULL when it does not have the wanted type."""
    present = [F.col(c).cast("string") for c in columns if c in df.columns]
    value = F.coalesce(*present) if present else F.lit(None).cast("string")
    return value.try_cast(type_name) if type_name else value


def row_delta(before: DataFrame, after: DataFrame, values: str = "values") -> DataFrame:
    """Keys added, changed or removed between two map snapshots of a row."""
    old = before.select("instance_id", F.explode(values).alias("key", "before"), F.lit(True).alias("_b"))
    new = after.select("instance_id", F.explode(values).alias("key", "after"), F.lit(True).alias("_a"))
    joined = old.join(new, ["instance_id", "key"], "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(
        ~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("instance_id", "key", "kind", "before", "after")


def links_from_text(text: Column) -> Column:
    """``[a.b, "c.d"]`` inside a text → array of links."""
    inner = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    cleaned = F.transform(F.split(inner, ","), lambda x: F.translate(F.trim(x), "`\"'", ""))
    return F.filter(cleaned, lambda x: x != "")


def links_from_pairs(pairs: Column) -> Column:
    """``[[table, column], …]`` → array of links."""
    return F.transform(pairs, lambda p: F.concat_ws(".", p[0], p[1]))


def links_from_records(records: Column) -> Column:
    """``[{table_name, column_name}, …]`` → array of links."""
    return F.transform(records, lambda r: F.concat_ws(".", r["table_name"], r["column_name"]))


def links_from_frame(frame: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows ``(table_name, column_name)`` → one sorted array per key (as wide as a catalog)."""
    return frame.groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(".", "table_name", "column_name"))).alias("links"))


def normalize_links(links: Column, form: str = "A") -> Column:
    """Unified links: A columns; B struct of tables and columns; C columns and literals.  Order is kept."""
    def cleaned(x: Column) -> Column:
        return F.translate(F.trim(x), "`\"'", "")

    def is_column(x: Column) -> Column:
        return cleaned(x).rlike(r"^[^.]+\.[^.]+$")

    columns = F.transform(F.filter(links, is_column), cleaned)
    if form == "A":
        return F.array_distinct(columns)
    if form == "B":
        tables = F.array_distinct(F.transform(columns, lambda x: F.substring_index(x, ".", 1)))
        return F.struct(tables.alias("tables"), columns.alias("columns"))
    if form == "C":
        return F.array_distinct(F.concat(columns, F.filter(links, lambda x: ~is_column(x))))
    raise ValueError(f"unknown form {form!r}")


def normalize_sub_questions(text: Column) -> Column:
    """JSON of a string, list, pairs or records → array of (sub_question, sql) records."""
    record = "array<struct<sub_question: string, sql: string, chain_of_thought: string>>"
    records = F.from_json(text, record)
    pairs = F.from_json(text, "array<array<string>>")
    plain = F.from_json(text, "array<string>")

    def as_record(q: Column, s: Column, c: Column) -> Column:
        return F.struct(F.coalesce(q, F.lit("")).alias("sub_question"), F.coalesce(s, F.lit("")).alias("sql"), c.alias("chain_of_thought"))

    none = F.lit(None).cast("string")
    return (
        F.when(text.rlike(r"^\s*\[\s*\{"), F.transform(records, lambda r: as_record(r["sub_question"], r["sql"], r["chain_of_thought"])))
        .when(text.rlike(r"^\s*\[\s*\["), F.transform(pairs, lambda p: as_record(p[0], F.get(p, F.lit(1)), none)))
        .when(text.rlike(r"^\s*\["), F.transform(plain, lambda q: as_record(q, F.lit(""), none)))
        .when(text.isNotNull(), F.array(as_record(text, F.lit(""), none)))
    )


def format_sub_questions(records: Column, form: str = "C") -> Column:
    """Prompt text of normalised sub-questions, last one first."""
    def line(r: Column) -> Column:
        sql = F.concat(F.lit("SQL:\n```sql\n"), r["sql"], F.lit("\n```"))
        first = F.concat(F.lit("Sub question: "), r["sub_question"])
        thought = F.when(r["chain_of_thought"].isNotNull(), F.concat(F.lit("Chain of thought: "), r["chain_of_thought"]))
        return {"A": first, "B": F.concat_ws("\n", first, sql), "C": F.concat_ws("\n", first, thought, sql)}[form]

    return F.array_join(F.reverse(F.transform(records, line)), "\n\n")


def run_sampling_metadata(runs: DataFrame) -> DataFrame:
    """Sampling mode, limit and seed of a run, and its validity class.

    A random sample named in the data source wins over the recorded fields,
    which win over the scope text.
    """
    source, scope = F.coalesce("data_source", F.lit("")), F.coalesce("scope", F.lit(""))
    drawn = F.regexp_extract(source, r"(?:^|[.:])random-(\d+)(?:\.|$)", 1)
    seeded = F.regexp_extract(source, r"(?:^|[.:])seed-(\d+)(?:\.|$)", 1)
    named, size = F.regexp_extract(scope, r"^(random|slice)-(\d+)$", 1), F.regexp_extract(scope, r"^(random|slice)-(\d+)$", 2)
    none = F.lit("")
    no_mode = F.col("sample_mode").isNull()
    mode = F.when(drawn != "", "random").otherwise(F.coalesce("sample_mode", F.nullif(named, none)))
    limit = F.when(drawn != "", F.nullif(drawn, none).cast("bigint")).otherwise(
        F.when(no_mode & (size != ""), F.nullif(size, none).cast("bigint")).otherwise(F.col("sample_limit")))
    seed = F.when((drawn != "") & (seeded != ""), F.nullif(seeded, none).cast("bigint")).otherwise(F.col("sample_seed"))
    limit = F.coalesce(F.when(limit != 0, limit), F.col("sample_count"))
    validity = F.when(F.coalesce("sample_count", F.lit(0)) == 0, "none").when(mode.isNotNull(), "bounded").otherwise("full")
    return runs.withColumn("mode", mode).withColumn("limit", limit).withColumn("seed", seed).withColumn("validity", validity)

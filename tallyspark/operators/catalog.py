"""Table catalogs: flattening, foreign keys, join paths, rendering and profiles.

The parallel catalog has one row per column: ``db_id, table_name, column_no,
column_name, column_types, column_descriptions, primary_key, foreign_key``.
Per-database arrays are as wide as one database has columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import cut_lineage

CUT = 150  # fixed value: longest type or description in a rendered catalog
SAMPLES = 3  # fixed value: sample values of a profile
LONG_TEXT = 360  # fixed value: longest text of sample values
TASK_ROWS = 200_000  # selected tables for each task that holds their neighbours

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def flatten_catalog(central: DataFrame) -> DataFrame:
    """Central rows (one per database, parallel arrays) → one row per column.

    A leading ``*`` entry shifts type, description and key indexes by one.
    """
    shift = F.when(F.col("column_names_original")[0]["table_idx"] == -1, 1).otherwise(0)
    columns = F.filter("column_names_original", lambda c: c["table_idx"] != -1)
    base = central.withColumn("_shift", shift).withColumn("_cols", columns).withColumn("_n", F.size("_cols"))
    rows = base.select("*", F.posexplode("_cols").alias("column_no", "_c")).withColumn("_i", F.col("column_no") + F.col("_shift"))
    keys = F.coalesce(F.flatten("primary_keys"), F.array().cast("array<int>"))
    reference = F.expr(
        "array_join(transform(filter(coalesce(foreign_keys, array()), f -> f.src = _i AND f.dst >= _shift AND f.dst - _shift < _n), "
        "f -> concat('[', table_names_original[_cols[f.dst - _shift].table_idx], '(', _cols[f.dst - _shift].name, ')]')), '')"
    )
    return rows.select(
        "db_id", F.coalesce("db_type", F.lit("sqlite")).alias("db_type"),
        F.col("table_names_original")[F.col("_c.table_idx")].alias("table_name"), "column_no",
        F.col("_c.name").alias("column_name"), F.get("column_types", F.col("_i")).alias("column_types"),
        F.coalesce(F.get("column_descriptions", F.col("_i"))["text"], F.lit("")).alias("column_descriptions"),
        F.array_contains(keys, F.col("_i")).alias("primary_key"), reference.alias("foreign_key"),
    )


def central_catalog(catalog: DataFrame) -> DataFrame:
    """One row per column → one row per database with parallel arrays."""
    cells = F.array_sort(F.collect_list(F.struct("table_name", "column_no", "column_name", "column_types")))
    packed = catalog.groupBy("db_id").agg(cells.alias("_c")).withColumn("_t", F.array_distinct("_c.table_name"))
    names = F.expr("transform(_c, c -> struct(CAST(array_position(_t, c.table_name) - 1 AS INT) AS table_idx, c.column_name AS name))")
    star = F.array(F.struct(F.lit(-1).alias("table_idx"), F.lit("*").alias("name")))
    return packed.select(
        "db_id", F.col("_t").alias("table_names_original"), F.concat(star, names).alias("column_names_original"),
        F.concat(F.array(F.lit("text")), F.col("_c.column_types")).alias("column_types"),
    )


def catalog_of(
    tables: dict[str, DataFrame], db_id: str, primary_keys: dict[str, Sequence[str]] | None = None,
    foreign_keys: Sequence[tuple[str, str, str, str]] = (),
) -> DataFrame:
    """Catalog rows from the schemas of live tables and declared keys; types become number or text."""
    any_table = next(iter(tables.values()))
    rows = []
    for table, df in tables.items():
        for i, field in enumerate(df.schema.fields):
            kind = "number" if field.dataType.typeName() in (*NUMERIC, "byte", "short", "integer", "long") else "text"
            target = "".join(f"[{t}({c})]" for s, sc, t, c in foreign_keys if (s, sc) == (table, field.name))
            rows.append((db_id, table, i, field.name, kind, "", field.name in (primary_keys or {}).get(table, ()), target))
    return any_table.sparkSession.createDataFrame(
        rows, "db_id string, table_name string, column_no int, column_name string, column_types string, "
              "column_descriptions string, primary_key boolean, foreign_key string")


def fk_edges(catalog: DataFrame) -> DataFrame:
    """Foreign-key edges from ``[t(c)]``, ``[t.c]`` or ``t.c = t.c`` texts."""
    text = F.trim("foreign_key")
    pair = r"^\[?\s*([^.=\[\]]+)\.([^=\[\]]+?)\s*=\s*([^.=\[\]]+)\.([^=\[\]]+?)\s*\]?$"
    target = r"\[\s*([^\[\].()]+)[.(]([^\[\])]+)\)?\s*\]"
    is_pair = text.contains("=")
    direct = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(target), 1).alias("t"), F.regexp_extract_all(text, F.lit(target), 2).alias("c")),
        lambda x: F.struct(F.col("table_name").alias("src_table"), F.col("column_name").alias("src_column"),
                           F.trim(x["t"]).alias("ref_table"), F.trim(x["c"]).alias("ref_column")))
    equal = F.filter(
        F.array(F.struct(*[F.trim(F.regexp_extract(text, pair, i + 1)).alias(n)
                           for i, n in enumerate(("src_table", "src_column", "ref_table", "ref_column"))])),
        lambda x: x["src_table"] != "")
    edges = F.when(is_pair, equal).otherwise(direct)
    return catalog.where(text != "").select("db_id", F.explode(edges).alias("e")).select("db_id", "e.*")


def fk_lines(edges: DataFrame) -> DataFrame:
    """``a.b = c.d`` text of each edge."""
    left, right = F.concat_ws(".", "src_table", "src_column"), F.concat_ws(".", "ref_table", "ref_column")
    return edges.select("db_id", F.concat_ws(" = ", left, right).alias("line"))


def fk_columns(edges: DataFrame) -> DataFrame:
    """Columns that take part in a foreign key, per table."""
    sides = F.array(
        F.struct(F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name")),
        F.struct(F.col("ref_table").alias("table_name"), F.col("ref_column").alias("column_name")))
    return edges.select("db_id", F.explode(sides).alias("s")).select("db_id", "s.*").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    condition = F.concat_ws(" = ", F.concat_ws(".", "src_table", "src_column"), F.concat_ws(".", "ref_table", "ref_column"))
    ways = F.array(
        F.struct(F.col("src_table").alias("a"), F.col("ref_table").alias("b"), condition.alias("on")),
        F.struct(F.col("ref_table").alias("a"), F.col("src_table").alias("b"), condition.alias("on")))
    return edges.select("db_id", F.explode(ways).alias("w")).select("db_id", "w.*").where("a <> b").groupBy("db_id", "a", "b").agg(F.min("on").alias("on"))


def fk_neighbors(selected: DataFrame, edges: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Tables one foreign key away from the selected ones, in either direction.

    ``selected``: ``instance_id, db_id, table_name``.  ``counted`` has at least as many rows; give it where it is cheaper to
    count.  The number of tasks that hold neighbours grows with that count.
    """
    rows = (selected if counted is None else counted).count()
    tasks = max(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))
    ways = both_ways(edges).select("db_id", F.lower("a").alias("_a"), F.col("b").alias("table_name"))
    near = (
        selected.select("instance_id", "db_id", F.lower("table_name").alias("_a"))
        .join(ways, ["db_id", "_a"]).select("instance_id", "db_id", "table_name", F.lower("table_name").alias("_l"))
    )
    taken = selected.select("instance_id", F.lower("table_name").alias("_l")).repartition(tasks, "instance_id", "_l")
    return near.join(taken, ["instance_id", "_l"], "left_anti").distinct().drop("_l")


def join_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest foreign-key path between table pairs with its ON conditions.

    Breadth-first frontier joins from the sources asked for; each round is cut
    from its lineage and the loop ends when no new table is reached, or after
    ``max_hops`` rounds if that is given.
    """
    ways = cut_lineage(both_ways(edges))
    reached = pairs.select("db_id", "source", F.col("source").alias("node"), F.lit(0).alias("hops"),
                           F.array().cast("array<string>").alias("path")).distinct()
    frontier = reached
    for hop in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        step = frontier.join(ways.withColumnRenamed("a", "node"), ["db_id", "node"]).select(
            "db_id", "source", F.col("b").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("on")).alias("path"))
        best = step.groupBy("db_id", "source", "node").agg(F.min(F.struct("hops", "path")).alias("m"))
        fresh = best.join(reached, ["db_id", "source", "node"], "left_anti").select("db_id", "source", "node", "m.hops", "m.path")
        frontier = cut_lineage(fresh)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return pairs.join(reached.withColumnRenamed("node", "target"), ["db_id", "source", "target"])


def _in_order(value: Column, order: str = "column_no") -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(order), value.alias("v"))))["v"]


def render_catalog(catalog: DataFrame, style: str = "detail") -> DataFrame:
    """Prompt text per database in one of the styles detail, compact, ddl, sequence.

    ``sequence`` reads an optional ``matches array<string>`` column of cell values.
    """
    per_table = ["db_id", "table_name"]
    if style == "detail":
        notes = F.substring("column_descriptions", 1, CUT)
        parts = F.concat_ws(", ", F.concat(F.lit("Type: "), F.substring("column_types", 1, CUT)),
                            F.when(notes != "", F.concat(F.lit("Description: "), notes)))
        item = F.concat("column_name", F.lit("("), parts, F.lit(")"))
        lines = catalog.groupBy(*per_table).agg(
            F.array_join(_in_order(item), ", ").alias("_items"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("primary_key"), F.struct("column_no", F.concat(F.lit("`"), "column_name", F.lit("`")).alias("v")))))["v"], ", ").alias("_pk"),
            F.flatten(_in_order(F.transform(F.regexp_extract_all("foreign_key", F.lit(r"\[(.*?)\]"), 1),
                                            lambda k: F.concat(F.col("table_name"), F.lit("("), F.col("column_name"), F.lit(") references "), k)))).alias("_fk"),
        )
        line = F.concat(F.lit("### Table = `"), "table_name", F.lit("`, columns = ["), "_items", F.lit("]"))
        pk = F.when(F.col("_pk") != "", F.concat("table_name", F.lit("("), "_pk", F.lit(")")))
        packed = lines.groupBy("db_id").agg(
            _in_order(line, "table_name").alias("l"), _in_order(pk, "table_name").alias("p"), F.flatten(_in_order(F.col("_fk"), "table_name")).alias("f"))
        primary, foreign = F.array_join("p", ", "), F.array_join("f", ", ")
        text = F.concat(
            F.array_join("l", "\n\n"), F.lit("\n"),
            F.when(primary != "", F.concat(F.lit("\n### Primary Keys:\n"), primary, F.lit("\n"))).otherwise(""),
            F.when(foreign != "", F.concat(F.lit("\n### Foreign Keys:\n"), foreign, F.lit("\n"))).otherwise(""))
        return packed.select("db_id", text.alias("text"))
    if style == "compact":
        line, glue = F.concat(F.lit("# "), "table_name", F.lit(" ( "), F.array_join("_c", ", "), F.lit(" )")), "\n"
        item = F.col("column_name")
    elif style == "ddl":
        line, glue = F.concat("table_name", F.lit("("), F.array_join("_c", ","), F.lit(")")), "\n# "
        item = F.concat(F.lit("`"), "column_name", F.lit("`"))
    elif style == "sequence":
        line, glue = F.concat("table_name", F.lit(" : "), F.array_join("_c", ", ")), " | "
        item = F.col("column_name")
        if "matches" in catalog.columns:
            shown = F.array_join(F.slice("matches", 1, 2), ", ")
            item = F.when(F.size("matches") > 0, F.concat("column_name", F.lit("("), shown, F.lit(")"))).otherwise(item)
    else:
        raise ValueError(f"unknown style {style!r}")
    lines = catalog.groupBy(*per_table).agg(_in_order(item).alias("_c"))
    return lines.groupBy("db_id").agg(F.array_join(_in_order(line, "table_name"), glue).alias("text"))


def _long(df: DataFrame, table_name: str) -> DataFrame:
    names = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    cells = [F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in names]
    return df.select(F.explode(F.array(*cells)).alias("c")).select(F.lit(table_name).alias("table_name"), "c.*")


def profile_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """NULLs, uniqueness, distinct count and up to three sample values per column.

    Values are counted per (column, value) first, so no task sees a whole column.
    """
    counted = None
    for name, df in tables.items():
        part = _long(df, name).groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = part if counted is None else counted.unionByName(part)
    keys = ["table_name", "column_name"]
    known = F.col("value").isNotNull()
    base = counted.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.coalesce(F.bool_or(~known), F.lit(False)).alias("has_null"), (F.max("n") == 1).alias("is_unique"),
        F.count("value").alias("distinct_count"))
    first = Window.partitionBy(*keys).orderBy("value")
    samples = (
        counted.where(known).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= SAMPLES)
        .groupBy(*keys).agg(F.array_sort(F.collect_list("value")).alias("samples")))
    long_text = F.length(F.array_join("samples", ", ")) > LONG_TEXT
    return base.join(samples, keys, "left").withColumn("long_text", F.coalesce(long_text, F.lit(False)))


def distinct_values(tables: dict[str, DataFrame], limit: int) -> DataFrame:
    """Value picklist per column: the first ``limit`` distinct values in order."""
    picked = None
    for name, df in tables.items():
        values = _long(df, name).where(F.col("value").isNotNull()).distinct()
        order = Window.partitionBy("table_name", "column_name").orderBy("value")
        part = values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        picked = part if picked is None else picked.unionByName(part)
    return picked


def column_notes(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Descriptions of the linked columns as one text per instance.

    ``notes``: ``table_name, column_name, description``; ``links``: ``instance_id, link``.
    """
    keyed = links.select("instance_id", F.lower("link").alias("_k")).distinct()
    named = notes.select(F.lower(F.concat_ws(".", "table_name", "column_name")).alias("_k"), "description")
    line = F.concat(F.col("_k"), F.lit(": "), F.col("description"))
    return keyed.join(named, "_k").groupBy("instance_id").agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("notes"))

"""Keyed joins that assemble, align, repair and link sample rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REPAIRED = ("pred_sql", "instance_schemas", "tc_original", "trace")  # fixed value: fields a repair overrides
MAX_VALUE = 50  # fixed value: shown cells are shorter than this
SHOWN = 5  # fixed value: similar cells shown per column


def assemble_samples(rows: DataFrame, parts: Sequence[DataFrame], diagnostics: DataFrame | None = None) -> DataFrame:
    """Left-join per-sample results onto rows by id; diagnostics only fill what rows lack."""
    result = rows
    for part in parts:
        result = result.join(part, "instance_id", "left")
    if diagnostics is None:
        return result
    shared = [c for c in diagnostics.columns if c in result.columns and c != "instance_id"]
    renamed = diagnostics.select(*[F.col(c).alias(f"_d_{c}") if c in shared else F.col(c) for c in diagnostics.columns])
    joined = result.join(renamed, "instance_id", "left")
    for c in shared:
        joined = joined.withColumn(c, F.coalesce(c, f"_d_{c}"))
    return joined.drop(*[f"_d_{c}" for c in shared])


def align_iterations(attempts: DataFrame) -> DataFrame:
    """Outcome per sample over k runs; a sample missing from a run has no outcome.

    ``attempts``: ``instance_id, iteration, ex, exec_error``.  Any pass counts
    as pass; all invalid stays NULL; the first error text is kept.
    """
    runs = attempts.agg(F.count_distinct("iteration")).scalar()
    folded = attempts.groupBy("instance_id").agg(
        F.max("ex").alias("ex"), F.count_distinct("iteration").alias("seen"),
        F.min_by(F.when(F.col("exec_error") != "", F.col("exec_error")), F.when(F.col("exec_error") != "", F.col("iteration"))).alias("exec_error"),
    ).withColumn("runs", runs)
    short = F.col("seen") < F.col("runs")
    return folded.select(
        "instance_id", F.when(~short, F.col("ex")).alias("ex"),
        F.when(short, "missing aligned rows across generate runs").otherwise(F.col("exec_error")).alias("exec_error"))


def attach_trace(samples: DataFrame, trace: DataFrame) -> DataFrame:
    return samples.join(trace, "instance_id", "left")


def ordered_ids(*frames: DataFrame) -> DataFrame:
    """Union of ids in order of first appearance; frames carry ``instance_id, pos``."""
    union = None
    for source, frame in enumerate(frames):
        part = frame.select(F.col("instance_id").cast("string").alias("instance_id"), F.struct(F.lit(source).alias("source"), "pos").alias("at"))
        union = part if union is None else union.unionByName(part)
    return union.where(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(F.min("at").alias("at")).select("instance_id", "at.*")


def merge_repairs(original: DataFrame, repair: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Override fields where a non-empty replacement exists (``scores`` limits to passing ones)."""
    usable = repair.where(F.col("pred_sql").isNotNull() & (F.col("pred_sql") != ""))
    if scores is not None:
        usable = usable.join(scores.where(F.col("ex") == 1).select("instance_id"), "instance_id", "left_semi")
    fields = [f for f in REPAIRED if f in original.columns and f in repair.columns]
    renamed = usable.select("instance_id", F.lit(True).alias("_hit"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    joined = original.join(renamed, "instance_id", "left")
    replaced = [F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in original.columns]
    return joined.select(*replaced, F.coalesce("_hit", F.lit(False)).alias("replaced"))


def containment_join(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold links of an instance that contain a predicted link's text.

    Both sides are folded to one array per instance first (as wide as a
    catalog), so matching stays inside a row.
    """
    g = gold.groupBy("instance_id").agg(F.collect_set("link").alias("_g"))
    p = pred.groupBy("instance_id").agg(F.collect_set("link").alias("_p"))
    covered = F.filter("_g", lambda x: F.exists("_p", lambda y: F.instr(x, y) > 0))
    return g.join(p, "instance_id").select("instance_id", F.explode(covered).alias("link"))


def text_grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters (2 or 3) of a text, in time linear in its length."""
    chars = F.split(text, "")
    grams = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda x, y: F.concat(x, y))
    if size == 3:
        grams = F.zip_with(grams, F.slice(chars, 3, 1 << 30), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.filter(grams, lambda g: g.isNotNull()))


def find_similar_values(values: DataFrame, literals: DataFrame, limit: int = SHOWN, max_value: int | None = MAX_VALUE) -> DataFrame:
    """Distinct cells that contain a literal, at most ``limit`` per column; both sides carry ``db_id``.

    The cells' grams of two and three characters are an index, as long as the
    cells are.  A literal is looked up by the rarest of its grams in its
    database only, and what is found is compared with the whole literal; one
    with a gram that no cell has is in none.  Cells have fewer than
    ``max_value`` characters, or any number with None.
    """
    asked = literals.select("db_id", F.lower("literal").alias("_s"), "literal").where(F.length("literal") > 1).distinct()
    shown = values.select("db_id", "table_name", "column_name", "value").where(F.length("value") < max_value if max_value else F.col("value").isNotNull())
    cells = shown.distinct().withColumn("_t", F.lower("value"))
    index = cells.select("db_id", "_t").distinct().select("db_id", "_t", F.explode(F.concat(text_grams(F.col("_t"), 2), text_grams(F.col("_t"), 3))).alias("_g"))
    counts = index.groupBy("db_id", "_g").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("_s") == 2, F.array("_s")).otherwise(text_grams(F.col("_s"), 3))
    known = asked.select("db_id", "_s").distinct().select("db_id", "_s", F.explode(own).alias("_g")).join(counts, ["db_id", "_g"], "left")
    rarest = known.groupBy("db_id", "_s").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"), F.count_if(F.col("_n").isNull()).alias("_missing"))
    met = rarest.where("_missing = 0").drop("_missing").join(index, ["db_id", "_g"]).where(F.contains("_t", "_s")).select("db_id", "_s", "_t")
    hits = met.join(asked, ["db_id", "_s"]).join(cells, ["db_id", "_t"]).select("db_id", "table_name", "column_name", "value", "literal")
    order = Window.partitionBy("literal", "db_id", "table_name", "column_name").orderBy("value")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def exclude_retrieved(pool: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pool rows that an earlier turn has not returned yet."""
    return pool.join(hits.select(*keys).distinct(), list(keys), "left_anti")


def keep_known_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Links that name a column of their database, spelled as in the catalog."""
    known = catalog.select("db_id", F.concat_ws(".", "table_name", "column_name").alias("known")).distinct()
    known = known.withColumn("_k", F.lower("known"))
    asked = links.withColumn("_k", F.lower(F.trim(F.translate("link", "`", ""))))
    return asked.join(known, ["db_id", "_k"]).select("instance_id", "db_id", F.col("known").alias("link")).distinct()


def merge_links(*parts: DataFrame) -> DataFrame:
    """Lower-cased union of several link lists."""
    union = None
    for part in parts:
        low = part.select("instance_id", F.lower("link").alias("link"))
        union = low if union is None else union.unionByName(low)
    return union.distinct()


def keyed_merge(left: DataFrame, right: DataFrame, key: str = "instance_id") -> DataFrame:
    """Update left rows with the non-NULL values of the right row of the same key."""
    shared = [c for c in right.columns if c != key]
    renamed = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in shared])
    joined = left.join(renamed, key, "left")
    kept = [F.coalesce(f"_r_{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns]
    added = [F.col(f"_r_{c}").alias(c) for c in shared if c not in left.columns]
    return joined.select(*kept, *added)


def drop_located(chunks: DataFrame, links: DataFrame, reserve: DataFrame | None = None) -> DataFrame:
    """Remove located columns from every chunk, then concatenate and dedupe by column."""
    found = links.select("instance_id", F.split("link", r"\.")[0].alias("table_name"), F.split("link", r"\.")[1].alias("column_name"))
    kept = chunks.join(found.distinct(), ["instance_id", "table_name", "column_name"], "left_anti")
    if reserve is not None:
        kept = kept.select(*chunks.columns).unionByName(reserve.select(*chunks.columns))
    return kept.dropDuplicates(["instance_id", "table_name", "column_name"])

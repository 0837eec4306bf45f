"""Executing query texts over registered views and recording their cells."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WRITTEN = "instance_id string, candidate int, at bigint, col_no int, num_value double, str_value string"
STATUS = "instance_id string, candidate int, n_cols bigint, error string, elapsed_s double"
NUMBERS = ("byte", "short", "integer", "long", "float", "double", "decimal")
TIMEOUT_S = 60.0  # fixed value: seconds one query may take
SLICE = 256  # query texts that the driver holds at once
AT_BITS = 33  # bits of the place within a partition in a monotonic row id


def result_cells(result: DataFrame) -> DataFrame:
    """Long cells of one result: numbers as doubles, all else as text, NULL as both missing.

    ``at`` has the partition and the place in it, so rows are numbered from what was written, without another execution.
    """
    names = [f"c{i}" for i in range(len(result.columns))]
    cells = []
    for i, field in enumerate(result.schema.fields):
        numeric = field.dataType.typeName() in NUMBERS
        value = F.col(names[i])
        cells.append(F.struct(
            F.lit(i).alias("col_no"), (value.cast("double") if numeric else F.lit(None).cast("double")).alias("num_value"),
            (F.lit(None).cast("string") if numeric else value.cast("string")).alias("str_value")))
    placed = result.toDF(*names).withColumn("at", F.monotonically_increasing_id())
    return placed.select("at", F.explode(F.array(*cells)).alias("c")).select("at", "c.*")


def numbered_cells(written: DataFrame) -> DataFrame:
    """Row numbers from 0 per query in place of ``at``: places within a partition, after the rows of the partitions before."""
    keys = ["instance_id", "candidate", "_part"]
    parted = written.withColumn("_part", F.shiftrightunsigned("at", AT_BITS)).withColumn("_place", F.col("at").bitwiseAND((1 << AT_BITS) - 1))
    sizes = parted.groupBy(*keys).agg((F.max("_place") + 1).alias("_n"))
    earlier = Window.partitionBy("instance_id", "candidate").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return parted.join(before, keys).select(
        "instance_id", "candidate", (F.col("_before") + F.col("_place")).alias("row_no"), "col_no", "num_value", "str_value")


def _run_one(spark: SparkSession, instance_id: str, candidate: int | str | None, sql: str | None, out_path: str, timeout_s: float) -> tuple:
    """Status of one query; its cells are appended in one execution, whose time is taken.  Whatever fails is in the status."""
    tag = f"pair-{uuid.uuid4().hex}"
    error, width, start = None, None, time.monotonic()
    context = spark.sparkContext
    late = threading.Event()
    try:
        number = int(candidate)
    except (TypeError, ValueError):
        return instance_id, None, None, f"candidate {candidate!r} is not a number", 0.0

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_s, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        result = spark.sql(sql)
        width = len(result.columns)
        named = result_cells(result).select(F.lit(instance_id).alias("instance_id"), F.lit(number).cast("int").alias("candidate"), "*")
        start = time.monotonic()
        named.write.parquet(f"{out_path}/pair={tag}")  # a folder of its own: writers side by side share no temporary files
    except Exception as problem:  # noqa: BLE001 - one bad query must not stop the batch
        error = "timed out" if late.is_set() else next(iter(str(problem).splitlines()), "") or type(problem).__name__
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    return instance_id, number, width, error, time.monotonic() - start


def _slices(queries: DataFrame | Iterable[tuple[str, int, str]]) -> Iterator[list]:
    rows = queries.select("instance_id", "candidate", "sql").toLocalIterator() if isinstance(queries, DataFrame) else iter(queries)
    while part := list(islice(rows, SLICE)):
        yield part


def run_query_pairs(
    spark: SparkSession, queries: DataFrame | Iterable[tuple[str, int, str]], out_path: str, timeout_s: float = TIMEOUT_S, at_once: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Run ``instance_id, candidate, sql`` and append their cells to ``out_path``, each text once.

    Every text is a plan of its own, so the driver starts them: it reads the texts in bounded slices and runs ``at_once``
    of them side by side; results go from the executors straight to the table.  A failing or slow query is recorded and
    does not stop the rest; every text has its status, also one without a usable candidate.  Returns (cells, status).
    """
    spark.createDataFrame([], WRITTEN).write.mode("append").parquet(f"{out_path}/cells/pair=none")
    spark.createDataFrame([], STATUS).write.mode("append").parquet(f"{out_path}/status")
    for part in _slices(queries):
        status: list[tuple] = []
        broken: list[BaseException] = []

        def work(todo: list, status: list = status, broken: list = broken) -> None:
            try:
                for instance_id, candidate, sql in todo:
                    status.append(_run_one(spark, instance_id, candidate, sql, f"{out_path}/cells", timeout_s))
            except BaseException as problem:  # noqa: BLE001 - a thread's error must reach the caller
                broken.append(problem)

        # Tags belong to a thread, so each worker takes every ``at_once``-th text of the slice.
        threads = [InheritableThread(target=work, args=(part[k::at_once],), session=spark) for k in range(min(at_once, len(part)))]
        for thread in threads:
            thread.start()
        for thread in threads:
            thread.join()
        if broken:
            raise broken[0]
        spark.createDataFrame(status, STATUS).write.mode("append").parquet(f"{out_path}/status")
    cells = numbered_cells(spark.read.schema(f"{WRITTEN}, pair string").parquet(f"{out_path}/cells").drop("pair"))
    sizes = cells.groupBy("instance_id", "candidate").agg((F.max("row_no") + 1).alias("n_rows"))
    known = spark.read.schema(STATUS).parquet(f"{out_path}/status")
    done = known.join(sizes, ["instance_id", "candidate"], "left").withColumn(
        "n_rows", F.when(F.col("error").isNull(), F.coalesce("n_rows", F.lit(0))))
    return cells, done

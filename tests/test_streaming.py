"""Incremental scoring: ids are state of the stream, and earlier samples are not read again."""

import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyspark.streaming import incremental as I

SCHEMA = "instance_id string, ex int, note string"


def feed(spark, folder, number, rows):
    """A file of the stream; the number is part of its time, so files come in order."""
    path = f"{folder}/in/{number}"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    for name in os.listdir(path):
        if name.startswith("part-"):
            os.makedirs(f"{folder}/stream", exist_ok=True)
            shutil.copy(f"{path}/{name}", f"{folder}/stream/{number}.parquet")
            os.utime(f"{folder}/stream/{number}.parquet", (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/stream")
    I.incremental_score(stream, f"{folder}/store", f"{folder}/state", ["ex"]).awaitTermination()


def totals(spark, folder):
    return [(r["batch"], r["samples"], r["ex_sum"], r["ex_n"]) for r in spark.read.parquet(f"{folder}/store/totals").orderBy("batch").collect()]


def test_a_third_batch_reads_no_earlier_sample(spark, tmp_path):
    folder = str(tmp_path)
    feed(spark, folder, 1, [("a", 1, "x"), ("b", None, "y"), ("c", 0, None)])
    feed(spark, folder, 2, [("d", 1, "x")])
    run(spark, folder)
    assert totals(spark, folder) == [(0, 3, 1.0, 2), (1, 1, 1.0, 1)]
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/store/samples").drop("batch").collect()), key=str) == [("a", 1, "x"), ("b", None, "y"), ("c", 0, None), ("d", 1, "x")]
    shutil.rmtree(f"{folder}/store/samples")  # what was stored cannot be read any more
    feed(spark, folder, 3, [("e", 1, "x"), ("f", 1, "x")])
    run(spark, folder)
    assert totals(spark, folder)[2] == (2, 2, 2.0, 2)
    assert spark.read.parquet(f"{folder}/store/samples").where(F.col("batch") < 2).count() == 0
    feed(spark, folder, 4, [("g", 1, "x"), ("b", 1, "again")])
    with pytest.raises(StreamingQueryException, match="sample already present: b"):
        run(spark, folder)
    assert len(totals(spark, folder)) == 3  # nothing of the refused batch is kept


def test_a_sample_twice_in_one_batch(spark, tmp_path):
    folder = str(tmp_path)
    feed(spark, folder, 1, [("a", 1, "x"), ("a", 0, "y")])
    with pytest.raises(StreamingQueryException, match="sample already present: a"):
        run(spark, folder)

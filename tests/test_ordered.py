"""Ordered helpers: cut keys must give the same answers as a plain window."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{i % 40}", rng.randrange(1000), i, rng.choice([None, 1, 2, 3])) for i in range(1200)]
    return spark.createDataFrame(data, "k string, o int, id int, v int")


def order():
    return [F.col("o"), F.col("id")]


def collect(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
def test_hot_equals_plain(rows, keys):
    for call in (
        lambda h: O.numbered(rows, keys, order(), hot_rows=h),
        lambda h: O.with_previous(rows, keys, order(), "v", "p", hot_rows=h),
        lambda h: O.running(rows, keys, order(), sums={"s": "v"}, maxima={"m": "v"}, hot_rows=h),
        lambda h: O.percentiles(rows, keys, "o", {"p50": 50.0, "p95": 95.0, "n95": 95.0}, nearest=("n95",), hot_rows=h),
    ):
        assert collect(call(50)) == collect(call(10**9))


def test_hot_key_is_cut(rows):
    cut = O.cut_hot_keys(rows, ["k"], order(), hot_rows=50)
    pieces = {r["k"]: r["n"] for r in cut.groupBy("k").agg(F.count_distinct("_ord_piece").alias("n")).collect()}
    assert pieces["hot"] > 4
    assert all(n == 1 for k, n in pieces.items() if k != "hot")


def test_percentile_rules(spark):
    df = spark.createDataFrame([(v,) for v in (100, 100, 1000)], "v int")
    row = O.percentiles(df, [], "v", {"lin": 95.0, "near": 95.0}, nearest=("near",)).first()
    assert row["lin"] == pytest.approx(910)
    assert row["near"] == 1000
    one = O.percentiles(spark.createDataFrame([(7,)], "v int"), [], "v", {"p": 95.0}).first()
    assert one["p"] == 7


def test_callers_may_use_short_names(spark):
    """Helper columns must not clash with those of a caller."""
    names = ("_o", "_n", "_r", "_c", "_v", "_last", "_before", "_piece", "_hot", "_edges")
    df = spark.range(400).select(F.lit("k").alias("k"), *[(F.col("id") * 7 % 401).alias(n) for n in names])
    for out in (O.numbered(df, ["k"], [F.col("_o")], hot_rows=30), O.with_previous(df, ["k"], [F.col("_o")], "_last", "p", hot_rows=30),
                O.running(df, ["k"], [F.col("_o")], sums={"s": "_v"}, hot_rows=30)):
        assert out.count() == 400 and set(names) <= set(out.columns)

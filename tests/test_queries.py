"""Every registered query against its SQL text in DuckDB, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402
import check_queries as check  # noqa: E402
from tallyspark.functions import ordered  # noqa: E402

SF = os.environ.get("TALLYSPARK_TEST_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message, _, _ = check.compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message


# Queries built on ordered windows: the same results must come from cut keys.
ORDERED = [
    "execution_match", "execution_match_any_order", "soft_f1", "percentile_linear", "percentile_nearest_rank", "latency_summary",
    "token_steps", "rank_candidates", "decayed_sample", "split_batches", "natural_order", "chunk_catalog", "stagnation",
    "log_snapshots", "cumulative_metrics", "random_few_shot", "dataset_fingerprint", "slice_metrics",
]


@pytest.mark.parametrize("name", ORDERED)
def test_query_with_hot_keys(spark, duck, name, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 7)
    ok, message, _, _ = check.compare(spark, duck, SF, name, QUERIES[name], ORACLES[name])
    assert ok, message


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

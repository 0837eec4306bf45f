"""The one-pass matrix report against the separate reports, on logs with gaps."""

import random

import pytest

from tallyspark.operators import matrix as M


def log(seed, methods=4, queries=40):
    rng = random.Random(seed)
    rows = []
    for q in range(queries):
        for m in range(methods):
            for k in range(rng.choice([0, 1, 1, 1, 3]) if q % 5 == 0 else rng.randint(1, 2)):
                rows.append((f"m{m}", f"q{q}", k, rng.choice([None, 0, 1, 1]) if k else rng.choice([0, 1]), rng.choice([None, 0.0, rng.uniform(0.1, 9)])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report_is_the_same_as_the_parts(spark, seed):
    samples = spark.createDataFrame(log(seed), "method string, instance_id string, ts int, ex int, act_elapsed_s double").repartition(3)
    matrix = M.matrix_from_log(samples)
    gap = M.oracle_gap(matrix).first()
    want = {("oracle_gap", k): gap[k] for k in ("ex_static", "ex_dynamic", "gap", "query_count")}
    want |= {("method_disagreement", f"{r['method_a']}|{r['method_b']}"): r["combined"] for r in M.disagreement(matrix).collect()}
    want |= {("empirical_difficulty", str(r["solved_by"])): r["queries"] for r in M.difficulty_histogram(matrix).collect()}
    want |= {("uniquely_solved", r["method"]): r["queries"] for r in M.uniquely_solved_counts(matrix).collect()}
    want |= {("efficiency_headroom", str(r["solved_by"])): r["headroom"] for r in M.efficiency_headroom(matrix).collect()}
    for cells in (M.packed_cells(samples), matrix):
        got = {(r["section"], r["item"]): r["value"] for r in M.matrix_report(cells).collect()}
        assert got == pytest.approx(want)
    assert M.oracle_gap_of_log(samples).first().asDict() == pytest.approx(gap.asDict())
    assert M.matrix_report(M.packed_cells(samples.where("method <> 'm0' OR instance_id = 'none'"))).where("section = 'uniquely_solved'").count() == 3


def test_the_log_is_read_once(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(log(4), "method string, instance_id string, ts int, ex int, act_elapsed_s double").write.parquet(path)
    report = M.matrix_report(M.packed_cells(spark.read.parquet(path)))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and report.count() > 0
    assert M.matrix_report(M.packed_cells(spark.read.parquet(path).limit(0))).count() == 0

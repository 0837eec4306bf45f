"""Hand-made tables for the NULL, empty and tie rules."""

import pytest
from pyspark.sql import functions as F

from tallyspark.metrics import Metric, Registry, default_registry
from tallyspark.operators import aggregate as A
from tallyspark.operators import catalog as K
from tallyspark.operators import evolve as V
from tallyspark.operators import hooks as H
from tallyspark.operators import matrix as M
from tallyspark.operators import process as P
from tallyspark.operators import sampling as B
from tallyspark.operators import scans as N
from tallyspark.operators import scoring as S
from tallyspark.operators import sqltext as Q
from tallyspark.sources import publish, readers, store
from tallyspark.streaming import incremental as I


@pytest.fixture(scope="module")
def five(spark):
    rows = [("s0", 1, "easy", "sqlite", 1.0), ("s1", 0, "easy", "sqlite", 2.0), ("s2", 1, "medium", "sqlite", 3.0),
            ("s3", 0, "hard", "bigquery", 8.0), ("s4", 1, "extra", None, 5.0)]
    return spark.createDataFrame(rows, "instance_id string, ex int, hardness string, db_type string, act_elapsed_s double")


def test_slices_keep_fixed_and_name_unknown(five):
    cells = {(r["axis"], r["label"]): r["count"] for r in A.slice_metrics(five, default_registry()).collect()}
    assert cells[("db_type", "unknown")] == 1 and cells[("db_type", "sqlite")] == 3
    assert [cells[("hardness", h)] for h in ("easy", "medium", "hard", "extra")] == [2, 1, 1, 1]
    empty = A.slice_metrics(five.where("hardness = 'easy'"), default_registry(), axes=["hardness"], layer="L1").collect()
    assert {r["label"]: (r["count"], r["metric_id"]) for r in empty}["hard"] == (0, None)


def test_overall_cells(five):
    cells = {r["metric_id"]: r for r in A.aggregate_metrics(five, default_registry()).collect()}
    assert cells["ex"]["value"] == pytest.approx(0.6) and cells["ex"]["low"] == pytest.approx(0.230724, abs=1e-5)
    assert cells["latency_p50"]["value"] == 3.0 and cells["latency_p95"]["value"] == pytest.approx(7.4)


def test_registry_rejects_bad_declarations():
    with pytest.raises(ValueError):
        Metric("x", "L9", "x", "mean")
    with pytest.raises(ValueError):
        Metric("x", "L1", "x", "percentile")
    with pytest.raises(ValueError):
        Registry().register(Metric("x", "L1", "x", "mean"), Metric("x", "L1", "x", "mean"))


def test_two_methods_four_queries(spark):
    ex = {"A": (1, 1, 1, 0), "B": (0, 1, 0, 1)}
    rows = [(m, f"q{i}", float(v), t) for m, t in (("A", 1.0), ("B", 3.0)) for i, v in enumerate(ex[m])]
    log = spark.createDataFrame(rows, "method string, instance_id string, value double, t double")
    matrix = M.method_matrix(log, log.select("method", "instance_id", F.col("t").alias("value"))).cache()
    gap = M.oracle_gap(matrix).first()
    assert (gap["ex_static"], gap["ex_dynamic"], gap["gap"], gap["best_static_method"]) == (0.75, 1.0, 0.25, "A")
    pair = M.disagreement(matrix).first()
    assert (pair["sample"], pair["efficiency"], pair["combined"]) == (0.75, 0.5, 0.625)
    assert {r["method"]: r["queries"] for r in M.uniquely_solved_counts(matrix).collect()} == {"A": 2, "B": 1}
    room = {r["solved_by"]: r["headroom"] for r in M.efficiency_headroom(matrix).collect()}
    assert room[1] == 0 and room[2] == pytest.approx(2 / 3)


def test_static_tie_goes_to_first_name(spark):
    log = spark.createDataFrame([("B", "q", 1.0), ("A", "q", 1.0)], "method string, instance_id string, value double")
    assert M.oracle_gap(M.method_matrix(log)).first()["best_static_method"] == "A"


def test_query_variance_rules(spark):
    rows = [("a ", 1), ("a", 0), ("b", 1), ("c", None), ("c", None), ("d", 1), ("d", None)]
    got = {r["gold_sql"]: (r["sample_count"], r["exec_acc"], r["flip"]) for r in A.query_variance_groups(spark.createDataFrame(rows, "gold_sql string, ex int")).collect()}
    assert got == {"a": (2, 0.5, True), "d": (2, 1.0, False)}


def test_bootstrap_of_one_value(spark):
    df = spark.createDataFrame([(1, 0.4)], "id int, v double")
    row = A.bootstrap_interval(df, [], "v", ["id"]).first()
    assert (row["low"], row["high"]) == (0.4, 0.4)


def test_gates(spark):
    rows = [("a", "s", None, 1, 5.0), ("b", None, None, 1, 1.0), ("c", "s", "Timed out", 0, 1.0), ("d", "s", "bad", 0, 1.0), ("e", "s", None, 0, 1.0), ("f", "s", None, 1, 50.0)]
    df = spark.createDataFrame(rows, "instance_id string, pred_sql string, exec_error string, ex int, act_elapsed_s double")
    got = {r["instance_id"]: r["failed_at"] for r in P.gate_outcome(df, 10.0).collect()}
    assert got == {"a": None, "b": "parseable", "c": "timely", "d": "executable", "e": "correct", "f": "efficient"}
    no_budget = {r["gate"]: r["survival"] for r in P.gate_funnel(df).collect()}
    assert no_budget["efficient"] is None and no_budget["correct"] == pytest.approx(2 / 6)


def test_link_scores(spark):
    rows = [(1, ["t.ab", "t.c"], ["t.a", "x.y"]), (2, ["t.a"], []), (3, [], ["t.a"]), (4, ["t.a"], None)]
    df = spark.createDataFrame(rows, "instance_id int, gold_schemas array<string>, pred_schemas array<string>")
    got = {r["instance_id"]: (r["link_recall"], r["link_precision"], r["link_exact_ref"], r["link_exact"]) for r in S.linking_scores(df).collect()}
    assert got[1] == (0.5, 0.5, True, False)  # this exactness only compares the two rates
    assert got[2] == (0.0, 0.0, True, False) and got[3] == got[4] == (None, None, None, None)


def test_efficiency_drops_outliers(spark):
    timings = spark.createDataFrame([(1, n, 1.0 if n < 9 else 100.0, 1.0) for n in range(10)], "instance_id int, repeat int, gold_s double, pred_s double")
    correct = spark.createDataFrame([(1, True), (2, False), (3, None)], "instance_id int, correct boolean")
    got = {r["instance_id"]: (r["ves"], r["rves"]) for r in S.efficiency_score(timings, correct).collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (None, None)}


def test_snapshot_key_prefers_exact_name(spark):
    df = spark.sql("SELECT map('pred_sql_before_MyScaler', array('a'), 'pred_sql_before_scale2', array('b')) AS m")
    row = df.select(S.before_key(F.col("m"), ("scale",)).alias("loose"), S.before_key(F.col("m"), ("scale",), "scale2").alias("exact"),
                    S.before_key(F.col("m"), ("select",)).alias("none")).first()
    assert tuple(row) == ("pred_sql_before_MyScaler", "pred_sql_before_scale2", None)


SQLS = [
    ("SELECT DISTINCT T1.name, count(*) AS n FROM singer AS T1 JOIN concert T2 ON T1.id = T2.sid WHERE T1.age > 20 AND T2.city LIKE 'New And%' GROUP BY T1.name HAVING count(*) > 2 ORDER BY T1.name DESC LIMIT 3;",
     {"query_fields": 2, "join": 1, "group_by": 1, "order_by": 1, "limit": 1, "like": 1, "distinct": 1, "aggregation": 2, "logical_connector": 1, "predicate": 4}),
    ("SELECT a FROM t WHERE x BETWEEN 1 AND 2 UNION SELECT b FROM u WHERE y IN (SELECT z FROM v)",
     {"query_fields": 1, "set_operation": 1, "subquery": 1, "logical_connector": 0, "predicate": 2}),
    ("SELECT * FROM t WHERE a = b + 1 -- and or", {"math_compute": 1, "logical_connector": 0}),
    (None, {"query_fields": -1, "like": -1}),
]


def test_sql_features(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SQLS)], "i int, sql string")
    for row in Q.sql_text_features(df, "sql").collect():
        for name, expected in SQLS[row["i"]][1].items():
            assert row["features"][name] == expected, (row["i"], name)


def test_sql_components(spark):
    row = Q.sql_components(spark.createDataFrame([(SQLS[0][0],)], "sql string"), "sql").first()
    assert row["c_select"] == ["count(*) as n", "name"] and row["c_join"] == ["concert", "singer"]
    assert row["c_where"] == ["age > VAL:20", "city LIKE", "count(*) > 2", "id = COL"] or "age > VAL:20" in row["c_where"]
    assert row["c_order"] == ["__LIMIT__", "name"] and row["c_keywords"] == ["DISTINCT", "LIKE"]


def test_component_scores_of_empty_sets(spark):
    df = spark.sql("SELECT array() AS a, array() AS b, array('x') AS c")
    f = df.select(Q.set_scores(F.col("a").cast("array<string>"), F.col("b").cast("array<string>"))["f1"].alias("both"),
                  Q.set_scores(F.col("c"), F.col("b").cast("array<string>"))["f1"].alias("one")).first()
    assert tuple(f) == (1.0, 0.0)


def test_fitness_terms(spark):
    assert (V.explore_weight(0.4), V.explore_weight(0.6), V.explore_weight(0.9)) == (1.0, pytest.approx(0.6), 0.2)
    run = spark.createDataFrame([(0.8, 0.5, 2.0, 0.6, -0.5, 3.0, 0.1)], "ex double, em double, ves double, hard_slice_score double, cost_delta double, latency_delta double, regression_rate double")
    assert V.run_fitness(run).first()["fitness"] == pytest.approx(0.45 * 0.8 + 0.05 + 0.1 + 0.12 + 0.05 - 0.05 - 0.015)


def test_stagnation_needs_history(spark):
    nodes = spark.createDataFrame([(1, n, f) for n, f in enumerate((0.5, 0.2, 0.3))] + [(2, 0, 0.1), (2, 1, 0.2)], "branch_id int, node_no int, fitness double")
    got = {r["branch_id"]: r["stagnant"] for r in V.stagnation(nodes, ["branch_id"], 2).collect()}
    assert got == {1: True, 2: False}


def test_filter_language(spark):
    assert B.parse_filter("20") == {"limit": (None, "20")}
    with pytest.raises(ValueError):
        B.parse_filter("a-b-c-d")
    df = spark.createDataFrame([(f"dev_{i}", i, "x" * i) for i in range(10)], "instance_id string, db_size int, question string")
    order = [B.natural_key(F.col("instance_id"))]
    assert [r["db_size"] for r in B.filter_samples(df, "db_size-5", order).collect()] == [0, 1, 2, 3, 4]
    limited = B.filter_samples(df, "limit-6.random-3.seed-1", order).collect()
    assert len(limited) == 3 and all(r["db_size"] < 6 for r in limited)


def test_natural_order(spark):
    ids = ["dev_10", "dev_2", "x", "dev_1"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").orderBy(B.natural_key(F.col("id")))
    assert [r["id"] for r in df.collect()] == ["dev_1", "dev_2", "dev_10", "x"]


def test_batches_disjoint(spark):
    B.assert_disjoint(spark.createDataFrame([("a", 0), ("b", 1)], "instance_id string, batch int"))
    with pytest.raises(ValueError):
        B.assert_disjoint(spark.createDataFrame([("a", 0), ("a", 1)], "instance_id string, batch int"))


def test_catalog_of_tables(spark):
    tables = {"a": spark.createDataFrame([(1, "x")], "id int, name string"), "b": spark.createDataFrame([(1, 2.0)], "a_id int, v double")}
    rows = {(r["table_name"], r["column_name"]): r for r in K.catalog_of(tables, "d", {"a": ["id"]}, [("b", "a_id", "a", "id")]).collect()}
    assert rows["a", "id"]["primary_key"] and rows["a", "name"]["column_types"] == "text" and rows["b", "v"]["column_types"] == "number"
    assert rows["b", "a_id"]["foreign_key"] == "[a(id)]"


def test_central_catalog_shift(spark):
    central = spark.sql("""SELECT 'd' AS db_id, CAST(NULL AS STRING) AS db_type, array('t', 'u') AS table_names_original,
      array(named_struct('table_idx', -1, 'name', '*'), named_struct('table_idx', 0, 'name', 'a'), named_struct('table_idx', 1, 'name', 'b')) AS column_names_original,
      array('text', 'number', 'text') AS column_types, array(named_struct('idx', -1, 'text', ''), named_struct('idx', 0, 'text', 'first')) AS column_descriptions,
      array(array(1)) AS primary_keys, array(named_struct('src', 2, 'dst', 1), named_struct('src', 2, 'dst', 9)) AS foreign_keys""")
    rows = {r["column_name"]: r for r in K.flatten_catalog(central).collect()}
    assert rows["a"]["primary_key"] and rows["a"]["column_types"] == "number" and rows["a"]["column_descriptions"] == "first"
    assert rows["b"]["foreign_key"] == "[t(a)]" and rows["b"]["column_descriptions"] == "" and rows["b"]["db_type"] == "sqlite"


def test_log_keeps_previous_prediction(spark, tmp_path):
    lines = ['{"instance_id": "s", "actor_name": "gen", "output_name": "pred_sql", "pred_sql": "A", "sl_recall": 0.5}', "not json",
             '{"instance_id": "s", "actor_name": "opt", "output_name": "pred_sql", "pred_sql": "B"}',
             '{"instance_id": "s", "actor_name": "opt", "output_name": "pred_sql", "pred_sql": "C", "parse_recall": 0.7}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = readers.read_log(spark, str(tmp_path / "log.jsonl"), "instance_id string, actor_name string, output_name string, pred_sql string, sl_recall double, parse_recall double")
    snap = {r["key"]: r["value"] for r in readers.log_snapshots(log, [F.col("pos")]).collect()}
    assert snap == {"pred_sql_before_opt": "A"}
    assert {r["field"]: float(r["value"]) for r in readers.log_diagnostics(log).collect()} == {"sl_recall": 0.7}


def test_missing_file_is_empty(spark):
    assert readers.read_rows(spark, "/nowhere/x.json", schema="a int").count() == 0


def test_store_replaces_a_run(spark, tmp_path):
    path = str(tmp_path / "store")
    runs = spark.createDataFrame([("r1", "m", "d", "dev", "2024-01-01"), ("r2", "m", "d", "dev", "2024-01-02")], "run_id string, method string, dataset string, split string, timestamp string")
    samples = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 0), ("r2", "a", 0)], "run_id string, instance_id string, ex int")
    store.write_eval_store(path, runs, samples)
    assert {r["instance_id"]: r["value"] for r in store.load_sample_metric(spark, path, "ex").collect()} == {"a": 0.0, "b": 0.0}
    store.write_eval_store(path, runs.where("run_id = 'r1'"), spark.createDataFrame([("r1", "b", 1)], "run_id string, instance_id string, ex int"))
    got = {(r["run_id"], r["instance_id"]): r["value"] for r in spark.read.parquet(f"{path}/sample_metrics").collect()}
    assert got == {("r1", "b"): 1.0, ("r2", "a"): 0.0}


def test_append_refuses_repeats(spark, tmp_path):
    path = str(tmp_path / "cum")
    assert store.append_predictions(path, spark.createDataFrame([("a",), ("b",)], "instance_id string")) == (2, 2)
    assert store.append_predictions(path, spark.createDataFrame([("c",)], "instance_id string")) == (3, 1)
    with pytest.raises(ValueError):
        store.append_predictions(path, spark.createDataFrame([("a",)], "instance_id string"))


def test_fingerprint_tree(spark):
    import hashlib

    df = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "instance_id string, pos int")
    def tree(chunk):
        level = [f"s{i}" for i in range(10)]
        for size in (chunk, chunk, len(level)):
            level = [hashlib.sha256("\n".join(level[a : a + size]).encode()).hexdigest() for a in range(0, len(level), size)]
        return level[0][:16]

    for chunk in (2, 4, 10, 200_000):
        assert publish.dataset_fingerprint(df, F.col("pos"), chunk=chunk).first()[0] == tree(chunk)


def test_secret_lines(spark):
    key = "AKIA" + "A" * 16
    text = f"one\n{key}\n{key} example\npassword =\n\n 'long enough'\napi_key: \"your_value_here\"\nsk-{'a' * 15}\n"
    docs = spark.createDataFrame([("f", text), ("g", key + "\x00"), ("h", "x" * 2_000_001 + key)], "path string, text string")
    everything = [("f", 2, "aws-access-key"), ("f", 4, "literal-credential-assignment"), ("g", 1, "aws-access-key")]
    assert sorted(map(tuple, N.scan_secrets(docs.where("path <> 'h'")).collect())) == everything
    long = spark.createDataFrame([("h", "x " * 1_500_000 + key)], "path string, text string")
    assert sorted(map(tuple, N.scan_secrets(long).collect())) == [("h", 1, "aws-access-key")]
    bounded = N.scan_secrets(docs.unionByName(long.withColumn("path", F.lit("i"))), max_bytes=2_000_000)
    assert sorted(map(tuple, bounded.collect())) == [*everything, ("h", 0, "not-scanned"), ("i", 0, "not-scanned")]


def test_identity_lines(spark):
    text = "me@corp.org, you@example.com\n/home/bob/x /Users/runner/y\nC:\\Users\\eve\\z\nAcme Inc\nmail a@b.co."
    rows = N.scan_identity(spark.createDataFrame([("f", text)], "path string, text string"), ["acme"]).collect()
    assert sorted((r["line"], r["category"]) for r in rows) == [
        (1, "personal email"), (2, "absolute user path"), (3, "absolute user path"), (4, "denylist term")]


def test_progress_ignores_stage_entry(spark):
    lines = [(1, "开始处理样本 a"), (2, "样本 a @ gen"), (3, "样本 a 处理完成"), (4, "样本 b @ sel")]
    row = I.progress(spark.createDataFrame(lines, "line_no int, line string"), target=4).first()
    assert tuple(row) == ("sel", 2, 1, 4, 25)


def test_convergence_needs_patience(spark):
    steps = spark.createDataFrame([(i, v) for i, v in enumerate((0.5, 0.7, 0.701, 0.702, 0.702))], "step int, v double")
    got = [r["converged"] for r in I.is_converged(steps, "v", 0.01, 2).orderBy("step").collect()]
    assert got == [False, False, False, True, True]


def test_custom_metric_isolates_errors(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "instance_id string, ex int")

    def fn(frame):
        if frame["instance_id"].iloc[0] == "b":
            raise RuntimeError("no")
        return {"mean": frame["ex"].mean(), "n": len(frame)}

    scores = H.custom_metric(df, fn)
    got = {(r["instance_id"], r["metric"]): (r["score"], r["error"]) for r in scores.collect()}
    assert got == {("a", "mean"): (0.5, None), ("a", "n"): (2.0, None), ("b", "score"): (None, "no")}


def test_transforms_by_name(spark):
    H.TRANSFORMS.pop("keep_even", None)
    H.register_transform("keep_even", lambda df: df.where("id % 2 = 0"))
    with pytest.raises(ValueError):
        H.register_transform("keep_even", lambda df: df)
    assert H.apply_transforms(spark.range(10), "keep_even").count() == 5


def test_benchmark_split_is_read_in_order(spark, tmp_path):
    folder = tmp_path / "bench" / "dev"
    folder.mkdir(parents=True)
    (folder / "dataset.json").write_text('[{"instance_id": "dev_10", "db_size": 5, "external_path": "a.md"}, {"instance_id": "dev_2", "db_size": 7, "external_path": ""}, {"instance_id": "dev_3", "db_size": 900, "external_path": ""}]')
    schema = "instance_id string, db_size int, external_path string"
    rows = readers.read_benchmark(spark, str(tmp_path), "bench:dev:db_size-l-100", schema, "/ext").collect()
    assert [(r["instance_id"], r["external_path"]) for r in rows] == [("dev_2", ""), ("dev_10", "/ext/a.md")]


def test_records_go_at_any_depth(spark):
    text = '{"ex": 1, "deep": [{"config_path": "x", "list": [{"per_sample": [1], "n": {"Path": 1, "k": "v"}}]}], "Records": []}'
    df = spark.createDataFrame([(text,), (None,), ("no json",), ("[]",)], "t string")
    assert [r[0] for r in N.strip_records(df, "t").collect()] == ['{"ex": 1, "deep": [{"list": [{"n": {"k": "v"}}]}]}', None, None, "[]"]
    numbers = spark.createDataFrame([('{"a b": 1, "x": {"y": [1, "s", [true, null]], "z": {"t": "u"}}}',), ('{"a": "b"}',)], "t string")
    assert [r[0] for r in N.numeric_fields(numbers, "t").collect()] == ['{"x": {"y": [1, [true]]}}', None]


def test_blank_errors_fall_back(spark):
    df = spark.createDataFrame([(" \n\t ",), ("\n plain \t",)], "t string")
    assert [r[0] for r in df.select(N.redact(F.col("t"))).collect()] == ["The provider request failed.", "plain"]


def test_join_path_of_seven_hops(spark):
    from tallyspark.operators import catalog as K

    edges = spark.createDataFrame([("d", f"t{k}", "r", f"t{k + 1}", "c") for k in range(8)], "db_id string, src_table string, src_column string, ref_table string, ref_column string")
    pairs = spark.createDataFrame([("d", "t0", "t7")], "db_id string, source string, target string")
    row = K.join_paths(edges, pairs).first()
    assert (row["hops"], len(row["path"])) == (7, 7)
    assert K.join_paths(edges, pairs, max_hops=4).count() == 0


def test_statement_shapes(spark):
    from tallyspark.fixtures import SHAPES
    from tallyspark.operators import sqltext as Q

    rows = [(k, sql.replace("@n", "5").replace("@v", "word")) for k, (sql, _) in enumerate(SHAPES)]
    parts = Q.sql_components(spark.createDataFrame(rows, "k int, sql string"), "sql").collect()
    found = {r["k"]: r for r in parts}
    for k, (_, want) in enumerate(SHAPES):
        assert "|".join(found[k]["c_where"]) == want.replace("@n", "5").replace("@v", "word"), rows[k]
    assert found[9]["c_group"] == ["HAVING:count(*) > 5 and max(b) < 3", "a"]
    assert found[11]["c_select"] == ["b", "f(g(h(k(((a, 5))))), 1)"]
    assert found[16]["c_join"] == ["SUBQ:s"] and found[16]["c_iuen"] == ["SETOP:Union", "SUBQ:a"]
    assert found[6]["c_keywords"] == ["IN"] and found[12]["c_keywords"] == ["EXISTS"] and found[16]["c_keywords"] == ["DISTINCT"]
    features = {r["k"]: r["features"] for r in Q.sql_text_features(spark.createDataFrame(rows, "k int, sql string"), "sql").collect()}
    assert features[11]["query_fields"] == 2 and features[4]["predicate"] == 2 and features[4]["order_by"] == 1


def test_query_pairs_run_once_and_time_out(spark, tmp_path):
    from tallyspark.sources import execution as X

    spark.range(0, 100, 1, 5).createOrReplaceTempView("hundred")
    slow = "SELECT count(*) FROM range(0, 100000000000, 1, 4) WHERE id % 7 = rand()"
    rows = [("a", 0, "SELECT id FROM hundred ORDER BY id DESC"), ("a", 1, "SELECT id, 'x' AS t FROM hundred WHERE id < 0"), ("b", 0, "SELECT nothing"), ("b", 1, slow)]
    queries = spark.createDataFrame(rows, "instance_id string, candidate int, sql string")
    cells, status = X.run_query_pairs(spark, queries, str(tmp_path / "out"), timeout_s=4.0)
    got = {(r["instance_id"], r["candidate"]): r for r in status.collect()}
    assert (got["a", 0]["n_rows"], got["a", 0]["n_cols"], got["a", 0]["error"]) == (100, 1, None)
    assert (got["a", 1]["n_rows"], got["a", 1]["n_cols"]) == (0, 2)
    assert got["b", 0]["error"] and got["b", 1]["error"] == "timed out"
    values = [r["num_value"] for r in cells.where("instance_id = 'a'").orderBy("row_no").collect()]
    assert values == [float(v) for v in range(99, -1, -1)]

"""Queries on inputs that are larger, or laid out in other files, than the small test tables."""

import datetime

from pyspark.sql import functions as F

from tallyspark.functions import jsonstream, ordered
from tallyspark.operators import catalog as K
from tallyspark.operators import compare as C
from tallyspark.operators import retrieval as R
from tallyspark.operators import sampling as P
from tallyspark.operators import scans as N
from tallyspark.operators import selection as S
from tallyspark.plans import registry

registry.load()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_of_name_links_are_not_broadcast(spark):
    questions = spark.createDataFrame([(1, "d", "show free meal count"), (2, "d", "free")], "query_id long, db_id string, question string")
    names = spark.createDataFrame([("d", "col", "c", "Free-Meal_Count"), ("d", "tab", "t", "free")], "db_id string, kind string, item string, name string")
    links = R.ngram_link(questions, names)
    assert "BroadcastHashJoin" not in plan_of(links)
    got = {(r["query_id"], r["pos"], r["flag"]) for r in links.collect()}
    assert got == {(1, 1, "TEM"), (2, 0, "TEM"), (2, 0, "CPM"), (1, 1, "CPM"), (1, 2, "CPM"), (1, 3, "CPM")}


def test_decayed_sample_sums_past_64_bits(spark, tmp_path):
    rows = [(9_000_000_000_000 + n, n, n, 1) for n in range(20)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    row = registry.QUERIES["decayed_sample"](spark, str(tmp_path)).collect()[0]
    assert row["kept"] == 16 and abs(row["ids"] / (16 * 9e18) - 1) < 1e-6


def test_streams_read_tables_in_several_files(spark, tmp_path):
    turns = [(c, t, "user", f"text {c} {t}") for c in range(6) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["instance_id"], r["pos"]) for r in registry.QUERIES["stream_snapshots"](spark, str(tmp_path)).collect()}
    assert got == {(str(c), t) for c in range(6) for t in (1, 2, 3)}
    day = datetime.datetime(2024, 1, 1)
    lines = [(n, 1 + n % 2, "A", 3.0, day) for n in range(10)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_shipdate timestamp").repartition(2).write.parquet(
        f"{tmp_path}/lineitem.parquet")
    usage = registry.QUERIES["token_usage_stream"](spark, str(tmp_path))
    assert usage.agg(F.sum("calls")).collect()[0][0] == 10


def test_edges_of_large_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(5000).select(F.concat(F.lit("dev_"), "id").alias("k"))
    cut = ordered.cut_hot_keys(df.withColumn("g", F.lit(0)), ["g"], [F.col("k")], hot_rows=100)
    assert "TakeOrderedAndProject" in plan_of(cut) or "WindowGroupLimit" in plan_of(cut)
    sizes = [r["count"] for r in cut.groupBy("_ord_piece").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) > 100 and max(sizes) < 500
    got = [r["k"] for r in ordered.numbered(df, [], [F.col("k")], hot_rows=100).orderBy("row_no").collect()]
    assert got == sorted(f"dev_{n}" for n in range(5000))


def test_rows_are_numbered_by_range_partitions(spark):
    keys = [f"dev_{n * 7919 % 4001}" for n in range(4000)] + [None, None, "dev", "dev_007", "dev_7"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    ranked = ordered.numbered(df, [], [P.natural_key(F.col("k"))], out="rank", start=3, hot_rows=300)
    assert "lambdafunction" not in plan_of(ranked) and "_ord_edges" not in plan_of(ranked)
    plain = ordered.numbered(df, [], [P.natural_key(F.col("k"))], out="rank", start=3)
    assert plain.dtypes == ranked.dtypes
    assert [tuple(r) for r in ranked.orderBy("rank").collect()] == [tuple(r) for r in plain.orderBy("rank").collect()]
    untyped = df.withColumn("v", F.lit(None))
    assert [r["row_no"] for r in ordered.numbered(untyped, [], [F.col("k")], hot_rows=300).orderBy("row_no").collect()] == list(range(4005))


def test_documents_are_dealt_before_they_are_cut_to_tokens(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": 2}]}',), ('{"a": [1, {"b": 2}]}',), (None,)], "t string")
    stream = jsonstream.token_stream(df, "t")
    assert plan_of(stream).count("Exchange hashpartitioning") == 1
    assert stream.where("role = 'open'").count() == 3


def test_only_targets_short_of_similar_rows_search_all(spark, monkeypatch):
    shapes = ["select _ from _", "select _ from _", "select _ from _", "select _ from _", "update _ set _", "update _ set _", "drop it", None]
    rows = [(n, [float(n * n % 11), float(n)], f"q{n}", s) for n, s in enumerate(shapes)]
    targets = spark.createDataFrame([*rows, (None, [1.0, 1.0], "q9", shapes[0]), rows[0], rows[4]], "query_id long, vector array<double>, question string, skeleton string")
    pool = spark.createDataFrame(rows, "item_id long, vector array<double>, question string, skeleton string")
    asked, search = [], R.search

    def seen(index, queries, *a, **b):
        asked.append({r[0] for r in queries.select("query_id").collect()})
        return search(index, queries, *a, **b)

    monkeypatch.setattr(R, "search", seen)
    got = {}
    for r in R.vector_few_shot_skeleton(targets, pool, 2).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["near"], r["distance"]))
    assert asked[1] - {None} == {5, 6, 7}  # the target that comes twice has its one similar row twice, as before
    for n, v, _, shape in rows[1:4] + rows[5:]:
        others = sorted((not (shape is not None and s == shape), round(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5, 5), m) for m, w, _, s in rows if m != n)
        assert got[n] == [(m, not far, d) for far, d, m in others[:2]]


def test_json_is_pruned_without_rows_of_tokens(spark, monkeypatch):
    monkeypatch.setattr(jsonstream, "TASK_CHARS", 1000)
    monkeypatch.setattr(jsonstream, "SLICE_TOKENS", 8)  # documents go over several slices of a batch
    texts = ['{"a": [1, {"b": "x"}, []], "c d": 2, "e": {"f": {}}}', None, "[1,", "[" * 2000 + "1" + "]" * 2000, '"x"', '{"records": [1], "k": {"x_path": "/a"}}'] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    numbers = N.numeric_fields(df, "t")
    assert plan_of(numbers).count("Exchange") == 1 and "Window" not in plan_of(numbers)
    want = ['{"a": [1]}', None, None, texts[3], None, '{"records": [1]}'] * 3
    assert [r["t"] for r in numbers.orderBy("n").collect()] == want
    assert numbers.where("n < 0").collect() == []


def test_records_go_without_rows_of_tokens(spark):
    df = spark.createDataFrame([(0, '{"x": {"records": [1], "k": [{"Path": 1}, "s"]}, "per_sample": 1}'), (1, '{"a" 1}'), (2, None)], "n int, t string")
    stripped = N.strip_records(df, "t")
    assert "Exchange" not in plan_of(stripped) and "Window" not in plan_of(stripped)
    assert [r["t"] for r in stripped.orderBy("n").collect()] == ['{"x": {"k": [{}, "s"]}}', None, None]


def test_cells_are_shuffled_once(spark):
    rows = [(i, c, k, n, None if n else "x", float(k + (c == 2) * 5) + 0.004 * (c == 1) if n else None)
            for i in range(6) for c in range(4) for k in range(5) for n in range(2) if not (c == 3 and k == 2)]
    cells = C.number_rows(spark.createDataFrame(rows, "instance_id long, candidate int, row_key long, col_no int, str_value string, num_value double"), "row_key")
    assert {r["row_no"] for r in cells.collect()} == set(range(5))

    def shuffles(df):
        return [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning" in line]

    equal, clusters = C.rowset_equal(cells), S.cluster_by_result(cells, tolerant=True)
    assert len(shuffles(equal)) <= 4  # one of cells, in both branches of the plan, and the join of results
    assert not any("row_no" in line for line in shuffles(clusters))
    assert {(r["candidate"], r["score"]) for r in equal.collect()} == {(1, 1), (2, 0), (3, 0)}
    assert {(r["candidate"], r["cluster"]) for r in clusters.collect()} == {(0, 0), (1, 0), (2, 2), (3, 3)}
    given = spark.createDataFrame([(i, c, 5, 2) for i in range(7) for c in range(2)], "instance_id long, candidate int, n_rows long, n_cols long")
    assert C.rowset_equal(cells, given).agg(F.sum("score"), F.count("score")).collect()[0] == (6, 7)


def test_tasks_that_hold_neighbors_grow_with_the_rows(spark, monkeypatch):
    selected = spark.createDataFrame([(n, "d", t) for n in range(60) for t in ("T1", "t2", "t2")], "instance_id long, db_id string, table_name string")
    edges = spark.createDataFrame([("d", "t1", "x", "t2", "x"), ("d", "t3", "x", "T1", "x"), ("d", "t3", "y", "t2", "y")],
                                  "db_id string, src_table string, src_column string, ref_table string, ref_column string")
    edges = edges.union(edges.withColumn("ref_table", F.lower("ref_table")))
    monkeypatch.setattr(K, "TASK_ROWS", 10)
    near = K.fk_neighbors(selected, edges)
    assert "REPARTITION_BY_NUM" in plan_of(near) and "18)" in plan_of(near)
    assert sorted(tuple(r) for r in near.collect()) == [(n, "d", "t3") for n in range(60)]
    assert sorted(tuple(r) for r in K.fk_neighbors(selected, edges, selected.union(selected)).collect()) == [(n, "d", "t3") for n in range(60)]

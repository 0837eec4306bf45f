"""Sampling, catalog and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.operators import catalog as K
from tallyspark.operators import joins as J
from tallyspark.operators import sampling as S
from tallyspark.plans.registry import query


def draw(key: str, seed: int = 42) -> str:
    return f"('0x' || substr(md5(concat(CAST({key} AS VARCHAR), '#{seed}')), 1, 8))::BIGINT"


def samples(spark, sf):
    return view(spark, sf, "samples")


@query("filter_samples", f"""
WITH f AS (SELECT * FROM samples WHERE db_size < 200 AND coalesce(difficulty, 'easy') = 'easy' AND query IS NOT NULL ORDER BY pos LIMIT 500)
SELECT instance_id, db_size FROM f ORDER BY {draw('instance_id', 7)}, instance_id LIMIT 50""", ("samples",))
def filter_samples(spark, sf):
    picked = S.filter_samples(samples(spark, sf), "db_size-l-200.difficulty-easy.has_label.limit-500.random-50.seed-7", [F.col("pos")])
    return picked.select("instance_id", "db_size")


@query("filter_by_length", "SELECT instance_id FROM samples WHERE length(question) > 30 AND length(coalesce(query, '')) <= 9", ("samples",))
def filter_by_length(spark, sf):
    return S.filter_samples(samples(spark, sf), "ques_length-m-30.query_length-le-9", [F.col("pos")]).select("instance_id")


@query("sample_rows", f"SELECT instance_id FROM samples ORDER BY {draw('instance_id')}, instance_id LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM samples)", ("samples",))
def sample_rows(spark, sf):
    return S.sample_rows(samples(spark, sf), "instance_id", fraction=0.1).select("instance_id")


@query("stratified_round_robin", """
WITH r AS (SELECT instance_id, coalesce(difficulty, '') AS d, db_id, row_number() OVER (PARTITION BY coalesce(difficulty, ''), db_id ORDER BY pos) - 1 AS turn FROM samples)
SELECT instance_id, CAST(turn AS BIGINT) AS turn FROM r ORDER BY turn, d, db_id LIMIT 250""", ("samples",))
def stratified_round_robin(spark, sf):
    return S.stratified_round_robin(samples(spark, sf), 250, ["difficulty", "db_id"], [F.col("pos")]).select(
        "instance_id", F.col("turn").cast("bigint").alias("turn"))


@query("label_round_robin", """
WITH r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY doc_id) - 1 AS turn FROM labels)
SELECT doc_id, quality, toxic FROM r ORDER BY turn, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR) LIMIT 60""")
def label_round_robin(spark, sf):
    return S.stratified_round_robin(table(spark, sf, "labels"), 60, ["quality", "toxic"], [F.col("doc_id")]).select("doc_id", "quality", "toxic")


@query("stratified_few_shot", f"""
WITH t AS (SELECT instance_id, db_id FROM samples), d AS (SELECT DISTINCT db_id FROM t),
p AS (SELECT p_partkey AS pool_id, 'db' || (p_partkey % 40) AS db_id, p_type AS level FROM part),
r AS (SELECT d.db_id, p.level, p.pool_id, row_number() OVER (PARTITION BY d.db_id, p.level ORDER BY {draw('p.pool_id')}, p.pool_id) AS rank FROM d JOIN p ON p.db_id <> d.db_id)
SELECT t.instance_id, r.level, r.rank, r.pool_id FROM t JOIN r USING (db_id) WHERE rank <= 3""", ("samples",))
def stratified_few_shot(spark, sf):
    pool = table(spark, sf, "part").select(
        F.col("p_partkey").alias("pool_id"), F.concat(F.lit("db"), F.col("p_partkey") % 40).alias("db_id"), F.col("p_type").alias("level"))
    picked = S.stratified_few_shot(samples(spark, sf).select("instance_id", "db_id"), pool, 3)
    return picked.select("instance_id", "level", F.col("rank").cast("bigint").alias("rank"), "pool_id")


@query("random_few_shot", f"""
WITH p AS (SELECT p_partkey AS pool_id, 'db' || (p_partkey % 40) AS db_id, row_number() OVER (ORDER BY 'db' || (p_partkey % 40), p_partkey) - 1 AS pos FROM part),
g AS (SELECT db_id, min(pos) AS lo, count(*) AS own FROM p GROUP BY 1),
a AS (SELECT s.instance_id, lo, own, (SELECT count(*) FROM p) - own AS m FROM samples s JOIN g USING (db_id)),
d AS (SELECT instance_id, rank, lo, own, ({draw('instance_id')} + CAST(floor((rank - 1) * m / 4) AS BIGINT)) % m AS q FROM a, range(1, 5) r(rank))
SELECT instance_id, rank, pool_id FROM d JOIN p ON p.pos = q + CASE WHEN q >= lo THEN own ELSE 0 END""", ("samples",))
def random_few_shot(spark, sf):
    pool = table(spark, sf, "part").select(F.col("p_partkey").alias("pool_id"), F.concat(F.lit("db"), F.col("p_partkey") % 40).alias("db_id"))
    return S.random_few_shot(samples(spark, sf), pool, 4, cross_domain=True).withColumn("rank", F.col("rank").cast("bigint"))


@query("decayed_sample", f"""
WITH r AS (SELECT l_linenumber - 1 AS turn_n, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey AS id, count(*) OVER (PARTITION BY l_linenumber) AS n,
 row_number() OVER (PARTITION BY l_linenumber ORDER BY {draw('l_orderkey * 1000000 + l_partkey * 100 + l_suppkey')}, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey) - 1 AS r FROM lineitem)
SELECT turn_n, count(*) AS kept, CAST(sum(id) AS DOUBLE) AS ids FROM r WHERE 0.8 * power(0.7, turn_n) > 0.1 AND r < floor(n * 0.8 * power(0.7, turn_n)) GROUP BY 1""")
def decayed_sample(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") - 1).alias("turn_n"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("id"))
    kept = S.decayed_sample(rows, "id", 0.8, 0.7)
    return kept.groupBy("turn_n").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("id").cast("decimal(20,0)")).cast("double").alias("ids"))


@query("repair_candidates", """
SELECT instance_id, coalesce(query, '') = 'SELECT' AS bare_select FROM (
 SELECT s.instance_id, s.query, CASE WHEN pos % 5 < 2 THEN 0 WHEN pos % 5 = 2 THEN NULL ELSE 1 END AS ex,
  CASE WHEN pos % 6 = 0 THEN 'execution_error' WHEN pos % 6 = 1 THEN 'model_missing_join' END AS error_root, CASE WHEN pos % 7 = 0 THEN 'boom' END AS exec_error FROM samples s)
WHERE coalesce(query, '') = 'SELECT' OR (coalesce(ex = 0, TRUE) AND (exec_error IS NOT NULL OR coalesce(error_root = 'execution_error', FALSE)))""", ("samples",))
def repair_candidates(spark, sf):
    rows, p = samples(spark, sf), F.col("pos")
    scores = rows.select(
        "instance_id", F.when(p % 5 < 2, 0).when(p % 5 > 2, 1).alias("ex"),
        F.when(p % 6 == 0, "execution_error").when(p % 6 == 1, "model_missing_join").alias("error_root"), F.when(p % 7 == 0, "boom").alias("exec_error"))
    return S.repair_candidates(rows.withColumnRenamed("query", "pred_sql"), scores).select("instance_id", "bare_select")


@query("natural_order", "SELECT instance_id, row_number() OVER (ORDER BY CAST(replace(instance_id, 'dev_', '') AS BIGINT)) - 1 AS rank FROM samples", ("samples",))
def natural_order(spark, sf):
    from tallyspark.functions.ordered import numbered

    return numbered(samples(spark, sf).select("instance_id"), [], [S.natural_key(F.col("instance_id"))], out="rank")


@query("split_batches", "SELECT instance_id, (row_number() OVER (ORDER BY pos) - 1) // 64 AS batch FROM samples", ("samples",))
def split_batches(spark, sf):
    return S.split_batches(samples(spark, sf).select("instance_id", "pos"), 64, [F.col("pos")]).drop("pos")


@query("duplicate_ids", "SELECT l_orderkey AS instance_id, l_linenumber AS stage_no, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("stage_no"))
    return S.duplicates(rows, "instance_id", "stage_no")


@query("chunk_catalog", "SELECT db_id, table_name, column_name, (row_number() OVER (PARTITION BY db_id ORDER BY table_name, column_no) - 1) // 20 AS chunk FROM catalog_columns", ("catalog_columns",))
def chunk_catalog(spark, sf):
    chunks = S.chunk_catalog(view(spark, sf, "catalog_columns"), [F.col("table_name"), F.col("column_no")], size=20)
    return chunks.select("db_id", "table_name", "column_name", "chunk")


@query("chunk_catalog_by_number", """
SELECT db_id, table_name, column_name, CAST(floor((row_number() OVER (PARTITION BY db_id ORDER BY table_name, column_no) - 1) / ceil(count(*) OVER (PARTITION BY db_id) / 6)) AS BIGINT) AS chunk FROM catalog_columns""", ("catalog_columns",))
def chunk_catalog_by_number(spark, sf):
    chunks = S.chunk_catalog(view(spark, sf, "catalog_columns"), [F.col("table_name"), F.col("column_no")], size=0, num=6)
    return chunks.select("db_id", "table_name", "column_name", "chunk")


@query("extract_path", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, coalesce(event_type, ts::VARCHAR) AS label FROM events""")
def extract_path(spark, sf):
    events = table(spark, sf, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("value"),
                         S.first_present(events, ["absent", "event_type", "ts"]).alias("label"))


@query("row_delta", """
WITH b AS (SELECT o_orderkey AS instance_id, 'status' AS key, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'old', 'x' FROM orders WHERE o_orderkey % 3 = 0),
a AS (SELECT o_orderkey AS instance_id, 'status' AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS v FROM orders UNION ALL SELECT o_orderkey, 'new', 'y' FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(a.instance_id, b.instance_id) AS instance_id, coalesce(a.key, b.key) AS key,
 CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'changed' END AS kind, b.v AS before, a.v AS after
FROM a FULL JOIN b ON a.instance_id = b.instance_id AND a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.v <> b.v""")
def row_delta(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")

    def snapshot(status, extra, when):
        entries = F.array_compact(F.array(F.struct(F.lit("status").alias("k"), status.alias("v")), F.when(when, F.struct(F.lit(extra[0]).alias("k"), F.lit(extra[1]).alias("v")))))
        return o.select(k.alias("instance_id"), F.map_from_entries(entries).alias("values"))

    return S.row_delta(snapshot(F.col("o_orderstatus"), ("old", "x"), k % 3 == 0),
                       snapshot(F.when(k % 2 == 0, "F").otherwise(F.col("o_orderstatus")), ("new", "y"), k % 5 == 0))


@query("normalize_links", """
SELECT p_partkey AS instance_id, 'part.p_name,t.c' || (p_partkey % 3) AS a, 'part,t' AS b, 'part.p_name,t.c' || (p_partkey % 3) || ',''lit''' AS c FROM part""")
def normalize_links(spark, sf):
    raw = F.array(F.lit("`part`.p_name"), F.concat(F.lit('t."c'), F.col("p_partkey") % 3, F.lit('"')), F.lit("'lit'"), F.lit("part.p_name "))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("instance_id"), F.array_join(S.normalize_links(raw, "A"), ",").alias("a"),
        F.array_join(S.normalize_links(raw, "B")["tables"], ",").alias("b"), F.array_join(S.normalize_links(raw, "C"), ",").alias("c"))


@query("link_shapes", "SELECT p_partkey AS instance_id, k AS t1, k AS t2, k AS t3 FROM (SELECT p_partkey, 'part.c' || (p_partkey % 9) || ',x.y' AS k FROM part)")
def link_shapes(spark, sf):
    name = F.concat(F.lit("c"), F.col("p_partkey") % 9)
    text = F.concat(F.lit("Links: ['part."), name, F.lit("', `x.y`] done"))
    pairs = F.array(F.array(F.lit("part"), name), F.array(F.lit("x"), F.lit("y")))
    records = F.array(F.struct(F.lit("part").alias("table_name"), name.alias("column_name")), F.struct(F.lit("x").alias("table_name"), F.lit("y").alias("column_name")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("instance_id"), F.array_join(S.links_from_text(text), ",").alias("t1"),
        F.array_join(S.links_from_pairs(pairs), ",").alias("t2"), F.array_join(S.links_from_records(records), ",").alias("t3"))


@query("links_from_frame", """
SELECT db_id AS instance_id, string_agg(table_name || '.' || column_name, ',' ORDER BY table_name || '.' || column_name) AS links FROM catalog_columns GROUP BY 1""", ("catalog_columns",))
def links_from_frame(spark, sf):
    frame = view(spark, sf, "catalog_columns").withColumnRenamed("db_id", "instance_id")
    return S.links_from_frame(frame).withColumn("links", F.array_join("links", ","))


@query("format_sub_questions", """
SELECT p_partkey AS instance_id, 'Sub question: b' || chr(10) || 'SQL:' || chr(10) || '```sql' || chr(10) || 'SELECT 2' || chr(10) || '```' || chr(10) || chr(10)
 || 'Sub question: a ' || p_name || chr(10) || 'SQL:' || chr(10) || '```sql' || chr(10) || 'SELECT 1' || chr(10) || '```' AS text FROM part""")
def format_sub_questions(spark, sf):
    text = F.concat(F.lit('[["a '), "p_name", F.lit('", "SELECT 1"], ["b", "SELECT 2"]]'))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), S.format_sub_questions(S.normalize_sub_questions(text)).alias("text"))


@query("params_by_size", """
SELECT instance_id, CASE WHEN db_size <= 200 THEN 40 WHEN db_size <= 400 THEN 50 ELSE 60 END AS top_k, CASE WHEN db_size <= 200 THEN 2 WHEN db_size <= 350 THEN 3 ELSE 6 END AS turn_n,
 CASE WHEN db_size <= 200 THEN 5 WHEN db_size <= 500 THEN 10 ELSE 15 END AS post_k, 1 AS post_turn_n FROM samples""", ("samples",))
def params_by_size(spark, sf):
    return S.params_by_size(samples(spark, sf)).select("instance_id", "top_k", "turn_n", "post_k", "post_turn_n")


@query("needs_pruning", """
SELECT db_id, count(DISTINCT table_name) AS tables, count(*) AS columns, count(DISTINCT table_name) > 3 AND NOT (count(*) / count(DISTINCT table_name) <= 6 AND count(*) <= 30) AS needs_pruning
FROM catalog_columns GROUP BY 1""", ("catalog_columns",))
def needs_pruning(spark, sf):
    return S.needs_pruning(view(spark, sf, "catalog_columns"))


@query("run_sampling_metadata", """
SELECT k AS run_id, CASE WHEN k % 3 = 0 THEN 'random' WHEN k % 3 = 1 THEN 'slice' END AS mode, CASE WHEN k % 3 = 0 THEN 20 WHEN k % 3 = 1 THEN 50 ELSE 97 END AS "limit",
 CASE WHEN k % 3 = 0 THEN 9 END AS seed, CASE WHEN k % 3 = 2 THEN 'full' ELSE 'bounded' END AS validity FROM (SELECT o_orderkey AS k FROM orders)""")
def run_sampling_metadata(spark, sf):
    k = F.col("o_orderkey")
    runs = table(spark, sf, "orders").select(
        k.alias("run_id"), F.when(k % 3 == 0, "bench:dev:random-20.seed-9").otherwise("bench:dev:").alias("data_source"),
        F.when(k % 3 == 1, "slice-50").otherwise("full").alias("scope"), F.lit(None).cast("string").alias("sample_mode"),
        F.lit(None).cast("bigint").alias("sample_limit"), F.lit(None).cast("bigint").alias("sample_seed"), F.lit(97).cast("bigint").alias("sample_count"))
    return S.run_sampling_metadata(runs).select("run_id", "mode", "limit", "seed", "validity")


@query("normalize_sub_questions", """
SELECT p_partkey AS instance_id, CASE p_partkey % 4 WHEN 3 THEN 1 ELSE 2 END AS n, CASE p_partkey % 4 WHEN 3 THEN 'plain ' || p_name ELSE 'a ' || p_name END AS first_question,
 CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'SELECT 1' ELSE '' END AS first_sql FROM part""")
def normalize_sub_questions(spark, sf):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    text = (F.when(k == 0, F.concat(F.lit('["a '), name, F.lit('", "b"]')))
            .when(k == 1, F.concat(F.lit('[["a '), name, F.lit('", "SELECT 1"], ["b"]]')))
            .when(k == 2, F.concat(F.lit('[{"sub_question": "a '), name, F.lit('", "sql": "SELECT 1"}, {"sub_question": "b"}]')))
            .otherwise(F.concat(F.lit("plain "), name)))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), S.normalize_sub_questions(text).alias("q"))
    return rows.select("instance_id", F.size("q").alias("n"), F.col("q")[0]["sub_question"].alias("first_question"), F.col("q")[0]["sql"].alias("first_sql"))


# --- joins -------------------------------------------------------------------

@query("assemble_samples", """
SELECT s.instance_id, s.pos % 2 AS ex, s.pos % 3 AS em, coalesce(CASE WHEN pos % 4 = 0 THEN pos / 10 END, CASE WHEN pos % 5 = 0 THEN 0.5 END) AS sl_recall,
 CASE WHEN pos % 5 = 0 THEN 'simple' END AS pred_classification FROM samples s""", ("samples",))
def assemble_samples(spark, sf):
    rows, p = samples(spark, sf), F.col("pos")
    base = rows.select("instance_id", F.when(p % 4 == 0, p / 10).alias("sl_recall"))
    logs = rows.where(p % 5 == 0).select("instance_id", F.lit(0.5).alias("sl_recall"), F.lit("simple").alias("pred_classification"))
    return J.assemble_samples(base, [rows.select("instance_id", (p % 2).alias("ex")), rows.select("instance_id", (p % 3).alias("em"))], logs)


@query("align_iterations", """
WITH r AS (SELECT l_orderkey AS instance_id, l_linenumber % 3 AS iteration, max(CASE WHEN l_tax < 0.07 THEN (l_returnflag = 'R')::INT END) AS ex,
 max(CASE WHEN l_linestatus = 'F' THEN 'boom' || (l_linenumber % 3) END) AS e FROM lineitem GROUP BY 1, 2)
SELECT instance_id, CASE WHEN count(*) = 3 THEN max(ex) END AS ex, CASE WHEN count(*) < 3 THEN 'missing aligned rows across generate runs' ELSE arg_min(e, iteration) FILTER (WHERE e IS NOT NULL) END AS exec_error
FROM r GROUP BY 1""")
def align_iterations(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id"), (F.col("l_linenumber") % 3).alias("iteration")).agg(
        F.max(F.when(F.col("l_tax") < 0.07, (F.col("l_returnflag") == "R").cast("int"))).alias("ex"),
        F.max(F.when(F.col("l_linestatus") == "F", F.concat(F.lit("boom"), F.col("l_linenumber") % 3))).alias("exec_error"))
    return J.align_iterations(rows)


@query("ordered_ids", """
WITH u AS (SELECT CAST(o_orderkey AS VARCHAR) AS instance_id, 0 AS source, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 1, l_orderkey * 10 + l_linenumber FROM lineitem)
SELECT instance_id, min(source) AS source, arg_min(pos, source * 100000000000 + pos) AS pos FROM u GROUP BY 1""")
def ordered_ids(spark, sf):
    first = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderkey").alias("pos"))
    second = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return J.ordered_ids(first, second)


@query("attach_trace", """
SELECT s.instance_id, s.difficulty, t.stages FROM samples s LEFT JOIN (SELECT l_orderkey AS pos, count(DISTINCT l_linenumber) AS stages FROM lineitem GROUP BY 1) t USING (pos)""", ("samples",))
def attach_trace(spark, sf):
    trace = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("dev_"), "l_orderkey").alias("instance_id")).agg(F.count_distinct("l_linenumber").alias("stages"))
    return J.attach_trace(samples(spark, sf).select("instance_id", "difficulty"), trace)


@query("merge_repairs", """
SELECT instance_id, CASE WHEN pos % 4 = 0 AND pos % 3 = 0 THEN 'FIXED ' || pos ELSE query END AS pred_sql, pos % 4 = 0 AND pos % 3 = 0 AS replaced FROM samples""", ("samples",))
def merge_repairs(spark, sf):
    rows, p = samples(spark, sf), F.col("pos")
    repair = rows.where(p % 4 == 0).select("instance_id", F.concat(F.lit("FIXED "), p).alias("pred_sql"))
    scores = rows.select("instance_id", (p % 3 == 0).cast("int").alias("ex"))
    return J.merge_repairs(rows.select("instance_id", F.col("query").alias("pred_sql")), repair, scores)


@query("containment_join", """
WITH p AS (SELECT instance_id, substr(link, 1, length(link) - 1) AS link FROM link_rows WHERE instance_id % 3 = 0)
SELECT DISTINCT g.instance_id, g.link FROM link_rows g JOIN p ON p.instance_id = g.instance_id AND contains(g.link, p.link)""", ("link_rows",))
def containment_join(spark, sf):
    gold = view(spark, sf, "link_rows")
    pred = gold.where("instance_id % 3 = 0").select("instance_id", F.expr("substring(link, 1, length(link) - 1)").alias("link"))
    return J.containment_join(gold, pred)


@query("find_similar_values", """
WITH l AS (SELECT DISTINCT 'db' || p_size % 5 AS db_id, lower(split_part(p_name, ' ', 1)) AS literal FROM part UNION SELECT DISTINCT 'db' || p_size % 5, lower(substr(p_brand, 1, 7)) FROM part),
h AS (SELECT v.db_id, v.table_name, v.column_name, v.value, l.literal, row_number() OVER (PARTITION BY l.literal, v.db_id, v.table_name, v.column_name ORDER BY v.value) AS rank
 FROM (SELECT * FROM cell_values UNION ALL SELECT 'db' || p_size % 5, 'part', 'p_name', p_name FROM part GROUP BY 1, p_name) v JOIN l ON l.db_id = v.db_id AND contains(lower(v.value), l.literal) WHERE length(v.value) < 50)
SELECT * FROM h WHERE rank <= 5""", ("cell_values",))
def find_similar_values(spark, sf):
    part = table(spark, sf, "part")
    db = F.concat(F.lit("db"), F.col("p_size") % 5).alias("db_id")
    literals = part.select(db, F.lower(F.substring_index("p_name", " ", 1)).alias("literal")).unionByName(
        part.select(db, F.lower(F.substring("p_brand", 1, 7)).alias("literal")))
    names = part.select(db, F.lit("part").alias("table_name"), F.lit("p_name").alias("column_name"), F.col("p_name").alias("value"))
    return J.find_similar_values(view(spark, sf, "cell_values").unionByName(names), literals).withColumn("rank", F.col("rank").cast("bigint"))


@query("keep_known_links", """
SELECT DISTINCT r.instance_id, r.db_id, c.table_name || '.' || c.column_name AS link FROM link_rows r JOIN catalog_columns c ON c.db_id = r.db_id AND lower(r.link) = lower(c.table_name || '.' || c.column_name)""",
       ("link_rows", "catalog_columns"))
def keep_known_links(spark, sf):
    return J.keep_known_links(view(spark, sf, "link_rows"), view(spark, sf, "catalog_columns"))


@query("merge_links", """
SELECT DISTINCT instance_id, lower(link) AS link FROM link_rows UNION SELECT o_orderkey, 'orders.' || lower(o_orderstatus) FROM orders""", ("link_rows",))
def merge_links(spark, sf):
    other = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.concat(F.lit("ORDERS."), "o_orderstatus").alias("link"))
    return J.merge_links(view(spark, sf, "link_rows"), other)


@query("keyed_merge", """
SELECT instance_id, CASE WHEN pos % 3 = 0 THEN 'hard' ELSE difficulty END AS difficulty, db_id, CASE WHEN pos % 3 = 0 THEN pos END AS note FROM samples""", ("samples",))
def keyed_merge(spark, sf):
    rows = samples(spark, sf)
    update = rows.where("pos % 3 = 0").select("instance_id", F.lit("hard").alias("difficulty"), F.lit(None).cast("string").alias("db_id"), F.col("pos").alias("note"))
    return J.keyed_merge(rows.select("instance_id", "difficulty", "db_id"), update)


@query("drop_located", """
SELECT k.db_id AS instance_id, k.table_name, k.column_name FROM catalog_columns k
LEFT JOIN (SELECT DISTINCT db_id, lower(link) AS l FROM link_rows) r ON r.db_id = k.db_id AND r.l = k.table_name || '.' || k.column_name WHERE r.l IS NULL""",
       ("link_rows", "catalog_columns"))
def drop_located(spark, sf):
    links = view(spark, sf, "link_rows").select(F.col("db_id").alias("instance_id"), F.lower("link").alias("link"))
    chunks = view(spark, sf, "catalog_columns").select(F.col("db_id").alias("instance_id"), "table_name", "column_name")
    return J.drop_located(chunks, links)


@query("exclude_retrieved", "SELECT p_partkey AS item_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def exclude_retrieved(spark, sf):
    pool = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_name")
    hits = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("item_id"))
    return J.exclude_retrieved(pool, hits, ["item_id"])


# --- catalogs ----------------------------------------------------------------

def catalog(spark, sf):
    return view(spark, sf, "catalog_columns")


@query("flatten_catalog", "SELECT db_id, table_name, column_name, column_types FROM catalog_columns", ("catalog_columns",))
def flatten_catalog(spark, sf):
    none = "array<array<int>>"
    central = K.central_catalog(catalog(spark, sf)).select(
        "*", F.lit("sqlite").alias("db_type"), F.array().cast("array<struct<idx:int,text:string>>").alias("column_descriptions"),
        F.array().cast(none).alias("primary_keys"), F.array().cast("array<struct<src:int,dst:int>>").alias("foreign_keys"))
    return K.flatten_catalog(central).select("db_id", "table_name", "column_name", "column_types")


@query("catalog_of", """
WITH c(table_name, column_no, column_name, column_types, primary_key, foreign_key) AS (VALUES
 ('region', 0, 'r_regionkey', 'number', true, ''), ('region', 1, 'r_name', 'text', false, ''),
 ('nation', 0, 'n_nationkey', 'number', true, ''), ('nation', 1, 'n_name', 'text', false, ''), ('nation', 2, 'n_regionkey', 'number', false, '[region(r_regionkey)]'),
 ('supplier', 0, 's_suppkey', 'number', true, ''), ('supplier', 1, 's_name', 'text', false, ''), ('supplier', 2, 's_nationkey', 'number', false, '[nation(n_nationkey)]'),
 ('supplier', 3, 's_acctbal', 'number', false, '')),
n AS (SELECT 'region' AS table_name, count(*) AS n_rows FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier)
SELECT 'shop' AS db_id, c.*, n.n_rows FROM c JOIN n USING (table_name)""")
def catalog_of(spark, sf):
    live = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}
    tables = {name: table(spark, sf, name).select(*columns) for name, columns in live.items()}
    rows = K.catalog_of(tables, "shop", {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"]},
                        [("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")])
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return rows.join(counts, "table_name").select("db_id", "table_name", "column_no", "column_name", "column_types", "primary_key", "foreign_key", "n_rows")


@query("flatten_catalog_keys", """
WITH r AS (SELECT db_id, table_name, column_name, row_number() OVER (PARTITION BY db_id ORDER BY table_name, column_no) AS i FROM catalog_columns),
f AS (SELECT db_id, table_name, column_name FROM r WHERE i = 1)
SELECT r.db_id, r.table_name, r.column_name, r.i % 2 = 1 AND r.i <= 3 AS primary_key, CASE WHEN r.i = 2 THEN '[' || f.table_name || '(' || f.column_name || ')]' ELSE '' END AS foreign_key FROM r JOIN f USING (db_id)""",
       ("catalog_columns",))
def flatten_catalog_keys(spark, sf):
    central = K.central_catalog(catalog(spark, sf)).select(
        "*", F.lit("sqlite").alias("db_type"), F.array().cast("array<struct<idx:int,text:string>>").alias("column_descriptions"),
        F.expr("array(array(1), array(3))").alias("primary_keys"), F.expr("array(named_struct('src', 2, 'dst', 1))").alias("foreign_keys"))
    return K.flatten_catalog(central).select("db_id", "table_name", "column_name", "primary_key", "foreign_key")


EDGES = """e AS (SELECT db_id, table_name AS src_table, column_name AS src_column,
  CASE WHEN column_no = 1 THEN 't' || (substr(table_name, 2)::INT - 1) WHEN column_no = 2 THEN 't' || (substr(table_name, 2)::INT - 3) ELSE 't2' END AS ref_table,
  CASE WHEN column_no = 3 THEN 'col_4' ELSE 'col_0' END AS ref_column FROM catalog_columns WHERE foreign_key <> '')"""


@query("fk_edges", f"WITH {EDGES} SELECT * FROM e", ("catalog_columns",))
def fk_edges(spark, sf):
    return K.fk_edges(catalog(spark, sf))


@query("fk_lines", f"WITH {EDGES} SELECT db_id, src_table || '.' || src_column || ' = ' || ref_table || '.' || ref_column AS line FROM e", ("catalog_columns",))
def fk_lines(spark, sf):
    return K.fk_lines(K.fk_edges(catalog(spark, sf)))


@query("fk_columns", f"WITH {EDGES} SELECT db_id, src_table AS table_name, src_column AS column_name FROM e UNION SELECT db_id, ref_table, ref_column FROM e", ("catalog_columns",))
def fk_columns(spark, sf):
    return K.fk_columns(K.fk_edges(catalog(spark, sf)))


SELECTED = "s AS (SELECT DISTINCT l_orderkey AS instance_id, 'db' || l_suppkey AS db_id, 'T' || l_linenumber AS table_name FROM lineitem)"


def selected(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.concat(F.lit("db"), "l_suppkey").alias("db_id"), F.concat(F.lit("T"), "l_linenumber").alias("table_name")).distinct()


@query("fk_neighbors", f"""WITH {EDGES}, {SELECTED},
n AS (SELECT s.instance_id, s.db_id, e.ref_table AS table_name FROM s JOIN e ON e.db_id = s.db_id AND e.src_table = lower(s.table_name)
 UNION SELECT s.instance_id, s.db_id, e.src_table FROM s JOIN e ON e.db_id = s.db_id AND e.ref_table = lower(s.table_name))
SELECT n.* FROM n LEFT JOIN (SELECT DISTINCT instance_id, lower(table_name) AS t FROM s) x ON x.instance_id = n.instance_id AND x.t = n.table_name WHERE x.t IS NULL""", ("catalog_columns",))
def fk_neighbors(spark, sf):
    return K.fk_neighbors(selected(spark, sf), K.fk_edges(catalog(spark, sf)), table(spark, sf, "lineitem"))


@query("join_paths", f"""WITH RECURSIVE {EDGES},
w AS (SELECT db_id, src_table AS a, ref_table AS b FROM e WHERE src_table <> ref_table UNION SELECT db_id, ref_table, src_table FROM e WHERE src_table <> ref_table),
p AS (SELECT DISTINCT db_id, 't1' AS source, table_name AS target FROM catalog_columns),
r AS (SELECT DISTINCT db_id, source, source AS node, 0 AS hops FROM p UNION SELECT r.db_id, r.source, w.b, r.hops + 1 FROM r JOIN w ON w.db_id = r.db_id AND w.a = r.node WHERE r.hops < 12)
SELECT p.db_id, p.source, p.target, min(r.hops) AS hops FROM p JOIN r ON r.db_id = p.db_id AND r.source = p.source AND r.node = p.target GROUP BY 1, 2, 3""", ("catalog_columns",))
def join_paths(spark, sf):
    columns = catalog(spark, sf)
    pairs = columns.select("db_id", F.lit("t1").alias("source"), F.col("table_name").alias("target")).distinct()
    return K.join_paths(K.fk_edges(columns), pairs).select("db_id", "source", "target", "hops")


ITEM = "column_name || '(Type: ' || column_types || CASE WHEN column_descriptions <> '' THEN ', Description: ' || column_descriptions ELSE '' END || ')'"


@query("render_catalog_detail", f"""
WITH t AS (SELECT db_id, table_name, string_agg({ITEM}, ', ' ORDER BY column_no) AS items, string_agg(CASE WHEN primary_key THEN '`' || column_name || '`' END, ', ' ORDER BY column_no) AS pk FROM catalog_columns GROUP BY 1, 2),
f AS (SELECT db_id, table_name, column_no, table_name || '(' || column_name || ') references ' || unnest(regexp_extract_all(foreign_key, '\\[(.*?)\\]', 1)) AS k FROM catalog_columns),
g AS (SELECT db_id, string_agg(k, ', ' ORDER BY table_name, column_no) AS fk FROM f GROUP BY 1),
l AS (SELECT db_id, string_agg('### Table = `' || table_name || '`, columns = [' || items || ']', chr(10) || chr(10) ORDER BY table_name) AS body,
 string_agg(CASE WHEN pk IS NOT NULL THEN table_name || '(' || pk || ')' END, ', ' ORDER BY table_name) AS pks FROM t GROUP BY 1)
SELECT l.db_id, body || chr(10) || CASE WHEN pks IS NOT NULL THEN chr(10) || '### Primary Keys:' || chr(10) || pks || chr(10) ELSE '' END
 || CASE WHEN fk IS NOT NULL THEN chr(10) || '### Foreign Keys:' || chr(10) || fk || chr(10) ELSE '' END AS text FROM l LEFT JOIN g USING (db_id)""", ("catalog_columns",))
def render_catalog_detail(spark, sf):
    return K.render_catalog(catalog(spark, sf))


@query("render_catalog_compact", """
WITH t AS (SELECT db_id, table_name, string_agg(column_name, ', ' ORDER BY column_no) AS c FROM catalog_columns GROUP BY 1, 2)
SELECT db_id, string_agg('# ' || table_name || ' ( ' || c || ' )', chr(10) ORDER BY table_name) AS text FROM t GROUP BY 1""", ("catalog_columns",))
def render_catalog_compact(spark, sf):
    return K.render_catalog(catalog(spark, sf), "compact")


@query("render_catalog_ddl", """
WITH t AS (SELECT db_id, table_name, string_agg('`' || column_name || '`', ',' ORDER BY column_no) AS c FROM catalog_columns GROUP BY 1, 2)
SELECT db_id, string_agg(table_name || '(' || c || ')', chr(10) || '# ' ORDER BY table_name) AS text FROM t GROUP BY 1""", ("catalog_columns",))
def render_catalog_ddl(spark, sf):
    return K.render_catalog(catalog(spark, sf), "ddl")


@query("render_catalog_sequence", """
WITH t AS (SELECT db_id, table_name, string_agg(CASE WHEN column_no % 4 = 0 THEN column_name || '(a, b)' ELSE column_name END, ', ' ORDER BY column_no) AS c FROM catalog_columns GROUP BY 1, 2)
SELECT db_id, string_agg(table_name || ' : ' || c, ' | ' ORDER BY table_name) AS text FROM t GROUP BY 1""", ("catalog_columns",))
def render_catalog_sequence(spark, sf):
    matches = F.when(F.col("column_no") % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return K.render_catalog(catalog(spark, sf).withColumn("matches", matches), "sequence")


def _profile(t: str, c: str) -> str:
    return (f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) > count({c}) AS has_null, max(n) = 1 AS is_unique, count(DISTINCT {c}) AS distinct_count, "
            f"array_to_string(list_sort(list(DISTINCT CAST({c} AS VARCHAR)))[1:3], ',') AS samples, FALSE AS long_text FROM (SELECT *, count(*) OVER (PARTITION BY {c}) AS n FROM {t})")


@query("profile_columns", " UNION ALL ".join(_profile(t, c) for t, cs in (
    ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")), ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))) for c in cs))
def profile_columns(spark, sf):
    tables = {"customer": table(spark, sf, "customer").drop("c_acctbal"), "part": table(spark, sf, "part").drop("p_retailprice")}
    return K.profile_columns(tables).withColumn("samples", F.array_join("samples", ","))


@query("distinct_values", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) AS rank FROM (SELECT DISTINCT {c} FROM {t})"
    for t, c in (("part", "p_brand"), ("part", "p_type"), ("customer", "c_name"))) + ") WHERE rank <= 10")
def distinct_values(spark, sf):
    tables = {"part": table(spark, sf, "part").select("p_brand", "p_type"), "customer": table(spark, sf, "customer").select("c_name")}
    return K.distinct_values(tables, 10).withColumn("rank", F.col("rank").cast("bigint"))


@query("column_notes", """
WITH n AS (SELECT DISTINCT lower(table_name || '.' || column_name) AS k, 'note ' || column_no AS d FROM catalog_columns),
l AS (SELECT DISTINCT instance_id, lower(link) AS k FROM link_rows)
SELECT instance_id, string_agg(k || ': ' || d, chr(10) ORDER BY k || ': ' || d) AS notes FROM l JOIN n USING (k) GROUP BY 1""", ("link_rows", "catalog_columns"))
def column_notes(spark, sf):
    notes = catalog(spark, sf).select("table_name", "column_name", F.concat(F.lit("note "), "column_no").alias("description")).distinct()
    return K.column_notes(notes, view(spark, sf, "link_rows"))


# --- set operations ----------------------------------------------------------

@query("union_distinct", "SELECT instance_id, link FROM link_rows UNION SELECT l_orderkey, 'T1.col_0' FROM lineitem", ("link_rows",))
def union_distinct(spark, sf):
    extra = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.lit("T1.col_0").alias("link"))
    return view(spark, sf, "link_rows").select("instance_id", "link").unionByName(extra).distinct()


@query("set_difference", "SELECT instance_id, link FROM link_rows EXCEPT SELECT instance_id, link FROM link_rows WHERE link LIKE '%col_1%'", ("link_rows",))
def set_difference(spark, sf):
    links = view(spark, sf, "link_rows").select("instance_id", "link")
    return links.subtract(links.where(F.col("link").like("%col_1%")))


@query("multiset_difference", "SELECT l_returnflag AS a, l_linenumber AS b FROM lineitem WHERE l_quantity > 25 EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_quantity <= 25")
def multiset_difference(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linenumber").alias("b"), "l_quantity")
    return rows.where("l_quantity > 25").drop("l_quantity").exceptAll(rows.where("l_quantity <= 25").drop("l_quantity"))



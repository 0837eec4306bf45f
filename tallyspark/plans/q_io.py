"""Source, sink, hook, incremental and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.operators import hooks as H
from tallyspark.operators.retrieval import build_vector_table
from tallyspark.plans.q_aggregate import rounded, runs, scored
from tallyspark.plans.registry import query
from tallyspark.session import checkpoint_dir
from tallyspark.sources import execution as X
from tallyspark.sources import publish as P
from tallyspark.sources import readers as R
from tallyspark.sources import store as ST
from tallyspark.streaming import incremental as I


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, shared by all executors."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------

@query("read_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def read_rows(spark, sf):
    path = scratch(spark, "rows")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").write.json(path)
    return R.read_rows(spark, path, "jsonl", "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("read_benchmark", """
SELECT instance_id, 'ext/' || difficulty AS external_path FROM samples WHERE coalesce(difficulty, 'easy') = 'hard'""", ("samples",))
def read_benchmark(spark, sf):
    path = scratch(spark, "bench")
    rows = view(spark, sf, "samples").select("instance_id", "difficulty", F.col("difficulty").alias("external_path"))
    rows.write.json(f"{path}/demo/dev/dataset.json")
    schema = "instance_id string, difficulty string, external_path string"
    return R.order_benchmark(R.read_rows(spark, f"{path}/demo/dev/dataset.json", "jsonl", schema), "difficulty-hard", "ext").select("instance_id", "external_path")


@query("import_files", "SELECT p_partkey AS p_key, p_name, p_size FROM part")
def import_files(spark, sf):
    path = scratch(spark, "upload")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("p-key"), F.col("p_name").alias("p name"), "p_size")
    part.write.csv(f"{path}/my parts.csv", header=True)
    tables = R.import_files(spark, [f"{path}/my parts.csv", f"{path}/none.xlsx"])
    return tables["my_parts"].withColumn("p_key", F.col("p_key").cast("bigint"))


def chat_log(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("instance_id"), F.col("turn").alias("pos"), F.col("role").alias("actor_name"), F.lit("pred_sql").alias("output_name"),
        F.when(F.col("turn") % 3 != 2, F.md5("text")).alias("pred_sql"), F.when(F.col("turn") % 2 == 0, F.length("text") / 100).alias("sl_recall"), F.col("role").alias("classification"))


CHAT = """c AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 <> 2 THEN md5(text) END AS p, CASE WHEN turn % 2 = 0 THEN length(text) / 100 END AS r FROM conversations)"""


@query("log_diagnostics", f"""WITH {CHAT}
SELECT CAST(conv_id AS VARCHAR) AS instance_id, 'sl_recall' AS field, CAST(arg_max(r, turn) AS VARCHAR) AS value FROM c WHERE r IS NOT NULL GROUP BY 1
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'pred_classification', arg_max(role, turn) FROM c GROUP BY 1""")
def log_diagnostics(spark, sf):
    return R.log_diagnostics(chat_log(spark, sf))


@query("log_snapshots", f"""WITH {CHAT},
b AS (SELECT conv_id, turn, role, last_value(p IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT CAST(conv_id AS VARCHAR) AS instance_id, 'pred_sql_before_' || role AS key, arg_min(before, turn) AS value FROM b WHERE before IS NOT NULL GROUP BY 1, 2""")
def log_snapshots(spark, sf):
    return R.log_snapshots(chat_log(spark, sf), [F.col("pos")])


@query("log_snapshots_named", f"""WITH {CHAT},
b AS (SELECT conv_id, turn, role, p, last_value(p IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
s AS (SELECT CAST(conv_id AS VARCHAR) AS instance_id, 'pred_sql_before_' || role AS key, arg_min(before, turn) AS value FROM b WHERE before IS NOT NULL GROUP BY 1, 2),
t AS (SELECT CAST(conv_id AS VARCHAR) AS instance_id, 'pred_sql_before_user' AS key, arg_max('given ' || turn, turn) AS told FROM c WHERE turn % 5 = 1 GROUP BY 1)
SELECT instance_id, key, coalesce(told, value) AS value FROM s FULL JOIN t USING (instance_id, key)""")
def log_snapshots_named(spark, sf):
    """The same log under other names, with snapshots given in some rows."""
    log = chat_log(spark, sf).withColumn("sample_id", F.col("instance_id")).withColumn("instance_id", F.when(F.col("pos") % 2 == 0, F.col("sample_id")).otherwise(""))
    log = log.withColumn("actor", F.col("actor_name")).withColumn("actor_name", F.lit("")).withColumn("result", F.col("pred_sql")).drop("pred_sql")
    log = log.withColumnRenamed("output_name", "OUTPUT_NAME").withColumn("pred_sql_before_user", F.when(F.col("pos") % 5 == 1, F.concat(F.lit("given "), "pos")))
    return R.log_snapshots(log, [F.col("pos")])


@query("join_external_text", """
SELECT o_orderkey AS instance_id, text AS external FROM orders LEFT JOIN (SELECT doc_id, text FROM documents WHERE trim(text) <> '') d ON d.doc_id = o_orderkey""")
def join_external_text(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.concat(F.lit("/ext/"), "o_orderkey", F.lit(".txt")).alias("external_path"))
    texts = table(spark, sf, "documents").select(F.concat(F.lit("file:///ext/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("value"))
    return R.join_external_text(rows, texts).select("instance_id", "external")


def stored(spark, sf) -> str:
    path = scratch(spark, "store")
    runs_ = runs(spark, sf).drop("sample_hash", "sample_count")
    ST.write_eval_store(path, runs_, scored(spark, sf).withColumn("instance_id", F.concat_ws("-", "instance_id", "event_id")))
    return path


@query("write_eval_store", """
SELECT metric_id, count(*) AS n, round(sum(value), 4) AS total FROM (
 SELECT 'ex' AS metric_id, ex::DOUBLE AS value FROM scored UNION ALL SELECT 'em', em::DOUBLE FROM scored UNION ALL SELECT 'sf1', sf1 FROM scored UNION ALL SELECT 'ves', ves FROM scored
 UNION ALL SELECT 'act_elapsed_s', act_elapsed_s FROM scored UNION ALL SELECT 'sl_recall', sl_recall FROM scored UNION ALL SELECT 'cf1_join', cf1_join FROM scored UNION ALL SELECT 'cf1_select', cf1_select FROM scored
 UNION ALL SELECT 'cf1_where', cf1_where FROM scored UNION ALL SELECT 'cf1_group', cf1_group FROM scored UNION ALL SELECT 'cf1_order', cf1_order FROM scored UNION ALL SELECT 'cf1_iuen', cf1_iuen FROM scored
 UNION ALL SELECT 'cf1_keywords', cf1_keywords FROM scored) WHERE value IS NOT NULL GROUP BY 1""", ("scored",))
def write_eval_store(spark, sf):
    cells = spark.read.parquet(f"{stored(spark, sf)}/sample_metrics")
    return cells.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("load_sample_metric", """
WITH r AS (SELECT run_id, max(ts) AS t FROM eval_log GROUP BY 1), x AS (SELECT e.method, 'q' || (e.event_id % 97) AS instance_id, e.ex, r.t, e.run_id FROM eval_log e JOIN r USING (run_id) WHERE ex IS NOT NULL),
k AS (SELECT method, run_id, instance_id, count(*) AS n, sum(ex) AS s FROM x GROUP BY 1, 2, 3)
SELECT method, count(*) AS n, CAST(sum(s) AS BIGINT) AS passed FROM k GROUP BY 1""".replace("count(*) AS n, CAST", "CAST(sum(n) AS BIGINT) AS n, CAST"), ("eval_log",))
def load_sample_metric(spark, sf):
    cells = ST.load_sample_metric(spark, stored(spark, sf), "ex", dataset="events")
    return cells.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("bigint").alias("passed"))


@query("build_vector_table", """
SELECT doc_id AS item_id, label % 5 AS db_id, length(text) AS chars, len(embedding) AS width FROM documents JOIN embeddings ON vec_id = doc_id""")
def build_vector_table_(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("vec_id") == F.col("doc_id"))
    texts = joined.select(F.col("doc_id").alias("item_id"), (F.col("label") % 5).alias("db_id"), "text")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    path = scratch(spark, "vectors")
    build_vector_table(texts, vectors, path)
    again = build_vector_table(texts, vectors, path)  # the second call finds the table and reads it
    return again.select("item_id", "db_id", F.length("text").alias("chars"), F.size("vector").alias("width"))


@query("missing_files", "SELECT DISTINCT 'f' || o_custkey AS path FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def missing_files(spark, sf):
    required = table(spark, sf, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("path")).distinct()
    present = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("f"), "c_custkey").alias("path"))
    return P.missing_files(present, required)


@query("append_predictions", "SELECT o_orderkey AS instance_id, o_orderstatus AS pred_sql FROM orders")
def append_predictions(spark, sf):
    path = scratch(spark, "predictions")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("instance_id"), F.col("o_orderstatus").alias("pred_sql"))
    ST.append_predictions(path, rows.where(F.col("pred_sql") == "F"))
    ST.append_predictions(path, rows.where(F.col("pred_sql") != "F"))
    return spark.read.parquet(path)


@query("run_query_pairs", """
WITH g AS (SELECT l_returnflag AS a, count(*)::DOUBLE AS b, row_number() OVER (ORDER BY l_returnflag) - 1 AS r FROM lineitem GROUP BY 1),
p AS (SELECT l_returnflag AS a, sum(l_quantity)::DOUBLE AS b, row_number() OVER (ORDER BY l_returnflag) - 1 AS r FROM lineitem GROUP BY 1)
SELECT 's1' AS instance_id, 0 AS candidate, r AS row_no, 0 AS col_no, CAST(NULL AS DOUBLE) AS num_value, a AS str_value FROM g UNION ALL SELECT 's1', 0, r, 1, b, NULL FROM g
UNION ALL SELECT 's1', 1, r, 0, NULL, a FROM p UNION ALL SELECT 's1', 1, r, 1, b, NULL FROM p""")
def run_query_pairs(spark, sf):
    name = f"lines_{uuid.uuid4().hex}"
    table(spark, sf, "lineitem").createOrReplaceTempView(name)
    pairs = [("s1", 0, f"SELECT l_returnflag, count(*) FROM {name} GROUP BY 1 ORDER BY 1"),
             ("s1", 1, f"SELECT l_returnflag, sum(l_quantity) FROM {name} GROUP BY 1 ORDER BY 1"), ("s1", 2, f"SELECT missing FROM {name}")]
    queries = spark.createDataFrame(pairs, "instance_id string, candidate int, sql string")
    return X.run_query_pairs(spark, queries, scratch(spark, "cells"))[0]


@query("run_query_status", """
SELECT * FROM (VALUES ('s1', 0, false, 1), ('s1', 1, true, NULL), ('s2', NULL, true, NULL), ('s3', NULL, true, NULL), ('s4', 3, false, 1)) t(instance_id, candidate, failed, n_rows)
WHERE (SELECT count(*) FROM region) > 0""")
def run_query_status(spark, sf):
    name = f"regions_{uuid.uuid4().hex}"
    table(spark, sf, "region").createOrReplaceTempView(name)
    good = f"SELECT count(*) FROM {name}"
    texts = [("s1", "0", good), ("s1", "1", ""), ("s2", None, good), ("s3", "two", good), ("s4", "3", good)]
    status = X.run_query_pairs(spark, texts, scratch(spark, "status"), at_once=2)[1]
    return status.select("instance_id", "candidate", F.col("error").isNotNull().alias("failed"), F.col("n_rows").cast("int").alias("n_rows"))


@query("verify_benchmark", """
SELECT o_orderstatus AS split, count(*) AS actual, CASE o_orderstatus WHEN 'F' THEN count(*) ELSE 7 END AS declared, o_orderstatus = 'F' AS ok FROM orders GROUP BY 1
UNION ALL SELECT 'gone', 0, 5, FALSE""")
def verify_benchmark(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("split"))
    manifest = rows.groupBy("split").agg(F.when(F.first("split") == "F", F.count(F.lit(1))).otherwise(F.lit(7)).alias("declared"))
    extra = spark.createDataFrame([("gone", 5)], "split string, declared bigint")
    return P.verify_benchmark(rows, manifest.unionByName(extra))


@query("public_diagnostics", """
SELECT event_id, (ex IS NOT NULL)::INT + 1 + (sf1 IS NOT NULL)::INT + (ves IS NOT NULL)::INT AS metrics, CASE WHEN exec_error IS NULL THEN 'completed' ELSE 'exec_error' END AS stage_status,
 round(act_elapsed_s * 1000, 3) AS latency_ms FROM scored""", ("scored",))
def public_diagnostics(spark, sf):
    rows = scored(spark, sf).withColumn("error_root", F.lit(None).cast("string")).withColumn("instance_id", F.col("event_id"))
    records = P.public_diagnostics(rows)
    return records.select(F.col("instance_id").alias("event_id"), F.size("metrics").alias("metrics"), "stage_status", "latency_ms")


@query("dataset_fingerprint", """
WITH i AS (SELECT instance_id AS id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM samples),
l AS (SELECT pos // 50 AS pos, sha256(string_agg(id, chr(10) ORDER BY pos)) AS id FROM i GROUP BY pos // 50),
b AS (SELECT pos // 50 AS pos, sha256(string_agg(id, chr(10) ORDER BY pos)) AS id FROM l GROUP BY pos // 50)
SELECT left(sha256(string_agg(id, chr(10) ORDER BY pos)), 16) AS fingerprint FROM b""", ("samples",))
def dataset_fingerprint(spark, sf):
    return P.dataset_fingerprint(view(spark, sf, "samples"), F.col("pos"), chunk=50)


@query("file_digests", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def file_digests(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return P.file_digests(files).withColumnRenamed("path", "doc_id")


# --- hooks -------------------------------------------------------------------

@query("custom_metric", """
SELECT instance_id, 'score' AS metric, CASE WHEN instance_id = 'q3' THEN NULL ELSE round(avg(ex), 6) END AS score, CASE WHEN instance_id = 'q3' THEN 'refused' END AS error FROM eval_log GROUP BY 1""", ("eval_log",))
def custom_metric(spark, sf):
    def mean_ex(frame):
        if frame["instance_id"].iloc[0] == "q3":
            raise ValueError("refused")
        return frame["ex"].mean()

    return rounded(H.custom_metric(view(spark, sf, "eval_log").select("instance_id", "ex"), mean_ex))


@query("custom_row_metric", "SELECT event_id, round(act_elapsed_s * 2 + em, 6) AS score FROM eval_log", ("eval_log",))
def custom_row_metric(spark, sf):
    rows = view(spark, sf, "eval_log").select("event_id", "act_elapsed_s", "em")
    return rounded(H.row_metric(rows, lambda b: b["act_elapsed_s"] * 2 + b["em"]).select("event_id", "score"))


@query("named_transforms", "SELECT instance_id, db_id FROM samples WHERE db_size < 100 AND query IS NOT NULL", ("samples",))
def named_transforms(spark, sf):
    H.TRANSFORMS.setdefault("small_databases", lambda df: df.where("db_size < 100"))
    H.TRANSFORMS.setdefault("labelled", lambda df: df.where("query IS NOT NULL"))
    return H.apply_transforms(view(spark, sf, "samples"), "small_databases", "labelled").select("instance_id", "db_id")


# --- incremental and streaming ----------------------------------------------

@query("pending", "SELECT s.instance_id FROM samples s WHERE pos NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)", ("samples",))
def pending(spark, sf):
    done = table(spark, sf, "lineitem").select(F.concat(F.lit("step"), "l_linenumber").alias("stage"), F.concat(F.lit("dev_"), "l_orderkey").alias("instance_id"))
    return I.pending(view(spark, sf, "samples"), done, "step3").select("instance_id")


@query("completed_counts", "SELECT 'step' || l_linenumber AS stage, count(DISTINCT l_orderkey) AS completed FROM lineitem GROUP BY 1")
def completed_counts(spark, sf):
    return I.completed_counts(table(spark, sf, "lineitem").select(F.concat(F.lit("step"), "l_linenumber").alias("stage"), F.col("l_orderkey").alias("instance_id")))


BATCHES = """b AS (SELECT event_id // 500 AS batch, count(*) AS samples, sum(ex) AS s, count(ex) AS n FROM eval_log GROUP BY 1),
h AS (SELECT batch, samples, CAST(sum(samples) OVER w AS BIGINT) AS samples_seen, round(sum(s) OVER w / sum(n) OVER w, 6) AS ex_avg FROM b WINDOW w AS (ORDER BY batch))"""


def history(spark, sf):
    rows = view(spark, sf, "eval_log").withColumn("batch", F.floor(F.col("event_id") / 500))
    return rounded(I.cumulative_metrics(I.batch_totals(rows, ["ex"]), ["ex"]))


@query("cumulative_metrics", f"WITH {BATCHES} SELECT * FROM h", ("eval_log",))
def cumulative_metrics(spark, sf):
    return history(spark, sf)


@query("is_converged", f"""WITH {BATCHES}, c AS (SELECT batch AS step, ex_avg, abs(ex_avg - lag(ex_avg) OVER (ORDER BY batch)) AS change FROM h),
m AS (SELECT *, count(change) OVER w AS n, max(change) OVER w AS mx FROM c WINDOW w AS (ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT step, ex_avg, round(change, 6) AS change, n = 3 AND coalesce(mx < 0.005, FALSE) AS converged FROM m""", ("eval_log",))
def is_converged(spark, sf):
    steps = history(spark, sf).select(F.col("batch").alias("step"), "ex_avg")
    return rounded(I.is_converged(steps, "ex_avg", 0.005, 3))


def log_lines(spark, sf):
    k, e = F.col("event_id") % 3, F.col("user_id")
    line = (F.when(k == 0, F.concat(F.lit("开始处理样本 s"), e)).when(k == 1, F.concat(F.lit("样本 s"), e, F.lit(" 处理完成")))
            .otherwise(F.concat(F.lit("样本 s"), e, F.lit(" @ "), "event_type")))
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), line.alias("line"))


@query("progress", """
WITH x AS (SELECT count(DISTINCT CASE WHEN event_id % 3 <> 1 THEN user_id END) AS begun, count(DISTINCT CASE WHEN event_id % 3 = 1 THEN user_id END) AS done, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 = 2) AS stage FROM events)
SELECT stage AS current_stage, greatest(begun, least(done, 5000)) AS started, least(done, 5000) AS completed, 5000::BIGINT AS total, CAST(round_even(100 * least(done, 5000) / 5000, 0) AS INT) AS percent FROM x""")
def progress(spark, sf):
    return I.progress(log_lines(spark, sf), target=5000)


@query("progress_reported", """
WITH x AS (SELECT count(DISTINCT CASE WHEN event_id % 3 <> 1 THEN user_id END) AS begun, count(*) AS total FROM events)
SELECT '评估完成' AS current_stage, greatest(begun, total) AS started, total AS completed, total, 100 AS percent FROM x""")
def progress_reported(spark, sf):
    lines = log_lines(spark, sf).select(F.col("line_no").cast("bigint").alias("line_no"), "line")
    last = lines.agg(F.max("line_no").alias("n"), F.count(F.lit(1)).alias("k"))
    report = last.select(F.explode(F.array(
        F.struct((F.col("n") + 1).alias("line_no"), F.lit("评估结果 dev").alias("line")),
        F.struct((F.col("n") + 2).alias("line_no"), F.concat(F.lit("  样本 "), "k", F.lit(" 条")).alias("line")))).alias("r")).select("r.*")
    return I.progress(lines.unionByName(report))


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a file-source stream: one file, or a folder of files, which a pattern that only the table's path fits takes alike."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def token_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The token log as a file-source stream."""
    lines = table_stream(spark, sf, "lineitem")
    quantity = F.col("l_quantity").cast("bigint")
    return lines.select(
        F.col("l_shipdate").alias("ts"), F.concat(F.lit("sample:"), "l_orderkey", F.lit("|step"), "l_linenumber").alias("tag"), F.col("l_returnflag").alias("model"),
        (quantity * 10).alias("prompt_tokens"), quantity.alias("completion_tokens"), (quantity * 11).alias("total_tokens"))


def run_available(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Run a stream over what is there and return the table it wrote."""
    folder = scratch(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    started = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start())
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("token_usage_stream", """
SELECT l_returnflag AS model, 'step' || l_linenumber AS step, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT) * 10) AS BIGINT) AS prompt_tokens,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS completion_tokens, CAST(sum(CAST(l_quantity AS BIGINT) * 11) AS BIGINT) AS total_tokens FROM lineitem WHERE l_quantity >= 1 GROUP BY 1, 2""")
def token_usage_stream(spark, sf):
    return run_available(I.token_usage(token_stream(spark, sf)), spark, "complete")


@query("token_usage_windows", """
WITH w AS (SELECT time_bucket(INTERVAL '28 days', l_shipdate, TIMESTAMP '1970-01-01') AS start, 'step' || l_linenumber AS step, count(*) AS calls, CAST(sum(q * 11) AS BIGINT) AS total_tokens
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_quantity >= 1) GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d') AS window_start, step, calls, total_tokens FROM w
WHERE start + INTERVAL '28 days' <= (SELECT max(l_shipdate) - INTERVAL '1 hour' FROM lineitem WHERE l_quantity >= 1)""")
def token_usage_windows(spark, sf):
    """Windows come out once the watermark has passed them, so their state goes; a window still open gives no row yet."""
    windows = run_available(I.token_usage_windows(token_stream(spark, sf), "ts", "28 days", unique=["tag", "ts", "total_tokens"]), spark, "append")
    return windows.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "step", "calls", "total_tokens")


@query("incremental_score", "SELECT count(*) AS samples, count(ex) AS ex_n, CAST(sum(ex) AS DOUBLE) AS ex_sum FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS ex FROM orders)")
def incremental_score(spark, sf):
    orders = table_stream(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("instance_id"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("ex"))
    folder = scratch(spark, "scores")
    I.incremental_score(rows, folder, f"{folder}/state", ["ex"]).awaitTermination()
    totals = spark.read.parquet(f"{folder}/totals")
    return totals.agg(F.sum("samples").alias("samples"), F.sum("ex_n").alias("ex_n"), F.sum("ex_sum").alias("ex_sum"))


@query("stream_snapshots", f"""WITH {CHAT},
b AS (SELECT conv_id, turn, role, last_value(p IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)
SELECT CAST(conv_id AS VARCHAR) AS instance_id, turn AS pos, role AS actor_name, before FROM b WHERE before IS NOT NULL""")
def stream_snapshots(spark, sf):
    turns = table_stream(spark, sf, "conversations")
    log = turns.select(F.col("conv_id").cast("string").alias("instance_id"), F.col("turn").alias("pos"), F.col("role").alias("actor_name"),
                       F.when(F.col("turn") % 3 != 2, F.md5("text")).alias("pred_sql"))
    return run_available(I.stream_snapshots(log), spark, "append")



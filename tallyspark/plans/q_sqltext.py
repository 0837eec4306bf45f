"""SQL text, component, link and per-question score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.metrics import COMPONENTS
from tallyspark.operators import scoring as S
from tallyspark.operators import selection as E
from tallyspark.operators import sqltext as Q
from tallyspark.plans.q_aggregate import rounded
from tallyspark.plans.registry import query

V = ("query_log",)


def both_features(spark, sf):
    log = Q.sql_text_features(view(spark, sf, "query_log"), "gold_sql", "gold_features")
    return Q.sql_text_features(log, "pred_sql", "pred_features")


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _features(sql: str) -> dict[str, str]:
    t = f"lower(regexp_replace({sql}, '''[^'']*''', '''''', 'g'))"
    zero = "0"
    return {
        "query_fields": f"{_count(f'split_part({t}, chr(32) || chr(102) || chr(114) || chr(111) || chr(109) || chr(32), 1)', ',')} + 1",
        "group_by": _count(t, r"\bgroup by\b"), "order_by": _count(t, r"\border by\b"), "limit": _count(t, r"\blimit\b"),
        "join": _count(t, r"\bjoin\b"), "predicate": f"{_count(t, '[<>=]+')} + {_count(t, chr(92) + 'blike' + chr(92) + 'b')}",
        "aggregation": _count(t, r"\b(?:count|sum|avg|max|min)\("), "scalar_function": zero,
        "subquery": _count(t, r"\(select\b"), "set_operation": _count(t, r"\b(?:union|intersect|except)\b"), "math_compute": zero,
        "logical_connector": _count(t, r"\b(?:and|or)\b"), "distinct": _count(t, r"\bdistinct\b"), "like": _count(t, r"\blike\b"),
        "control_flow": _count(t, r"\bcase\b"), "window": _count(t, r"\bover\b"),
    }


@query("sql_text_features", "SELECT instance_id, " + ", ".join(
    f"CAST({e} AS INT) AS \"{n}\"" for n, e in _features("pred_sql").items()) + " FROM query_log", V)
def sql_text_features(spark, sf):
    return Q.sql_text_features(view(spark, sf, "query_log"), "pred_sql").select("instance_id", "features.*")


@query("sql_shapes", "SELECT instance_id, shape, conditions FROM shape_log", ("shape_log",))
def sql_shapes(spark, sf):
    log = Q.sql_components(view(spark, sf, "shape_log").drop("conditions"), "pred_sql")
    return log.select("instance_id", "shape", F.array_join("c_where", "|").alias("conditions"))


@query("sql_hardness", """
SELECT p_partkey AS instance_id, CASE WHEN 1 + (k3 AND TRUE)::INT * 2 + k5::INT * 2 <= 2 THEN 'easy'
  WHEN k3 AND NOT k5 THEN 'hard' ELSE CASE WHEN 1 + k3::INT * 2 + k5::INT * 2 <= 3 THEN 'hard' ELSE 'hard' END END AS hardness
FROM (SELECT p_partkey, p_partkey % 3 = 0 AS k3, p_partkey % 5 = 0 AS k5 FROM part)""")
def sql_hardness(spark, sf):
    return both_features(spark, sf).select("instance_id", Q.hardness("gold_features").alias("hardness"))


@query("feature_delta", "SELECT instance_id, " + ", ".join(
    f"CAST(({p}) - ({g}) AS INT) AS \"delta_{n}\"" for (n, p), g in zip(_features("pred_sql").items(), _features("gold_sql").values(), strict=True))
    + " FROM query_log", V)
def feature_delta(spark, sf):
    return both_features(spark, sf).select("instance_id", Q.feature_delta("gold_features", "pred_features").alias("d")).select("instance_id", "d.*")


def both_components(spark, sf):
    log = Q.sql_components(view(spark, sf, "query_log"), "gold_sql", "g_")
    return Q.sql_components(log, "pred_sql", "p_")


@query("sql_components", """
SELECT p_partkey AS instance_id, CASE WHEN p_partkey % 4 = 0 THEN 'p_name,p_size' ELSE 'p_name' END AS "select",
 CASE WHEN p_partkey % 6 = 0 THEN 'p_brand LIKE,' ELSE '' END || 'p_size > VAL:' || p_size AS "where", '' AS "group",
 CASE WHEN p_partkey % 5 = 0 THEN '__LIMIT__,p_name' ELSE '' END AS "order", 'part' AS "join", '' AS iuen,
 CASE WHEN p_partkey % 6 = 0 THEN 'LIKE' ELSE '' END AS keywords FROM part""")
def sql_components(spark, sf):
    parts = Q.sql_components(view(spark, sf, "query_log"), "pred_sql")
    return parts.select("instance_id", *[F.array_join(f"c_{c}", ",").alias(c) for c in COMPONENTS])


@query("exact_match", "SELECT p_partkey AS instance_id, (p_partkey % 4 <> 0 AND (p_partkey % 3 = 0) = (p_partkey % 6 = 0))::INT AS em FROM part")
def exact_match(spark, sf):
    return both_components(spark, sf).select("instance_id", Q.exact_match().alias("em"))


@query("component_f1", """
SELECT p_partkey AS instance_id, CASE WHEN p_partkey % 4 = 0 THEN round(2.0 / 3, 6) ELSE 1::DOUBLE END AS cf1_select,
 CASE WHEN (p_partkey % 3 = 0) <> (p_partkey % 6 = 0) THEN round(2.0 / 3, 6) ELSE 1::DOUBLE END AS cf1_where, 1::DOUBLE AS cf1_group, 1::DOUBLE AS cf1_order, 1::DOUBLE AS cf1_join,
 1::DOUBLE AS cf1_iuen, CASE WHEN (p_partkey % 3 = 0) <> (p_partkey % 6 = 0) THEN 0 ELSE 1::DOUBLE END AS cf1_keywords FROM part""")
def component_f1(spark, sf):
    return rounded(both_components(spark, sf).select("instance_id", Q.component_f1().alias("c")).select("instance_id", "c.*"))


@query("where_conditions", "SELECT p_partkey AS instance_id, '' AS table_name, 'p_size' AS column_name, '>' AS op, CAST(p_size AS VARCHAR) AS value FROM part")
def where_conditions(spark, sf):
    return Q.where_conditions(view(spark, sf, "query_log"), "gold_sql")


@query("clean_sql_operators", "SELECT p_partkey AS instance_id, 'SELECT p_name FROM part WHERE p_size >= ' || p_size AS cleaned FROM part")
def clean_sql_operators(spark, sf):
    raw = F.concat(F.lit("```sql\nSELECT p_name  FROM part\nWHERE p_size > = "), F.col("p_size"), F.lit("\n```"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), Q.clean_sql(raw, "operators").alias("cleaned"))


@query("clean_sql_clock", """
SELECT p_partkey AS instance_id, 'SELECT x FROM t WHERE d >= datetime(''2100-12-31 23:59:00'', ''-' || p_size || CASE WHEN p_size = 1 THEN ' month' ELSE ' months' END || ''') AND v BETWEEN 35.5 AND 38.1' AS cleaned FROM part""")
def clean_sql_clock(spark, sf):
    raw = F.concat(F.lit("SELECT x FROM t  WHERE d > = DATE_SUB(NOW(), INTERVAL "), F.col("p_size"),
                   F.lit(" MONTH) AND v BETWEEN temperature_lower AND temperature_upper"))
    cleaned = F.replace(Q.clean_sql(raw, "clock"), F.lit("''2100-12-31 23:59:00''"), F.lit("'2100-12-31 23:59:00'"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), cleaned.alias("cleaned"))


@query("clean_sql_reply", "SELECT p_partkey AS instance_id, 'SELECT d FROM t WHERE d > date((SELECT MAX(d) FROM t), ''-' || p_size || ' day'')' AS cleaned FROM part")
def clean_sql_reply(spark, sf):
    raw = F.concat(F.lit("Here it is:\n```sql\nSELECT d FROM t WHERE d > (SELECT MAX(d) FROM t) - INTERVAL '"), F.col("p_size"), F.lit("' DAY; -- done\n```"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), Q.clean_sql(raw, "reply").alias("cleaned"))


@query("sql_skeleton", """
SELECT p_partkey AS instance_id, 'select _ from _ where _' || CASE WHEN p_partkey % 6 = 0 THEN ' like _' ELSE '' END
 || CASE WHEN p_partkey % 5 = 0 THEN ' order by _ asc limit _' ELSE '' END AS skeleton FROM part""")
def sql_skeleton(spark, sf):
    log = view(spark, sf, "query_log").withColumn("tables", F.array(F.lit("part"))).withColumn(
        "columns", F.array(*[F.lit(c) for c in ("p_name", "p_size", "p_brand")]))
    return Q.sql_skeleton(log, "pred_sql", "tables", "columns").select("instance_id", "skeleton")


@query("unknown_column_refs", "SELECT p_partkey AS instance_id, 'part.p_ghost' AS ref FROM part WHERE p_partkey % 4 = 1")
def unknown_column_refs(spark, sf):
    part = table(spark, sf, "part")
    text = F.concat(F.lit("SELECT part.p_name, x.any, 1.5 FROM part WHERE part."),
                    F.when(F.col("p_partkey") % 4 == 1, "p_ghost").otherwise("p_size"), F.lit(" > 3"))
    catalog = spark.createDataFrame([("part", c) for c in part.columns], "table_name string, column_name string")
    return Q.unknown_column_refs(part.select(F.col("p_partkey").alias("instance_id"), text.alias("sql")), "sql", catalog)


@query("shape_preference", """
SELECT p_partkey AS instance_id, (CASE WHEN k = 0 THEN 1.0 WHEN k = 1 THEN -2.5 WHEN k = 2 THEN 2.0 ELSE -1.0 END)::DOUBLE AS score FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part)""")
def shape_preference(spark, sf):
    k = F.col("p_partkey") % 4
    ask = F.when(k <= 1, "how many parts are there").when(k == 2, "parts that do not sell").otherwise("all parts")
    sql = (F.when(k == 0, "SELECT count(*) FROM part").when(k == 1, "SELECT count(DISTINCT p_size) FROM part")
           .when(k == 2, "SELECT a FROM part EXCEPT SELECT a FROM sold").otherwise("SELECT a FROM part LEFT JOIN sold ON x = y"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), Q.shape_preference(ask, sql).alias("score"))


@query("literal_preference", """
SELECT p_partkey AS instance_id, (CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS score FROM part""")
def literal_preference(spark, sf):
    ask = F.concat(F.lit("parts of type "), F.lower("p_type"))
    sql = F.concat(F.when(F.col("p_partkey") % 3 == 0, "SELECT * FROM part WHERE t = '").otherwise("SELECT p_name FROM part WHERE t = '"),
                   F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lit("zzz")), F.lit("'"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), Q.literal_preference(ask, sql).alias("score"))


@query("links_in_text", """
WITH c AS (SELECT unnest(['part.p_name', 'part.p_size', 'part.p_brand', 'orders.o_total']) AS link),
w AS (SELECT link, split_part(link, '.', 2) AS col FROM c)
SELECT q.instance_id, w.link FROM query_log q, w WHERE contains(lower(pred_sql), col)
 OR len(list_filter(string_split(col, '_'), lambda x: contains(lower(pred_sql), x))) > 0""", V)
def links_in_text(spark, sf):
    links = F.array(*[F.lit(x) for x in ("part.p_name", "part.p_size", "part.p_brand", "orders.o_total")])
    log = view(spark, sf, "query_log").withColumn("db_id", F.lit("shop"))
    return Q.links_in_text(log, log.select("db_id").distinct().withColumn("links", links), "pred_sql")


@query("cluster_by_structure", """
WITH c AS (SELECT p_partkey AS candidate, p_size AS instance_id, concat(p_partkey % 4 = 0, p_partkey % 6 = 0, p_partkey % 5 = 0) AS k FROM part)
SELECT instance_id, candidate, min(candidate) OVER w AS cluster, count(*) OVER w AS size FROM c WINDOW w AS (PARTITION BY instance_id, k)""")
def cluster_by_structure(spark, sf):
    log = view(spark, sf, "query_log").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("instance_id"), "p_size"), "instance_id")
    parts = Q.sql_components(log.select(F.col("p_size").alias("instance_id"), F.col("instance_id").alias("candidate"), "pred_sql"), "pred_sql")
    return E.cluster_by_structure(parts)


# --- per-question scores -----------------------------------------------------

def timings(spark, sf):
    line = table(spark, sf, "lineitem")
    rows = line.select(
        (F.col("l_orderkey") % 700).alias("instance_id"), F.col("l_linenumber").alias("repeat"),
        F.col("l_quantity").alias("gold_s"), (F.col("l_suppkey") % 7).cast("double").alias("pred_s"))
    correct = rows.select("instance_id").distinct().withColumn("correct", F.col("instance_id") % 3 != 0)
    return rows, correct


@query("efficiency_score", """
WITH t AS (SELECT l_orderkey % 700 AS instance_id, l_quantity AS g, CAST(l_suppkey % 7 AS DOUBLE) AS p FROM lineitem),
r AS (SELECT instance_id, g / p AS r FROM t WHERE p > 1e-6),
k AS (SELECT instance_id, r, count(*) OVER w AS n, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s FROM r WINDOW w AS (PARTITION BY instance_id)),
v AS (SELECT instance_id, sqrt(avg(r)) AS v FROM k WHERE n < 3 OR s = 0 OR abs(r - m) <= 2 * s GROUP BY 1)
SELECT i.instance_id, round(CASE WHEN i.instance_id % 3 <> 0 THEN coalesce(v, 0) ELSE 0 END, 6) AS ves,
 round(CASE WHEN i.instance_id % 3 <> 0 THEN least(1, coalesce(v, 0)) ELSE 0 END, 6) AS rves
FROM (SELECT DISTINCT instance_id FROM t) i LEFT JOIN v USING (instance_id)""")
def efficiency_score(spark, sf):
    return rounded(S.efficiency_score(*timings(spark, sf)))


def candidates(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_partkey")).alias("candidate"),
        F.when(F.col("l_tax") < 0.07, (F.col("l_returnflag") == "R").cast("int")).alias("ex"),
        F.when(F.col("l_linestatus") == "F", "boom").alias("exec_error"))


CAND = """c AS (SELECT l_orderkey AS instance_id, l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey AS candidate,
 CASE WHEN l_tax < 0.07 THEN (l_returnflag = 'R')::INT END AS ex, CASE WHEN l_linestatus = 'F' THEN 'boom' END AS exec_error FROM lineitem)"""


@query("candidate_outcomes", f"""WITH {CAND}
SELECT instance_id, count(*) AS candidate_count, count(*) FILTER (WHERE exec_error IS NULL) AS valid_sql_count,
 arg_min(ex, candidate) FILTER (WHERE ex IS NOT NULL) AS first_ex, max(ex) AS oracle_ex, min(candidate) FILTER (WHERE ex = 1) AS best_candidate,
 count(exec_error) AS exec_error_count, round(count(*) FILTER (WHERE exec_error IS NULL) / count(*), 6) AS valid_rate FROM c GROUP BY 1""")
def candidate_outcomes(spark, sf):
    return rounded(S.candidate_outcomes(candidates(spark, sf)))


@query("pass_at_k", f"WITH {CAND} SELECT instance_id, max(ex) AS pass_at_k FROM c WHERE candidate <= 3000000 GROUP BY 1")
def pass_at_k(spark, sf):
    return S.pass_at_k(candidates(spark, sf), 3_000_000)


@query("selection_outcome", f"""WITH {CAND},
o AS (SELECT instance_id, max(ex) AS oracle_ex, arg_min(ex, candidate) FILTER (WHERE ex IS NOT NULL) AS first_ex, arg_max(ex, candidate) FILTER (WHERE ex IS NOT NULL) AS selected_ex FROM c GROUP BY 1)
SELECT *, selected_ex - first_ex AS selection_gain, oracle_ex - selected_ex AS selection_loss, coalesce(oracle_ex = 1 AND selected_ex = 0, FALSE) AS missed_correct FROM o""")
def selection_outcome(spark, sf):
    rows = candidates(spark, sf)
    chosen = rows.groupBy("instance_id").agg(
        F.max_by(F.when(F.col("ex").isNotNull(), F.col("ex")), F.when(F.col("ex").isNotNull(), F.col("candidate"))).alias("chosen"))
    joined = S.candidate_outcomes(rows).join(chosen, "instance_id")
    return joined.select("instance_id", S.selection_outcome(F.col("oracle_ex"), F.col("first_ex"), F.col("chosen")).alias("o")).select("instance_id", "o.*")


@query("refinement_outcome", """
SELECT event_id, em AS ex_before, ex AS ex_after, coalesce(em = 0 AND ex = 1, FALSE) AS fix_success, coalesce(em = 1 AND ex = 0, FALSE) AS degradation FROM eval_log""", ("eval_log",))
def refinement_outcome(spark, sf):
    return view(spark, sf, "eval_log").select("event_id", S.refinement_outcome(F.col("em"), F.col("ex")).alias("o")).select("event_id", "o.*")


@query("stage_snapshot_delta", """
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS sc, o_orderkey % 3 = 0 AS op, o_orderkey % 5 = 0 AS se, o_orderkey % 4 = 0 AS ok FROM orders)
SELECT k AS instance_id, sc AS has_scaler, CASE WHEN sc THEN 3 END AS candidate_count, CASE WHEN sc THEN round(2.0 / 3, 6) END AS candidate_diversity,
 CASE WHEN sc THEN 0 END AS pass_1, CASE WHEN sc THEN ok::INT END AS pass_k, CASE WHEN sc THEN ok::INT END AS scaler_gain,
 op AS has_optimizer, CASE WHEN op THEN 0 END AS ex_before, CASE WHEN op THEN ok::INT END AS ex_after, CASE WHEN op THEN ok END AS fix_success,
 se AS has_selector, CASE WHEN se THEN 1 END AS oracle_ex, CASE WHEN se THEN 1 END AS first_ex, CASE WHEN se THEN ok::INT END AS selected_ex,
 CASE WHEN se THEN 1 - ok::INT END AS selection_loss, k % 7 > 0 AS has_decomposer, CAST(k % 7 AS INT) AS sub_question_count FROM s""")
def stage_snapshot_delta(spark, sf):
    k = F.col("o_orderkey")
    pre = F.lit(S.SNAPSHOT)
    keys = F.array_compact(F.array(
        F.when(k % 2 == 0, F.concat(pre, F.lit("MyScaler"))), F.when(k % 3 == 0, F.concat(pre, F.lit("Optimizer1"))),
        F.when(k % 5 == 0, F.concat(pre, F.lit("fastselect")))))
    values = F.transform(keys, lambda x: F.when(x.contains("select"), F.array(F.lit("good"), F.lit("bad"))).otherwise(F.array(F.lit("bad"))))
    samples = table(spark, sf, "orders").select(
        k.alias("instance_id"), F.array(F.when(k % 4 == 0, "good").otherwise("bad"), F.lit("bad2"), F.lit("bad2")).alias("pred_sql"),
        F.map_from_arrays(keys, values).alias("snapshots"),
        F.when(k % 7 > 0, F.array_repeat(F.lit("sub"), (k % 7).cast("int"))).alias("sub_questions"), F.lit(1).alias("debug_turns"))
    scores = samples.select("instance_id").withColumn(
        "s", F.explode(F.array(*[F.struct(F.lit(n).alias("sql"), F.lit(v).alias("ex")) for n, v in (("good", 1), ("bad", 0), ("bad2", 0))]))
    ).select("instance_id", "s.*")
    deltas = S.stage_deltas(samples, scores)
    return rounded(deltas.select(
        "instance_id", "scaler.*", "optimizer.has_optimizer", "optimizer.ex_before", "optimizer.ex_after", "optimizer.fix_success",
        "selector.has_selector", "selector.oracle_ex", "selector.first_ex", "selector.selected_ex", "selector.selection_loss", "decomposer.*"))


def answers(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.when(e % 5 == 0, "null").otherwise((e % 3).cast("string")).alias("gold_answer"),
        F.when(e % 7 == 0, "null").otherwise((e % 2).cast("string")).alias("pred_answer"))


REL = """s AS (SELECT event_id, CASE WHEN g = p THEN 1 WHEN g <> 'null' AND p = 'null' THEN 0 ELSE -1 END AS score FROM (
 SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(event_id % 3 AS VARCHAR) END AS g, CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(event_id % 2 AS VARCHAR) END AS p FROM events))"""


@query("reliability", f"WITH {REL} SELECT * FROM s")
def reliability(spark, sf):
    return S.reliability(answers(spark, sf)).select("event_id", "score")


@query("reliability_score", f"""WITH {REL}, n AS (SELECT count(*) AS n FROM s)
SELECT round(100 * avg(CASE WHEN score = -1 THEN 0 ELSE score END), 6) AS accuracy0, round(100 * avg(CASE WHEN score = -1 THEN -5 ELSE score END), 6) AS accuracy5,
 round(100 * avg(CASE WHEN score = -1 THEN -10 ELSE score END), 6) AS accuracy10, round(100 * avg(CASE WHEN score = -1 THEN -n ELSE score END), 6) AS "accuracyN" FROM s, n""")
def reliability_score(spark, sf):
    return rounded(S.reliability_score(answers(spark, sf)))


def linked(spark, sf):
    """Gold and predicted links per part, cut from its keys."""
    k = F.col("p_partkey")
    gold = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("t.c"), ((k + i) % 5).cast("string"), F.lit("x")))
    pred = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("t.c"), ((k + i * 2) % 5).cast("string"), F.when(k % 2 == 0, "x").otherwise("")))
    return table(spark, sf, "part").select(
        k.alias("instance_id"), gold.alias("gold_schemas"), F.when(k % 11 != 0, pred).alias("pred_schemas"), F.col("p_size").alias("db_size"))


LINKS = """l AS (SELECT p_partkey AS k, p_size, list_transform(range(0, p_partkey % 3 + 1), lambda i: 't.c' || ((p_partkey + i) % 5) || 'x') AS g,
 CASE WHEN p_partkey % 11 <> 0 THEN list_distinct(list_transform(range(0, p_partkey % 4 + 1), lambda i: 't.c' || ((p_partkey + i * 2) % 5) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END)) END AS p FROM part)"""


@query("linking_scores", f"""WITH {LINKS},
s AS (SELECT k, len(list_filter(g, lambda x: len(list_filter(p, lambda y: contains(x, y))) > 0)) / len(g) AS r,
 len(list_filter(p, lambda y: len(list_filter(g, lambda x: contains(x, y))) > 0)) / len(p) AS pr, p, list_sort(g) = list_sort(p) AS same FROM l)
SELECT k AS instance_id, CASE WHEN p IS NOT NULL THEN round(r, 6) END AS link_recall, CASE WHEN p IS NOT NULL THEN round(pr, 6) END AS link_precision,
 CASE WHEN p IS NOT NULL THEN r = pr END AS link_exact_ref, CASE WHEN p IS NOT NULL THEN same END AS link_exact FROM s""")
def linking_scores(spark, sf):
    return rounded(S.linking_scores(linked(spark, sf)).select("instance_id", "link_recall", "link_precision", "link_exact_ref", "link_exact"))


@query("linking_scores_equal", f"""WITH {LINKS}
SELECT k AS instance_id, CASE WHEN p IS NOT NULL THEN round(len(list_intersect(g, p)) / len(g), 6) END AS link_recall,
 CASE WHEN p IS NOT NULL THEN round(len(list_intersect(g, p)) / len(p), 6) END AS link_precision FROM l""")
def linking_scores_equal(spark, sf):
    return rounded(S.linking_scores(linked(spark, sf), substring=False).select("instance_id", "link_recall", "link_precision"))


@query("reduce_rate", f"WITH {LINKS} SELECT k AS instance_id, CASE WHEN p_size > 0 AND p IS NOT NULL THEN round(len(p) / p_size, 6) END AS reduce_rate FROM l")
def reduce_rate(spark, sf):
    return rounded(S.reduce_rate(linked(spark, sf)).select("instance_id", "reduce_rate"))


@query("missing_and_extra", f"""WITH {LINKS}
SELECT k AS instance_id, array_to_string(list_sort(list_filter(g, lambda x: len(list_filter(p, lambda y: contains(x, y))) = 0)), ',') AS missing,
 array_to_string(list_sort(list_filter(p, lambda y: NOT list_contains(g, y))), ',') AS extra FROM l WHERE p IS NOT NULL""")
def missing_and_extra(spark, sf):
    rows = linked(spark, sf).where(F.col("pred_schemas").isNotNull())
    return S.missing_and_extra(rows).select("instance_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))

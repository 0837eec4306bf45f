"""Result comparison, clustering and selection queries over the result cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.operators import compare as C
from tallyspark.operators import selection as S
from tallyspark.plans.q_aggregate import rounded
from tallyspark.plans.registry import query

V = ("result_cells",)

BASE = """
cells AS (SELECT *, row_number() OVER (PARTITION BY instance_id, candidate, col_no ORDER BY row_key) - 1 AS row_no FROM result_cells),
shp AS (SELECT instance_id, candidate, max(row_no) + 1 AS n_rows, max(col_no) + 1 AS n_cols FROM cells GROUP BY 1, 2),
prs AS (SELECT p.*, g.n_rows AS g_rows, g.n_cols AS g_cols FROM shp p JOIN shp g ON g.instance_id = p.instance_id AND g.candidate = 0 WHERE p.candidate <> 0)"""
CLOSE = """((p.num_value IS NULL AND p.str_value IS NULL AND g.num_value IS NULL AND g.str_value IS NULL) OR coalesce(p.str_value = g.str_value, FALSE)
 OR coalesce(abs(p.num_value - g.num_value) <= greatest(1e-9 * greatest(abs(p.num_value), abs(g.num_value)), 0.01), FALSE))"""


def match_sql(source: str) -> str:
    return f"""
mt AS (SELECT p.instance_id, p.candidate, p.col_no AS pc, g.col_no AS gc, count(*) FILTER (WHERE {CLOSE}) AS same
 FROM {source} p JOIN {source} g ON g.instance_id = p.instance_id AND g.candidate = 0 AND g.row_no = p.row_no WHERE p.candidate <> 0 GROUP BY ALL),
ok AS (SELECT mt.* FROM mt JOIN prs USING (instance_id, candidate) WHERE same = g_rows AND same = n_rows),
sc AS (SELECT prs.instance_id, prs.candidate,
  CASE WHEN count(DISTINCT ok.gc) = any_value(g_cols) AND count(DISTINCT ok.pc) = any_value(g_cols) THEN 1 ELSE 0 END AS score
  FROM prs LEFT JOIN ok USING (instance_id, candidate) GROUP BY 1, 2)"""


RESORT = """
srt AS (SELECT instance_id, candidate, col_no, num_value, str_value, row_number() OVER (PARTITION BY instance_id, candidate, col_no
 ORDER BY (num_value IS NULL AND str_value IS NULL), num_value IS NULL, coalesce(CAST(num_value AS VARCHAR), str_value, ''), row_no) - 1 AS row_no FROM cells)"""


def cells(spark, sf):
    return C.number_rows(view(spark, sf, "result_cells"), "row_key")


@query("execution_match", f"WITH {BASE}, {match_sql('cells')} SELECT * FROM sc", V)
def execution_match(spark, sf):
    return C.execution_match(cells(spark, sf))


@query("execution_match_any_order", f"WITH {BASE}, {RESORT}, {match_sql('srt')} SELECT * FROM sc", V)
def execution_match_any_order(spark, sf):
    return C.execution_match(cells(spark, sf), ignore_order=True)


@query("execution_match_reuse", f"WITH {BASE}, {match_sql('cells')} SELECT * FROM sc", V)
def execution_match_reuse(spark, sf):
    return C.execution_match(cells(spark, sf), reuse_columns=True)


@query("execution_match_one_column", f"""WITH {BASE}, {match_sql('cells')}
SELECT prs.instance_id, prs.candidate, CASE WHEN count(ok.gc) > 0 THEN 1 ELSE 0 END AS score
FROM prs LEFT JOIN ok ON ok.instance_id = prs.instance_id AND ok.candidate = prs.candidate AND ok.gc = 0 GROUP BY 1, 2""", V)
def execution_match_one_column(spark, sf):
    return C.execution_match(cells(spark, sf), condition_cols=[0])


ENC = "CASE WHEN num_value IS NOT NULL THEN 'n' || CAST(round(num_value, 2) AS VARCHAR) WHEN str_value IS NOT NULL THEN 's' || str_value ELSE '0' END"
ROWS = f"rws AS (SELECT instance_id, candidate, row_no, string_agg({ENC}, '|' ORDER BY col_no) AS r, list_sort(list({ENC})) AS sr FROM cells GROUP BY 1, 2, 3)"


@query("quick_reject", f"""WITH {BASE}, {ROWS},
l AS (SELECT instance_id, candidate, list(sr ORDER BY sr) AS x FROM rws GROUP BY 1, 2)
SELECT p.instance_id, p.candidate, NOT (p.n_rows = p.g_rows AND p.n_cols = p.g_cols AND a.x = b.x) AS rejected
FROM prs p JOIN l a USING (instance_id, candidate) JOIN l b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def quick_reject(spark, sf):
    return C.quick_reject(cells(spark, sf), ignore_order=True)


@query("execution_match_strict", f"""WITH {BASE}, {ROWS}, {match_sql('cells')},
l AS (SELECT instance_id, candidate, list(sr ORDER BY row_no) AS x FROM rws GROUP BY 1, 2)
SELECT p.instance_id, p.candidate, CASE WHEN p.n_rows = p.g_rows AND p.n_cols = p.g_cols AND a.x = b.x THEN sc.score ELSE 0 END AS score
FROM prs p JOIN sc USING (instance_id, candidate) JOIN l a USING (instance_id, candidate) JOIN l b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def execution_match_strict(spark, sf):
    return C.execution_match(cells(spark, sf), strict_columns=True)


SETS = "st AS (SELECT instance_id, candidate, list_sort(list(DISTINCT r)) AS x FROM rws GROUP BY 1, 2)"


@query("rowset_equal", f"""WITH {BASE}, {ROWS}, {SETS}
SELECT p.instance_id, p.candidate, (p.n_rows = p.g_rows AND p.n_cols = p.g_cols AND a.x = b.x)::INT AS score
FROM prs p JOIN st a USING (instance_id, candidate) JOIN st b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def rowset_equal(spark, sf):
    return C.rowset_equal(cells(spark, sf))


@query("multiset_equal", f"""WITH {BASE},
raw AS (SELECT instance_id, candidate, row_no, max(str_value) || '|' || CAST(max(num_value) AS VARCHAR) AS r FROM cells GROUP BY 1, 2, 3),
l AS (SELECT instance_id, candidate, list(r ORDER BY r) AS x FROM raw GROUP BY 1, 2)
SELECT p.instance_id, p.candidate, (a.x = b.x)::INT AS score
FROM prs p JOIN l a USING (instance_id, candidate) JOIN l b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def multiset_equal(spark, sf):
    swapped = cells(spark, sf).withColumn(
        "col_no", F.when(F.col("candidate") == 1, 1 - F.col("col_no")).otherwise(F.col("col_no")))
    return C.multiset_equal_any_column_order(swapped)


@query("multiset_equal_wide", f"""WITH {BASE},
raw AS (SELECT instance_id, candidate, row_no, CAST(max(num_value) AS VARCHAR) AS r FROM cells GROUP BY 1, 2, 3),
l AS (SELECT instance_id, candidate, list(r ORDER BY r) AS x, list(r ORDER BY row_no) AS y FROM raw GROUP BY 1, 2)
SELECT p.instance_id, p.candidate, (a.x = b.x)::INT AS score, (a.y = b.y)::INT AS ordered
FROM prs p JOIN l a USING (instance_id, candidate) JOIN l b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def multiset_equal_wide(spark, sf):
    """Ten equal columns per result: one permutation is tried, not 3.6 million."""
    wide = cells(spark, sf).where("col_no = 1").drop("col_no").withColumn("col_no", F.explode(F.sequence(F.lit(0), F.lit(9))))
    plain = C.multiset_equal_any_column_order(wide)
    ordered = C.multiset_equal_any_column_order(wide, ordered=True).withColumnRenamed("score", "ordered")
    return plain.join(ordered, ["instance_id", "candidate"])


@query("canonical_answer_equal", f"""WITH {BASE},
raw AS (SELECT instance_id, candidate, row_no, max(str_value) AS s, CAST(round(max(num_value), 3) AS VARCHAR) AS n FROM cells GROUP BY 1, 2, 3),
l AS (SELECT instance_id, candidate, list([s, n] ORDER BY [s, n])[1:100] AS x FROM raw GROUP BY 1, 2)
SELECT p.instance_id, p.candidate, (a.x = b.x)::INT AS score
FROM prs p JOIN l a USING (instance_id, candidate) JOIN l b ON b.instance_id = p.instance_id AND b.candidate = 0""", V)
def canonical_answer_equal(spark, sf):
    return C.canonical_answer_equal(cells(spark, sf))


@query("soft_f1", f"""WITH {BASE},
raw AS (SELECT DISTINCT instance_id, candidate, s, n FROM (SELECT instance_id, candidate, row_no, max(str_value) AS s, max(num_value) AS n FROM cells GROUP BY 1, 2, 3)),
rk AS (SELECT *, row_number() OVER (PARTITION BY instance_id, candidate ORDER BY s, 'n' || CAST(n AS VARCHAR)) AS k FROM raw),
g AS (SELECT prs.instance_id, prs.candidate, rk.k, rk.s, rk.n FROM rk JOIN prs ON prs.instance_id = rk.instance_id WHERE rk.candidate = 0),
b AS (SELECT coalesce(g.instance_id, p.instance_id) AS instance_id, coalesce(g.candidate, p.candidate) AS candidate, g.k AS gk, p.k AS pk,
  (g.s = p.s)::INT AS a, (abs(g.n - p.n) <= greatest(1e-9 * greatest(abs(g.n), abs(p.n)), 0.01))::INT AS c
  FROM g FULL JOIN (SELECT * FROM rk WHERE candidate <> 0) p ON p.instance_id = g.instance_id AND p.candidate = g.candidate AND p.k = g.k),
s AS (SELECT instance_id, candidate, sum(CASE WHEN gk IS NULL OR pk IS NULL THEN 0 ELSE (a + c) / 2 END) AS tp,
  sum(CASE WHEN gk IS NULL THEN 1 WHEN pk IS NULL THEN 0 ELSE (2 - a - c) / 2 END) AS fp,
  sum(CASE WHEN gk IS NULL THEN 0 WHEN pk IS NULL THEN 1 ELSE (2 - a - c) / 2 END) AS fn FROM b GROUP BY 1, 2)
SELECT instance_id, candidate, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn,
 round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS score FROM s""", V)
def soft_f1(spark, sf):
    return rounded(C.soft_f1(cells(spark, sf)))


@query("self_consistency", f"""WITH {BASE}, {ROWS}, {SETS},
k AS (SELECT st.instance_id, n_rows, x, count(*) AS k FROM st JOIN shp USING (instance_id, candidate) WHERE candidate <> 0 GROUP BY 1, 2, 3)
SELECT instance_id, CAST(sum(k) AS BIGINT) AS n, CASE WHEN sum(k) >= 2 THEN round(sum(k * (k - 1) / 2) / (sum(k) * (sum(k) - 1) / 2), 6) END AS sc FROM k GROUP BY 1""", V)
def self_consistency(spark, sf):
    return rounded(C.self_consistency(cells(spark, sf)))


CLUSTERS = f"""{BASE}, {ROWS}, {SETS},
cl AS (SELECT st.instance_id, candidate, min(candidate) OVER (PARTITION BY st.instance_id, n_rows, x) AS cluster FROM st JOIN shp USING (instance_id, candidate))"""


@query("cluster_by_result", f"WITH {CLUSTERS} SELECT * FROM cl", V)
def cluster_by_result(spark, sf):
    return S.cluster_by_result(cells(spark, sf))


@query("cluster_by_tolerant_result", f"""WITH {BASE}, {RESORT},
m AS (SELECT p.instance_id, p.candidate AS c, g.candidate AS r, p.col_no AS pc, g.col_no AS gc, count(*) FILTER (WHERE {CLOSE}) AS same
 FROM srt p JOIN srt g ON g.instance_id = p.instance_id AND g.candidate < p.candidate AND g.row_no = p.row_no GROUP BY ALL),
f AS (SELECT m.instance_id, c, r FROM m JOIN shp a ON a.instance_id = m.instance_id AND a.candidate = c JOIN shp b ON b.instance_id = m.instance_id AND b.candidate = r
 WHERE same = a.n_rows AND same = b.n_rows GROUP BY m.instance_id, c, r, b.n_cols HAVING count(DISTINCT gc) = b.n_cols),
c0 AS (SELECT instance_id, candidate FROM shp WHERE candidate = 0),
one AS (SELECT s.instance_id, 1 AS candidate, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.instance_id = s.instance_id AND c = 1 AND r = 0) THEN 0 ELSE 1 END AS cluster FROM shp s WHERE s.candidate = 1),
two AS (SELECT s.instance_id, 2 AS candidate, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.instance_id = s.instance_id AND c = 2 AND r = 0) THEN 0
  WHEN EXISTS (SELECT 1 FROM f JOIN one USING (instance_id) WHERE f.instance_id = s.instance_id AND c = 2 AND r = 1 AND one.cluster = 1) THEN 1 ELSE 2 END AS cluster FROM shp s WHERE s.candidate = 2),
three AS (SELECT s.instance_id, 3 AS candidate, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.instance_id = s.instance_id AND c = 3 AND r = 0) THEN 0
  WHEN EXISTS (SELECT 1 FROM f JOIN one USING (instance_id) WHERE f.instance_id = s.instance_id AND c = 3 AND r = 1 AND one.cluster = 1) THEN 1
  WHEN EXISTS (SELECT 1 FROM f JOIN two USING (instance_id) WHERE f.instance_id = s.instance_id AND c = 3 AND r = 2 AND two.cluster = 2) THEN 2 ELSE 3 END AS cluster FROM shp s WHERE s.candidate = 3)
SELECT instance_id, candidate, 0 AS cluster FROM c0 UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""", V)
def cluster_by_tolerant_result(spark, sf):
    return S.cluster_by_result(cells(spark, sf), tolerant=True)


ELAPSED = "(instance_id * 7 + candidate * 3) % 10"


def runs(spark, sf):
    return S.cluster_by_result(cells(spark, sf)).withColumn("elapsed", F.expr(ELAPSED)).withColumn(
        "score", F.expr("(instance_id * 5 + candidate * 7) % 4"))


PER = f"""{CLUSTERS},
pc AS (SELECT instance_id, cluster, count(*) AS size, min(candidate) AS first, arg_min(candidate, {ELAPSED} * 100 + candidate) AS fast,
 max(((instance_id * 5 + candidate * 7) % 4) * 100 - candidate) AS best FROM cl GROUP BY 1, 2)"""


@query("select_majority_fastest", f"""WITH {PER}
SELECT instance_id, CASE WHEN count(*) = sum(size) THEN (SELECT arg_min(candidate, {ELAPSED} * 100 + candidate) FROM cl WHERE cl.instance_id = pc.instance_id)
  ELSE arg_max(fast, size * 100 - first) END AS chosen, max(size) AS votes, CAST(sum(size) AS BIGINT) AS runs FROM pc GROUP BY 1""", V)
def select_majority_fastest(spark, sf):
    return S.select_majority_fastest(runs(spark, sf))


@query("select_majority_first", f"""WITH {PER}
SELECT instance_id, arg_max(first, size * 100 - first) AS chosen, max(size) AS votes, CAST(sum(size) AS BIGINT) AS runs FROM pc GROUP BY 1""", V)
def select_majority_first(spark, sf):
    return S.select_majority_first(runs(spark, sf))


@query("select_majority_random_tie", f"""WITH {PER}
SELECT instance_id, arg_max(first, size * 4294967296 + ('0x' || substr(md5(concat(CAST(instance_id AS VARCHAR), '|', CAST(first AS VARCHAR), '#42')), 1, 8))::BIGINT) AS chosen,
 max(size) AS votes, CAST(sum(size) AS BIGINT) AS runs FROM pc GROUP BY 1""", V)
def select_majority_random_tie(spark, sf):
    return S.select_majority_first(runs(spark, sf), tie="random")


@query("select_cluster_then_structure", f"""WITH {PER}
SELECT instance_id, arg_max(CAST(ceil(best / 100.0) * 100 - best AS BIGINT), size * 10000 + ceil(best / 100.0) * 100 - first) AS chosen, max(size) AS votes FROM pc GROUP BY 1""", V)
def select_cluster_then_structure(spark, sf):
    return S.select_cluster_then_structure(runs(spark, sf))


def attempts(spark, sf):
    """Candidate rows from lineitem: one question per order."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("candidate"), F.col("l_partkey").alias("part_no"),
        F.concat(F.lit("q"), F.col("l_suppkey") % 3).alias("sql"), (F.col("l_tax") < 0.07).alias("ok"),
        (F.col("l_quantity") % 5).alias("score"))


@query("rank_candidates", """
WITH a AS (SELECT l_orderkey AS instance_id, 'q' || (l_suppkey % 3) AS sql, l_linenumber AS c, l_quantity % 5 + CASE WHEN l_linenumber = 1 THEN 0.4 ELSE 0 END AS s FROM lineitem WHERE l_tax < 0.07),
d AS (SELECT instance_id, sql, max(s) AS score, min(c) FILTER (WHERE s = m) AS candidate FROM (SELECT *, max(s) OVER (PARTITION BY instance_id, sql) AS m FROM a) GROUP BY 1, 2)
SELECT instance_id, sql, round(score, 6) AS score, candidate, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, candidate, sql) AS rank FROM d""")
def rank_candidates(spark, sf):
    ranked = S.rank_candidates(attempts(spark, sf))
    return rounded(ranked)


@query("tournament_score", """
WITH c AS (SELECT l_orderkey AS instance_id, l_linenumber AS candidate, max(l_suppkey % 5 + 1) AS size FROM lineitem GROUP BY 1, 2),
w AS (SELECT a.instance_id, CASE WHEN (a.candidate + b.candidate + a.instance_id) % 2 = 0 THEN a.candidate ELSE b.candidate END AS candidate,
  CASE WHEN (a.candidate + b.candidate + a.instance_id) % 2 = 0 THEN b.size ELSE a.size END AS gain
  FROM c a JOIN c b ON b.instance_id = a.instance_id AND b.candidate = a.candidate + 1),
t AS (SELECT instance_id, candidate, sum(gain) AS gain FROM w GROUP BY 1, 2),
s AS (SELECT instance_id, candidate, c.size + coalesce(gain, 0) AS score FROM c LEFT JOIN t USING (instance_id, candidate))
SELECT instance_id, arg_max(candidate, score * 100 - candidate) AS chosen, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY 1""")
def tournament_score(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("candidate")).agg(
        F.max(F.col("l_suppkey") % 5 + 1).alias("size"))
    nxt = c.select("instance_id", (F.col("candidate") - 1).alias("candidate"), F.col("candidate").alias("right_id"), F.col("size").alias("right_size"))
    outcomes = c.join(nxt, ["instance_id", "candidate"]).select(
        "instance_id", F.col("candidate").alias("left_id"), "right_id",
        ((F.col("candidate") + F.col("right_id") + F.col("instance_id")) % 2 == 0).alias("left_wins"),
        F.col("size").alias("left_size"), "right_size")
    scored = S.tournament_score(outcomes, c.select("instance_id", "candidate", F.col("size").alias("score")))
    return S.best_by_score(scored)


def rankings(spark, sf):
    """Two rankings of five tables per supplier nation, cut from keys."""
    names = F.array(*[F.lit(n) for n in ("Part", "Orders", "Nation", "Region", "Customer")])
    picks = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.lower(F.element_at(names, ((i * (F.col("s_suppkey") % 4 + 1)) % 5 + 1).cast("int"))))
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("instance_id"), F.col("s_suppkey").alias("ranking_no"),
        F.concat(F.array(F.lit("ghost")), picks).alias("tables"))


@query("vote_tables", """
WITH r AS (SELECT s_nationkey AS instance_id, s_suppkey AS ranking_no,
  list_concat(['ghost'], list_transform(range(1, 6), lambda i: lower(['Part', 'Orders', 'Nation', 'Region', 'Customer'][(i * (s_suppkey % 4 + 1)) % 5 + 1]))) AS tables FROM supplier),
p AS (SELECT instance_id, ranking_no, i, list_filter(tables[1:i], lambda t: t <> 'ghost') AS sel FROM r, range(1, 7) x(i)),
c AS (SELECT * FROM p WHERE i = 1 OR len(list_filter(list_distinct(list_filter(sel, lambda t: TRUE)), lambda t: TRUE)) <= 3),
q AS (SELECT *, list_sort(sel) AS s FROM c WHERE len(sel) <= 3),
v AS (SELECT instance_id, s, count(*) AS votes, min(ranking_no * 100 + i) AS first FROM q GROUP BY 1, 2),
b AS (SELECT instance_id, arg_max(first, votes * 1000000 - first) AS first, max(votes) AS votes FROM v GROUP BY 1),
w AS (SELECT b.instance_id, q.sel, b.votes FROM b JOIN q ON q.instance_id = b.instance_id AND q.ranking_no * 100 + q.i = b.first),
n AS (SELECT *, list_transform(sel, lambda t: list_filter(['Part', 'Orders', 'Nation', 'Region', 'Customer'], lambda k: lower(k) = t)[1]) AS nm FROM w)
SELECT instance_id, array_to_string(list_concat(nm, list_filter(['Part', 'Orders', 'Nation', 'Region', 'Customer'], lambda k: NOT list_contains(nm, k)))[1:3], ',') AS tables, votes FROM n""")
def vote_tables(spark, sf):
    ranked = rankings(spark, sf)
    known = F.array(*[F.lit(n) for n in ("Part", "Orders", "Nation", "Region", "Customer")])
    catalogs = ranked.select("instance_id").distinct().withColumn("known", known)
    return S.vote_tables(ranked, catalogs, 3).withColumn("tables", F.array_join("tables", ","))


@query("vote_columns", """
WITH r AS (SELECT s_nationkey AS instance_id, s_suppkey AS ranking_no, list_transform(range(1, 7), lambda i: 'c' || ((i * (s_suppkey % 5 + 1)) % 7)) AS cols FROM supplier),
e AS (SELECT instance_id, ranking_no, list_filter(cols, lambda c: c <> 'c0')[1:4] AS cols FROM r),
x AS (SELECT instance_id, ranking_no, unnest(cols) AS column_name, generate_subscripts(cols, 1) AS pos FROM e),
v AS (SELECT instance_id, column_name, count(*) AS votes, min(ranking_no * 100 + pos) AS seen FROM x GROUP BY 1, 2)
SELECT instance_id, 't' AS table_name, upper(column_name) AS column_name, votes, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY votes DESC, seen) AS rank FROM v) WHERE rank <= 3""")
def vote_columns(spark, sf):
    cols = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.concat(F.lit("c"), (i * (F.col("s_suppkey") % 5 + 1)) % 7))
    results = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("instance_id"), F.col("s_suppkey").alias("ranking_no"), F.lit("t").alias("table_name"), cols.alias("columns"))
    known = F.array(*[F.lit(f"C{i}") for i in range(1, 7)])
    catalogs = results.select("instance_id", "table_name").distinct().withColumn("known", known)
    return S.vote_columns(results, catalogs, 3)


@query("vote_database", """
WITH w AS (SELECT o_custkey AS instance_id, o_orderstatus AS db_id, count(*) AS weight FROM orders GROUP BY 1, 2)
SELECT instance_id, arg_max(db_id, weight * 4294967296 + ('0x' || substr(md5(concat(CAST(instance_id AS VARCHAR), '|', db_id, '#42')), 1, 8))::BIGINT) AS db_id, max(weight) AS weight
FROM w GROUP BY 1""")
def vote_database(spark, sf):
    votes = table(spark, sf, "orders").select(F.col("o_custkey").alias("instance_id"), F.col("o_orderstatus").alias("db_id"), F.lit(1).alias("weight"))
    return S.vote_database(votes)


@query("merge_overwrite", """
SELECT l_orderkey AS instance_id, 'sql' AS key, arg_max(v, n) AS value FROM (SELECT l_orderkey, 'q' || l_suppkey AS v, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS n FROM lineitem WHERE l_tax < 0.07) GROUP BY 1""")
def merge_overwrite(spark, sf):
    return S.merge_outputs(outputs(spark, sf), "overwrite", executable_only=True)


def outputs(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("instance_id"), F.lit("sql").alias("key"), F.concat(F.lit("q"), "l_suppkey").alias("value"),
        (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("producer_no"), (F.col("l_tax") < 0.07).alias("ok"))


@query("merge_append", """
SELECT l_orderkey AS instance_id, 'sql' AS key, string_agg('q' || l_suppkey, ',' ORDER BY CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS value FROM lineitem GROUP BY 1""")
def merge_append(spark, sf):
    return S.merge_outputs(outputs(spark, sf), "append").withColumn("value", F.array_join("value", ","))


@query("merge_extend", """
SELECT l_orderkey AS instance_id, 'sql' AS key, string_agg('q' || l_suppkey || ',x', ',' ORDER BY CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey) AS value FROM lineitem GROUP BY 1""")
def merge_extend(spark, sf):
    rows = outputs(spark, sf).withColumn("value", F.array("value", F.lit("x")))
    return S.merge_outputs(rows, "extend").withColumn("value", F.array_join("value", ","))

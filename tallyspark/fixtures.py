"""Views over the test tables that give every operator an input.

The SELECT texts run unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "eval_log": """
SELECT concat('m', CAST(user_id % 5 AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
       concat('m', CAST(user_id % 5 AS STRING)) AS method,
       concat('q', CAST(event_id % 97 AS STRING)) AS instance_id,
       ts, event_id,
       CASE (event_id % 97) % 5 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' WHEN 3 THEN 'extra' END AS hardness,
       CASE (event_id % 97) % 3 WHEN 0 THEN 'sqlite' WHEN 1 THEN 'big_query' END AS db_type,
       CASE WHEN event_type IN ('purchase','click') THEN 1
            WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL ELSE 0 END AS ex,
       CASE WHEN event_type IN ('purchase','click') AND event_id % 2 = 0 THEN 1 ELSE 0 END AS em,
       CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'timed out after 30s'
            WHEN event_id % 3 = 1 THEN 'no such column: x' ELSE 'near FROM: syntax error' END AS exec_error,
       value AS act_elapsed_s
FROM events""",
    "stage_log": """
SELECT CAST(l_orderkey AS STRING) AS instance_id, l_linenumber AS stage_no,
       CASE l_linenumber WHEN 1 THEN 'ReduceTask' WHEN 2 THEN 'ParseTask' WHEN 3 THEN 'GenerateTask'
            WHEN 4 THEN 'ScaleTask' WHEN 5 THEN 'OptimizeTask' WHEN 6 THEN 'SelectTask' ELSE 'DecomposeTask' END AS task_type,
       concat('sample:', CAST(l_orderkey AS STRING), '|step', CAST(l_linenumber AS STRING)) AS tag,
       CAST(l_quantity AS BIGINT) * 10 AS prompt_tokens, CAST(l_quantity AS BIGINT) AS completion_tokens,
       CAST(l_quantity AS BIGINT) * 11 AS total_tokens, l_shipdate AS ts,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS stage_ok
FROM lineitem""",
    "result_cells": """
SELECT o.o_custkey AS instance_id, c.candidate, o.o_orderkey AS row_key, k.col_no,
       CASE k.col_no WHEN 0 THEN o.o_orderstatus END AS str_value,
       CASE k.col_no WHEN 1 THEN o.o_totalprice + CASE WHEN c.candidate = 1 THEN 0.004 WHEN c.candidate = 2 THEN 5.0 ELSE 0.0 END END AS num_value
FROM orders o CROSS JOIN (SELECT 0 AS candidate UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) c
     CROSS JOIN (SELECT 0 AS col_no UNION ALL SELECT 1) k
WHERE NOT (c.candidate = 3 AND o.o_orderkey % 11 = 3)""",
    "query_log": """
SELECT p_partkey AS instance_id,
       concat('SELECT p_name FROM part WHERE p_size > ', CAST(p_size AS STRING),
              CASE WHEN p_partkey % 3 = 0 THEN ' AND p_brand LIKE ''%1%''' ELSE '' END,
              CASE WHEN p_partkey % 5 = 0 THEN ' ORDER BY p_name LIMIT 5' ELSE '' END) AS gold_sql,
       concat('SELECT ', CASE WHEN p_partkey % 4 = 0 THEN 'p_name, p_size' ELSE 'p_name' END,
              ' FROM part WHERE p_size > ', CAST(p_size AS STRING),
              CASE WHEN p_partkey % 6 = 0 THEN ' AND p_brand LIKE ''%1%''' ELSE '' END,
              CASE WHEN p_partkey % 5 = 0 THEN ' ORDER BY p_name LIMIT 5' ELSE '' END) AS pred_sql
FROM part""",
    "cell_values": """
SELECT d.db_id, b.table_name, b.column_name, b.value
FROM (SELECT 'part' AS table_name, 'p_brand' AS column_name, p_brand AS value FROM part GROUP BY p_brand
      UNION ALL SELECT 'part', 'p_type', p_type FROM part GROUP BY p_type
      UNION ALL SELECT 'nation', 'n_name', n_name FROM nation GROUP BY n_name
      UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer GROUP BY c_mktsegment) b
     JOIN (SELECT 'db0' AS db_id, 0 AS k UNION ALL SELECT 'db1', 1 UNION ALL SELECT 'db2', 2 UNION ALL SELECT 'db3', 3 UNION ALL SELECT 'db4', 4) d
     ON d.k = 0 OR length(b.value) % 4 <> d.k - 1""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: table(spark, sf_dir, name) for name in (names or TABLES)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` as a DataFrame, without touching the session catalog."""
    return run_sql(spark, sf_dir, VIEWS[name])


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a SELECT over the test tables; table names become DataFrame parameters."""
    pattern = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b")
    parts = text.replace("{", "{{").replace("}", "}}").split("'")
    used = {m.group(2) for part in parts[::2] for m in pattern.finditer(part)}
    parts[::2] = [pattern.sub(r"\1 {\2}", part) for part in parts[::2]]  # odd parts are string literals
    return spark.sql("'".join(parts), **tables(spark, sf_dir, *sorted(used)))


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle statement with the views it reads, as CTEs."""
    ctes = ", ".join(f"{name} AS ({VIEWS[name]}\n)" for name in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes}\n{body}"


VIEWS["scored"] = f"""
SELECT e.method, e.instance_id, e.run_id, e.ts, e.event_id, e.hardness, e.db_type, e.ex, e.em, e.exec_error, e.act_elapsed_s,
       CASE WHEN ex IS NULL THEN NULL ELSE CAST(event_id % 11 AS DOUBLE) / 10 END AS sf1,
       CASE WHEN ex = 1 THEN CAST(event_id % 7 AS DOUBLE) / 4 WHEN ex = 0 THEN CAST(0 AS DOUBLE) END AS ves,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) / 4 END AS sl_recall,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS cf1_join,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_select,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_where,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 7 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_group,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_order,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_iuen,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 23 = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS cf1_keywords,
       event_id % 3 - 1 AS delta_join, event_id % 5 - 2 AS delta_query_fields, event_id % 4 - 1 AS delta_predicate,
       event_id % 3 AS f_join, event_id % 2 AS f_group_by, event_id % 5 AS f_predicate, event_id % 4 AS f_logical,
       CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS f_subquery, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS f_set
FROM ({VIEWS['eval_log']}) e"""

VIEWS["stage_rows"] = """
SELECT CAST(l_orderkey AS STRING) AS instance_id, concat('step', CAST(l_linenumber AS STRING)) AS stage_id,
       l_linenumber AS stage_no, l_partkey AS part_no, l_suppkey AS supp_no,
       CASE l_linenumber WHEN 1 THEN 'ReduceTask' WHEN 2 THEN 'ParseTask' WHEN 3 THEN 'GenerateTask'
            WHEN 4 THEN 'ScaleTask' WHEN 5 THEN 'OptimizeTask' WHEN 6 THEN 'SelectTask' ELSE 'DecomposeTask' END AS task_type,
       CASE WHEN l_linenumber <= 2 AND l_tax < 0.07 THEN CASE WHEN l_discount < 0.08 THEN CAST(1 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END END AS recall,
       CASE WHEN l_linenumber <= 2 THEN l_quantity / 50 END AS link_precision,
       CASE WHEN l_linenumber = 2 AND l_tax < 0.02 THEN l_discount < 0.04 END AS exact_links,
       CASE WHEN l_linenumber IN (3, 4) AND l_tax < 0.07 THEN CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END END AS oracle_ex,
       CASE WHEN l_linenumber IN (3, 4) THEN CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END END AS first_ex,
       CASE WHEN l_linenumber IN (3, 4) THEN 4 END AS candidate_count,
       CASE WHEN l_linenumber IN (3, 4) THEN CAST(l_suppkey % 5 AS INT) END AS valid_sql_count,
       CASE WHEN l_linenumber = 6 THEN l_returnflag = 'A' AND l_discount > 0.05 END AS missed_correct,
       CASE WHEN l_linenumber = 6 AND l_tax < 0.07 THEN CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END END AS selected_ex,
       CASE WHEN l_linestatus = 'F' AND l_partkey % 50 = 0 THEN 'boom' END AS error,
       l_quantity AS elapsed_s
FROM lineitem"""

VIEWS["stage_finals"] = """
SELECT CAST(o_orderkey AS STRING) AS instance_id,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS ex,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'model_missing_join' END AS error_root,
       CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'no such table: t' END AS exec_error,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'SELECT 1' END AS pred_sql,
       o_totalprice / 10000 AS act_elapsed_s
FROM orders"""


VIEWS["samples"] = """
SELECT concat('dev_', CAST(o_orderkey AS STRING)) AS instance_id, o_orderkey AS pos, concat('db', CAST(o_custkey % 40 AS STRING)) AS db_id,
       CAST(o_custkey % 500 AS INT) AS db_size, CASE o_orderstatus WHEN 'F' THEN 'easy' WHEN 'O' THEN 'hard' END AS difficulty,
       concat('how many orders are ', o_orderpriority) AS question,
       CASE WHEN o_orderkey % 4 = 0 THEN 'SELECT' WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat('SELECT ', CAST(o_orderkey % 100 AS STRING)) END AS query
FROM orders"""

VIEWS["catalog_columns"] = """
SELECT DISTINCT concat('db', CAST(l_suppkey AS STRING)) AS db_id, concat('t', CAST(l_linenumber AS STRING)) AS table_name,
       CAST(l_partkey % 13 AS INT) AS column_no, concat('col_', CAST(l_partkey % 13 AS STRING)) AS column_name,
       CASE WHEN l_partkey % 13 % 2 = 0 THEN 'number' ELSE 'text' END AS column_types,
       CASE WHEN l_partkey % 13 % 3 = 0 THEN concat('note ', CAST(l_partkey % 13 AS STRING)) ELSE '' END AS column_descriptions,
       l_partkey % 13 = 0 AS primary_key,
       CASE WHEN l_partkey % 13 = 1 AND l_linenumber > 1 THEN concat('[t', CAST(l_linenumber - 1 AS STRING), '(col_0)]')
            WHEN l_partkey % 13 = 2 AND l_linenumber > 3 THEN concat('[t', CAST(l_linenumber - 3 AS STRING), '.col_0]')
            WHEN l_partkey % 13 = 3 AND l_linenumber = 7 THEN 't7.col_3 = t2.col_4' ELSE '' END AS foreign_key
FROM lineitem"""

VIEWS["link_rows"] = """
SELECT DISTINCT l_orderkey AS instance_id, concat('db', CAST(l_orderkey % 50 AS STRING)) AS db_id,
       concat('T', CAST(l_linenumber AS STRING), '.col_', CAST(l_partkey % 17 AS STRING)) AS link
FROM lineitem"""

# Statement shapes with the WHERE set of each; @n is a number and @v a word of the part.
SHAPES = (
    ("select a from t where x = 1 or y = @n", "x = 1 or y = @n"),
    ("SELECT a FROM t WHERE x = @n AND y > 2", "x = VAL:@n|y > VAL:2"),
    ("select a from t where n not like '@vA%'", "n not like '@va%'"),
    ("select a from t where n = 'O''Brien @n'", "n = VAL:O'Brien @n"),
    ("select a from t where n = 'x--y @n' and b > 1 order by a", "b > VAL:1|n = VAL:x--y @n"),
    ("select a /* , z */ from t where n /* = 3 */ = '@v'", "n = VAL:@v"),
    ("select a from t where x in (select y from u where z = @n and w = 1) and k = @n", "k = VAL:@n|x IN"),
    ("select a from t where x between @n and 9 and y = @n", "x BETWEEN|y = VAL:@n"),
    ("select a from t where (x = @n or y = 2) and z is not null", "(x = @n or y = 2)|z is not null"),
    ("select a, count(*) from t group by a having count(*) > @n and max(b) < 3", "count(*) > VAL:@n|max(b) < VAL:3"),
    ("select a from t join u on t.id = u.id and u.k = @n", "id = COL|k = VAL:@n"),
    ("select f(g(h(k(((a, @n))))), 1), b from t where not x = @n", "not x = @n"),
    ("select a from t where exists (select 1 from u where u.k = 3) and w >= @n.5", "EXISTS|w >= VAL:@n.5"),
    ("select a from t where x is null and y <> \"@v and @n\"", "x IS|y != VAL:@v and @n"),
    ("select a from t where x like 'where%' and y != '/* @n */' limit 3", "x LIKE|y != VAL:/* @n */"),
    ("select a from t where b = ';' and c = @n;", "b = VAL:;|c = VAL:@n"),
    ("select count(distinct a) from (select a from u where q = 1) as s where s.a = @n union select 2 from t where v = @n", "a = VAL:@n"),
    ("select a from t where lower(n) = '@v' and a.b = c.d", "b = COL|lower(n) = VAL:@v"),
    ("select a from t where x not in (@n, 2) or x not between 1 and @n", "x not in (@n, 2) or x not between 1 and @n"),
    ("select a from t where x = '' and y = ' @n '", "x = VAL:|y = VAL: @n "),
)
_quoted = "'{}'".format
VIEWS["shape_log"] = "SELECT p_partkey AS instance_id, s.shape, " + ", ".join(
    f"replace(replace(s.{c}, '@n', CAST(p_size AS STRING)), '@v', lower(p_brand)) AS {c}" for c in ("pred_sql", "conditions")) + " FROM part JOIN (" + " UNION ALL ".join(
    f"SELECT {k} AS shape, {_quoted(sql.replace(chr(39), chr(39) * 2))} AS pred_sql, {_quoted(want.replace(chr(39), chr(39) * 2))} AS conditions"
    for k, (sql, want) in enumerate(SHAPES)) + f") s ON p_partkey % {len(SHAPES)} = s.shape"

VIEWS["asked"] = """
SELECT c_custkey AS query_id, concat('db', CAST(c_custkey % 10 AS STRING)) AS db_id,
       concat('Show col ', CAST(c_custkey % 13 AS STRING), ' of t', CAST(c_nationkey % 9 AS STRING), ' where Col ', CAST(c_nationkey % 13 AS STRING),
              ' is ', CAST(c_nationkey AS STRING), ' for Brand#', CAST(c_custkey % 25 + 1 AS STRING), ' ', c_mktsegment, ' in NATION_', CAST(c_nationkey AS STRING)) AS question
FROM customer"""

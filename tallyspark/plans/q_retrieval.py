"""Retrieval and linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.fixtures import table, view
from tallyspark.functions.words import NAME_STOPWORDS, STOPWORDS, jaccard, name_tokens, words
from tallyspark.operators import retrieval as R
from tallyspark.plans.q_aggregate import rounded
from tallyspark.plans.registry import query

STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
NAME_STOP_SQL = ", ".join(f"'{w}'" for w in NAME_STOPWORDS)
ASKED = ("asked",)


def asked(spark, sf):
    return view(spark, sf, "asked")


@query("name_tokens", f"""
WITH w AS (SELECT query_id, list_transform(regexp_extract_all(replace(question, '_', ' '), '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM asked),
k AS (SELECT query_id, list_filter(w, lambda x: NOT list_contains([{NAME_STOP_SQL}], x)) AS k FROM w)
SELECT query_id, array_to_string(list_sort(list_distinct(list_concat(k, list_transform(list_filter(k, lambda x: length(x) > 3 AND x LIKE '%s'), lambda x: left(x, length(x) - 1))))), ',') AS tokens FROM k""", ASKED)
def tokens(spark, sf):
    return asked(spark, sf).select("query_id", F.array_join(F.array_sort(name_tokens(F.col("question"), NAME_STOPWORDS)), ",").alias("tokens"))


_TOK = """list_distinct(list_filter(list_transform(regexp_extract_all(replace({x}, '_', ' '), '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: NOT list_contains([{stop}], x)))"""


def _tok(x: str) -> str:
    return _TOK.format(x=x, stop=NAME_STOP_SQL)


@query("lexical_score", f"""
SELECT p_partkey AS item_id, round(len(list_intersect({_tok("p_name || ' ' || p_type")}, ['small', 'ring', 'economy', 'widget'])) + 0.35 * len(list_filter(['small', 'ring', 'economy', 'widget'],
 lambda t: contains(lower(replace(p_name || p_type, ' ', '')), t))), 6)::DOUBLE AS score FROM part""")
def lexical_score(spark, sf):
    part = table(spark, sf, "part")
    q = F.array(*[F.lit(w) for w in ("small", "ring", "economy", "widget")])
    score = R.lexical_score(q, F.concat_ws(" ", "p_name", "p_type"), NAME_STOPWORDS)
    return part.select(F.col("p_partkey").alias("item_id"), F.round(score.cast("double"), 6).alias("score"))


LEXICAL = f"""
q AS (SELECT query_id, db_id, {_tok('question')} AS q FROM asked),
c AS (SELECT db_id, table_name, column_no, column_name, {_tok("column_name || ' ' || column_descriptions")} AS t, lower(replace(replace(column_name || column_descriptions, '_', ''), ' ', '')) AS k, foreign_key FROM catalog_columns),
cs AS (SELECT q.query_id, c.*, round(len(list_intersect(c.t, q.q)) + 0.35 * len(list_filter(q.q, lambda w: length(w) > 3 AND contains(c.k, w))), 6)::DOUBLE AS score FROM q JOIN c USING (db_id))"""


def lexical_catalog(spark, sf):
    return R.table_catalog(view(spark, sf, "catalog_columns"), NAME_STOPWORDS)


@query("rank_columns", f"""WITH {LEXICAL}
SELECT query_id, table_name, rank, column_name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY score DESC, column_no) AS rank FROM cs) WHERE rank <= 3""", ("asked", "catalog_columns"))
def rank_columns(spark, sf):
    return R.rank_columns(asked(spark, sf), lexical_catalog(spark, sf), 3, NAME_STOPWORDS).withColumn("rank", F.col("rank").cast("bigint"))


@query("rank_tables", f"""WITH {LEXICAL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY score DESC) AS r FROM cs),
s AS (SELECT r.query_id, r.table_name, any_value(q.q) AS q, sum(CASE WHEN r = 1 THEN score WHEN r <= 3 THEN 0.25 * score ELSE 0 END) + 2 * any_value(len(list_filter(q.q, lambda w: w = r.table_name))) AS s,
 row_number() OVER (PARTITION BY r.query_id ORDER BY r.table_name) AS o FROM r JOIN q USING (query_id) GROUP BY r.query_id, r.table_name),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, o) AS k FROM s),
e AS (SELECT DISTINCT db_id, table_name AS src, unnest(regexp_extract_all(foreign_key, '\\[([A-Za-z_]\\w*)\\(', 1)) AS ref FROM catalog_columns),
f AS (SELECT k.query_id, e.ref, max(len(list_filter(k.q, lambda w: w = e.ref)) + 0.2 * (4 - k.k)) AS hit FROM k JOIN asked a USING (query_id) JOIN e ON e.db_id = a.db_id AND e.src = k.table_name
  WHERE k.k <= 3 GROUP BY 1, 2),
g AS (SELECT k.query_id, k.table_name, k.k, CASE WHEN k.k <= 3 THEN 0 WHEN f.hit > 0 THEN 1 ELSE 2 END AS tier, CASE WHEN k.k > 3 THEN round(f.hit, 6) END AS hit FROM k LEFT JOIN f ON f.query_id = k.query_id AND f.ref = k.table_name)
SELECT query_id, table_name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 1 THEN -hit ELSE 0 END, k) AS rank FROM g) WHERE rank <= 5""", ("asked", "catalog_columns"))
def rank_tables(spark, sf):
    return R.rank_tables(asked(spark, sf), lexical_catalog(spark, sf), 5, NAME_STOPWORDS).withColumn("rank", F.col("rank").cast("bigint"))


def given_catalog(spark, sf):
    """A catalog in which some tables and columns bring a probability along."""
    c = view(spark, sf, "catalog_columns")
    table_prob = F.when(F.col("table_name") == "t5", F.col("column_no") / 2).when(F.col("table_name") == "t2", F.lit(0.0))
    column_prob = F.when(F.col("column_no") % 3 == 1, F.col("column_no") / 8)
    return R.table_catalog(c.withColumn("table_pred_prob", table_prob).withColumn("column_score", F.lit(None).cast("double")).withColumn("column_prob", column_prob), NAME_STOPWORDS)


@query("rank_columns_given", f"""WITH {LEXICAL},
p AS (SELECT query_id, table_name, column_no, column_name, CASE WHEN column_no % 3 = 1 THEN round(column_no / 8, 6) ELSE score END AS score FROM cs)
SELECT query_id, table_name, rank, column_name, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY score DESC, column_no) AS rank FROM p) WHERE rank <= 3""", ("asked", "catalog_columns"))
def rank_columns_given(spark, sf):
    return R.rank_columns(asked(spark, sf), given_catalog(spark, sf), 3, NAME_STOPWORDS).withColumn("rank", F.col("rank").cast("bigint"))


@query("rank_tables_given", f"""WITH {LEXICAL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY score DESC) AS r FROM cs),
s AS (SELECT r.query_id, r.table_name, CASE r.table_name WHEN 't5' THEN max(column_no) / 2 WHEN 't2' THEN 0 ELSE
  sum(CASE WHEN r = 1 THEN score WHEN r <= 3 THEN 0.25 * score ELSE 0 END) + 2 * any_value(len(list_filter(q.q, lambda w: w = r.table_name))) END AS s FROM r JOIN q USING (query_id) GROUP BY r.query_id, r.table_name)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, table_name) AS rank, table_name FROM s QUALIFY rank <= 3""", ("asked", "catalog_columns"))
def rank_tables_given(spark, sf):
    return R.rank_tables(asked(spark, sf), given_catalog(spark, sf), 3, NAME_STOPWORDS).withColumn("rank", F.col("rank").cast("bigint"))


HAY = """
h AS (SELECT a.query_id, c.table_name, c.column_name, 0.01 + len(list_intersect(list_distinct(regexp_extract_all(lower(c.table_name || ' ' || c.column_name || ' ' || c.column_types), '[a-z0-9]+')),
  list_distinct(regexp_extract_all(lower(a.question), '[a-z0-9]+')))) + CASE WHEN contains(lower(a.question), lower(c.column_name)) THEN 2 ELSE 0 END + CASE WHEN contains(lower(a.question), lower(c.table_name)) THEN 1 ELSE 0 END AS score
 FROM asked a JOIN catalog_columns c USING (db_id))"""


def hay_catalog(spark, sf):
    hay = F.struct("table_name", "column_name", F.concat_ws(" ", "table_name", "column_name", "column_types").alias("haystack"))
    return view(spark, sf, "catalog_columns").groupBy("db_id").agg(F.array_sort(F.collect_list(hay)).alias("columns"))


@query("normalized_scores", f"""WITH {HAY}
SELECT query_id, table_name, column_name, round(score, 6)::DOUBLE AS score, round(score / max(score) OVER (PARTITION BY query_id), 4)::DOUBLE AS prob FROM h""", ("asked", "catalog_columns"))
def normalized_scores(spark, sf):
    return rounded(R.normalized_scores(asked(spark, sf), hay_catalog(spark, sf)))


@query("ranked_schema", f"""WITH {HAY},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, table_name ORDER BY score DESC, column_name) AS column_rank, max(score) OVER (PARTITION BY query_id, table_name) AS ts FROM h),
t AS (SELECT query_id, table_name, row_number() OVER (PARTITION BY query_id ORDER BY max(ts) DESC, table_name) AS table_rank FROM c GROUP BY 1, 2)
SELECT query_id, table_name, column_name, table_rank, column_rank FROM c JOIN t USING (query_id, table_name) WHERE table_rank <= 4 AND column_rank <= 5""", ("asked", "catalog_columns"))
def ranked_schema(spark, sf):
    return R.ranked_schema(asked(spark, sf), hay_catalog(spark, sf), 4, 5)


GRAMS = """
w AS (SELECT query_id, db_id, string_split(lower(question), ' ') AS w FROM asked),
g AS (SELECT query_id, db_id, i AS pos, n, array_to_string(w[i + 1:i + n], ' ') AS gram FROM w, range(0, 20) r(i), range(1, 6) s(n) WHERE i + n <= len(w)),
nm AS (SELECT DISTINCT db_id, 'col' AS kind, column_name AS item, replace(column_name, '_', ' ') AS name FROM catalog_columns UNION SELECT DISTINCT db_id, 'tab', table_name, table_name FROM catalog_columns)"""
LINK = f"""{GRAMS},
hit AS (SELECT g.query_id, g.pos + d AS pos, nm.kind, nm.item, max((g.gram = nm.name)::INT) AS exact FROM g JOIN nm ON nm.db_id = g.db_id AND contains(' ' || nm.name || ' ', ' ' || g.gram || ' '), range(0, 5) x(d)
 WHERE d < g.n AND (g.gram = nm.name OR g.gram NOT IN ({STOP_SQL})) GROUP BY 1, 2, 3, 4),
lk AS (SELECT query_id, pos, kind, item, CASE WHEN kind = 'col' THEN 'C' ELSE 'T' END || CASE WHEN exact = 1 THEN 'EM' ELSE 'PM' END AS flag FROM hit)"""


def names(spark, sf):
    c = view(spark, sf, "catalog_columns")
    cols = c.select("db_id", F.lit("col").alias("kind"), F.col("column_name").alias("item"), F.col("column_name").alias("name"))
    tabs = c.select("db_id", F.lit("tab").alias("kind"), F.col("table_name").alias("item"), F.col("table_name").alias("name"))
    return cols.unionByName(tabs).distinct()


@query("ngram_link", f"WITH {LINK} SELECT query_id, CAST(pos AS INT) AS pos, kind, item, flag FROM lk", ("asked", "catalog_columns"))
def ngram_link(spark, sf):
    return R.ngram_link(asked(spark, sf), names(spark, sf))


MARKED = "CASE column_no % 3 WHEN 0 THEN 'Col-' || column_no || ' (Brand#' || column_no || ')' WHEN 1 THEN 'Free/' || table_name || '-Col ' || column_no ELSE column_name END"


@query("ngram_link_marks", f"""WITH {GRAMS.replace("column_name AS item, replace(column_name, '_', ' ') AS name", f"column_name || table_name AS item, lower(replace({MARKED}, '_', ' ')) AS name")},
pairs AS (SELECT DISTINCT gram, nm.name FROM g JOIN nm USING (db_id)),
met AS (SELECT gram, name, gram = name AS exact FROM pairs WHERE gram = name OR (gram NOT IN ({STOP_SQL}) AND regexp_matches(name, '\\b' || regexp_escape(gram) || '\\b'))),
hit AS (SELECT g.query_id, g.pos + d AS pos, nm.kind, nm.item, max(met.exact::INT) AS exact FROM g JOIN nm USING (db_id) JOIN met ON met.gram = g.gram AND met.name = nm.name, range(0, 5) x(d) WHERE d < g.n GROUP BY 1, 2, 3, 4)
SELECT query_id, CAST(pos AS INT) AS pos, kind, item, CASE WHEN kind = 'col' THEN 'C' ELSE 'T' END || CASE WHEN exact = 1 THEN 'EM' ELSE 'PM' END AS flag FROM hit""", ("asked", "catalog_columns"))
def ngram_link_marks(spark, sf):
    c = view(spark, sf, "catalog_columns")
    cols = c.select("db_id", F.lit("col").alias("kind"), F.concat("column_name", "table_name").alias("item"), F.expr(MARKED).alias("name"))
    tabs = c.select("db_id", F.lit("tab").alias("kind"), F.col("table_name").alias("item"), F.col("table_name").alias("name"))
    return R.ngram_link(asked(spark, sf), cols.unionByName(tabs).distinct())


RESOLVED = f"""{LINK},
per AS (SELECT query_id, pos, list(flag || '|' || kind || '|' || item) AS m, count(*) AS n FROM lk GROUP BY 1, 2),
o AS MATERIALIZED (SELECT *, list_filter(m, lambda x: x[2:3] = 'EM') AS e, row_number() OVER (PARTITION BY query_id ORDER BY n, pos) AS r FROM per),
st AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS taken, CAST(-1 AS BIGINT) AS pos, CAST([] AS VARCHAR[]) AS kept FROM o
 UNION ALL SELECT o.query_id, o.r, CASE WHEN len(list_intersect(s.taken, o.m)) > 0 THEN s.taken WHEN len(o.e) > 0 THEN list_concat(s.taken, o.e) ELSE list_concat(s.taken, o.m) END, CAST(o.pos AS BIGINT),
  CASE WHEN len(list_intersect(s.taken, o.m)) > 0 THEN list_intersect(o.m, s.taken) WHEN len(o.e) > 0 THEN o.e ELSE o.m END FROM st s JOIN o ON o.query_id = s.query_id AND o.r = s.r + 1),
res AS (SELECT query_id, CAST(pos AS INT) AS pos, string_split(unnest(kept), '|') AS x FROM st)"""


@query("resolve_overlaps", f"WITH RECURSIVE {RESOLVED} SELECT query_id, pos, x[1] AS flag, x[2] AS kind, x[3] AS item FROM res", ("asked", "catalog_columns"))
def resolve_overlaps(spark, sf):
    return R.resolve_overlaps(R.ngram_link(asked(spark, sf), names(spark, sf)))


@query("mask_question", """
SELECT query_id, regexp_replace(regexp_replace(question, '^Show \\S+', '<mask> <unk>'), '(\\S+)$', '<unk>') AS masked FROM asked""", ASKED)
def mask_question(spark, sf):
    size = F.size(F.split("question", r"\s+"))
    rows = asked(spark, sf).withColumn("schema_pos", F.array(F.lit(0))).withColumn("value_pos", F.array(F.lit(1), size - 1))
    return R.mask_question(rows).select("query_id", "masked")


@query("tag_links", """
WITH w AS (SELECT query_id, db_id, question, string_split(lower(question), ' ') AS w FROM asked),
c AS (SELECT w.query_id, k.table_name, k.column_no, CASE WHEN list_contains(w.w, k.table_name) OR list_contains(w.w, k.column_name) THEN 'EM '
  WHEN list_contains(w.w, 'col') THEN 'PA ' WHEN k.primary_key THEN 'RK ' WHEN k.foreign_key <> '' THEN 'FO ' ELSE '' END || k.column_types || ' ' || k.table_name || '@' || k.column_name AS x
  FROM w JOIN catalog_columns k USING (db_id)),
t AS (SELECT DISTINCT w.query_id, k.table_name, CASE WHEN list_contains(w.w, k.table_name) THEN 'EM ' ELSE '' END || k.table_name AS x FROM w JOIN catalog_columns k USING (db_id)),
cl AS (SELECT query_id, string_agg(x, ' | ' ORDER BY table_name, column_no) AS x FROM c GROUP BY 1), tl AS (SELECT query_id, string_agg(x, ' | ' ORDER BY table_name) AS x FROM t GROUP BY 1)
SELECT w.query_id, '<C> text * | ' || cl.x || ' | <T> ' || tl.x || ' | <S> ( t1 , t2 ) | <Q> ' || question AS line FROM w JOIN cl USING (query_id) JOIN tl USING (query_id)""", ("asked", "catalog_columns"))
def tag_links(spark, sf):
    column = F.struct("table_name", "column_no", "column_name", F.col("column_types").alias("type"), F.col("primary_key").alias("pk"), (F.col("foreign_key") != "").alias("fk"))
    packed = view(spark, sf, "catalog_columns").groupBy("db_id").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    catalogs = packed.withColumn("tables", F.array_distinct("columns.table_name")).withColumn("fk_pairs", F.array(F.lit("( t1 , t2 )")))
    return R.tag_links(asked(spark, sf), catalogs)


# Questions that also name a nation with a possessive ending.
OWNED = "concat(question, ' like ', CASE WHEN query_id % 3 = 0 THEN 'germany''s' WHEN query_id % 3 = 1 THEN 'United Kingdoms' ELSE 'chinas' END, ' shops')"

VALUES = """
v AS (SELECT db_id, table_name, column_name, lower(trim(value)) AS cell FROM cell_values GROUP BY ALL)"""


CELLS = f"""{VALUES},
t AS (SELECT query_id, db_id, unnest(string_split(lower(question), ' ')) AS word, generate_subscripts(string_split(lower(question), ' '), 1) - 1 AS pos FROM asked),
cw AS (SELECT DISTINCT db_id, table_name, column_name, unnest(string_split_regex(cell, '\\s+')) AS word FROM v),
h AS (SELECT query_id, db_id, table_name, column_name, pos, word, pos - row_number() OVER (PARTITION BY query_id, table_name, column_name ORDER BY pos) AS run FROM t JOIN cw USING (db_id, word) WHERE word NOT IN ({STOP_SQL}) AND try_cast(word AS DOUBLE) IS NULL),
r AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY query_id, table_name, column_name, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS span FROM h),
cl AS (SELECT query_id, table_name, column_name, CASE WHEN EXISTS (SELECT 1 FROM v WHERE v.db_id = r.db_id AND v.table_name = r.table_name AND v.column_name = r.column_name AND v.cell = r.span) THEN 'EXACTMATCH' ELSE 'PARTIALMATCH' END AS flag, CAST(pos AS INT) AS pos FROM r)"""


@query("cell_value_link", f"WITH {CELLS} SELECT * FROM cl", ("asked", "cell_values"))
def cell_value_link(spark, sf):
    return R.cell_value_link(asked(spark, sf), view(spark, sf, "cell_values"))


FIRMS = RESOLVED.replace("SELECT DISTINCT db_id, 'tab', table_name, table_name FROM catalog_columns", "SELECT DISTINCT db_id, 'tab', table_name, table_name FROM catalog_columns UNION SELECT DISTINCT db_id, 'tab', 'firms', 'building-firms' FROM catalog_columns").replace(
    "contains(' ' || nm.name || ' ', ' ' || g.gram || ' ')", "(contains(' ' || nm.name || ' ', ' ' || g.gram || ' ') OR (nm.item = 'firms' AND g.gram = 'building'))")


@query("drop_linked_cells", f"WITH RECURSIVE {FIRMS},{CELLS} SELECT * FROM cl WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.query_id = cl.query_id AND res.pos = cl.pos)", ("asked", "catalog_columns", "cell_values"))
def drop_linked_cells(spark, sf):
    """A table named after a market segment is linked, so the segment's cells are not."""
    known = names(spark, sf)
    firms = known.select("db_id", F.lit("tab").alias("kind"), F.lit("firms").alias("item"), F.lit("Building-Firms").alias("name")).distinct()
    links = R.resolve_overlaps(R.ngram_link(asked(spark, sf), known.unionByName(firms)))
    return R.drop_linked_cells(cell_value_link(spark, sf), links).select("query_id", "table_name", "column_name", "flag", "pos")


@query("numeric_tokens", """
WITH t AS (SELECT query_id, db_id, unnest(string_split(lower(question), ' ')) AS word, generate_subscripts(string_split(lower(question), ' '), 1) - 1 AS pos FROM asked),
n AS (SELECT db_id, count(*) AS n FROM catalog_columns WHERE column_types = 'number' GROUP BY 1)
SELECT query_id, CAST(pos AS INT) AS pos, word, n AS number_columns FROM t JOIN n USING (db_id) WHERE try_cast(word AS DOUBLE) IS NOT NULL""", ("asked", "catalog_columns"))
def numeric_tokens(spark, sf):
    catalogs = view(spark, sf, "catalog_columns").groupBy("db_id").agg(
        F.array_compact(F.collect_list(F.when(F.col("column_types") == "number", F.concat_ws(".", "table_name", "column_name")))).alias("number_columns"),
        F.array().cast("array<string>").alias("time_columns"))
    return R.numeric_tokens(asked(spark, sf), catalogs).select("query_id", "pos", "word", F.size("number_columns").cast("bigint").alias("number_columns"))


@query("fuzzy_value_match", f"""WITH v AS (SELECT db_id, table_name, column_name, value, lower(trim(value)) AS cell FROM cell_values GROUP BY ALL),
w AS (SELECT query_id, db_id, string_split(lower({OWNED}), ' ') AS w FROM asked),
b AS (SELECT DISTINCT query_id, db_id, array_to_string(w[i + 1:i + n], ' ') AS gram FROM w, range(0, 30) r(i), range(1, 30) s(n) WHERE i + n <= len(w)),
g AS (SELECT query_id, db_id, gram, min(owner) AS owner FROM (SELECT *, 0 AS owner FROM b UNION ALL SELECT query_id, db_id, left(gram, length(gram) - 2), 1 FROM b WHERE gram LIKE '%''s') GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT gram FROM g WHERE gram NOT IN ({STOP_SQL}, 'id')), e AS (SELECT DISTINCT cell FROM v WHERE cell NOT IN ({STOP_SQL}, 'id') AND try_cast(replace(cell, ',', '') AS DOUBLE) IS NULL),
p AS (SELECT gram, cell, 1 - levenshtein(gram, cell) / greatest(length(gram), length(cell)) AS ratio FROM d, e WHERE left(gram, 1) = left(cell, 1) AND levenshtein(gram, cell) <= floor(0.15 * greatest(length(gram), length(cell)) + 1e-9)),
h AS (SELECT query_id, table_name, column_name, value, round(max(ratio), 6) AS score FROM g JOIN p USING (gram) JOIN v USING (db_id, cell)
 WHERE ratio = 1 OR (upper(value) <> value AND owner = 0 AND NOT contains(column_name, 'name')) GROUP BY 1, 2, 3, 4)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, table_name, column_name ORDER BY score DESC, value) AS rank FROM h) WHERE rank <= 2""", ("asked", "cell_values"))
def fuzzy_value_match(spark, sf):
    questions = asked(spark, sf).withColumn("question", F.expr(OWNED))
    return rounded(R.fuzzy_value_match(questions, view(spark, sf, "cell_values")))


@query("nearest_name", """
WITH k AS (SELECT DISTINCT 'db' || p_size % 10 AS db_id, p_name AS known FROM part),
n AS (SELECT DISTINCT db_id, name FROM (SELECT 'db' || p_size % 10 AS db_id, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, 'i', 'y') WHEN 1 THEN p_name || 's' ELSE left(p_name, 4) END AS name FROM part) WHERE (db_id, name) NOT IN (SELECT db_id, known FROM k)),
p AS (SELECT n.db_id, name, known, 1 - levenshtein(lower(name), lower(known)) / greatest(length(name), length(known)) AS ratio FROM n JOIN k USING (db_id)
 WHERE levenshtein(lower(name), lower(known)) <= floor(0.2 * greatest(length(name), length(known)) + 1e-9))
SELECT db_id, name, known AS nearest, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY db_id, name ORDER BY ratio DESC, lower(known), known) AS r FROM p) WHERE r = 1""")
def nearest_name(spark, sf):
    part = table(spark, sf, "part").withColumn("db_id", F.concat(F.lit("db"), F.col("p_size") % 10))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.replace("p_name", F.lit("i"), F.lit("y"))).when(k == 1, F.concat("p_name", F.lit("s"))).otherwise(F.substring("p_name", 1, 4))
    found = R.nearest_name(part.select("db_id", name.alias("name")), part.select("db_id", F.col("p_name").alias("known")).distinct(), 0.8)
    return rounded(found)


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")


def benchmark(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


@query("bm25_top_n", f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, s GROUP BY term, n), f AS (SELECT avg(idf) * 0.25 AS floor FROM i),
q AS (SELECT item_id AS query_id, unnest({_words('text')}) AS term FROM benchmark), qc AS (SELECT query_id, term, count(*) AS c FROM q GROUP BY 1, 2),
x AS (SELECT query_id, doc_id, round(sum(c * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM qc JOIN tf USING (term) JOIN i USING (term), f, s GROUP BY 1, 2)
SELECT query_id, doc_id AS item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 5""")
def bm25_top_n(spark, sf):
    queries = benchmark(spark, sf).select("query_id", words(F.col("text")).alias("tokens"))
    return R.bm25_top_n(queries, documents(spark, sf).select("item_id", words(F.col("text")).alias("tokens")), 5)


@query("bm25_column_samples", """
WITH v AS (SELECT db_id, table_name || '.' || column_name AS col, value, string_split_regex(table_name || ' ' || column_name || ' ' || value, '\\s+') AS w, count(*) OVER (PARTITION BY db_id, table_name, column_name) AS k FROM cell_values),
m AS (SELECT * FROM v WHERE k > 6), s AS (SELECT db_id, col, count(*) AS n, avg(len(w)) AS avgdl FROM m GROUP BY 1, 2),
tf AS (SELECT db_id, col, value, len(w) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM m) GROUP BY 1, 2, 3, 4, 5),
i AS (SELECT db_id, col, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN s USING (db_id, col) GROUP BY db_id, col, term, n), f AS (SELECT db_id, col, avg(idf) * 0.25 AS floor FROM i GROUP BY 1, 2),
q AS (SELECT query_id, db_id, term, count(*) AS c FROM (SELECT query_id, db_id, unnest(string_split_regex(question, '\\s+')) AS term FROM asked) GROUP BY 1, 2, 3),
x AS (SELECT query_id, col, value, round(sum(c * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM q JOIN tf USING (db_id, term) JOIN i USING (db_id, col, term) JOIN f USING (db_id, col) JOIN s USING (db_id, col) GROUP BY 1, 2, 3),
y AS (SELECT a.query_id, m.col, m.value, coalesce(x.score, 0) AS score FROM asked a JOIN m USING (db_id) LEFT JOIN x ON x.query_id = a.query_id AND x.col = m.col AND x.value = m.value)
SELECT query_id, col, value, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, col ORDER BY score DESC, value) AS rank FROM y) WHERE rank <= 6""", ("asked", "cell_values"))
def bm25_column_samples(spark, sf):
    return R.bm25_column_samples(asked(spark, sf), view(spark, sf, "cell_values"), 6)


@query("static_column_samples", """
SELECT db_id, table_name, column_name, value FROM (SELECT *, count(*) OVER (PARTITION BY db_id, table_name, column_name) AS k FROM cell_values) WHERE k <= 6""", ("cell_values",))
def static_column_samples(spark, sf):
    return R.static_column_samples(view(spark, sf, "cell_values"), 6)


@query("overlap_few_shot", f"""
WITH d AS (SELECT DISTINCT doc_id, unnest({_words('text')}) AS term FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest({_words('text')}) AS term FROM benchmark),
x AS (SELECT query_id, doc_id, count(*)::DOUBLE AS score FROM q JOIN d USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id AS item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 3""")
def overlap_few_shot(spark, sf):
    return R.overlap_few_shot(benchmark(spark, sf).withColumnRenamed("text", "question"), documents(spark, sf).withColumnRenamed("text", "question"), 3)


def vectors(spark, sf, key):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias(key), F.col("embedding").alias("vector"), F.col("label").alias("db_id"), F.col("vec_id").cast("string").alias("question"),
        F.concat(F.lit("select _ from _ where _ "), F.col("vec_id") % 3).alias("skeleton"))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("vector_few_shot_cosine", f"""WITH {EMB},
x AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.label <> b.label)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM x) WHERE rank <= 5""")
def vector_few_shot_cosine(spark, sf):
    return R.vector_few_shot(vectors(spark, sf, "query_id"), vectors(spark, sf, "item_id"), 5, "cosine", cross_domain=True)


@query("vector_few_shot_euclidean", f"""WITH {EMB},
x AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(-list_distance(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM x) WHERE rank <= 5""")
def vector_few_shot_euclidean(spark, sf):
    return R.vector_few_shot(vectors(spark, sf, "query_id"), vectors(spark, sf, "item_id"), 5, "euclidean")


@query("vector_few_shot_skeleton", f"""WITH {EMB},
x AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, a.vec_id % 3 = b.vec_id % 3 AS near, round(list_distance(a.v, b.v), 5) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT query_id, item_id, rank, near, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, d, item_id) AS rank FROM x) WHERE rank <= 4""")
def vector_few_shot_skeleton(spark, sf):
    return R.vector_few_shot_skeleton(vectors(spark, sf, "query_id"), vectors(spark, sf, "item_id"), 4)


@query("vector_threshold_match", f"""WITH {EMB},
x AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label = b.label WHERE list_inner_product(a.v, b.v) > 0.1)
SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM x) WHERE rank <= 15 AND item_id % 2 = 0""")
def vector_threshold_match(spark, sf):
    keys = vectors(spark, sf, "item_id").where("item_id % 2 = 0").select("item_id")
    return R.vector_threshold_match(vectors(spark, sf, "query_id"), vectors(spark, sf, "item_id"), 15, 0.1, keys)


def indexed(spark, sf):
    return vectors(spark, sf, "item_id").select((F.col("item_id") % 2).alias("index_id"), "item_id", "vector")


RET = f"""{EMB},
x AS (SELECT a.vec_id AS query_id, b.vec_id % 2 AS index_id, b.vec_id AS item_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, index_id ORDER BY score DESC, item_id) AS r FROM x)"""


@query("retrieve", f"WITH {RET} SELECT query_id, index_id, item_id, score FROM r WHERE r <= 3")
def retrieve(spark, sf):
    asked_ = vectors(spark, sf, "query_id").select("query_id", F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("index_ids"), "vector")
    return R.retrieve(asked_, indexed(spark, sf), 3)


@query("retrieve_two_turns", f"""WITH {RET}, one AS (SELECT * FROM r WHERE r <= 3),
n AS (SELECT a.vec_id AS query_id, b.vec_id % 2 AS index_id, b.vec_id AS item_id, round(list_cosine_similarity(list_reverse(a.v), b.v), 6) AS score FROM e a, e b),
two AS (SELECT n.*, row_number() OVER (PARTITION BY n.query_id, n.index_id ORDER BY n.score DESC, n.item_id) AS r FROM n LEFT JOIN one USING (query_id, index_id, item_id) WHERE one.r IS NULL)
SELECT query_id, index_id, item_id, score, 0 AS turn_n FROM one UNION ALL SELECT query_id, index_id, item_id, score, 1 FROM two WHERE r <= 3""")
def retrieve_two_turns(spark, sf):
    first = vectors(spark, sf, "query_id").select("query_id", F.array(F.lit(0), F.lit(1)).cast("array<bigint>").alias("index_ids"), "vector")
    return R.retrieve_two_turns(first, first.withColumn("vector", F.reverse("vector")), indexed(spark, sf), 3)


@query("jaccard_pairs", """
WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS a, list_distinct(string_split(p_type || ' ' || p_brand, ' ')) AS b FROM part)
SELECT p_partkey AS query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM p""")
def jaccard_pairs(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("query_id"), F.round(jaccard(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")), 6).alias("similarity"))


@query("example_quality", """
WITH l AS (SELECT l_orderkey AS query_id, string_split(a.p_name || ' ' || a.p_type, ' ') AS a, ['small', 'ring', 'ECONOMY'] AS b FROM lineitem JOIN part a ON a.p_partkey = l_partkey)
SELECT query_id, round(avg(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))), 6) AS quality FROM l GROUP BY 1""")
def example_quality(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("skeleton_a"))
    pairs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_partkey").join(part, "l_partkey").withColumn("skeleton_b", F.lit("small ring ECONOMY"))
    return rounded(R.example_quality(pairs))


def shown(spark, sf):
    line = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank")).agg(F.min("l_partkey").alias("p_partkey"))
    return line.join(table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text")), "p_partkey").drop("p_partkey")


SHOWN = """s AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1, 2),
h AS (SELECT query_id, rank, p_name || ' ' || p_type AS text FROM s JOIN part USING (p_partkey))"""


@query("few_shot_context", f"WITH {SHOWN} SELECT query_id, string_agg('-- Example ' || rank || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY 1")
def few_shot_context(spark, sf):
    return R.few_shot_context(shown(spark, sf))


@query("pack_examples", f"""WITH {SHOWN}, u AS (SELECT query_id, rank, len(string_split(text, ' ')) AS tokens FROM h),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) + 2 AS used FROM u)
SELECT query_id, rank, CAST(used AS BIGINT) AS used FROM r WHERE used <= 9""")
def pack_examples(spark, sf):
    return R.pack_examples(shown(spark, sf), 9, 2).select("query_id", "rank", "used")

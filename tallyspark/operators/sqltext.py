"""Lexical facts about SQL text, computed with regular expressions over columns.

The grammar covered is the flat statement ``SELECT … FROM … [WHERE] [GROUP BY]
[HAVING] [ORDER BY] [LIMIT]`` with joins.  Strings and comments never count as
keywords, whatever they hold; parentheses nest to any depth.  Nested queries are
counted but not decomposed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.stats import ratio
from tallyspark.metrics import COMPONENTS

# The sixteen features and the pattern counted for each.
FEATURE_PATTERNS = {
    "group_by": r"\bgroup\s+by\b",
    "order_by": r"\border\s+by\b",
    "limit": r"\blimit\b",
    "join": r"\bjoin\b",
    "predicate": r"<=|>=|<>|!=|=|<|>|\blike\b|\bin\s*\(|\bbetween\b|\bis\b|\bexists\b",
    "aggregation": r"\b(?:count|sum|avg|max|min)\s*\(",
    "scalar_function": r"\b(?:abs|length|cast|round|upper|lower|rand|random|strftime|juliaday|now|instr|substr)\s*\(",
    "subquery": r"\(\s*select\b",
    "set_operation": r"\b(?:union|intersect|except)\b",
    "math_compute": r"[\w)]\s*[-+*/%]\s*(?=[\w(])",
    "distinct": r"\bdistinct\b",
    "like": r"\blike\b",
    "control_flow": r"\bcase\b|\biif\s*\(",
    "window": r"\bover\s*\(",
}
FEATURES = (
    "query_fields", "group_by", "order_by", "limit", "join", "predicate", "aggregation", "scalar_function", "subquery",
    "set_operation", "math_compute", "logical_connector", "distinct", "like", "control_flow", "window",
)
KEYWORDS = {
    "DISTINCT": r"\bdistinct\b", "LIKE": r"\blike\b", "BETWEEN": r"\bbetween\b", "IN": r"\bin\s*\(",
    "IS": r"\bis\b", "EXISTS": r"\bexists\b", "ANY": r"\bany\b", "ALL": r"\ball\b",
}


TOKEN = r"""'[^']*(?:''[^']*)*'|"[^"]*(?:""[^"]*)*"|--[^\n]*|/\*[\s\S]*?\*/|[^'"/-]+|[\s\S]"""
INNER_BLANK, INNER_COMMA = "\u0001", "\u0002"


def _quiet(sql: Column) -> Column:
    """Lower-case text without comments; a string literal is its value as hexadecimal digits in single quotes.

    Strings and comments are found in one pass, so neither is looked for inside the other; a doubled quote is one quote.
    """
    def token(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        value = F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.concat(quote, quote), quote)
        literal = F.concat(F.lit("'"), F.hex(F.encode(value, "UTF-8")), F.lit("'"))
        string = quote.isin("'", '"') & (F.length(t) > 1)
        return F.when(string, literal).when(t.startswith("--") | t.startswith("/*"), " ").otherwise(F.lower(t))

    plain = F.array_join(F.transform(F.regexp_extract_all(sql, F.lit(TOKEN), 0), token), "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[;\s]+$", "")


def _value(digits: Column) -> Column:
    return F.decode(F.unhex(digits), "UTF-8")


def _restored(text: Column) -> Column:
    """Text with the values of its literals, and with what stands in parentheses readable again."""
    quote = F.lit("'")
    parts = F.transform(F.split(text, "'"), lambda x, i: F.when(i % 2 == 1, F.concat(quote, F.replace(_value(x), quote, F.lit("''")), quote)).otherwise(x))
    return _readable(F.array_join(parts, ""))


def _readable(text: Column) -> Column:
    return F.translate(text, INNER_BLANK + INNER_COMMA, " ,")


def _levels(text: Column) -> Column:
    """Struct of two texts whose blanks and commas inside parentheses are replaced, to any depth: ``all``, and ``top`` without subqueries.

    What splits at blanks, commas and keywords between blanks then sees the outermost level only.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("sub"), F.lit("").alias("all"), F.lit("").alias("top"))

    def step(acc: Column, t: Column) -> Column:
        depth, opens, closes = acc["depth"], t == "(", t == ")"
        sub = F.when((acc["sub"] == 0) & (depth > 0) & t.rlike(r"^\s*select\b"), depth).otherwise(acc["sub"])
        shown = F.when(depth > 0, F.translate(t, " ,", INNER_BLANK + INNER_COMMA)).otherwise(t)
        ends = closes & (depth == sub)
        return F.struct(
            F.greatest(depth + opens.cast("int") - closes.cast("int"), F.lit(0)).alias("depth"), F.when(ends, 0).otherwise(sub).alias("sub"),
            F.concat(acc["all"], shown).alias("all"), F.when((sub == 0) | ends, F.concat(acc["top"], shown)).otherwise(acc["top"]).alias("top"))

    folded = F.aggregate(F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), 0), start, step)
    flat = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("sub"), text.alias("all"), text.alias("top"))
    return F.when(text.contains("("), folded).otherwise(flat)  # without an opening bracket every text is its outermost level


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("int")


def sql_text_features(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    """Add the sixteen counts as a struct; all −1 when there is no SQL."""
    text = F.col("_q")
    bare = F.regexp_replace(text, r"\bselect\s+(?:distinct\s+)?\*", "select")
    fields = F.regexp_extract(F.col("_top"), r"^\s*select\s+(.*?)(?:\sfrom\s|$)", 1)
    counts = {name: _count(bare if name == "math_compute" else text, p) for name, p in FEATURE_PATTERNS.items()}
    counts["query_fields"] = F.when(F.trim(fields) != "", F.size(F.split(fields, ","))).otherwise(0)
    counts["logical_connector"] = _count(text, r"\b(?:and|or)\b") - _count(text, r"\bbetween\b")
    missing = F.col("_q").isNull() | (F.col("_q") == "")
    struct = F.struct(*[F.when(missing, -1).otherwise(counts[f]).cast("int").alias(f) for f in FEATURES])
    outer = F.regexp_replace("_q", r"^[\s(]+(?=select\b)", "")
    return df.withColumn("_q", _quiet(F.col(column))).withColumn("_top", _levels(outer)["all"]).withColumn(out, struct).drop("_q", "_top")


def hardness(features: str) -> Column:
    """easy / medium / hard / extra; NULL when the SQL could not be read."""
    f = {name: F.col(f"{features}.{name}") for name in FEATURES}

    def total(*conditions: Column) -> Column:
        result = F.lit(0)
        for c in conditions:
            result = result + c.cast("int")
        return result

    shape = total(*[f[n] > 0 for n in ("predicate", "group_by", "order_by", "limit", "join", "logical_connector", "like")])
    nested = f["subquery"] + f["set_operation"]
    others = total(*[f[n] > 1 for n in ("aggregation", "query_fields", "predicate", "group_by")])
    return F.when(f["query_fields"] >= 0, (
        F.when((shape <= 2) & (nested == 0), "easy")
        .when(((shape <= 2) & (others < 2)) | ((shape <= 1) & (others <= 2)), "medium")
        .when((shape <= 3) | (nested <= 1), "hard").otherwise("extra")
    ))


def feature_delta(gold: str, pred: str) -> Column:
    """Predicted minus gold per feature; NULL when either side is unreadable."""
    known = (F.col(f"{gold}.query_fields") >= 0) & (F.col(f"{pred}.query_fields") >= 0)
    return F.when(known, F.struct(*[(F.col(f"{pred}.{n}") - F.col(f"{gold}.{n}")).alias(f"delta_{n}") for n in FEATURES]))


def _clause(start: str, stops: tuple[str, ...]) -> Column:
    end = "|".join(rf"\s{s}\s" for s in stops)
    return F.regexp_extract(F.col("_q"), rf"\s{start}\s+(.*?)(?:{end}|\s(?:union|intersect|except)\s|$)", 1)


_STOPS = ("where", r"group\s+by", "having", r"order\s+by", "limit")


def _list(text: Column) -> Column:
    """Split at top-level commas, dropping empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _cut(text: Column, limit: int) -> Column:
    """A long text as its beginning and a digest of the whole, so that texts that differ later stay different."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("#"), F.substring(F.md5(text), 1, 8))).otherwise(text)


def _bare(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(reference, "`", ""), r"^.*\.", "")


def _name(expr: Column) -> Column:
    """Column name of a plain reference; NULL for a literal; the text (cut at 80) of anything else."""
    literal = expr.rlike(r"^'[0-9A-F]*'$|^-?\d+(?:\.\d+)?$")
    return F.when(literal, F.lit(None)).when(expr.rlike(r"^[\w`.]+$"), _bare(expr)).otherwise(_cut(F.lower(_restored(expr)), 80))


def _names(items: Column) -> Column:
    return F.array_compact(F.transform(items, _name))


def _conditions(text: Column) -> Column:
    """The conditions of an AND chain; with an OR on the same level the whole text is one condition."""
    joined = F.regexp_replace(text, r"(\bbetween\s+\S+)\s+and\s+", "$1 ~ ")
    parts = F.when(text.rlike(r"\sor\s"), F.array(text)).otherwise(F.split(joined, r"\s+and\s+"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def _repr(c: Column) -> Column:
    """Comparable text of one condition; literal values are kept behind ``VAL:``.

    A comparison needs a column or a function call on its left; OR, NOT and everything else is its own text.
    """
    comparison = r"^([\w`.]+|\w+\(.*?\))\s*(<=|>=|<>|!=|=|<|>)\s*(.+)$"
    op = F.regexp_replace(F.regexp_extract(c, comparison, 2), "<>", "!=")
    right = F.regexp_extract(c, comparison, 3)
    value = F.when(right.rlike(r"^'[0-9A-F]*'$"), _value(F.replace(right, F.lit("'"), F.lit("")))).when(right.rlike(r"^\d+(?:\.\d+)?$"), right)
    compared = F.concat_ws(" ", _name(F.regexp_extract(c, comparison, 1)), op, F.when(value.isNotNull(), F.concat(F.lit("VAL:"), value)).otherwise("COL"))
    subject = _bare(F.regexp_extract(c, r"^([\w`.]+)\s", 1))
    whole = _cut(F.lower(_restored(F.regexp_replace(c, r" ~ ", " and "))), 60)
    result = F.when(c.rlike(r"\s(?:or|and)\s|^not\s"), whole).when(c.rlike(r"^exists\b"), F.lit("EXISTS"))
    for word, pattern in (("IN", r"^[\w`.]+\s+in\s*\("), ("LIKE", r"^[\w`.]+\s+like\s"),
                          ("BETWEEN", r"^[\w`.]+\s+between\s"), ("IS", r"^[\w`.]+\s+is\s+(?!not\s)")):
        result = result.when(c.rlike(pattern), F.concat(subject, F.lit(f" {word}")))
    return result.when(c.rlike(comparison), compared).otherwise(whole)


def sql_components(df: DataFrame, column: str, prefix: str = "c_") -> DataFrame:
    """Add the seven component sets as arrays ``<prefix>select`` … ``<prefix>keywords``."""
    work = df.withColumn("_raw", F.concat(F.lit(" "), _quiet(F.col(column)))).withColumn("_level", _levels(F.col("_raw")))
    work = work.withColumn("_q", F.col("_level.all"))
    select = F.regexp_extract("_q", r"^\s*select\s+(?:distinct\s+)?(.*?)(?:\sfrom\s|$)", 1)
    source = _clause("from", _STOPS)
    where, having = _clause("where", _STOPS[1:]), _clause("having", _STOPS[3:])
    group, order = _clause(r"group\s+by", _STOPS[2:]), _clause(r"order\s+by", _STOPS[4:])
    tables = F.transform(
        F.split(source, r"\s+(?:(?:inner|left|right|full|outer|cross)\s+)*join\s+|\s*,\s*"),
        lambda x: F.when(x.rlike(r"^\s*\("), F.concat(F.lit("SUBQ:"), F.regexp_replace(F.regexp_extract(x, r"\)\s*(?:as\s+)?(\w*)\s*(?:on\s.*)?$", 1), "^$", "anon")))
        .otherwise(F.regexp_replace(F.regexp_extract(x, r"^\s*([\w`.]+)", 1), "`", "")),
    )
    on = F.flatten(F.transform(
        F.regexp_extract_all(source, F.lit(r"\son\s+(.*?)(?=\s(?:inner|left|right|full|outer|cross|join)\s|$)"), 1), _conditions))
    checks = F.concat(_conditions(where), _conditions(having), on)
    nested = F.transform(F.regexp_extract_all("_raw", F.lit(r"\(\s*select\s+([\w`.*]+)"), 1), lambda x: F.concat(F.lit("SUBQ:"), _name(x)))
    sets = F.transform(F.regexp_extract_all("_raw", F.lit(r"\b(union|intersect|except)\b"), 1), lambda x: F.concat(F.lit("SETOP:"), F.initcap(x)))
    order_cols = F.transform(_list(order), lambda x: F.regexp_replace(x, r"\s+(?:asc|desc)$", ""))
    parts = {
        "select": F.filter(_names(_list(select)), lambda x: x != "*"),
        "where": F.transform(checks, _repr),
        "group": F.concat(_names(_list(group)), F.when(F.trim(having) != "", F.array(F.concat(F.lit("HAVING:"), _repr(F.regexp_replace(
            F.trim(having), r"(\bbetween\s+\S+)\s+and\s+", "$1 ~ "))))).otherwise(F.array().cast("array<string>"))),
        "order": F.concat(_names(order_cols), F.when(F.col("_raw").rlike(r"\slimit\s"), F.array(F.lit("__LIMIT__"))).otherwise(F.array().cast("array<string>"))),
        "join": F.filter(tables, lambda x: x != ""),
        "iuen": F.concat(nested, sets),
        "keywords": F.array_compact(F.array(*[F.when(_readable(F.col("_level.top")).rlike(p), k) for k, p in KEYWORDS.items()])),
    }
    for name in COMPONENTS:
        work = work.withColumn(f"{prefix}{name}", F.array_sort(F.array_distinct(parts[name])))
    return work.drop("_q", "_raw", "_level")


def exact_match(gold: str = "g_", pred: str = "p_") -> Column:
    """1 when all seven component sets agree, NULL when either SQL is missing."""
    known, same = F.lit(True), F.lit(True)
    for name in COMPONENTS:
        g, p = F.col(f"{gold}{name}"), F.col(f"{pred}{name}")
        known = known & g.isNotNull() & p.isNotNull()
        same = same & (F.size(F.array_except(g, p)) == 0) & (F.size(F.array_except(p, g)) == 0)
    return F.when(known, same.cast("int"))


def set_scores(gold: Column, pred: Column) -> Column:
    """Struct of precision, recall and F1; two empty sets agree fully."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(g, p))
    empty = (F.size(g) == 0) & (F.size(p) == 0)
    one = F.lit(1.0)
    precision = F.when(empty, one).otherwise(F.coalesce(ratio(both, F.size(p)), F.lit(0.0)))
    recall = F.when(empty, one).otherwise(F.coalesce(ratio(both, F.size(g)), F.lit(0.0)))
    f1 = F.when(empty, one).otherwise(F.coalesce(ratio(2.0 * both, F.size(g) + F.size(p)), F.lit(0.0)))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def component_f1(gold: str = "g_", pred: str = "p_") -> Column:
    """Struct ``cf1_select`` … of F1 per component."""
    return F.struct(*[set_scores(F.col(f"{gold}{n}"), F.col(f"{pred}{n}"))["f1"].alias(f"cf1_{n}") for n in COMPONENTS])


def where_conditions(df: DataFrame, column: str, key: str = "instance_id") -> DataFrame:
    """One row per comparison of a column in WHERE: table, column, operator, value."""
    work = df.withColumn("_q", _levels(F.concat(F.lit(" "), _quiet(F.col(column))))["all"])
    items = F.split(F.regexp_replace(_clause("where", _STOPS[1:]), r"(\bbetween\s+\S+)\s+and\s+", "$1 ~ "), r"\s+(?:and|or)\s+")
    pattern = r"^\s*(?:([\w`]+)\.)?([\w`]+)\s*(<=|>=|<>|!=|=|<|>)\s*(.+?)\s*$"
    rows = work.select(key, F.explode(items).alias("_c")).where(F.col("_c").rlike(pattern))
    right = F.regexp_extract("_c", pattern, 4)
    value = F.when(right.rlike(r"^'[0-9A-F]*'$"), _value(F.replace(right, F.lit("'"), F.lit("")))).otherwise(_restored(right))
    return rows.select(
        key, F.regexp_replace(F.regexp_extract("_c", pattern, 1), "`", "").alias("table_name"),
        F.regexp_replace(F.regexp_extract("_c", pattern, 2), "`", "").alias("column_name"),
        F.regexp_replace(F.regexp_extract("_c", pattern, 3), "<>", "!=").alias("op"), value.alias("value"),
    )


# Fixed values of the answerability profile: a frozen clock.
NOW = "2100-12-31 23:59:00"
TODAY = "2100-12-31"
CLOCK = "23:59:00"
VALUE_RANGES = {
    "temperature": (35.5, 38.1),
    "sao2": (95.0, 100.0),
    "heart rate": (60.0, 100.0),
    "respiration": (12.0, 18.0),
    "systolic bp": (90.0, 120.0),
    "diastolic bp": (60.0, 90.0),
    "mean bp": (60.0, 110.0),
}


def _bind(value: Column, use) -> Column:
    """Apply ``use`` to a value that is computed once, however often it is referenced."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _operators(sql: Column) -> Column:
    for spaced, tight in (("> =", ">="), ("< =", "<="), ("! =", "!=")):
        sql = F.replace(sql, F.lit(spaced), F.lit(tight))
    return sql


def _fences(sql: Column) -> Column:
    for noise, instead in (("\\n", " "), ("\n", " "), ("```", ""), ("sql", "")):
        sql = F.replace(sql, F.lit(noise), F.lit(instead))
    return F.trim(sql)


def _extracted(sql: Column) -> Column:
    """SQL statement inside a model reply: fenced block, from WITH/SELECT to the first semicolon."""
    fence = F.regexp_extract(sql, r"(?i)```(?:sql|sqlite)?\s*([\s\S]*?)```", 1)
    body = F.trim(F.when(fence != "", fence).otherwise(sql))
    start = F.regexp_extract(body, r"(?i)(\b(?:with|select)\b[^;]*)", 1)
    return F.trim(F.regexp_replace(F.when(start != "", start).otherwise(body), r";+\s*$", ""))


def _interval(sql: Column) -> Column:
    pattern = r"(?i)(\(\s*SELECT\s+MAX\([^)]*\)\s+FROM\s+`?\w+`?\s*\))\s*-\s*INTERVAL\s+'(\d+)'\s+"
    for unit in ("year", "month", "day"):
        sql = F.regexp_replace(sql, pattern + unit.upper(), f"date($1, '-$2 {unit}')")
    return sql


def _frozen_clock(sql: Column, ranges: dict[str, tuple[float, float]]) -> Column:
    text = _operators(F.trim(F.regexp_replace(F.replace(sql, F.lit("\n"), F.lit(" ")), " +", " ")))
    for name, sign in (("DATE_SUB", "-"), ("DATE_ADD", "+")):
        for unit in ("month", "year", "day"):
            call = rf"{name}\((\w+\(\)|'[^']+')[, ]+ INTERVAL "
            text = F.regexp_replace(text, call + rf"1 {unit.upper()}\)", f"datetime($1, '{sign}1 {unit}')")
            text = F.regexp_replace(text, call + rf"(\d+) {unit.upper()}\)", f"datetime($1, '{sign}$2 {unit}s')")
    for word, value in (("current_time", NOW), ("current_date", TODAY), ("'now'", NOW), ("NOW()", NOW), ("CURDATE()", TODAY), ("CURTIME()", CLOCK)):
        text = F.replace(text, F.lit(word), F.lit(f"'{value}'"))
    for name, (low, high) in ranges.items():
        key = name.replace(" ", "_")

        def bounded(t: Column) -> Column:
            both = t.rlike(rf"\s{key}_lower\b") & t.rlike(rf"\s{key}_upper\b")  # noqa: B023 - used at once
            bound = F.regexp_replace(F.regexp_replace(t, rf"\b{key}_lower\b", str(low)), rf"\b{key}_upper\b", str(high))  # noqa: B023
            return F.when(both, bound).otherwise(t)

        text = _bind(text, bounded)
    text = F.replace(F.replace(text, F.lit("%y"), F.lit("%Y")), F.lit("%j"), F.lit("%J"))
    return F.when(sql == "null", F.lit("null")).otherwise(text)


def clean_sql(sql: Column, profile: str = "basic", ranges: dict[str, tuple[float, float]] = VALUE_RANGES) -> Column:
    """Clean SQL text by profile.

    ``basic`` drops fences and line breaks; ``operators`` also repairs split
    operators and runs of spaces; ``year`` fixes the current year to 2020;
    ``reply`` extracts a statement from a model reply and rewrites interval
    arithmetic; ``clock`` freezes the clock and resolves named value ranges;
    ``spelling`` repairs doubled equals signs and spaces.
    """
    if profile == "basic":
        return _fences(sql)
    if profile == "operators":
        return _fences(F.regexp_replace(_operators(sql), " {2,}", " "))
    if profile == "year":
        return F.regexp_replace(sql, r"(?i)YEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)\s*", "2020")
    if profile == "reply":
        return _interval(_extracted(sql))
    if profile == "clock":
        return _frozen_clock(sql, ranges)
    if profile == "spelling":
        return F.regexp_replace(F.replace(sql, F.lit("=="), F.lit("=")), " {2,}", " ")
    raise ValueError(f"unknown profile {profile!r}")


def sql_skeleton(df: DataFrame, column: str, tables: str, columns: str, out: str = "skeleton") -> DataFrame:
    """SQL with tables, columns and literals replaced by ``_`` and runs collapsed.

    ``tables`` and ``columns`` name array columns with the catalog's lower-case names.
    """
    text = F.regexp_replace(F.trim(F.regexp_replace(F.col(column), '"', "'")), r"\s*;\s*$", "")
    lowered = F.array_join(
        F.transform(F.split(text, "'"), lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(x)), "'"
    )
    ordered = F.when(
        lowered.contains("order by") & ~lowered.contains("asc") & ~lowered.contains("desc"),
        F.regexp_replace(lowered, r"order by ((?:\w+\s*\([^)]*\)|[\w.]+)(?: [-+<>=]+ [\w.]+)*)", "order by $1 asc"),
    ).otherwise(lowered)
    bare = F.regexp_replace(ordered, r"\s+as\s+\w+", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"'[^']*'|-?\d+\.\d+|[\w.]*\w|<=|>=|!=|<>|[^\s\w]"), 0)

    def mask(token: Column) -> Column:
        last = F.regexp_replace(token, r"^.*\.", "")
        name = F.array_contains(F.col(tables), token) | F.array_contains(F.col(columns), last) | (token == "*")
        return F.when(name | token.rlike(r"^'.*'$|^-?\d+(?:\.\d+)?$"), F.lit("_")).otherwise(token)

    skeleton = F.array_join(F.transform(tokens, mask), " ")
    for pattern, instead in (
        (r"on _ = _(?: (?:and|or) _ = _)+", "on _ = _"), (r" on _ = _", ""), (r"_ (?:join _ ?)+", "_ "),
        (r"_(?: , _)+", "_"), (r"_ (?:=|!=|>=|<=|>|<) _", "_"), (r"where _(?: (?:and|or) _)+", "where _"),
        (r" {2,}", " "), (r"order by \S+", "order by _"),
    ):
        skeleton = F.regexp_replace(skeleton, pattern, instead)
    return df.withColumn(out, F.trim(skeleton))


def unknown_column_refs(sqls: DataFrame, column: str, catalog: DataFrame, key: str = "instance_id") -> DataFrame:
    """``table.column`` references whose table is known but whose column is not."""
    refs = F.regexp_extract_all(F.col(column), F.lit(r"\b(\w+\.\w+)\b"), 1)
    rows = sqls.select(key, F.explode(F.array_distinct(refs)).alias("ref")).where(~F.col("ref").rlike(r"^\d+\.\d+$"))
    pair = F.split(F.lower("ref"), r"\.")
    rows = rows.withColumn("t", pair[0]).withColumn("c", pair[1])
    known = catalog.select(F.lower("table_name").alias("t"), F.lower("column_name").alias("c")).distinct()
    return rows.join(known.select("t").distinct(), "t", "left_semi").join(known, ["t", "c"], "left_anti").select(key, "ref")


# Phrases in the question, shapes of the SQL, and the weight of each pairing.
DISPLAY = (" name ", " names ", " title ", " titles ", " city ", " cities ", " country ", " countries ", " description ",
           " descriptions ", " detail ", " details ", " maker ", " makers ", " model ", " models ")
IDENTIFIER = (" id ", " ids ", " code ", " codes ", " number ", " numbers ")
NEGATIVE = (" not ", " no ", " without ", " do not ", " does not ", " don't ", " never ")
COUNTING = (" how many ", " number of ", " count of ")
FREQUENT = (" most number of ", " greatest number of ", " largest number of ", " most frequent ", " by their frequency ")
KEY_COLUMNS = r"\b(?:sourceairport|destairport|airportcode|countryid|template_id|template_type_code|student_id|singer_id|visitor_id|owner_id)\b"
UNIQUE = (" distinct ", " different ", " unique ")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: text.contains(p))


def shape_preference(question: Column, sql: Column) -> Column:
    """Sum of weights for SQL shapes that the question's wording suggests."""
    q, s = F.concat(F.lit(" "), F.lower(question), F.lit(" ")), F.concat(F.lit(" "), F.lower(sql), F.lit(" "))
    selected = F.lower(F.trim(F.regexp_extract(F.regexp_replace(sql, r"\s+", " "), r"(?i)\bselect\b(.*?)\bfrom\b", 1)))
    join, nested = s.rlike(r"\bjoin\b"), s.rlike(r"\b(?:in|exists)\s*\(")
    sets, negative = s.rlike(r"\b(?:intersect|except|union)\b"), _any(q, NEGATIVE)
    display = _any(q, DISPLAY)
    naming = display & ~_any(q, IDENTIFIER)
    either, both = q.contains(" or "), q.contains(" both ")
    counting, frequent = _any(q, COUNTING), _any(q, FREQUENT)
    rules = [
        (naming & selected.rlike(KEY_COLUMNS), -3.5),
        (naming & join, 1.0),
        (either & s.rlike(r"\bor\b|\bunion\b"), 3.0),
        (either & s.rlike(r"\bintersect\b"), -4.0),
        (negative & s.rlike(r"\bnot\s+in\b|\bexcept\b"), 2.0),
        (negative & s.rlike(r"\bleft\s+join\b"), -1.5),
        (counting & s.rlike(r"count\s*\(\s*distinct\b") & ~_any(q, UNIQUE), -2.5),
        (counting & s.rlike(r"count\s*\(\s*\*\s*\)"), 1.0),
        (frequent & s.rlike(r"\bgroup\s+by\b") & s.rlike(r"\border\s+by\s+count\s*\("), 2.0),
        (frequent & s.rlike(r"select\s+count\s*\("), -2.0),
        (both & s.rlike(r"\bintersect\b"), 1.5),
        (both & ~s.rlike(r"\bintersect\b") & (nested | join), 0.5),
        (s.rlike(r"\bleft\s+join\b"), -1.0),
        (s.rlike(r"\bright\s+join\b"), -4.0),
        (sets & ~both & ~either & ~negative, -0.8),
        (nested & ~join & display & ~negative, -0.8),
    ]
    score = F.lit(0.0)
    for condition, weight in rules:
        score = score + F.when(condition, weight).otherwise(0.0)
    return score


def literal_preference(question: Column, sql: Column) -> Column:
    """Preference by agreement of the SQL's literals with the question."""
    q, s = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(sql, F.lit("")))
    literals = F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit("'([^']*)'"), 1)
    han = "[\\u4e00-\\u9fff]"
    words = F.regexp_extract_all(q, F.lit("([a-z][a-z0-9]+)"), 1)

    def agrees(x: Column) -> Column:
        low = F.regexp_replace(F.lower(x), "^[% ]+|[% ]+$", "")
        inside = F.regexp_extract_all(low, F.lit("([a-z][a-z0-9]+)"), 1)
        all_words = (F.size(inside) > 0) & (F.size(F.array_except(inside, words)) == 0)
        return ~x.rlike(han) & (((low != "") & (F.instr(q, low) > 0)) | all_words)

    foreign = F.array_join(literals, " ").rlike(han) & ~F.coalesce(question, F.lit("")).rlike(han)
    rules = [
        (foreign, -5.0), (F.exists(literals, agrees), 5.0), (s.contains("select *"), 1.0),
        (s.rlike(r"[<>]=?\s*0\.\d+") & q.contains("%"), -4.0), (s.rlike(r"^\s*select\s*$"), -20.0),
    ]
    score = F.lit(0.0)
    for condition, weight in rules:
        score = score + F.when(condition, weight).otherwise(0.0)
    return score


def links_in_text(texts: DataFrame, catalogs: DataFrame, column: str, key: str = "instance_id") -> DataFrame:
    """Catalog columns named in a text, whole or by one of their words.

    ``catalogs``: ``db_id, links array<table.column>``, one row per database, so
    the join is by database and only matching links are emitted.
    """
    def mentioned(link: Column) -> Column:
        name = F.trim(F.regexp_replace(F.lower(F.regexp_replace(link, r"^[^.]*\.", "")), "`", ""))
        words = F.split(name, "_")
        return (F.instr(F.col("_low"), name) > 0) | F.exists(words, lambda w: F.instr(F.col("_low"), w) > 0)

    joined = texts.select(key, "db_id", F.lower(column).alias("_low")).join(catalogs, "db_id")
    return joined.select(key, F.explode(F.array_distinct(F.filter("links", mentioned))).alias("link"))

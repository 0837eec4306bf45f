"""Lexical, fuzzy and vector retrieval of tables, columns, values and examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.editjoin import edit_join
from tallyspark.functions.postings import top_items
from tallyspark.functions.vectors import VectorIndex, build_index, search
from tallyspark.functions.words import COMMON_TERMS, COMMON_WORDS, STOPWORDS, jaccard, name_tokens, plain_tokens, word_array, words
from tallyspark.session import written

# Lexical weights, gram length, shown matches, thresholds.
LONG_TOKEN_BONUS = 0.35
BASE_SCORE, COLUMN_HIT, TABLE_HIT = 0.01, 2.0, 1.0
MAX_GRAM = 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
LONG_VALUES = 600
VALUE_THETA, VALUE_TOP_K = 0.85, 2
COLUMN_SIMILARITY, COLUMN_TOP_K, KEY_SIMILARITY, KEY_TOP_K = 0.5, 15, 0.65, 10
SKELETON_SIMILARITY = 0.85
PUNCTUATION = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def lexical_score(question_tokens: Column, name_parts: Column, stopwords=()) -> Column:
    """Shared tokens, plus a bonus per long question token inside the compacted name."""
    compact = F.lower(F.regexp_replace(name_parts, "[^A-Za-z0-9]+", ""))
    overlap = F.size(F.array_intersect(name_tokens(name_parts, stopwords), question_tokens))
    inside = F.size(F.filter(question_tokens, lambda t: (F.length(t) > 3) & (F.instr(compact, t) > 0)))
    return overlap + LONG_TOKEN_BONUS * inside


def _supplied(catalog: DataFrame, kind: str) -> Column:
    """The probability that a row of the catalog brings along, under the first of its names that has one."""
    present = [F.col(n).cast("double") for n in (f"{kind}_pred_prob", f"{kind}_pred_probs", f"{kind}_score", f"{kind}_prob") if n in catalog.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def table_catalog(catalog: DataFrame, stopwords=(), abbreviations=None, hints: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per database: nested tables with their columns and tokens, ready for row-local scoring.

    Probabilities of a supplied model (``table_prob``, ``column_prob`` and the like) take the place of lexical scores; a
    table's is the greatest of its rows.
    """
    compact = F.lower(F.regexp_replace(F.concat_ws(" ", "column_name", "column_descriptions"), "[^A-Za-z0-9]+", ""))
    column = F.struct(
        "column_no", "column_name", name_tokens(F.concat_ws(" ", "column_name", "column_descriptions"), stopwords).alias("tokens"),
        compact.alias("compact"), _supplied(catalog, "column").alias("given"),
    )
    hint_map = F.create_map(*[x for t, w in (hints or {}).items() for x in (F.lit(t), word_array(w))]) if hints else None
    hinted = F.coalesce(F.try_element_at(hint_map, F.lower("table_name")), word_array(())) if hint_map is not None else word_array(())
    tables = catalog.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(column)).alias("columns"),
        F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("foreign_key", F.lit(r"\[([A-Za-z_]\w*)\("), 1)))).alias("related"),
        F.max(_supplied(catalog, "table")).alias("given"),
    )
    table = F.struct(
        "table_name", name_tokens(F.col("table_name"), stopwords).alias("tokens"),
        F.array_union(name_tokens(F.col("table_name"), stopwords, abbreviations), hinted).alias("all_tokens"), hinted.alias("hints"),
        F.lower(F.regexp_replace("table_name", "[^A-Za-z0-9]+", "")).alias("compact"), "columns", "related", "given",
    )
    return tables.groupBy("db_id").agg(F.array_sort(F.collect_list(table)).alias("tables"))


_LEX = "(size(array_intersect({x}.tokens, q)) + 0.35D * size(filter(q, w -> length(w) > 3 AND instr({x}.compact, w) > 0)))"


def _with_tables(questions: DataFrame, tables: DataFrame, stopwords) -> DataFrame:
    return questions.select("query_id", "db_id", name_tokens(F.col("question"), stopwords).alias("q")).join(tables, "db_id")


def rank_tables(questions: DataFrame, tables: DataFrame, top_k: int, stopwords=()) -> DataFrame:
    """Best tables per question: the supplied probability, else twice the name score, hints, best column and a quarter of the next two.

    The first k−2 go by score, then related tables with a positive score, then the rest.
    ``tables`` is one row per database (``table_catalog``), so scoring never pairs rows.
    """
    lex_t, lex_c = _LEX.format(x="t"), _LEX.format(x="c")
    scored = F.expr(
        f"transform(tables, (t, i) -> named_struct('o', i, 'name', t.table_name, 'given', t.given, 'related', t.related, 'hit', size(array_intersect(t.all_tokens, q)), "
        f"'base', 2D * {lex_t} + 1.2D * size(array_intersect(t.hints, q)), "
        f"'cols', reverse(array_sort(transform(t.columns, c -> {lex_c})))))"
    )
    total = F.expr(
        "array_sort(transform(scored, s -> named_struct('neg', -round(coalesce(s.given, s.base + coalesce(get(s.cols, 0), 0D) + 0.25D * (coalesce(get(s.cols, 1), 0D) + coalesce(get(s.cols, 2), 0D))), 6), "
        "'o', s.o, 'name', s.name, 'related', s.related, 'hit', s.hit)))"
    )
    primary = top_k if top_k <= 3 else top_k - 2
    related = F.expr(
        "flatten(transform(first, (f, p) -> transform(filter(f.related, r -> NOT exists(first, x -> x.name = r)), r -> named_struct("
        f"'neg', -round(coalesce(get(filter(ranked, x -> x.name = r), 0).hit, 0) + 0.2D * ({primary} - p), 6), "
        "'o', array_position(transform(ranked, x -> x.name), r), 'name', r))))"
    )
    found = F.expr("array_distinct(transform(filter(array_sort(related), r -> r.neg < 0 AND r.o > 0), r -> r.name))")
    names = F.expr("transform(ranked, x -> x.name)")
    ordered = F.array_distinct(F.concat(F.expr("transform(first, f -> f.name)"), F.col("found"), F.col("names")))
    return (
        _with_tables(questions, tables, stopwords).withColumn("scored", scored).withColumn("ranked", total)
        .withColumn("first", F.slice("ranked", 1, primary)).withColumn("related", related).withColumn("found", found)
        .withColumn("names", names)
        .select("query_id", F.posexplode(F.slice(ordered, 1, top_k)).alias("pos", "table_name"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "table_name")
    )


def rank_columns(questions: DataFrame, tables: DataFrame, top_k: int, stopwords=()) -> DataFrame:
    """Best columns per question and table by the supplied probability, else lexically, stable in catalog order."""
    lex_c = _LEX.format(x="c")
    best = F.expr(
        f"transform(tables, t -> named_struct('table_name', t.table_name, 'cols', slice(array_sort(transform(t.columns, c -> named_struct("
        f"'neg', -round(coalesce(c.given, {lex_c}), 6), 'no', c.column_no, 'name', c.column_name))), 1, {int(top_k)})))"
    )
    rows = _with_tables(questions, tables, stopwords).select("query_id", F.explode(best).alias("t"))
    return rows.select("query_id", "t.table_name", F.posexplode("t.cols").alias("pos", "c")).select(
        "query_id", "table_name", (F.col("pos") + 1).alias("rank"), F.col("c.name").alias("column_name"), (-F.col("c.neg") + F.lit(0.0)).alias("score"))


def normalized_scores(questions: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Column scores (base, overlap, column and table hits) and their share of the question's maximum.

    ``catalogs``: ``db_id, columns array<struct<table_name, column_name, haystack>>``.
    """
    # Column tokens are cut once per database, before any question meets them.
    cut = F.transform("columns", lambda c: F.struct(
        c["table_name"].alias("table_name"), c["column_name"].alias("column_name"), F.lower(c["table_name"]).alias("t"),
        F.lower(c["column_name"]).alias("c"), plain_tokens(c["haystack"]).alias("tokens")))
    prepared = catalogs.select("db_id", cut.alias("columns"))
    asked = questions.select("query_id", "db_id", F.lower("question").alias("_t"), plain_tokens(F.col("question")).alias("_q")).join(prepared, "db_id")

    def score(c: Column) -> Column:
        return (
            BASE_SCORE + F.size(F.array_intersect(c["tokens"], F.col("_q")))
            + F.when(F.instr(F.col("_t"), c["c"]) > 0, COLUMN_HIT).otherwise(0.0)
            + F.when(F.instr(F.col("_t"), c["t"]) > 0, TABLE_HIT).otherwise(0.0))

    scored = F.transform("columns", lambda c: F.struct(c["table_name"].alias("table_name"), c["column_name"].alias("column_name"), score(c).alias("score")))
    rows = asked.select("query_id", scored.alias("s")).withColumn("top", F.array_max(F.transform("s", lambda x: x["score"])))
    return rows.select("query_id", "top", F.explode("s").alias("c")).select(
        "query_id", "c.*", F.round(F.col("c.score") / F.col("top"), 4).alias("prob"))


def ranked_schema(questions: DataFrame, catalogs: DataFrame, top_tables: int, top_columns: int) -> DataFrame:
    """Top tables by their best column, and the top columns of each."""
    scores = normalized_scores(questions, catalogs)
    by_column = Window.partitionBy("query_id", "table_name").orderBy(F.desc("score"), "column_name")
    columns = scores.withColumn("column_rank", F.row_number().over(by_column)).where(F.col("column_rank") <= top_columns)
    tables = scores.groupBy("query_id", "table_name").agg(F.max("score").alias("table_score"))
    by_table = Window.partitionBy("query_id").orderBy(F.desc("table_score"), "table_name")
    tables = tables.withColumn("table_rank", F.row_number().over(by_table)).where(F.col("table_rank") <= top_tables)
    return columns.join(tables, ["query_id", "table_name"]).select("query_id", "table_name", "column_name", "table_rank", "column_rank")


def question_grams(questions: DataFrame, max_n: int | str = MAX_GRAM) -> DataFrame:
    """Word n-grams with their positions: ``query_id, db_id, pos, n, gram``.  ``max_n`` is a number or a column of ``questions``."""
    grams = F.expr(
        f"flatten(transform(sequence(1, least({max_n}, size(_w))), n -> transform(sequence(0, size(_w) - n), i -> "
        "struct(i AS pos, n AS n, array_join(slice(_w, i + 1, n), ' ') AS gram))))")
    keep = [c for c in ("query_id", "db_id") if c in questions.columns]
    return questions.withColumn("_w", words(F.col("question"))).where(F.size("_w") > 0).select(*keep, F.explode(grams).alias("g")).select(*keep, "g.*")


def boundary_stretches(text: Column) -> Column:
    """All stretches of a text from one word boundary to another that have at most ``MAX_GRAM`` words between blanks.

    Runs of word characters and of others take turns, and a boundary stands between two runs; a run of others at either
    end of the text has none outside.
    """
    inner = F.regexp_replace(text, r"(?U)^\W+|\W+$", "")
    runs = F.regexp_extract_all(inner, F.lit(r"(?U)\w+|\W+"), F.lit(0))

    def from_run(_run: Column, i: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.size(runs) - i)
        return F.transform(sizes, lambda n: F.array_join(F.slice(runs, i + 1, n), ""))

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, from_run)), lambda x: F.size(F.split(x, " ")) <= MAX_GRAM))


def ngram_link(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Question positions that match a table or column name: whole name, or a part of it between word boundaries.

    ``names``: ``db_id, kind ('col' or 'tab'), item, name``.  Names are cut at
    all word boundaries ("free" is part of "Free-Meal Count"), so both kinds of
    match are one equi-join.  Both sides grow by an explode that the planner's
    sizes do not count, so neither is broadcast.
    """
    spaced = names.select("db_id", "kind", "item", F.array_join(F.filter(F.split(F.lower("name"), r"[\s_]+"), lambda t: t != ""), " ").alias("_y"))
    parts = F.transform(F.filter(boundary_stretches(F.col("_y")), lambda x: x != F.col("_y")), lambda x: F.struct(x.alias("gram"), F.lit(False).alias("whole")))
    entries = F.concat(F.array(F.struct(F.col("_y").alias("gram"), F.lit(True).alias("whole"))), parts)
    index = spaced.where(F.col("_y") != "").select("db_id", "kind", "item", F.explode(entries).alias("r")).select("db_id", "kind", "item", "r.*")
    noise = (*STOPWORDS, *PUNCTUATION)
    hits = question_grams(questions).join(index.hint("merge"), ["db_id", "gram"]).where(F.col("whole") | ~F.col("gram").isin(*noise))
    spread = hits.select("query_id", "kind", "item", "whole", F.explode(F.expr("sequence(pos, pos + n - 1)")).alias("pos"))
    flagged = spread.groupBy("query_id", "pos", "kind", "item").agg(F.bool_or("whole").alias("exact"))
    flag = F.concat(F.when(F.col("kind") == "col", "C").otherwise("T"), F.when(F.col("exact"), "EM").otherwise("PM"))
    return flagged.select("query_id", "pos", "kind", "item", flag.alias("flag"))


def resolve_overlaps(matches: DataFrame) -> DataFrame:
    """Choose matches per question: positions with fewest matches first, reusing items chosen before.

    A question's matches are one array; it is as long as the question has words
    times the names they hit.
    """
    per_pos = matches.groupBy("query_id", "pos").agg(F.array_sort(F.collect_set(F.struct("flag", "kind", "item"))).alias("m"))
    ordered = per_pos.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.size("m").alias("n"), "pos", "m"))).alias("ps"))
    kind = "array<struct<flag: string, kind: string, item: string>>"
    chosen = F.expr(
        f"aggregate(ps, struct(CAST(array() AS {kind}) AS taken, CAST(array() AS array<struct<pos: int, m: {kind}>>) AS res), (acc, p) -> struct("
        "concat(acc.taken, CASE WHEN size(array_intersect(acc.taken, p.m)) > 0 THEN array() "
        "WHEN exists(p.m, x -> x.flag IN ('CEM', 'TEM')) THEN filter(p.m, x -> x.flag IN ('CEM', 'TEM')) ELSE p.m END) AS taken, "
        "concat(acc.res, array(struct(p.pos AS pos, CASE WHEN size(array_intersect(acc.taken, p.m)) > 0 THEN array_intersect(acc.taken, p.m) "
        "WHEN exists(p.m, x -> x.flag IN ('CEM', 'TEM')) THEN filter(p.m, x -> x.flag IN ('CEM', 'TEM')) ELSE p.m END AS m))) AS res)).res")
    ordered = ordered.withColumn("ps", F.expr("transform(ps, p -> struct(CAST(p.n AS INT) AS n, CAST(p.pos AS INT) AS pos, p.m AS m))"))
    return ordered.select("query_id", F.explode(chosen).alias("r")).select("query_id", "r.pos", F.explode("r.m").alias("x")).select("query_id", "pos", "x.*")


def drop_linked_cells(cells: DataFrame, links: DataFrame) -> DataFrame:
    """Cell matches on words that are not already linked to a name."""
    return cells.join(links.select("query_id", "pos").distinct(), ["query_id", "pos"], "left_anti")


def mask_question(questions: DataFrame, mask: str = "<mask>", value: str = "<unk>") -> DataFrame:
    """Replace linked words by a mask and value words by a tag.

    Reads ``question, schema_pos array<int>, value_pos array<int>``.
    """
    tokens = F.split("question", r"\s+")
    masked = F.transform(tokens, lambda t, i: F.when(F.array_contains("schema_pos", i), F.lit(mask)).when(
        F.array_contains("value_pos", i), F.lit(value)).otherwise(t))
    return questions.withColumn("masked", F.array_join(masked, " "))


def tag_links(questions: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Serialised link line: columns and tables tagged by match (EM, PA) or key (RK, FO).

    ``catalogs``: ``db_id, tables array<string>, columns array<struct<table_name,
    column_name, type, pk, fk>>, fk_pairs array<string>``.
    """
    tokens = F.col("_w")

    def part(name: Column) -> Column:
        return F.exists(F.split(F.regexp_replace(name, "_", " "), r"\s+"), lambda w: (F.length(w) > 2) & F.array_contains(tokens, w))

    def column_tag(c: Column) -> Column:
        t, n = F.lower(c["table_name"]), F.lower(c["column_name"])
        exact = F.array_contains(tokens, F.concat_ws("@", t, n)) | F.array_contains(tokens, n) | F.array_contains(tokens, t)
        return F.when(exact, "EM").when(part(n) | part(t), "PA").when(c["pk"], "RK").when(c["fk"], "FO")

    def column_text(c: Column) -> Column:
        return F.concat_ws(" ", column_tag(c), c["type"], F.concat_ws("@", F.lower(c["table_name"]), F.lower(c["column_name"])))

    def table_text(t: Column) -> Column:
        low = F.lower(t)
        return F.concat_ws(" ", F.when(F.array_contains(tokens, low), "EM").when(part(low), "PA"), low)

    rows = questions.select("query_id", "db_id", "question", words(F.col("question")).alias("_w")).join(catalogs, "db_id")
    line = F.concat(
        F.lit("<C> "), F.array_join(F.concat(F.array(F.lit("text *")), F.transform("columns", column_text)), " | "),
        F.lit(" | <T> "), F.array_join(F.transform("tables", table_text), " | "),
        F.when(F.size("fk_pairs") > 0, F.concat(F.lit(" | <S> "), F.array_join("fk_pairs", " | "))).otherwise(" | <S>"),
        F.lit(" | <Q> "), F.col("question"))
    return rows.select("query_id", line.alias("line"))


def cell_value_link(questions: DataFrame, values: DataFrame) -> DataFrame:
    """Runs of question words that appear as whole words of a column's cells.

    A run is exact when its words joined equal a cell, else partial; one row per
    word of the run.  ``values``: ``db_id, table_name, column_name, value``; a
    question meets the cells of its own database only.
    """
    noise = (*STOPWORDS, *PUNCTUATION)
    tokens = questions.select("query_id", "db_id", F.posexplode(words(F.col("question"))).alias("pos", "word")).where(
        ~F.col("word").isin(*noise) & F.col("word").try_cast("double").isNull())
    distinct = values.select("db_id", "table_name", "column_name", F.lower(F.trim("value")).alias("cell")).distinct()
    cell_words = distinct.select("db_id", "table_name", "column_name", F.explode(F.split("cell", r"\s+")).alias("word")).distinct()
    hits = tokens.join(cell_words, ["db_id", "word"])
    keys = ["query_id", "db_id", "table_name", "column_name"]
    islands = hits.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    runs = islands.groupBy(*keys, "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("stop"),
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word")))["word"], " ").alias("cell"))
    known = distinct.withColumn("exact", F.lit(True))
    flagged = runs.join(known, ["db_id", "table_name", "column_name", "cell"], "left")
    flag = F.when(F.col("exact"), "EXACTMATCH").otherwise("PARTIALMATCH")
    return flagged.select("query_id", "table_name", "column_name", flag.alias("flag"), F.explode(F.sequence("start", "stop")).alias("pos"))


def numeric_tokens(questions: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Number words with the database's numeric and time columns.

    ``catalogs``: ``db_id, number_columns array, time_columns array``.
    """
    tokens = questions.select("query_id", "db_id", F.posexplode(words(F.col("question"))).alias("pos", "word")).where(
        F.col("word").try_cast("double").isNotNull())
    return tokens.join(catalogs, "db_id").select("query_id", "pos", "word", "number_columns", "time_columns")


def fuzzy_value_match(questions: DataFrame, values: DataFrame, theta: float = VALUE_THETA, top_k: int = VALUE_TOP_K) -> DataFrame:
    """Cells of the question's database close to a span of its words, best ``top_k`` per question and column.

    Spans are word n-grams as long as the longest cell of the database; a span
    may drop a possessive ending, and then has to equal the cell.  Stopwords,
    numbers and common terms never match; common words, upper-case cells and
    columns of names only when equal.  ``values``: ``db_id, table_name,
    column_name, value``.
    """
    cells = values.select("db_id", "table_name", "column_name", "value", F.lower(F.trim("value")).alias("cell")).distinct()
    longest = cells.groupBy("db_id").agg(F.max(F.size(F.split("cell", r"\s+"))).alias("_longest"))
    grams = question_grams(questions.select("query_id", "db_id", "question").join(longest, "db_id"), "_longest").select("query_id", "db_id", "gram")
    owned = grams.where(F.col("gram").endswith("'s")).select("query_id", "db_id", F.regexp_replace("gram", "'s$", "").alias("gram"), F.lit(True).alias("owner"))
    spans = grams.withColumn("owner", F.lit(False)).unionByName(owned).groupBy("query_id", "db_id", "gram").agg(F.min("owner").alias("owner"))
    blocked = (*STOPWORDS, *COMMON_TERMS)
    usable = cells.where(~F.col("cell").isin(*blocked) & F.regexp_replace("cell", ",", "").try_cast("double").isNull())
    pairs = edit_join(
        spans.select(F.col("gram").alias("left_text")).distinct().where(~F.col("left_text").isin(*blocked)),
        usable.select(F.col("cell").alias("right_text")).distinct(), theta)
    same_start = F.substring("left_text", 1, 1) == F.substring("right_text", 1, 1)
    exact_only = F.col("left_text").isin(*COMMON_WORDS) | F.col("right_text").isin(*COMMON_WORDS)
    pairs = pairs.where(same_start & ((F.col("ratio") == 1) | ~exact_only))
    hits = (
        spans.join(pairs.select(F.col("left_text").alias("gram"), F.col("right_text").alias("cell"), "ratio"), "gram")
        .join(usable, ["db_id", "cell"])
        .where((F.col("ratio") == 1) | ((F.upper("value") != F.col("value")) & ~F.col("owner") & ~F.col("column_name").contains("name")))
        .groupBy("query_id", "table_name", "column_name", "value").agg(F.max("ratio").alias("score")))
    order = Window.partitionBy("query_id", "table_name", "column_name").orderBy(F.desc("score"), "value")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def nearest_name(names: DataFrame, catalog: DataFrame, cutoff: float = 0.88) -> DataFrame:
    """Closest catalog name of the same database for each misspelt one (edit ratio, ties by name).

    ``names``: ``db_id, name``; ``catalog``: ``db_id, known``.  Names that are known already are left out.
    """
    asked = names.select("db_id", "name").distinct().join(catalog.select("db_id", F.col("known").alias("name")), ["db_id", "name"], "left_anti")
    pairs = edit_join(
        asked.select("db_id", F.lower("name").alias("left_text")),
        catalog.select("db_id", F.lower("known").alias("right_text")), cutoff, ["db_id"])
    best = pairs.groupBy("db_id", "left_text").agg(F.min(F.struct((-F.col("ratio")).alias("neg"), "right_text")).alias("b"))
    spelled = catalog.groupBy("db_id", F.lower("known").alias("_k")).agg(F.min("known").alias("nearest"))
    found = best.select("db_id", F.col("left_text").alias("_l"), F.col("b.right_text").alias("_k"), (-F.col("b.neg")).alias("ratio")).join(spelled, ["db_id", "_k"])
    return asked.withColumn("_l", F.lower("name")).join(found, ["db_id", "_l"]).select("db_id", "name", "nearest", "ratio")


def bm25_postings(corpus: DataFrame, asked: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The asked terms that each document holds, with their Okapi weights: *group, item_id, term, weight.

    ``corpus``: ``item_id, tokens``; ``asked``: ``term``.  Term statistics come
    from map-side combined counts over the whole corpus; rare negative weights
    are floored at a share of the mean inverse document frequency.
    """
    keys = list(group) or ["_g"]
    docs = corpus if group else corpus.withColumn("_g", F.lit(0))
    sized = docs.select(*keys, "item_id", F.size("tokens").alias("dl"), "tokens")
    def one_per_group(summary: DataFrame) -> DataFrame:
        return summary if group else F.broadcast(summary)  # without groups it is a single row

    # A document is one row, so its distinct terms are found before any shuffle; its length goes with the first of them.
    every = sized.select(*keys, "dl", F.posexplode(F.array_distinct("tokens")).alias("pos", "term"))
    counted = written(every.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("pos") == 0, F.col("dl"))).alias("tokens")), "counted")
    sizes = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shape = counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).join(sizes, keys)
    shape = one_per_group(shape.select(*keys, "n", (F.col("tokens") / F.col("n")).alias("avgdl")))
    per_term = counted.select(*keys, "term", "df").join(shape, keys)
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    per_term = per_term.withColumn("raw", raw)
    floor = one_per_group(per_term.groupBy(*keys).agg((F.avg("raw") * BM25_EPSILON).alias("floor")))
    wanted = per_term.join(asked.select("term").distinct(), "term", "left_semi").join(floor, keys).select(
        *keys, "term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    weight = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    occurrences = sized.select(*keys, "item_id", "dl", F.explode("tokens").alias("term")).join(wanted, [*keys, "term"])
    counted = occurrences.groupBy(*keys, "term", "item_id", "dl", "idf", "avgdl").agg(F.count(F.lit(1)).alias("tf"))
    return counted.select(*[k for k in keys if k != "_g"], "item_id", "term", weight.alias("weight"))


def query_terms(queries: DataFrame, column: str = "tokens") -> DataFrame:
    """Distinct terms of each query with their counts as weights, one row each; all columns but the tokens stay."""
    kept = [c for c in queries.columns if c != column]
    return queries.select(*kept, F.explode(column).alias("term")).groupBy(*kept, "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def bm25_top_n(queries: DataFrame, corpus: DataFrame, n: int, group: Sequence[str] = ()) -> DataFrame:
    """Okapi BM25 top n per query.  ``queries``: ``query_id, tokens``; ``corpus``: ``item_id, tokens``.

    Documents without a shared term are not returned.
    """
    asked = queries.select(F.explode("tokens").alias("term"))
    return top_items(query_terms(queries.select("query_id", *group, "tokens")), bm25_postings(corpus, asked, group), n, group)


def _column_sizes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["db_id", "table_name", "column_name"]
    distinct = values.select(*keys, "value").where(F.col("value").isNotNull()).distinct()
    return distinct, distinct.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("value")).alias("len"), F.min("value").alias("first"))


def static_column_samples(values: DataFrame, limit: int) -> DataFrame:
    """Values that every question is shown: all of a small column, the first of a column of very long values."""
    distinct, sizes = _column_sizes(values)
    keys = ["db_id", "table_name", "column_name"]
    long_ones = sizes.where(F.col("len") > LONG_VALUES).select(*keys, F.col("first").alias("value"))
    small = sizes.where((F.col("len") <= LONG_VALUES) & (F.col("n") <= limit)).select(*keys)
    return long_ones.unionByName(distinct.join(small, keys, "left_semi"))


def bm25_column_samples(questions: DataFrame, values: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` values per question and column of its database, for columns with more values than that.

    BM25 ranks the text '<table> <column> <value>'; when fewer values share a
    term with the question, the first of the others by value fill up with score
    0, so a column always gives ``limit`` rows.  Other columns:
    ``static_column_samples``.
    """
    distinct, sizes = _column_sizes(values)
    keys = ["db_id", "table_name", "column_name"]
    many = distinct.join(sizes.where((F.col("len") <= LONG_VALUES) & (F.col("n") > limit)).select(*keys), keys, "left_semi")
    column = F.concat_ws(".", "table_name", "column_name")
    corpus = many.select("db_id", column.alias("col"), F.col("value").alias("item_id"), F.split(F.concat_ws(" ", "table_name", "column_name", "value"), r"\s+").alias("tokens"))
    asked = questions.select("query_id", "db_id", F.split(F.regexp_replace("question", "[\"'`]", ""), r"\s+").alias("tokens"))
    columns = corpus.select(F.col("db_id").alias("_db"), F.col("col").alias("_col")).distinct()
    scoped = asked.join(columns, F.col("db_id") == F.col("_db")).select("query_id", "db_id", F.col("_col").alias("col"), "tokens")
    postings = bm25_postings(corpus, asked.select(F.explode("tokens").alias("term")), ["db_id", "col"])
    named = scoped.select(F.struct("query_id", "col").alias("query_id"), "db_id", "col", "tokens")
    hits = top_items(query_terms(named), postings, limit, ["db_id", "col"])
    hits = hits.select("query_id.query_id", "query_id.col", F.col("item_id").alias("value"), "score")
    # At most ``limit`` of the first 2 * limit values can be among the hits, so the rest are enough to fill up.
    by_value = Window.partitionBy("db_id", "col").orderBy("item_id")
    first = corpus.withColumn("_r", F.row_number().over(by_value)).where(F.col("_r") <= 2 * limit).select(
        F.col("db_id").alias("_db"), F.col("col").alias("_col"), F.col("item_id").alias("_value"))
    every_pair = scoped.select("query_id", "db_id", F.col("col").alias("_asked"))
    offered = every_pair.join(first, (F.col("db_id") == F.col("_db")) & (F.col("_asked") == F.col("_col"))).select(
        "query_id", F.col("_asked").alias("col"), F.col("_value").alias("value"), F.lit(None).cast("double").alias("score"))
    # A value that was hit keeps its score; the others of a column with fewer than ``limit`` hits have none, so 0.
    scored = hits.unionByName(offered).groupBy("query_id", "col", "value").agg(F.max("score").alias("score"))
    counted = scored.withColumn("_n", F.count("score").over(Window.partitionBy("query_id", "col")))  # at most 3 * limit rows
    every = counted.where(F.col("score").isNotNull() | (F.col("_n") < limit)).withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("query_id", "col").orderBy(F.desc("score"), "value")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "col", "value", "rank", "score")


def overlap_few_shot(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Examples sharing most distinct words with the question; none shared, none returned.

    ``queries``: ``query_id, question``; ``pool``: ``item_id, question``.
    """
    def terms(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array_distinct(words(F.col("question")))).alias("term"), F.lit(1.0).alias("weight"))

    asked = terms(queries, "query_id")
    held = terms(pool, "item_id").join(asked.select("term").distinct(), "term", "left_semi")
    return top_items(asked, held, k, head=1.0)  # all words weigh the same


def vector_few_shot(
    targets: DataFrame, pool: DataFrame, k: int, metric: str = "cosine", cross_domain: bool = False, probes: int | None = None
) -> DataFrame:
    """Nearest pool rows by cosine or Euclidean distance, never the same question.

    Both sides: id, ``vector, question`` and, for ``cross_domain``, ``db_id``.  ``probes`` as in ``vectors.search``.
    """
    same = ["question", *(["db_id"] if cross_domain else [])]
    columns = ["vector", *same]
    index = build_index(pool.select("item_id", *columns), metric)
    return search(index, targets.select("query_id", *columns), k, exclude_same=same, probes=probes)


def similar_skeletons(left: DataFrame, right: DataFrame, threshold: float = SKELETON_SIMILARITY) -> DataFrame:
    """left_skeleton, right_skeleton: pairs of distinct skeletons whose token sets have a Jaccard similarity of ``threshold``.

    Both sides: ``skeleton``.  Similar sets share one of their rarest tokens, so the join meets on those alone.
    """
    def sets(df: DataFrame) -> DataFrame:
        tokens = F.array_distinct(F.filter(F.split("skeleton", r"\s+"), lambda t: t != ""))
        return df.select("skeleton").distinct().select("skeleton", tokens.alias("tokens"))

    a, b = sets(left), sets(right)
    counts = b.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        exploded = df.select("skeleton", "tokens", F.explode("tokens").alias("token")).join(counts, "token", "left")
        ranked = exploded.groupBy("skeleton", "tokens").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("r"))
        size = F.size("r")
        rarest = F.slice("r", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
        return ranked.select(F.col("skeleton").alias(f"{side}_skeleton"), F.col("tokens").alias(f"{side}_tokens"), F.explode(rarest["token"]).alias("token"))

    met = prefixes(a, "left").join(prefixes(b, "right"), "token").drop("token").distinct()
    union = F.size(F.array_union("left_tokens", "right_tokens"))
    return met.where(F.size(F.array_intersect("left_tokens", "right_tokens")) / union >= threshold).select("left_skeleton", "right_skeleton")


def vector_few_shot_skeleton(targets: DataFrame, pool: DataFrame, k: int, threshold: float = SKELETON_SIMILARITY) -> DataFrame:
    """Nearest rows among those with a similar SQL skeleton, back-filled by plain distance.

    Distinct skeletons are compared once; a target then searches the rows of the skeletons that its own is similar to.  Only targets
    with fewer than ``k`` similar rows search all rows too: the similar ones are all among the results, so the nearest ``k`` of all rows
    are enough to fill up from.
    """
    similar = written(similar_skeletons(targets, pool, threshold), "similar")
    index = build_index(pool.select("item_id", "vector", "question", "skeleton"), "euclidean")
    asked = targets.select("query_id", "vector", "question", "skeleton")
    near = asked.withColumnRenamed("skeleton", "left_skeleton").join(similar, "left_skeleton").select(
        "query_id", "vector", "question", F.col("right_skeleton").alias("skeleton"))
    hits = written(search(index, near, k, ["skeleton"], ["question"], digits=5), "near").withColumn("near", F.lit(True))
    filled = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("query_id")
    short = asked.join(filled, "query_id", "left_anti")
    pairs = similar.select(F.col("left_skeleton").alias("skeleton"), "right_skeleton", F.lit(True).alias("same"))
    plain = search(index, short.drop("skeleton"), k, (), ["question"], digits=5)
    plain = plain.join(short.select("query_id", "skeleton"), "query_id").join(pool.select("item_id", F.col("skeleton").alias("right_skeleton")), "item_id")
    others = plain.join(pairs, ["skeleton", "right_skeleton"], "left").where("same IS NULL").withColumn("near", F.lit(False))
    columns = ["query_id", "item_id", "near", F.round(-F.col("score"), 5).alias("distance")]
    every = hits.select(*columns).unionByName(others.select(*columns))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "distance", "item_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "item_id", "rank", "near", "distance")


def vector_threshold_match(queries: DataFrame, index: DataFrame, k: int, min_sim: float, keep: DataFrame | None = None) -> DataFrame:
    """Top k index rows per query above a similarity, optionally only those also in ``keep`` (``item_id``)."""
    group = ["db_id"] if "db_id" in queries.columns and "db_id" in index.columns else []
    placed = build_index(index.select("item_id", *group, "vector"), "dot")
    hits = search(placed, queries.select("query_id", *group, "vector"), k, group, min_score=min_sim)
    return hits if keep is None else hits.join(keep.select("item_id").distinct(), "item_id", "left_semi")


def retrieve(queries: DataFrame, index: DataFrame | VectorIndex, k: int, probes: int | None = None) -> DataFrame:
    """k nearest rows from every index for every query, best first.

    ``index``: ``index_id, item_id, vector``, or built from it for the cosine; ``queries``: ``query_id, index_ids array, vector``.
    """
    placed = index if isinstance(index, VectorIndex) else build_index(index.select("index_id", "item_id", "vector"), "cosine")
    asked = queries.select(F.struct("query_id", "index_id").alias("query_id"), "index_id", "vector") if "index_id" in queries.columns else (
        queries.withColumn("index_id", F.explode("index_ids")).select(F.struct("query_id", "index_id").alias("query_id"), "index_id", "vector"))
    hits = search(placed, asked, k, ["index_id"], probes=probes)
    return hits.select("query_id.query_id", "query_id.index_id", "item_id", "score")


def retrieve_two_turns(queries: DataFrame, second: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """A first turn, then rewritten queries over what the first turn did not return for that query.

    A query sees at most k first-turn rows per index, so the second turn asks
    for twice as many and drops those already seen: the result is exact.  Both
    turns search one index.
    """
    placed = build_index(index.select("index_id", "item_id", "vector"), "cosine")
    first = written(retrieve(queries, placed, k).withColumn("turn_n", F.lit(0)), "turn")
    again = retrieve(second, placed, 2 * k).join(first.select("query_id", "index_id", "item_id"), ["query_id", "index_id", "item_id"], "left_anti")
    order = Window.partitionBy("query_id", "index_id").orderBy(F.desc("score"), "item_id")
    fresh = again.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r").withColumn("turn_n", F.lit(1))
    return first.unionByName(fresh.select(*first.columns))


def example_quality(pairs: DataFrame) -> DataFrame:
    """Mean skeleton similarity of the examples shown to each target."""
    return pairs.groupBy("query_id").agg(F.avg(jaccard(F.col("skeleton_a"), F.col("skeleton_b"))).alias("quality"))


def few_shot_context(hits: DataFrame) -> DataFrame:
    """Numbered example text per target from ``query_id, rank, text``."""
    line = F.concat(F.lit("-- Example "), F.col("rank"), F.lit("\n"), F.col("text"))
    return hits.groupBy("query_id").agg(
        F.trim(F.array_join(F.array_sort(F.collect_list(F.struct("rank", line.alias("l"))))["l"], "\n\n")).alias("context"))


def pack_examples(hits: DataFrame, budget: int, fixed: Column | int = 0) -> DataFrame:
    """Leading examples whose whitespace token count fits the budget beside the fixed part."""
    size = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.lit(fixed) if isinstance(fixed, int) else fixed
    return hits.withColumn("tokens", size).withColumn("used", F.sum("tokens").over(so_far) + base).where(F.col("used") <= budget)


def build_vector_table(texts: DataFrame, vectors: DataFrame, path: str, chunk_chars: int | None = None) -> DataFrame:
    """Join texts with their supplied vectors and persist them per database; an existing table is reused."""
    spark = texts.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        return spark.read.parquet(path)
    rows = texts
    if chunk_chars:
        pieces = F.expr(f"transform(sequence(0, greatest(0, CAST(ceil(length(text) / {chunk_chars}) AS INT) - 1)), i -> substring(text, i * {chunk_chars} + 1, {chunk_chars}))")
        rows = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(pieces).alias("chunk", "text"))
    keys = [c for c in ("item_id", "chunk") if c in rows.columns and c in vectors.columns]
    rows.join(vectors, keys).write.partitionBy("db_id").mode("errorifexists").parquet(path)
    return spark.read.parquet(path)



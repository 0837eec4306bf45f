"""Information-theoretic sanitisation: personal data by pattern, and the terms that give it away, as SQL expressions and joins.

Every value found by pattern is a protected entity.  How much a term tells about an entity is their pointwise mutual
information over the corpus, log(N * both / (entity * term)) in documents, and it is held against the entity's own
information content, log(N / entity): at 1 the term stands in no document without the entity.  A term beyond the threshold
is a span of its own wherever it stands.  It is generalised to its class ("<name>", "<number>", "<code>", "<word>") unless
the class gives the entity away as well; then it is removed.

Work on texts with personal data is done once for each distinct text, so copies cost nothing but a join on a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# The base patterns, written so that no run of characters is read from each of its own characters again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = r"@[A-Za-z0-9-]|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){13}"
SPACE = r"[\x20\x09-\x0D]"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTEXT = 100  # code points on each side of a value in which terms are looked for
REACH = 5  # terms on each side
MIN_CHARS = 3
MIN_SUPPORT = 3  # distinct contexts in distinct texts
THRESHOLD = 0.9


def lower(text: Column) -> Column:
    """A-Z in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_of(token: Column) -> Column:
    """A run of characters without white space, less the ASCII marks at its ends, A-Z in lower case."""
    return lower(F.btrim(token, F.lit(MARKS)))


def class_of(token: Column) -> Column:
    """What a term is generalised to."""
    bare = F.btrim(token, F.lit(MARKS))
    return (F.when(bare.rlike("^[0-9][0-9.,-]*$"), "<number>").when(bare.rlike("[0-9]"), "<code>")
            .when(bare.rlike(r"^\p{Lu}"), "<name>").otherwise("<word>"))


def terms_of(tokens: Column) -> Column:
    """The distinct terms of some tokens, and their classes."""
    long_ones = F.filter(tokens, lambda t: F.length(F.btrim(t, F.lit(MARKS))) >= MIN_CHARS)
    return F.array_distinct(F.flatten(F.transform(long_ones, lambda t: F.array(term_of(t), class_of(t)))))


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Every second digit from the right but one counts double, less 9 if over 9; the sum is a multiple of ten."""
    backwards = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    weighed = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + d) % 10 == 0


def is_valid(kind: Column, hit: Column) -> Column:
    """Whether a match of a pattern is personal data of its kind."""
    small = F.forall(F.split(hit, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    n_digits = F.length(digits(hit))
    card = F.when(n_digits.between(14, 19), passes_luhn(digits(hit))).otherwise(F.lit(False))
    return F.when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", n_digits.between(10, 15)).otherwise(F.lit(True))


def entity_of(kind: Column, hit: Column) -> Column:
    """The protected value, however it is written."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), digits(hit)).otherwise(lower(hit)))


def suspicious_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key, text, copies: each distinct text that may match a pattern, and how many rows have it."""
    held = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(HINT))
    return held.groupBy(text_key(F.col("text")).alias("key")).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def base_spans(texts: DataFrame) -> DataFrame:
    """key, copies, kind, start, end, entity, before, after: personal data by pattern, with the context of each value.

    The parts of a text between the matches of a pattern and the matches themselves, in turn, make up the text, so the
    offsets are running sums of lengths.
    """
    def matches(kind: str) -> Column:
        pattern = F.lit(PATTERNS[kind])
        parts = F.split(F.col("text"), PATTERNS[kind], -1)
        zipped = F.arrays_zip(parts.alias("part"), F.regexp_extract_all(F.col("text"), pattern, F.lit(0)).alias("hit"), F.slice(parts, 2, 1 << 30).alias("next"))
        return F.transform(F.filter(zipped, lambda m: m["hit"].isNotNull()), lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(m["part"]).alias("gap"), m["hit"].alias("hit"),
            F.right(m["part"], F.lit(CONTEXT)).alias("before"), F.left(m["next"], F.lit(CONTEXT)).alias("after")))

    rows = texts.select("key", "copies", F.explode(F.concat(*map(matches, KINDS))).alias("m")).select("key", "copies", "m.*")
    so_far = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(so_far).cast("bigint"))
    kind, hit = F.col("kind"), F.col("hit")
    return placed.where(is_valid(kind, hit)).select(
        "key", "copies", "kind", (F.col("end") - F.length("hit")).alias("start"), "end", entity_of(kind, hit).alias("entity"), "before", "after")


def contexts(spans: DataFrame) -> DataFrame:
    """entity, term, n_both, support: terms near each entity, in how many documents, and in how many distinct contexts.

    A context counts once however often it is copied, and a text counts for one context, so a group of copies is one
    piece of evidence.
    """
    def tokens(text: Column) -> Column:
        return F.filter(F.split(text, SPACE), lambda t: t != "")

    whole_before = F.when(F.length("before") < CONTEXT, F.col("before")).otherwise(F.regexp_replace("before", r"^[^\x20\x09-\x0D]+", ""))
    whole_after = F.when(F.length("after") < CONTEXT, F.col("after")).otherwise(F.regexp_replace("after", rf"{SPACE}[^\x20\x09-\x0D]*$", ""))
    left, right = tokens(whole_before), tokens(whole_after)
    left = F.slice(left, F.greatest(F.size(left) - REACH + 1, F.lit(1)), F.lit(REACH))
    near = F.concat(left, F.slice(right, 1, REACH))
    rows = spans.select("key", "copies", "entity", near.alias("near"))
    rows = rows.select("key", "copies", "entity", F.xxhash64("near").alias("context"), F.explode(terms_of(F.col("near"))).alias("term"))
    of_text = rows.groupBy("entity", "term", "key").agg(F.max("copies").alias("copies"), F.min("context").alias("context"))
    return of_text.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.countDistinct("context").alias("support"))


def term_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n_term: in how many of all documents each term, and each class, stands; counted before the shuffle."""
    every = docs.select(F.explode(terms_of(F.split(F.col(text_col), SPACE))).alias("term"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosures(docs: DataFrame, spans: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """entity, term, share, support: terms that tell at least ``threshold`` of an entity's information content.

    Classes ("<name>" …) are terms here too.  An entity in every document has no information to give away.
    """
    entities = spans.groupBy("entity", "key").agg(F.max("copies").alias("copies")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    size = F.log(docs.agg(F.count(F.lit(1))).scalar())
    near = contexts(spans).where(F.col("support") >= min_support)
    counted = near.join(term_documents(docs, text_col), "term").join(entities, "entity")
    counted = counted.withColumn("content", size - F.log("n_entity")).withColumn("told", F.col("content") + F.log("n_both") - F.log("n_term"))
    content, told = F.col("content"), F.col("told")
    return counted.where((content > 0) & (told >= threshold * content)).select("entity", "term", (told / content).alias("share"), "support")


def term_actions(found: DataFrame) -> DataFrame:
    """term, action: the class that each disclosing term becomes, '' for one that is removed.

    ``found`` is the result of ``disclosures``; the class of a term follows from how it is written, so all four are kept
    with the term and the text's own token chooses.
    """
    is_class = F.col("term").startswith("<")
    classes = found.where(is_class).groupBy("entity").agg(F.collect_set("term").alias("told"))  # at most four
    words = found.where(~is_class).join(classes, "entity", "left")
    return words.groupBy("term").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("told", F.array().cast("array<string>"))))).alias("removed"))


def term_spans(docs: DataFrame, actions: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """key, start, end, label: where disclosing terms stand in any document, outside personal data."""
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    tokens = F.split(F.col("text"), SPACE, -1)
    words = texts.select("key", F.explode(F.array_distinct(F.transform(tokens, term_of))).alias("term"))
    keys = words.join(actions, "term", "left_semi").select("key").distinct()
    held = texts.join(keys, "key", "left_semi").dropDuplicates(["key"])
    rows = held.select("key", F.posexplode(tokens).alias("i", "token"))
    before = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = F.lit(MARKS)
    lead = F.length("token") - F.length(F.ltrim("token", marks))
    placed = rows.withColumn("start", F.sum(F.length("token") + 1).over(before) - F.length("token") - 1 + lead)
    named = placed.withColumn("term", term_of(F.col("token"))).join(actions, "term")
    label = F.when(F.array_contains("removed", class_of(F.col("token"))), "").otherwise(class_of(F.col("token")))
    found = named.select("key", F.col("start").cast("bigint").alias("start"),
                         (F.col("start") + F.length(F.btrim("token", marks))).cast("bigint").alias("end"), label.alias("label"))
    base = spans.select(F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return found.join(base, (F.col("key") == F.col("_key")) & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")), "left_anti")


def private_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """key, spans: for each distinct text with any, its spans (start, rank, kind, end, label, done) in order.

    ``rank`` is the kind's place, and ``done`` the greatest end of the spans before.
    """
    base = shared_table(base_spans(suspicious_texts(docs, text_col)), "private")
    found = shared_table(disclosures(docs, base, text_col, threshold, min_support), "disclosures")
    terms = term_spans(docs, term_actions(found), base, text_col)
    ranked = F.array_position(F.array(*map(F.lit, (*KINDS, TERM))), F.col("kind")).cast("int")
    every = base.select("key", "start", "kind", "end", F.concat(F.lit("<"), "kind", F.lit(">")).alias("label")).unionByName(
        terms.withColumn("kind", F.lit(TERM))).withColumn("rank", ranked)
    before = Window.partitionBy("key").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    return placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "label", "done"))).alias("spans"))


def with_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with ``__spans``: the spans of each row's text, an empty array where there are none."""
    found = private_spans(docs, text_col, threshold, min_support).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    keyed = docs.withColumn("__key", text_key(F.col(text_col)))
    none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint, label: string, done: bigint>>")
    return keyed.join(found, "__key", "left").withColumn("__spans", F.coalesce("__spans", none)).drop("__key")


def sanitized_text(chars: Column, spans: Column) -> Column:
    """The text, given as its characters, with each span's label in its place; the first of overlapping spans has its label shown."""
    pieces = F.transform(spans, lambda s: F.concat(
        F.array_join(F.slice(chars, (s["done"] + 1).cast("int"), F.greatest(s["start"] - s["done"], F.lit(0)).cast("int")), ""),
        F.when(s["start"] >= s["done"], s["label"]).otherwise("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"])).cast("int")
    return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))


def sanitize(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``docs`` with the text sanitised, and ``private``: array of (kind, start, end, label) in code points of the old text.

    Personal data becomes its kind ("<email>"), a term that gives some away becomes its class or goes.  Null and empty texts
    stay as they are and have no spans; repeated rows are counted as often as they come and give repeated results; ids are
    not looked at; an empty table gives no rows; a column ``private`` is replaced.
    """
    spans, chars = F.col("__spans"), F.when(F.size("__spans") > 0, F.split(text_col, ""))
    text = F.when(F.size(spans) > 0, sanitized_text(F.col("__chars"), spans)).otherwise(F.col(text_col))
    shown = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "private"]
    found = with_spans(docs, text_col, threshold, min_support)
    # One generated row per row, so that a text is cut into characters once and not once for each span.
    return found.withColumn("__chars", F.explode(F.array(chars))).select(*columns, shown.alias("private"))


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256 of the base spans as ``kind:start:end``, and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    spans = F.col("__spans")
    base = F.filter(spans, lambda s: s["kind"] != TERM)
    found = with_spans(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")))
    return found.select(id_col, *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    """The same result in SQL, with the base patterns as they are given and marks stripped by pattern."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    marks = r"[!-/:-@\[-`{-~]"
    lowered, bare = f"translate(%s, '{UPPER}', '{LOWER}')", f"regexp_replace(regexp_replace(token, '^{marks}+', ''), '{marks}+$', '')"
    kinds = "\nUNION ALL ".join(
        f"SELECT key, copies, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS parts FROM texts"
        for rank, (kind, pattern) in enumerate(plain.items(), 1))
    classes = "CASE WHEN regexp_matches(bare, '^[0-9][0-9.,-]*$') THEN '<number>' WHEN regexp_matches(bare, '[0-9]') THEN '<code>' WHEN regexp_matches(bare, '^\\p{Lu}') THEN '<name>' ELSE '<word>' END"
    terms = f"SELECT DISTINCT %s, unnest([{lowered % 'bare'}, {classes}]) AS term FROM (SELECT *, {bare} AS bare FROM %s) WHERE length(bare) >= {MIN_CHARS}"
    return rf"""
WITH texts AS (SELECT text AS key, text, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text),
split AS ({kinds}),
matched AS (SELECT key, copies, kind, rank, unnest(range(1, len(hits) + 1)) AS i, hits, parts FROM split WHERE len(hits) > 0),
sized AS (SELECT key, copies, kind, rank, i, hits[i] AS hit, parts[i] AS before, parts[i + 1] AS after FROM matched),
placed AS (SELECT *, sum(length(before) + length(hit)) OVER (PARTITION BY key, kind ORDER BY i) AS stop, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM sized),
base AS (SELECT key, copies, kind, rank, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, before, after,
  kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN d ELSE {lowered % 'hit'} END AS entity FROM placed
  WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 3) AS INT), 0) > 255)) = 0
    WHEN 'phone' THEN length(d) BETWEEN 10 AND 15
    ELSE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
      CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(d[j] AS INT) WHEN CAST(d[j] AS INT) > 4 THEN 2 * CAST(d[j] AS INT) - 9 ELSE 2 * CAST(d[j] AS INT) END)) % 10 = 0 END),
cut AS (SELECT key, copies, entity, kind, start,
  list_filter(regexp_split_to_array(CASE WHEN length(before) < {CONTEXT} THEN before ELSE regexp_replace(right(before, {CONTEXT}), '^[^\x20\x09-\x0D]+', '') END, '{SPACE}'), lambda t: t <> '')[-{REACH}:] ||
  list_filter(regexp_split_to_array(CASE WHEN length(after) < {CONTEXT} THEN after ELSE regexp_replace(left(after, {CONTEXT}), '{SPACE}[^\x20\x09-\x0D]*$', '') END, '{SPACE}'), lambda t: t <> '')[1:{REACH}] AS near FROM base),
near AS (SELECT key, copies, entity, near, unnest(near) AS token FROM cut),
near_terms AS ({terms % ('key, copies, entity, near', 'near')}),
of_text AS (SELECT entity, term, key, max(copies) AS copies, min(near) AS near FROM near_terms GROUP BY entity, term, key),
pairs AS (SELECT entity, term, sum(copies) AS n_both FROM of_text GROUP BY entity, term HAVING count(DISTINCT near) >= {MIN_SUPPORT}),
words AS (SELECT key, copies, i - 1 AS i, parts[i] AS token, sum(length(parts[i]) + 1) OVER (PARTITION BY key ORDER BY i) - length(parts[i]) - 1 AS lead
  FROM (SELECT key, copies, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT key, copies, regexp_split_to_array(text, '{SPACE}') AS parts FROM texts))),
held AS ({terms % ('key, copies', 'words')}),
n_terms AS (SELECT term, sum(copies) AS n_term FROM held GROUP BY term),
n_entities AS (SELECT entity, sum(copies) AS n_entity FROM (SELECT DISTINCT entity, key, copies FROM base) GROUP BY entity),
size AS (SELECT count(*) AS n FROM documents),
found AS (SELECT DISTINCT term FROM pairs JOIN n_terms USING (term) JOIN n_entities USING (entity) CROSS JOIN size
  WHERE n > n_entity AND ln(n) - ln(n_entity) + ln(n_both) - ln(n_term) >= {THRESHOLD} * (ln(n) - ln(n_entity)) AND term[1] <> '<'),
named AS (SELECT key, lead + length(token) - length(regexp_replace(token, '^{marks}+', '')) AS start, bare FROM (SELECT *, {bare} AS bare FROM words) WHERE {lowered % 'bare'} IN (SELECT term FROM found)),
spans AS (SELECT key, kind, rank, start, stop FROM base UNION ALL
  SELECT key, '{TERM}', 5, CAST(start AS BIGINT), CAST(start + length(bare) AS BIGINT) FROM named n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.key = n.key AND n.start < b.stop AND b.start < n.start + length(n.bare))),
per_text AS (SELECT key, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in KINDS)},
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind <> '{TERM}'), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY key)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per_text ON key = text"""


ORACLE = oracle()

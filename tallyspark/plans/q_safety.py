"""Publication and safety scan queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.fixtures import table
from tallyspark.operators import scans as S
from tallyspark.plans.registry import query


def docs(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), "text")


LINES = """ln AS (SELECT 'doc-' || doc_id AS path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"""
MARKS = "['${env:', '<', 'changeme', 'dummy', 'example', 'getenv', 'none', 'null', 'os.environ', 'placeholder', 'redacted', 'replace', 'test', 'your_']"
CLEAN = f"len(list_filter({MARKS}, lambda m: contains(lower(l), m))) = 0"
TOKENS = {
    "private-key": "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "openai-style-token": r"\bsk-[A-Za-z0-9_-]{16,}\b",
    "github-token": r"\b(?:ghp_|gho_|ghu_|ghs_|github_pat_)[A-Za-z0-9_]{16,}\b", "aws-access-key": r"\bAKIA[0-9A-Z]{16}\b",
    "slack-token": r"\bxox[baprs]-[A-Za-z0-9-]{16,}\b", "google-api-key": r"\bAIza[0-9A-Za-z_-]{30,}\b",
}
QUOTED = r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|private[_-]?key)\b\s*[:=]\s*[\"\x27]([^\"\x27]{8,})[\"\x27]"


@query("scan_secrets", f"""WITH {LINES}
SELECT DISTINCT path, CAST(line AS INT) AS line, category FROM (""" + " UNION ALL ".join(
    f"SELECT path, line, '{name}' AS category FROM ln WHERE regexp_matches(l, '{pattern}') AND {CLEAN}" for name, pattern in TOKENS.items()) + f"""
 UNION ALL SELECT path, line, 'literal-credential-assignment' FROM ln WHERE len(list_filter(regexp_extract_all(l, '{QUOTED}', 1), lambda v: len(list_filter({MARKS}, lambda m: contains(lower(v), m))) = 0)) > 0)""")
def scan_secrets(spark, sf):
    return S.scan_secrets(docs(spark, sf))


@query("scan_secrets_planted", """
SELECT 'doc-' || doc_id AS path, CAST(length(text) - length(replace(text, chr(10), '')) + 2 + k.shift AS INT) AS line, k.category
FROM documents, (VALUES (0, 0, 'aws-access-key'), (1, 0, 'github-token'), (2, 0, 'literal-credential-assignment'), (2, 2, 'literal-credential-assignment'), (4, 0, 'private-key'), (5, 0, 'openai-style-token')) k(m, shift, category)
WHERE doc_id % 7 = k.m""")
def scan_secrets_planted(spark, sf):
    k, d = F.col("doc_id") % 7, F.lpad(F.col("doc_id").cast("string"), 4, "0")
    planted = (
        F.when(k == 0, F.concat(F.lit("id AKIAABCDEFGHIJKL"), d)).when(k == 1, F.concat(F.lit("ghp_abcdefghijklmnop"), d))
        .when(k == 2, F.concat(F.lit("password = 'hunter-"), d, F.lit("'\n\napi-key :\n  \"quux-"), d, F.lit('"')))
        .when(k == 3, F.concat(F.lit("password = 'example-"), d, F.lit("'"))).when(k == 4, "-----BEGIN RSA PRIVATE KEY-----")
        .when(k == 5, F.concat(F.lit("sk-abcdefghijklmnop"), d, F.lit("-"))).otherwise("AKIATEST"))
    rows = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("path"), F.concat("text", F.lit("\n"), planted).alias("text"))
    return S.scan_secrets(rows)


DENY = ("license", "copyright", "secret")


@query("scan_identity", f"""WITH {LINES}
SELECT DISTINCT path, CAST(line AS INT) AS line, category FROM (
 SELECT path, line, 'personal email' AS category FROM ln WHERE len(list_filter(regexp_extract_all(l, '(?i)(?:^|[^\\pL\\pN_.+-])[A-Z0-9._%+-]+@([A-Z0-9.-]+\\.[A-Z]{{2,}})(?:$|[^\\pL\\pN_.-])', 1), lambda d: lower(d) NOT IN ('example.com', 'example.net', 'example.org'))) > 0
 UNION ALL SELECT path, line, 'absolute user path' FROM ln WHERE len(list_filter(list_concat(regexp_extract_all(l, '/(?:Users|home)/([^/\\s]+)(?:/|\\b)', 1), regexp_extract_all(l, '(?i)[A-Z]:\\\\Users\\\\([^\\\\\\s]+)(?:\\\\|\\b)', 1)), lambda u: lower(u) NOT IN ('example', 'runner'))) > 0
 UNION ALL SELECT path, line, 'denylist term' FROM ln WHERE contains(lower(l), 'license') OR contains(lower(l), 'copyright') OR contains(lower(l), 'secret'))""")
def scan_identity(spark, sf):
    return S.scan_identity(docs(spark, sf), DENY)


@query("scan_identity_pages", """
WITH ln AS (SELECT url AS path, unnest(string_split(html, chr(10))) AS l, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages)
SELECT DISTINCT path, CAST(line AS INT) AS line, 'personal email' AS category FROM ln
WHERE len(list_filter(regexp_extract_all(l, '(?i)(?:^|[^\\pL\\pN_.+-])[A-Z0-9._%+-]+@([A-Z0-9.-]+\\.[A-Z]{2,})(?:$|[^\\pL\\pN_.-])', 1), lambda d: lower(d) NOT IN ('example.com', 'example.net', 'example.org'))) > 0
UNION SELECT path, CAST(line AS INT), 'absolute user path' FROM ln WHERE len(list_filter(regexp_extract_all(l, '/(?:Users|home)/([^/\\s]+)(?:/|\\b)', 1), lambda u: lower(u) NOT IN ('example', 'runner'))) > 0""")
def scan_identity_pages(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return S.scan_identity(pages)


@query("scan_narrative", """
WITH ln AS (SELECT 'docs/' || doc_id || '.md' AS path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM
 (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'As shown in this paper, it holds.' ELSE 'plain' END AS text FROM documents))
SELECT path, CAST(line AS INT) AS line, 'submission narrative' AS category FROM ln WHERE regexp_matches(l, '(?i)\\b(?:the|this) paper\\b|\\b(?:reviewer|rebuttal|camera[- ]ready|submission id)\\b|\\baccompanying (?:paper|manuscript)\\b')
 OR regexp_matches(l, '\\b(?:ACL|EMNLP|NAACL|NeurIPS|ICML|ICLR)\\b')""")
def scan_narrative(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, "As shown in this paper, it holds.").otherwise("plain")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), F.concat("text", F.lit("\n"), tail).alias("text"))
    return S.scan_identity(rows).where(F.col("category") == "submission narrative")


def listing(spark, sf):
    k = F.col("l_orderkey") % 11
    name = (F.when(k == 0, ".env").when(k == 1, "id.PEM").when(k == 2, "my-credentials.txt").when(k == 3, "review/notes.md")
            .when(k == 4, "submission-final.pdf").when(k == 5, "../up.txt").when(k == 6, "__MACOSX/x").otherwise("readme.md"))
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("a"), F.col("l_suppkey") % 5).alias("archive"), F.concat(F.lit("d"), F.col("l_partkey"), F.lit("/"), name).alias("path"),
        (F.col("l_quantity") * 100).cast("bigint").alias("size"), F.when(F.col("l_tax") < 0.02, 0).otherwise(F.col("l_linenumber") * 4).cast("bigint").alias("compressed"))


PATHS = """p AS (SELECT 'a' || (l_suppkey % 5) AS archive, l_orderkey % 11 AS k, 'd' || l_partkey || '/' || CASE l_orderkey % 11 WHEN 0 THEN '.env' WHEN 1 THEN 'id.PEM' WHEN 2 THEN 'my-credentials.txt'
 WHEN 3 THEN 'review/notes.md' WHEN 4 THEN 'submission-final.pdf' WHEN 5 THEN '../up.txt' WHEN 6 THEN '__MACOSX/x' ELSE 'readme.md' END AS path,
 CAST(l_quantity * 100 AS BIGINT) AS size, CASE WHEN l_tax < 0.02 THEN 0 ELSE l_linenumber * 4 END AS compressed FROM lineitem)"""


@query("scan_paths", f"""WITH {PATHS}
SELECT DISTINCT path, 0 AS line, CASE k WHEN 0 THEN 'credential-file' WHEN 1 THEN 'private-credential-file' WHEN 2 THEN 'credential-named-file' ELSE 'private submission path' END AS category FROM p WHERE k <= 4""")
def scan_paths(spark, sf):
    return S.scan_paths(listing(spark, sf))


@query("scan_archive", f"""WITH {PATHS}
SELECT archive || '!' || path AS path, 0 AS line, CASE k WHEN 0 THEN 'archive-credential-file' WHEN 1 THEN 'archive-private-credential-file' WHEN 2 THEN 'archive-credential-named-file'
 WHEN 5 THEN 'unsafe-archive-path' ELSE 'archive-system-file' END AS category FROM p WHERE k IN (0, 1, 2, 5, 6) GROUP BY ALL
UNION SELECT archive || '!' || path, 0, 'abnormal-compression-ratio' FROM p WHERE size > 0 AND (compressed = 0 OR size / compressed > 200)
UNION SELECT archive || '!' || path, 0, 'duplicate-archive-member' FROM p GROUP BY archive, path HAVING count(*) > 1""")
def scan_archive(spark, sf):
    return S.scan_archive(listing(spark, sf))


@query("unsafe_text", """
SELECT doc_id, CASE WHEN regexp_matches(text, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|\\bsk-[A-Za-z0-9_-]{20,}\\b|\\bgh[opusr]_[A-Za-z0-9]{20,}\\b|\\bAKIA[0-9A-Z]{16}\\b') THEN 'secret'
 WHEN len(list_filter(regexp_extract_all(text, '(?i)\\b(?:api[_-]?key|access[_-]?token|secret[_-]?key)\\s*[:=]\\s*[\\x27"]?([A-Za-z0-9_./+=-]{12,})', 1), lambda v: NOT regexp_matches(v, '(?i)^(?:your[_-]|placeholder|null\\b|none\\b)'))) > 0 THEN 'secret'
 WHEN regexp_matches(text, '(?:^|[^A-Za-z0-9_])/(?:Users|home|root|private|var|tmp|opt|etc)/[^\\s\\x27"`]+') OR regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9_])[A-Z]:\\\\[^\\s\\x27"`]+') THEN 'absolute path'
 WHEN regexp_matches(text, '(?is)\\b(?:select\\s+.{1,200}?\\s+from|insert\\s+into|update\\s+\\S+\\s+set|delete\\s+from)\\b') THEN 'sql text' END AS reason FROM documents""")
def unsafe_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.unsafe_text(F.col("text")).alias("reason"))


@query("unsafe_structure", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'forbidden field' ELSE '' END || CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN 'unknown field' ELSE '' END AS problems FROM events""")
def unsafe_structure(spark, sf):
    e = F.col("event_id")
    body = F.concat(
        F.lit('{"instance_id": "'), e, F.lit('", "token_usage": {"prompt_tokens": 3}, "metrics": {"ex": 1'), F.when(e % 7 == 0, ', "Pred-SQL": 0').otherwise(""), F.lit("}"),
        F.when(e % 5 == 0, ', "extra": true').otherwise(""), F.lit("}"))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"))
    return S.unsafe_structure(rows, "body", S.DIAGNOSTIC_FIELDS).select("event_id", F.array_join("problems", ",").alias("problems"))


@query("unsafe_manifest", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'forbidden field' WHEN 3 THEN 'forbidden field' WHEN 4 THEN 'non-finite number' WHEN 5 THEN 'invalid json' ELSE '' END AS problems FROM events""")
def unsafe_manifest(spark, sf):
    k = F.col("event_id") % 6
    counters = F.when(k == 0, '"note_tokens_prompt": "3"').otherwise('"prompt_tokens": 3, "raw_response_tokens": 4.5')
    privacy = F.when(k == 3, '"contains_question_text": true').otherwise('"contains_question_text": false, "contains_sql": false')
    body = F.concat(F.lit('{"run": {"token_usage": {'), counters, F.lit('}}, "privacy": {'), privacy, F.lit('}, "list": [[1, '), F.when(k == 4, "NaN").otherwise("2"), F.when(k == 5, "],").otherwise("]"), F.lit(']}'))
    rows = table(spark, sf, "events").select("event_id", body.alias("body"))
    return S.unsafe_structure(rows, "body", document="manifest").select("event_id", F.array_join("problems", ",").alias("problems"))


@query("strip_records", """
SELECT event_id, '{"ex": 0.5, "by": {"easy": {"n": ' || event_id || ', "list": [{"score": 1}, [{"k": 2}], "text"]}}, "n": ' || user_id || '}' AS body FROM events""")
def strip_records(spark, sf):
    body = F.concat(
        F.lit('{"ex": 0.5, "per_sample": [1], "by": {"easy": {"n": '), F.col("event_id"),
        F.lit(', "Config-Path": "x", "list": [{"path": "/a", "score": 1}, [{"Records": [{"a": 1}], "k": 2}], "text"]}}, "Path": 1, "n": '), F.col("user_id"), F.lit("}"))
    return S.strip_records(table(spark, sf, "events").select("event_id", body.alias("body")), "body")


@query("redact", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'The configured API key was rejected.' WHEN 1 THEN 'The provider request failed.' WHEN 2 THEN 'call [redacted] failed'
 WHEN 3 THEN 'auth [redacted] at [redacted]' ELSE 'plain ' || event_type END AS message, CASE WHEN event_id % 2 = 0 THEN 'run-' || event_id ELSE '[redacted]' END AS run_id FROM events""")
def redact(spark, sf):
    k = F.col("event_id") % 5
    message = (F.when(k == 0, "Error: invalid_api_key").when(k == 1, " \n\t ").when(k == 2, "call https://host/x?y=1 failed")
               .when(k == 3, "auth token=abc at /home/me/x.log").otherwise(F.concat(F.lit("plain "), "event_type")))
    run_id = F.concat(F.when(F.col("event_id") % 2 == 0, "run-").otherwise("run "), "event_id")
    return table(spark, sf, "events").select("event_id", S.redact(message).alias("message"), S.public_value(run_id).alias("run_id"))


@query("numeric_fields", """
SELECT event_id, '{"k": ' || json_extract_string(props, '$.k') || ', "deep": {"on": true, "list": [1, [2.5], {"n": ' || event_id || '}]}}' AS kept FROM events""")
def numeric_fields(spark, sf):
    deep = F.concat(F.lit(', "bad key": 1, "text": "x", "deep": {"on": true, "off": null, "list": [1, "y", [2.5, []], {"n": '), F.col("event_id"), F.lit(', "s": "z"}], "none": {"a": "b"}}}'))
    text = F.concat(F.expr("substring(props, 1, length(props) - 1)"), deep)
    return S.numeric_fields(table(spark, sf, "events").select("event_id", text.alias("kept")), "kept")

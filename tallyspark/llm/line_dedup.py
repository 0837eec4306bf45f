"""Line dedup: lines found in many documents, as compressed bitmaps of the lines that each document keeps.

The lines' hashes are range-partitioned and sorted by (hash, document, position).  Because the document is part of the
range, a very common line spreads over many partitions.  One pass over the sorted rows marks the first occurrence of a
line in each document; those are counted per line with combining before the shuffle.  A document gets back bitmap words
(64 lines each) only where it loses lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.shared import shared_table

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 1
MIN_DOCUMENTS = 10
PARTS = 16


def lines_of(text: Column) -> Column:
    """The lines of a text, split at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """Tells rows with the same id but different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, doc_hash, pos, h1, h2: one row per line whose key has enough characters; two 64-bit hashes stand for the key."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("doc_hash"), F.posexplode(lines_of(text)).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "doc_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def line_occurrences(hashed: DataFrame) -> DataFrame:
    """The rows of ``hashed_lines`` range-partitioned by hash and document, a partition's rows sorted by (hash, document, position)."""
    order = ["h1", "h2", "doc_id", "doc_hash"]
    return hashed.repartitionByRange(*order).sortWithinPartitions(*order, "pos")


def line_counts(occurrences: DataFrame) -> DataFrame:
    """h1, h2, n_documents: in how many documents each line occurs, from the first occurrences in the sorted stream."""
    document = Window.partitionBy("h1", "h2", "doc_id", "doc_hash").orderBy("pos")
    firsts = occurrences.withColumn("place", F.row_number().over(document)).where("place = 1")
    return firsts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_documents"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """doc_id, doc_hash, keep: for each document that loses lines, the words of its keep bitmap that have a cleared bit.

    ``keep`` is an array of (word, bits): bit b of word w belongs to line 64 * w + b, counted from 0; words that are not
    listed are all ones.  A line is lost when its key occurs in ``min_documents`` documents or more; with ``keep_first`` the
    first occurrence, by document and position, stays.  Rows with the same id and text are one document; rows with one id
    and different texts are different documents.  A null text is an empty one; an empty table gives no rows.
    """
    # Written once: finding the bounds of ranges, the counts and the join would else each split every text.
    hashed = shared_table(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    occurrences = line_occurrences(hashed)
    # Common lines meet their occurrences in ``PARTS`` parts by document, so one line's occurrences are never one task's.
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    common = line_counts(occurrences).where(F.col("n_documents") >= min_documents).select("h1", "h2", parts)
    dealt = hashed.withColumn("part", F.pmod(F.xxhash64("doc_id", "doc_hash"), F.lit(PARTS)).cast("int"))
    lost = dealt.join(common, ["h1", "h2", "part"]).drop("part")
    if keep_first:
        first = lost.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "doc_hash", "pos")).alias("first"))
        lost = lost.join(first, ["h1", "h2"]).where(~F.struct("doc_id", "doc_hash", "pos").eqNullSafe(F.col("first")))
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    words = lost.groupBy("doc_id", "doc_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set."""
    bits = F.map_from_entries(keep)

    def stays(_line: Column, pos: Column) -> Column:
        word = F.coalesce(F.try_element_at(bits, F.floor(pos / 64).cast("int")), F.lit(-1).cast("bigint"))
        return F.getbit(word, pos % 64) == 1

    return F.filter(lines, stays)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_dropped (long): lines before, and lines lost.

    All columns of ``docs`` stay; a text without lost lines stays as it is (null too).  When every line goes, the text is
    empty.  See ``keep_bitmaps`` for the rule and for repeated rows.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_documents, keep_first)
    maps = maps.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash"), F.col("keep").alias("__keep"))
    found = docs.withColumn("__text_hash", text_key(F.col(text_col)))
    joined = found.join(maps, found[id_col].eqNullSafe(maps["__id"]) & (found["__text_hash"] == maps["__hash"]), "left")
    lines = lines_of(F.col(text_col))
    n_lines = F.size(lines).cast("bigint")
    left = joined.withColumn("__kept", F.when(F.col("__keep").isNotNull(), kept_lines(lines, F.col("__keep"))))
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_dropped = F.coalesce(n_lines - F.size("__kept"), F.lit(0)).cast("bigint")
    return left.select(*columns, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = dedup_lines(docs)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS})
SELECT k.doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY k.doc_id"""

"""JSON documents as a stream of tokens, one row each, so that trees of any depth are judged and pruned without a parser per row.

Depth is a running sum of brackets.  Within one level of a document, the tokens from an opening bracket to its closing one are
neighbours, whatever is nested deeper, so a token's container, its key and whether it may stand where it stands follow from the
rows before and after it.  A subtree is an interval of positions; dropping subtrees is a running sum of interval edges.

Documents are judged as rows of tokens, equal ones once (``token_stream``).  They are pruned whole (``pruned``), by the same rules on
arrays of token kinds, a batch of documents at a time: only their texts are shuffled, to even out the tasks, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import written as written_table

TOKEN = r'"[^"\\]*+(?:(?s:\\.)[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++|"'
STRING = r'^"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1F]*+)*+"$'
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
NOT_FINITE = r"^(?:NaN|-?Infinity)$"
TASK_CHARS = 4_000_000
VALUES = ("value", "string", "scalar")
# Kinds of tokens: a class, and what a single token tells.
BRACKETS = {"{": 0, "[": 1, "}": 2, "]": 3}
COMMA, COLON, TEXT, SCALAR = 4, 5, 6, 7
WELL_FORMED, MARKED = 8, 16
SLICE_TOKENS = 1 << 18  # of the documents that are pruned at a time


def document_key(text: Column) -> Column:
    return F.sha2(text, 256)


def plain_string(token: Column) -> Column:
    """What a string token says."""
    inner = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(token.contains("\\"), F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]).otherwise(inner)


def dealt(texts: DataFrame) -> DataFrame:
    """One row per document (``doc, text``), dealt by document while it is still one text: its tokens then need no shuffle.

    A partition holds about ``TASK_CHARS`` characters, so that its tokens are sorted in memory.
    """
    return texts.repartition(_at_least(texts, _tasks(texts, "text")), "doc").dropDuplicates(["doc"])


def _tasks(df: DataFrame, column: str) -> int:
    chars = df.agg(F.sum(F.length(F.col(column)))).first()[0] or 0
    return -(-chars // TASK_CHARS)


def _at_least(df: DataFrame, tasks: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)


def token_stream(df: DataFrame, column: str) -> DataFrame:
    """One row per token of each distinct document, an opening bracket as a value of its container and as a container.

    ``doc, pos, token, role, level``; ``home`` and ``shape`` are place and bracket of the container; ``key`` and ``start`` are
    the key and the first place of a member of an object; ``item`` counts the items of a list before it; ``stop`` is where a
    container ends; ``ok`` tells whether the token may stand here.  Roles: value (of a container), open, close, comma,
    colon, string, scalar, name.
    """
    texts = dealt(df.select(F.col(column).alias("text")).where(F.col(column).isNotNull()).select(document_key(F.col("text")).alias("doc"), "text"))
    tokens = texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    step = F.when(F.col("token").isin("{", "["), 1).when(F.col("token").isin("}", "]"), -1).otherwise(0)
    tokens = tokens.withColumn("step", step).withColumn("depth", F.sum("step").over(Window.partitionBy("doc").orderBy("pos")))

    def role(name: str | Column, level: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("role"), level.alias("level"))

    depth = F.col("depth")
    plain = F.when(F.col("token") == ",", "comma").when(F.col("token") == ":", "colon").when(F.col("token").startswith('"'), "string").otherwise("scalar")
    roles = F.when(F.col("step") == 1, F.array(role("value", depth - 1), role("open", depth))).when(
        F.col("step") == -1, F.array(role("close", depth + 1))).otherwise(F.array(role(plain, depth)))
    rows = tokens.select("doc", "pos", "token", F.explode(roles).alias("r")).select("doc", "pos", "token", "r.role", "r.level")

    level = Window.partitionBy("doc", "level").orderBy("pos")
    so_far, onward = level.rowsBetween(Window.unboundedPreceding, 0), level.rowsBetween(0, Window.unboundedFollowing)
    opened = F.col("role") == "open"
    rows = rows.select(
        "*", F.last(F.when(opened, F.col("pos")), ignorenulls=True).over(so_far).alias("home"), F.last(F.when(opened, F.col("token")), ignorenulls=True).over(so_far).alias("shape"),
        F.lag("role").over(level).alias("before"), F.lag("role", 2).over(level).alias("before2"), F.lead("role").over(level).alias("after"),
        F.lag("token", 2).over(level).alias("key_token"), F.lag("pos", 2).over(level).alias("key_pos"),
        F.first(F.when(F.col("role") == "close", F.col("pos")), ignorenulls=True).over(onward).alias("close_pos"))
    in_object, in_list = F.col("shape").eqNullSafe("{"), F.col("shape").eqNullSafe("[")
    named = in_object & (F.col("role") == "string") & F.col("before").isin("open", "comma")
    rows = rows.withColumn("role", F.when(named, "name").otherwise(F.col("role")))
    role_, before, after = F.col("role"), F.col("before"), F.col("after")
    placed = F.when(in_object, before == "colon").when(in_list, before.isin("open", "comma")).otherwise(before.isNull() & after.isNull())
    quoted = F.col("token").rlike(STRING)
    ok = (F.when(role_ == "name", quoted & (after == "colon"))
          .when(role_ == "string", quoted & placed)
          .when(role_ == "scalar", placed & (F.col("token").rlike(NUMBER) | F.col("token").rlike(NOT_FINITE) | F.col("token").isin("true", "false", "null")))
          .when(role_ == "value", placed)
          .when(role_ == "colon", in_object & (before == "string") & F.col("before2").isin("open", "comma"))
          .when(role_ == "comma", (in_object | in_list) & before.isin(*VALUES) & (after != "close"))
          .when(role_ == "close", before.isin("open", *VALUES) & (F.col("token") == F.when(in_object, "}").when(in_list, "]")))
          .otherwise(F.col("close_pos").isNotNull()))
    items = F.count(F.when(F.col("role") == "comma", 1)).over(Window.partitionBy("doc", "level", "home").orderBy("pos"))
    member = in_object & role_.isin(*VALUES)
    return rows.select(
        "doc", "pos", "token", "role", "level", "home", "shape", F.when(member, plain_string(F.col("key_token"))).alias("key"),
        F.when(member, F.col("key_pos")).otherwise(F.col("pos")).alias("start"), F.when(in_list, items).alias("item"),
        F.when(opened, F.col("close_pos")).alias("stop"), F.coalesce(ok, F.lit(False)).alias("ok"))


def valid_documents(stream: DataFrame) -> DataFrame:
    """doc: the documents that are one JSON value (NaN and Infinity taken for numbers)."""
    edges = F.sum(F.when(F.col("role") == "open", 1).when(F.col("role") == "close", -1).otherwise(0))
    judged = stream.groupBy("doc").agg(F.bool_and("ok").alias("ok"), edges.alias("open"), F.min("level").alias("least"))
    return judged.where("ok AND open = 0 AND least >= 0").select("doc")


def json_values(stream: DataFrame) -> DataFrame:
    """The values of each document: ``doc, pos, token, role, level, home, key, start, stop, item``, and ``home_key``, the key of the container."""
    spans = stream.where("role = 'open'").select("doc", "pos", F.col("stop").alias("end"))
    values = stream.where(F.col("role").isin(*VALUES)).select("doc", "pos", "token", "role", "level", "home", "key", "start", "item")
    values = values.join(spans, ["doc", "pos"], "left").withColumn("stop", F.coalesce("end", "pos")).drop("end")
    keys = values.where("role = 'value'").select("doc", F.col("pos").alias("home"), F.col("key").alias("home_key"))
    return values.join(keys, ["doc", "home"], "left")


def token_kinds(text: Column, marked_key: Callable[[Column], Column], marked_scalar: Callable[[Column], Column] | None = None) -> Column:
    """Kind of each token: its class, ``WELL_FORMED`` and ``MARKED``, the latter for keys and scalars that the given conditions name."""
    def flag(condition: Column, bit: int) -> Column:
        return F.when(condition, bit).otherwise(0)

    def kind(token: Column) -> Column:
        known = F.when(token == ",", COMMA).when(token == ":", COLON)
        for bracket, number in BRACKETS.items():
            known = known.when(token == bracket, number)
        plain = F.lit(SCALAR) + flag(token.isin("true", "false", "null") | token.rlike(NUMBER) | token.rlike(NOT_FINITE), WELL_FORMED)
        if marked_scalar is not None:
            plain = plain + flag(marked_scalar(token), MARKED)
        quoted = F.lit(TEXT) + flag(token.rlike(STRING), WELL_FORMED) + flag(marked_key(plain_string(token)), MARKED)
        return known.when(token.startswith('"'), quoted).otherwise(plain).cast("tinyint")

    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), kind)


def _covered(size: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The positions that an interval covers, both ends with it."""
    edges = np.bincount(start, minlength=size + 1) - np.bincount(stop + 1, minlength=size + 1)
    return np.cumsum(edges)[:size] > 0


def kept_pieces(kinds: np.ndarray, ends: np.ndarray, numbers_only: bool = False, max_items: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of documents stay: 0 not, else 1, and 2 more with a comma before and 4 more with a colon after; and which documents are valid.

    ``ends`` are the documents' ends among the tokens.  Members with a marked key go.  With ``numbers_only`` go all values but marked
    scalars, items of lists from ``max_items`` on, and containers in which no marked scalar is left.  The rules are those of ``token_stream``:
    a token stands in two rows if it opens a container, and rows are ordered by document, level and place.
    """
    size, docs = len(kinds), len(ends)
    counts = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(docs), counts)
    kind, good, marked = kinds & 7, (kinds & WELL_FORMED) > 0, (kinds & MARKED) > 0
    opens, closes = kind < 2, (kind == 2) | (kind == 3)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    depth -= np.concatenate([[0], depth])[ends - counts][doc]
    pos = np.repeat(np.arange(size), 1 + opens)
    opening = np.zeros(len(pos), dtype=bool)
    opening[1:] = pos[1:] == pos[:-1]
    level = depth[pos] + closes[pos] - (opens[pos] & ~opening)
    least = level.min(initial=0)
    order = np.argsort(doc[pos] * (level.max(initial=0) - least + 1) + (level - least), kind="stable")
    pos, opening, level = pos[order], opening[order], level[order]
    at, k, d = np.arange(len(pos)), kind[pos], doc[pos]
    opened, closed, comma, colon = opening, closes[pos], k == COMMA, k == COLON
    value = ~(opened | closed | comma | colon)

    def near(by: int) -> np.ndarray:
        """The row so far behind in the same level of the same document, else one that is nothing."""
        other = at + by
        inside = (other >= 0) & (other < len(at))
        other[~inside] = 0
        inside &= (d[other] == d) & (level[other] == level)
        return np.where(inside, other, len(at))

    def seen(rows: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.append(rows, False)[there]

    before, before2, after = near(-1), near(-2), near(1)
    first = np.maximum.accumulate(np.where(before == len(at), at, 0))
    home = np.maximum.accumulate(np.where(opened, at, -1))
    housed = home >= first
    in_object, in_list = housed & (k[home] == 0), housed & (k[home] == 1)
    last = np.minimum.accumulate(np.where(after == len(at), at, len(at))[::-1])[::-1]
    close = np.minimum.accumulate(np.where(closed, at, len(at))[::-1])[::-1]
    starts = seen(opened, before) | seen(comma, before)
    named = in_object & (k == TEXT) & starts
    placed = np.where(in_object, seen(colon, before), np.where(in_list, starts, (before == len(at)) & (after == len(at))))
    ok = np.select(
        [named, opened, closed, comma, colon],
        [good[pos] & seen(colon, after), close <= last, (seen(opened, before) | seen(value, before)) & ((in_object & (k == 2)) | (in_list & (k == 3))),
         housed & seen(value, before) & (after < len(at)) & ~seen(closed, after), in_object & seen(value & (k == TEXT), before) & (seen(opened, before2) | seen(comma, before2))],
        placed & (good[pos] | (k < 2)))
    valid = (counts > 0) & (np.bincount(d[~ok | (level < 0)], minlength=docs) == 0)
    valid &= np.bincount(doc[opens], minlength=docs) == np.bincount(doc[closes], minlength=docs)

    # From here on only rows of valid documents count.
    value &= ~named & valid[d]
    stop = np.arange(size)
    ended = opened & valid[d]
    stop[pos[ended]] = pos[close[ended]]
    member = value & in_object
    start = pos.copy()
    start[member] = pos[before2[member]]
    unwanted = member & marked[start]
    if numbers_only:
        unwanted |= value & (k >= TEXT) & ~((k == SCALAR) & marked[pos])
        if max_items is not None:
            commas = np.cumsum(comma)
            unwanted |= value & in_list & (commas - commas[home] >= max_items)
    gone = _covered(size, start[unwanted], stop[pos[unwanted]])
    if numbers_only:
        held = np.cumsum((kind == SCALAR) & marked & ~gone)
        box = value & (k < 2)
        unwanted |= box & (held[stop[pos]] == held[pos])
        gone = _covered(size, start[unwanted], stop[pos[unwanted]])

    stays = valid[doc] & (kind != COMMA) & (kind != COLON) & ~gone
    pieces = stays.astype(np.int8)
    leads = (named | (value & in_list)) & stays[pos]
    lead, house = pos[leads], home[leads]
    later = np.zeros(len(lead), dtype=bool)
    later[1:] = house[1:] == house[:-1]
    pieces[lead[later]] += 2
    pieces[pos[named & stays[pos]]] += 4
    return pieces, valid


def pruned(df: DataFrame, column: str, marked_key: Callable[[Column], Column], marked_scalar: Callable[[Column], Column] | None = None,
           max_items: int | None = None) -> DataFrame:
    """``df`` with the document in ``column`` freed of members that ``marked_key`` names; NULL for invalid JSON and where nothing is left.

    With ``marked_scalar`` only the scalars that it names are left, of lists the first ``max_items`` items, and no empty containers.
    Scalars come as they were written, with one blank after commas and colons.  Rows are dealt evenly first, so that the number of tasks
    follows the length of the texts, not the files that they were read from.
    """
    text = F.col(column)
    only = marked_scalar is not None

    def slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of documents of about ``SLICE_TOKENS`` tokens."""
        turns = np.flatnonzero(np.diff((np.cumsum(counts) - counts) // SLICE_TOKENS)) + 1
        yield from zip([0, *turns], [*turns, len(counts)], strict=True)

    @F.arrow_udf("array<tinyint>")
    def pieces(kinds: pa.Array) -> pa.Array:
        counts = kinds.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = kinds.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts)
        parts, left = [], []
        for a, b in slices(counts):
            low = ends[a] - counts[a] if len(counts) else 0
            part, valid = kept_pieces(flat[low : low + counts[a:b].sum()], ends[a:b] - low, only, max_items)
            kept = np.concatenate([[0], np.cumsum(part > 0)])
            parts.append(part)
            left.append(valid & (kept[ends[a:b] - low] > kept[ends[a:b] - low - counts[a:b]]))
        values, left = np.concatenate(parts), np.concatenate(left)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int8()), mask=pa.array(~left))

    def piece(token: Column, how: Column) -> Column:
        return F.when(how > 0, F.concat(F.when(how.bitwiseAND(2) > 0, ", ").otherwise(""), token, F.when(how.bitwiseAND(4) > 0, ": ").otherwise("")))

    found = pieces(token_kinds(text, marked_key, marked_scalar))
    left = F.array_join(F.zip_with(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), found, piece), "")
    tasks = _tasks(df, column)  # rows that one task can take stay where they are
    return (df if tasks <= 1 else df.repartition(_at_least(df, tasks))).withColumn(column, left)


def held_stream(df: DataFrame, column: str) -> DataFrame:
    """The token stream, written once because judging and pruning read it several times."""
    return written_table(token_stream(df, column), "tokens")

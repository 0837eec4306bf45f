"""Benchmark decontamination by template windows: questions are found again with other numbers, names or units.

Texts are cut into tokens; numbers, units after numbers, and names become typed placeholders.  Windows of ``WINDOW`` template
tokens of the benchmark are the build side of a hash join.  A window with as many slots as literals, and a question under
``SHORTEST`` tokens, is looked for literally.  Every window of every whole document is looked up in a table of
the benchmark's window hashes, which is broadcast in blocks of ``BLOCK_HASHES`` at most, one pass over the documents for
each block; what is found is joined in Spark.  A match counts when its slots are consistent: within one alignment of a
document with a question, each value of the question always stands for the same value of the document.  Verbatim windows,
without slots or with the question's own values, count in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.shared import shared_table

WINDOW = 8
SHORTEST = 5  # a shorter question is a literal window, with its case and the mark after it
PLAIN, NAMED, LITERAL, EXACT, ENDED = range(5)  # forms of windows
BLOCK_HASHES = 1 << 20
TABLE_BITS = 22
NUMBER, UNIT, NAME = (W.mix(np.array([k], dtype=np.uint64))[0] for k in (11, 12, 13))
UNITS = (
    "percent", "km", "m", "cm", "mm", "mi", "mile", "miles", "meter", "meters", "metre", "metres", "ft", "feet", "foot", "inch", "inches", "yard", "yards",
    "kg", "g", "mg", "lb", "lbs", "pound", "pounds", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "mph", "kmh", "degree", "degrees",
)
WEIGHTS = W.mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)

# Kinds of bytes: letters (all bytes beyond ASCII too), digits, and separators.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), ord("_"), *range(128, 256)]] = 1
KIND[ord("0") : ord("9") + 1] = 2
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".!?:;\n\r\"()")] = True


class Tokens:
    """Template tokens of a batch of texts: spans, the text's number, literal hashes and kinds."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = W.flat(texts)
        data = self.data
        kind = KIND[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        change = np.concatenate(([True], kind[1:] != kind[:-1]))[: len(data)] | edge[:-1]
        starts = np.flatnonzero(change & (kind > 0))
        ends = np.flatnonzero(np.concatenate((change[1:], [True]))[: len(data)] & (kind > 0)) + 1
        number = kind[starts] == 2
        text = np.searchsorted(offsets, starts, side="right") - 1
        # 1,000.5 is one number: digits after one comma or point after digits go on.
        if len(starts) > 1:
            gap = data[np.minimum(ends[:-1], len(data) - 1)]
            goes_on = number[1:] & number[:-1] & (text[1:] == text[:-1]) & (starts[1:] == ends[:-1] + 1) & ((gap == ord(".")) | (gap == ord(",")))
            first = np.concatenate(([True], ~goes_on))
            last = np.concatenate((~goes_on, [True]))
            starts, ends, number, text = starts[first], ends[last], number[first], text[first]
        self.starts, self.ends, self.text = starts, ends, text
        self.offsets = np.searchsorted(text, np.arange(len(offsets)))
        self.hashes = W.hash_spans(W.LOWER[data], starts, ends)
        same = np.concatenate(([False], text[1:] == text[:-1]))[: len(starts)]
        after = same & np.concatenate(([False], number[:-1]))[: len(starts)]
        unit = after.copy()
        unit[after] = np.isin(self.hashes[after], UNIT_HASHES)
        breaks = np.concatenate(([0], np.cumsum(ENDS[data])))
        before = np.concatenate(([0], ends[:-1]))[: len(starts)]
        second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(data) else data
        capital = (data[starts] >= ord("A")) & (data[starts] <= ord("Z")) & (ends - starts > 1) & ~((second >= ord("A")) & (second <= ord("Z")))
        name = capital & same & (breaks[starts] == breaks[before])
        self.kinds = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
        plain = self.hashes.copy()
        plain[number], plain[unit] = NUMBER, UNIT
        named = plain.copy()
        named[name] = NAME
        self.forms = {PLAIN: plain, NAMED: named, LITERAL: self.hashes}
        self.ended = breaks[np.concatenate((np.where(same[1:], starts[1:], offsets[text[:-1] + 1]), offsets[-1:]))[: len(starts)]] > breaks[ends]

    @cached_property
    def exact(self) -> np.ndarray:
        """Hashes of the tokens in their own case."""
        return W.hash_spans(self.data, self.starts, self.ends)

    def windows(self, form: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First tokens and hashes of the windows of ``length`` tokens within a text.

        Plain and named windows have more literals than slots; ended ones have a mark behind them.
        """
        tokens = self.forms[form] if form in self.forms else self.exact
        count = len(tokens) - length + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        out = np.full(count, length, dtype=np.uint64)
        for k in range(length):
            out += tokens[k : k + count] * WEIGHTS[k]
        good = self.text[length - 1 :] == self.text[:count]
        if form in (PLAIN, NAMED):
            good &= ~self.dense(form, length)
        if form == NAMED:  # the same as the plain form where no name is in it
            names = np.concatenate(([0], np.cumsum(self.kinds == 3)))
            good &= names[length:] > names[:-length]
        if form == ENDED:
            good &= self.ended[length - 1 :]
        at = np.flatnonzero(good)
        return at, W.mix(out[at] + np.uint64(form))

    def dense(self, form: int, length: int) -> np.ndarray:
        """Whether the tokens from each one on have as many slots as literals, or more."""
        slot = self.kinds > 0 if form == NAMED else (self.kinds == 1) | (self.kinds == 2)
        slots = np.concatenate(([0], np.cumsum(slot)))
        return 2 * (slots[length:] - slots[:-length]) >= length

    def asked(self, form: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows that stand for a question: literal ones where the plain form has too many slots or too few tokens."""
        at, hashes = self.windows(form, length)
        size = np.diff(self.offsets)[self.text[at]]
        good = (length == WINDOW) & (size >= WINDOW) | (size == length)
        if form == LITERAL:
            good &= self.dense(PLAIN, length)[at]
        if form == EXACT:
            good &= ~self.ended[at + length - 1]
        return at[good], hashes[good]

    def slots(self, at: int, length: int, form: int) -> list[str]:
        """The values of the slots of a window, in lower case, with their kinds."""
        kinds = {PLAIN: (1, 2), NAMED: (1, 2, 3)}.get(form, ())
        found = (k for k in range(at, at + length) if self.kinds[k] in kinds)
        return [f"{self.kinds[k]}:{W.LOWER[self.data[self.starts[k] : self.ends[k]]].tobytes().decode('utf-8', 'replace')}" for k in found]


UNIT_HASHES = W.word_hashes(pa.array(UNITS))[0]
FORMS = {length: (PLAIN, NAMED, LITERAL) if length >= SHORTEST else (EXACT, ENDED) for length in range(1, WINDOW + 1)}
_HITS = "hash bigint, pos bigint, length int, form int, slots array<string>"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, hash, pos, length, form, slots: windows of each question; one under 8 tokens is a window of its own."""
    schema = pa.schema([("item_id", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("length", pa.int32()), ("form", pa.int32()), ("slots", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.slices(batch, "text"):
                tokens, ids, rows = Tokens(piece.column(1)), piece.column(0).to_pylist(), []
                for length, forms in FORMS.items():
                    for form in forms:
                        for at, value in zip(*tokens.asked(form, length), strict=True):
                            text = tokens.text[at]
                            rows.append((ids[text], int(value.astype(np.int64)), int(at - tokens.offsets[text]), length, form, tokens.slots(at, length, form)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"item_id bigint, {_HITS}")


def _found(docs: DataFrame, hashes: np.ndarray, kinds: list[tuple[int, int]]) -> DataFrame:
    """doc_id, doc_hash and the windows, of these lengths and forms, of the documents whose hash is among ``hashes``."""
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(hashes), kinds))
    schema = pa.schema([("doc_id", pa.int64()), ("doc_hash", pa.int64()), ("hash", pa.int64()), ("pos", pa.int64()), ("length", pa.int32()), ("form", pa.int32()), ("slots", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, kinds = shared.value
        shift = np.uint64(64 - TABLE_BITS)
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[(wanted >> shift).astype(np.int64)] = True
        for batch in batches:
            for piece in W.slices(batch, "text"):
                tokens, rows = Tokens(piece.column(2)), []
                for length, form in kinds:
                    at, values = tokens.windows(form, length)
                    near = table[(values >> shift).astype(np.int64)]
                    at, values = at[near], values[near]
                    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
                    hit = wanted[place] == values
                    rows += [(tokens.text[a], int(v), int(a - tokens.offsets[tokens.text[a]]), length, form, tokens.slots(a, length, form))
                             for a, v in zip(at[hit].tolist(), values[hit].view(np.int64), strict=True)]
                if rows:
                    text, *rest = zip(*rows, strict=True)
                    taken = [piece.column(k).take(pa.array(text)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[2:], strict=True))], schema=schema)

    return docs.mapInArrow(work, f"doc_id bigint, doc_hash bigint, {_HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_windows: int = 1,
                 item_col: str = "item_id", item_text_col: str = "text", block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """doc_id, doc_hash, item_id, n_windows, n_slots, n_changed: documents that hold a question of the benchmark.

    One row per document and question with at least ``min_windows`` windows in a consistent alignment, or as many verbatim
    windows in another one, of which only these count.  ``n_windows`` is the most of any alignment, ``n_slots`` its slots with
    their distinct values and ``n_changed`` those with another value than in the question.  Where a window of the question has
    as many slots as literals its literal tokens count, and so does a question under five tokens as a whole, in its own case
    and with the mark that ends it; literal windows have no slots.
    ``doc_hash`` (xxhash64 of the text) tells rows with one id apart; repeated rows count once; null ids are kept.  Null or
    empty texts have no windows; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    windows = shared_table(benchmark_windows(benchmark, item_col, item_text_col), "questions")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("doc_hash"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = sorted((r.length, r.form) for r in windows.select("length", "form").distinct().collect())
    n_blocks = -(-windows.select("hash").distinct().count() // block_hashes)
    hits = spark.createDataFrame([], f"doc_id bigint, doc_hash bigint, {_HITS}")
    for block in range(n_blocks):
        own = windows.where(F.pmod("hash", F.lit(n_blocks)) == block).select("hash").distinct().toArrow().column(0).to_numpy()
        found = _found(rows, own.astype(np.int64).view(np.uint64), kinds)
        hits = found if n_blocks == 1 else hits.unionByName(shared_table(found, "hits"))
    key = ["doc_id", "doc_hash", "item_id", "shift"]
    asked = windows.select("item_id", "hash", "length", "form", F.col("pos").alias("at"), F.col("slots").alias("values"))
    matched = hits.join(asked, ["hash", "length", "form"]).withColumn("shift", F.col("pos") - F.col("at"))
    matched = matched.select(*key, "pos", F.arrays_zip("values", "slots").alias("filled"))
    verbatim = F.forall("filled", lambda x: x["values"] == x["slots"])
    one_each = matched.groupBy(*key).agg(F.count_distinct("pos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"),
                                         F.count_distinct(F.when(verbatim, F.col("pos"))).alias("n_verbatim"),
                                         F.array_distinct(F.flatten(F.collect_set(F.when(verbatim, F.col("filled"))))).alias("unchanged"))
    consistent = F.size(F.array_distinct(F.transform("filled", lambda x: x["values"]))) == F.size("filled")
    counted = one_each.select(*key, F.when(consistent, F.col("n_windows")).otherwise(F.col("n_verbatim")).alias("n_windows"),
                              F.when(consistent, F.col("filled")).otherwise(F.col("unchanged")).alias("filled"))
    changed = F.size(F.filter("filled", lambda x: x["values"] != x["slots"]))
    aligned = counted.where((F.col("n_windows") > 0) & (F.col("n_windows") >= min_windows)).withColumn("n_slots", F.size("filled")).withColumn("n_changed", changed)
    best = F.max_by(F.struct("n_windows", "n_slots", "n_changed"), F.struct("n_windows", -F.col("shift")))
    return aligned.groupBy("doc_id", "doc_hash", "item_id").agg(best.alias("best")).select("doc_id", "doc_hash", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no question of the benchmark, unchanged."""
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return rows.join(found, rows[id_col].eqNullSafe(found["__id"]) & (rows["__text_hash"] == found["__hash"]), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "n_slots", "n_changed")

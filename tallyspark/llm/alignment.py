"""Alignment of two tokenizers' tokens of the same texts by a galloping intersection of their byte ends.

A document's tokens end at growing byte offsets.  The shorter of the two lists of ends drives: each of its ends is looked
for in the longer list from where the last one was found, in steps that double, then by halving.  Ends that both lists
have cut the tokens into groups; the ranks of two neighbouring ends tell which tokens overlap.  Many stretches ("lanes") of
the driving lists are searched side by side in numpy.

Corpus-wide counts of linked id pairs are asked for once per slice of texts, not once per document: a slice of about
a megabyte names its distinct pairs, and the answers go back to the slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import bpe
from tallyspark.llm import words as W
from tallyspark.llm.pieces import SLICE_BYTES, SPACE, PieceEncoder
from tallyspark.llm.shared import shared_table

LANE = 64
BLANK = "▁"
PAIRS_BYTES = 1 << 20
SEPARATORS = np.frombuffer(b",|,;", dtype=np.uint8)  # within and after the first side's tokens, then the second side's


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short``, how many of ``long`` are smaller; both grow strictly.  Gallops in lanes of ``LANE`` values."""
    out = np.zeros(len(short), dtype=np.int64)
    heads = np.arange(0, len(short), LANE)
    beyond = np.append(long, np.iinfo(np.int64).max)
    low = np.searchsorted(long, short[heads])
    out[heads] = low
    for step in range(1, min(LANE, len(short))):
        asked = heads + step
        asked = asked[asked < len(short)]
        low = low[: len(asked)].copy()
        want, high, jump = short[asked], np.empty(len(asked), dtype=np.int64), 1
        live = np.arange(len(asked))
        while len(live):
            probe = np.minimum(low[live] + jump - 1, len(long))
            less = beyond[probe] < want[live]
            high[live[~less]] = probe[~less]
            live = live[less]
            low[live] = probe[less] + 1
            jump *= 2
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            less = beyond[middle] < want[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        out[asked] = low
    return out


class Links:
    """Overlaps of two sides' tokens over the same bytes; ``ends`` grow strictly, and both sides end together.

    ``common_a`` and ``common_b`` mark the tokens that end a group; ``first`` and ``second`` are the tokens of each link.
    """

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray):
        swapped = len(ends_a) > len(ends_b)
        short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
        rank = ranks(short, long)
        found = long[np.minimum(rank, len(long) - 1)] == short if len(long) else np.zeros(len(short), dtype=bool)
        common = np.zeros(len(long), dtype=bool)
        common[rank[found]] = True
        start = np.concatenate(([0], (rank + found)[:-1])) if len(short) else rank
        sizes = rank - start + 1
        driver = np.repeat(np.arange(len(short)), sizes)
        other = np.arange(len(driver)) - np.repeat(np.cumsum(sizes) - sizes - start, sizes)
        self.common_a, self.common_b = (common, found) if swapped else (found, common)
        self.first, self.second = (other, driver) if swapped else (driver, other)


def digits_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of each id, the first ones in the first row, and how many there are."""
    width = len(str(int(ids.max())))
    counts = np.ones(len(ids), dtype=np.int64)
    for k in range(1, width):
        counts += ids >= 10**k
    places = np.maximum(counts[None] - 1 - np.arange(width)[:, None], 0)
    return (ids[None] // 10**places % 10 + ord("0")).astype(np.uint8), counts


class BlankEncoder(PieceEncoder):
    """Encodes what stands between blanks apart: a piece begins with a blank that follows no white space.

    Exact for a sentence-piece model without a token that goes on after a blank, which is checked.
    """

    def __init__(self, model):
        tokens = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(BLANK in token.lstrip(BLANK) for token in tokens):
            raise ValueError("the sentence-piece model has tokens with a blank inside")
        self.model = model
        super().__init__(self._encode, lambda text: b"", [])

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.model.encode([piece[1:] for piece in pieces], num_threads=1)  # the model adds the blank itself
        blank = [self.model.piece_to_id(BLANK)]
        return [np.array(ids if len(piece) > 1 else blank, dtype="<u4").tobytes() for piece, ids in zip(pieces, found, strict=True)]

    def starts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        space = self.classes[codes] == SPACE
        begins = (codes == ord(" ")) & ~np.concatenate(([True], space[:-1]))
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begins)


class Tokenizers:
    """Both tokenizers, and the bytes and the decimal digits of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        own = bpe.codec(path_a)
        self.split = PieceEncoder(own.merge_all, own.encode, [])  # strings of added tokens are plain text
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.blanks = BlankEncoder(self.model)
        self.bytes_a = own.by_id
        self.bytes_b = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.sizes_a = np.fromiter(map(len, self.bytes_a), dtype=np.int64)
        self.sizes_b = np.fromiter(map(len, self.bytes_b), dtype=np.int64)
        self.figures, self.counts = digits_of(np.arange(max(len(self.bytes_a), len(self.bytes_b))))

    def _piece(self, token: int) -> bytes:
        piece = self.model.id_to_piece(token)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(token) else piece.replace(BLANK, " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text on both sides; both empty where there is no text, or a side's bytes are not blank + text.

        The sign for a blank comes back as a blank, so a text that has this sign itself never fits.
        """
        none = np.zeros(0, dtype=np.int64)
        spaced = [" " + text if text and BLANK not in text else "" for text in texts]
        held = pa.array(spaced, pa.large_string())
        (ids_a, from_a), (ids_b, from_b) = self.split.encode_batch(held), self.blanks.encode_batch(held)
        first, second = [], []
        for k, text in enumerate(spaced):
            mine, own, raw = ids_a[from_a[k] : from_a[k + 1]], ids_b[from_b[k] : from_b[k + 1]], text.encode()
            same = b"".join(map(self.bytes_b.__getitem__, own.tolist())) == raw and b"".join(map(self.bytes_a.__getitem__, mine.tolist())) == raw
            first.append(mine.astype(np.int64) if same else none)
            second.append(own.astype(np.int64) if same else none)
        return first, second


class Slice:
    """The aligned documents of one slice of texts."""

    def __init__(self, own: Tokenizers, texts: list[str | None]):
        first, second = own.encode(texts)
        self.own = own
        self.n_a, self.n_b = (np.fromiter(map(len, side), dtype=np.int64, count=len(texts)) for side in (first, second))
        self.a, self.b = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in (first, second))
        self.from_a, self.from_b = (np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        ends_a, ends_b = np.cumsum(own.sizes_a[self.a]), np.cumsum(own.sizes_b[self.b])
        self.common_a, self.common_b = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        links = []
        for drives in (self.n_a <= self.n_b, self.n_a > self.n_b):  # the shorter list of each document drives
            at_a, at_b = np.flatnonzero(np.repeat(drives, self.n_a)), np.flatnonzero(np.repeat(drives, self.n_b))
            found = Links(ends_a[at_a], ends_b[at_b])
            self.common_a[at_a], self.common_b[at_b] = found.common_a, found.common_b
            links.append((at_a[found.first], at_b[found.second]))
        self.first, self.second = (np.concatenate(side) for side in zip(*links, strict=True))
        self.document = np.searchsorted(self.from_a, self.first, side="right") - 1
        self.n_groups = self.per_document(np.repeat(np.arange(len(texts)), self.n_a)[self.common_a])
        self.n_links = self.per_document(self.document)

    def per_document(self, documents: np.ndarray) -> np.ndarray:
        return np.bincount(documents, minlength=len(self.n_a)).astype(np.int64)

    def group_texts(self) -> tuple[bytes, np.ndarray]:
        """The groups of all documents as text behind each other, and the n + 1 offsets; each document's last ``;`` included."""
        group_a = np.cumsum(self.common_a) - self.common_a
        group_b = np.cumsum(self.common_b) - self.common_b
        ends_a, ends_b = np.flatnonzero(self.common_a) + 1, np.concatenate(([0], np.flatnonzero(self.common_b) + 1))
        slot_a = np.arange(len(self.a)) + ends_b[group_a]
        slot_b = np.arange(len(self.b)) + (ends_a[group_b] if len(ends_a) else 0)
        ids, mark = np.empty(len(self.a) + len(self.b), dtype=np.int64), np.empty(len(self.a) + len(self.b), dtype=np.uint8)
        ids[slot_a], ids[slot_b] = self.a, self.b
        mark[slot_a], mark[slot_b] = SEPARATORS[self.common_a.astype(int)], SEPARATORS[2 + self.common_b.astype(int)]
        counts = self.own.counts[ids]
        ends = np.cumsum(counts + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
        starts = ends - counts - 1
        for k, figure in enumerate(self.own.figures):
            has = np.flatnonzero(counts > k)
            out[starts[has] + k] = figure[ids[has]]
        out[ends - 1] = mark
        return out.tobytes(), np.concatenate(([0], ends))[self.from_a + self.from_b]

    def group_digests(self) -> list[str]:
        text, at = self.group_texts()
        return [hashlib.sha256(text[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Codes a * ``width`` + b of the distinct linked pairs, their counts, and for each document (place in codes, count) packed."""
        codes, place, counts = np.unique(self.a[self.first] * width + self.b[self.second], return_inverse=True, return_counts=True)
        held, times = np.unique(self.document * max(1, len(codes)) + place, return_counts=True)
        cut = np.searchsorted(held, np.arange(len(self.n_a) + 1) * max(1, len(codes)))
        packed = np.stack((held % max(1, len(codes)), times)).astype("<u4")
        return codes, counts, [packed[:, lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]


def tokenizers_of(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or bpe.vocabulary_path(), path_b or bpe.vocabulary_path("piece_bpe_32k.model")


def _worker(path_a: str, path_b: str) -> Tokenizers:
    return bpe.per_worker(("alignment", path_a, path_b), lambda: Tokenizers(path_a, path_b))


def _cut(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row: id, ``a_ids``, ``b_ids``, and ``a_ends``, ``b_ends``: after how many tokens of each side every group ends.

    Tokens of blank + text by the byte-level tokenizer A and of the text by the sentence-piece tokenizer B, whose bytes
    must be the same; a null or empty text, or one whose bytes differ, has empty lists.  Other columns are left out, so
    their names cannot clash; every row gives one row, repeated ids and null ids too.  No shuffle.
    """
    paths = tokenizers_of(path_a, path_b)
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(*paths)
        for batch in batches:
            for piece in W.slices(batch, "__text", SLICE_BYTES):
                done = Slice(own, piece.column(1).to_pylist())
                columns = [piece.column(0), _cut(done.a, done.from_a), _cut(done.b, done.from_b)]
                for common, start in ((done.common_a, done.from_a), (done.common_b, done.from_b)):
                    ends = np.flatnonzero(common) + 1
                    at = np.concatenate(([0], np.cumsum(done.n_groups)))
                    columns.append(_cut(ends - np.repeat(start[:-1], done.n_groups), at))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "a_ids", "b_ids", "a_ends", "b_ends"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_col}` {kind}, a_ids array<bigint>, b_ids array<bigint>, a_ends array<bigint>, b_ends array<bigint>")


def aligned_slices(docs: DataFrame, id_col: str, text_col: str, paths: tuple[str, str]) -> DataFrame:
    """Rows of documents and rows of slices; the latter hold the slice's distinct linked pairs.  For one written table."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slice", "held", "codes", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _worker(*paths), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in W.slices(batch, "__text", PAIRS_BYTES):
                done = Slice(own, piece.column(1).to_pylist())
                codes, counts, held = done.pairs(len(own.bytes_b))
                rows, at = piece.num_rows, pa.array([number] * piece.num_rows, pa.int64())
                figures = [pa.array(n, pa.int64()) for n in (done.n_a, done.n_b, done.n_groups, done.n_links)]
                empty = pa.nulls(rows, pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), *figures, pa.array(done.group_digests()), at, pa.array(held, pa.binary()), empty, empty], names=names)
                lists = [pa.array([values.astype(kind).tobytes()], pa.binary()) for values, kind in ((codes, "<i8"), (counts, "<u4"))]
                blank = [pa.nulls(1, kind) for kind in (piece.column(0).type, *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([*blank, pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), *lists], names=names)
                number += 1

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
                                 "slice bigint, held binary, codes binary, counts binary")


def slice_pairs(slices: DataFrame) -> DataFrame:
    """slice, place, pair, n: the distinct linked pairs of each slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = np.frombuffer(codes, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
                columns = [np.full(len(pair), number), np.arange(len(pair)), pair, n]
                for at in range(0, len(pair), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], pa.int64()) for c in columns], names=["slice", "place", "pair", "n"])

    listed = slices.where("codes IS NOT NULL").select("slice", "codes", "counts")
    return listed.mapInArrow(work, "slice bigint, place bigint, pair bigint, n bigint")


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of overlapping token occurrences; the count of an id pair is how many links of the whole table hold
    it.  ``n_best`` counts links whose pair is the most frequent of its B id (ties too), ``count_sum`` adds up the counts
    over links; ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``.  Rows as in ``align``; one without tokens has
    zeros and '', and an empty table gives no rows.
    """
    paths = tokenizers_of(path_a, path_b)
    width = _worker(*paths).model.get_piece_size()
    slices = shared_table(aligned_slices(docs, id_col, text_col, paths), "aligned")
    pairs = slice_pairs(slices)
    total = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("pair") % width)  # at most one row per id of A
    known = total.withColumn("best", F.col("total") == F.max("total").over(of_b))
    answers = pairs.select("slice", "place", "pair").join(known, "pair").select("slice", "place", "total", "best")
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = slices.where("held IS NOT NULL").select(*names, "slice", "held")

    def digest(own: pa.Table, said: pa.Table) -> pa.Table:
        place = said.column("place").to_numpy()
        total, best = np.zeros(len(place), dtype=np.int64), np.zeros(len(place), dtype=np.int64)
        total[place], best[place] = said.column("total").to_numpy(), said.column("best").to_numpy(zero_copy_only=False)
        sums = np.zeros((2, own.num_rows), dtype=np.int64)
        for k, held in enumerate(own.column("held")):
            at, times = np.frombuffer(held.as_buffer(), "<u4").reshape(2, -1).astype(np.int64)
            sums[:, k] = times @ best[at], times @ total[at]
        return own.select(names).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(digest, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

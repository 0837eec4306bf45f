"""Token ids in binary shard files: fixed-width bit packing with block offsets.

A shard is: magic and version, the header numbers (``HEADER``), the id and the end of each document, the byte offset of each
block, then the blocks.  A block holds ``block_ids`` ids of ``bits`` bits each, where ``bits`` is the least that numbers all
of the vocabulary, lowest bit first, and starts at a byte.  Any range of ids is read from its blocks alone.

Documents are range-partitioned and sorted by id, so file names in order give the documents in order.  A task writes a
shard under a name of its own and renames it when it is whole; a repeated task replaces it by the same bytes.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.bpe import byte_letters, per_worker, vocabulary_path
from tallyspark.llm.pieces import SLICE_BYTES, PieceEncoder
from tallyspark.llm.shared import shared_folder

MAGIC = b"TOKSHRD1"
HEADER = ("bits", "block_ids", "n_docs", "n_ids")
BLOCK_IDS = 1 << 16
SHARD_IDS = 4 << 20
END_ID = 0
NULL_ID = -(1 << 63)  # stands for a null document id


def bits_for(vocabulary: int) -> int:
    """The least number of bits that tells ``vocabulary`` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, lowest bit first, filled up to a whole byte."""
    every = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(every[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    every = np.zeros((count, 32), dtype=np.uint8)
    every[:, :bits] = np.unpackbits(data, count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(every.ravel(), bitorder="little").view("<u4")


def shard_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[at : at + block_ids], bits) for at in range(0, len(ids), block_ids)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64))).astype("<i8")
    names = np.array([NULL_ID if i is None else i for i in doc_ids], dtype="<i8")
    head = np.array([bits, block_ids, len(names), len(ids)], dtype="<i8")
    return b"".join((MAGIC, head.tobytes(), names.tobytes(), np.cumsum(sizes, dtype=np.int64).astype("<i8").tobytes(), offsets.tobytes(), *blocks))


class Shard:
    """Reads documents or any range of ids of a shard; only the blocks that hold them are unpacked."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC)

        def numbers(count: int) -> np.ndarray:
            nonlocal at
            at += 8 * count
            return np.frombuffer(data, dtype="<i8", count=count, offset=at - 8 * count)

        self.bits, self.block_ids, self.n_docs, self.n_ids = map(int, numbers(len(HEADER)))
        self.doc_ids = [None if i == NULL_ID else i for i in numbers(self.n_docs).tolist()]
        self.ends = numbers(self.n_docs)
        self.offsets = numbers(-(-self.n_ids // self.block_ids) + 1)
        self.payload = np.frombuffer(data, dtype=np.uint8, offset=at)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.payload[self.offsets[k] : self.offsets[k + 1]], count, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard, end id included."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the shard, ids) of all documents; each block is unpacked once."""
        k, rest, at = 0, np.zeros(0, dtype="<u4"), 0
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            parts = [rest]
            held = len(rest)
            while held < end - at:
                parts.append(self.block(k))
                held += len(parts[-1])
                k += 1
            rest = np.concatenate(parts)
            yield doc_id, at, rest[: end - at]
            rest, at = rest[end - at :], end


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all: under the attempt's own name first, then renamed."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    context = TaskContext.get()
    own = f"{path}/_{name}.{context.taskAttemptId() if context else os.getpid()}"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(own) as out:
        out.write(data)
    system.move(own, f"{path}/{name}")


def _tokenizer(path: str) -> tuple[PieceEncoder, int]:
    """An encoder of batches that gives each distinct pre-token to the tokenizers library once, and the vocabulary's size."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    def make() -> tuple[PieceEncoder, int]:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        model, cut = library.model, library.pre_tokenizer
        plain = library.normalizer is None and isinstance(model, BPE) and isinstance(cut, ByteLevel) and not cut.add_prefix_space
        letters = {b: letter for letter, b in byte_letters().items()}

        def pieces(texts: list[str]) -> list[bytes]:
            """Ids of pre-tokens; where nothing but the letters of bytes stands before the library's model, by the model itself."""
            if not plain:
                return [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
            spelled = [text.encode().decode("latin-1").translate(letters) for text in texts]
            found = [[token.id for token in model.tokenize(text)] for text in spelled]
            raw = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes()
            edges = list(accumulate((4 * len(ids) for ids in found), initial=0))
            return [raw[at:to] for at, to in zip(edges, edges[1:], strict=False)]

        def whole(text: str) -> bytes:
            return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

        added = [token.content for token in library.get_added_tokens_decoder().values()]
        return PieceEncoder(pieces, whole, added), library.get_vocab_size(with_added_tokens=True)

    return per_worker(("tokenizers", path), make)


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards in ascending id order; returns the manifest.

    The manifest (file, n_docs, n_ids, start; also written as ``manifest`` in the folder) has the number of ids before each
    file.  A null text is an empty one; null ids come first; rows with one id are ordered by the hash of their text.  A text
    is never cut: a very long one makes a larger shard.  An empty table gives an empty manifest.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _tokenizer(path)
        bits = bits_for(vocabulary)
        partition, made = TaskContext.get().partitionId(), 0
        names, sizes, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, sizes, parts, held, made
            file = f"part-{partition:06d}-{made:06d}.tok"
            _put(folder, file, shard_bytes(names, sizes, np.concatenate(parts), bits, block_ids))
            row = pa.RecordBatch.from_pydict({"file": [file], "n_docs": [len(names)], "n_ids": [held]}, schema=_ROW)
            names, sizes, parts, held, made = [], [], [], 0, made + 1
            return row

        for batch in batches:
            for piece in W.slices(batch, "text", SLICE_BYTES):
                ids, offsets = encoder.encode_batch(piece.column(1))
                for k, doc_id in enumerate(piece.column(0).to_pylist()):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id))
                    names.append(doc_id)
                    sizes.append(len(own))
                    parts.append(own)
                    held += len(own)
                    if held >= shard_ids:
                        yield flush()
        if names:
            yield flush()

    manifest = f"{folder}/manifest"
    rows.mapInArrow(work, "file string, n_docs bigint, n_ids bigint").write.parquet(manifest)
    files = docs.sparkSession.read.schema("file string, n_docs bigint, n_ids bigint").parquet(manifest)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file of many megabytes
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


_ROW = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/*.tok").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    placed = files.join(manifest.select("file", "start"), "file").select("start", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0), batch.column(1), strict=True):
                first = start.as_py()
                out = [(i, first + at, len(ids), zlib.crc32(ids.tobytes())) for i, at, ids in Shard(content.as_buffer()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _DOC, strict=True)], schema=_DOC)

    return placed.mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_shards(spark, folder, manifest)

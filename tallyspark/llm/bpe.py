"""Byte-level byte-pair encoding and decoding with a segment tree over the ranks of neighbouring pairs.

A pre-token starts as bytes.  Leaf i of the tree holds (rank, i) of the pair that begins at i; the root is then the
leftmost pair of the lowest rank.  Merging it changes three leaves, each update is logarithmic, and a pre-token of n bytes
takes O(n log n) steps however long it is.  The trees of many distinct pre-tokens are rows of one array and are worked on
together.  Vocabulary and merges are read from a tokenizer file; nothing is trained.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import words as W
from tallyspark.llm.pieces import SLICE_BYTES, PieceEncoder

#: Fixed value: how byte-level tokenizers of this family cut a text before merging; white space by its Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NONE = 1 << 62
POSITION_BITS = 32
TREE_NODES = 1 << 18
LONG_PIECE = 256


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: itself if printable, else the next from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class PairTree:
    """Segment tree over the pair keys of one long pre-token; the root is the smallest."""

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        self.nodes = nodes = [NONE] * size + keys + [NONE] * (size - len(keys))
        for k in range(size - 1, 0, -1):
            nodes[k] = min(nodes[2 * k], nodes[2 * k + 1])

    def put(self, at: int, key: int) -> None:
        nodes, k = self.nodes, at + self.size
        nodes[k] = key
        while k > 1:
            left, right = nodes[k & ~1], nodes[k | 1]
            k >>= 1
            best = left if left < right else right
            if nodes[k] == best:
                return
            nodes[k] = best


class BytePairCodec:
    """Encoder and decoder of one tokenizer file; ``added`` tokens are cut out of a text before anything else."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        self.pieces = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.byte_ids = np.array([vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int64)
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
        self.merged = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pieces |= {i: content.encode() for content, i in self.added.items()}
        contents = sorted(self.added, key=lambda c: (-len(c), c))
        self.cut = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.size = max(self.pieces) + 1
        codes = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges], dtype=np.int64)
        self.pair_codes, self.pair_ranks = np.unique(codes, return_index=True)  # of equal pairs the first
        self.pair_table = dict(zip(self.pair_codes.tolist(), self.pair_ranks.tolist(), strict=True))
        self.by_id = [self.pieces.get(i, b"") for i in range(self.size)]
        self.split = regex.compile(PATTERN).findall
        self.batches = PieceEncoder(self.merge_all, self.encode, list(self.added))

    def merge(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit integers."""
        return self.merge_all([piece])[0]

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each pre-token; trees of the same size are worked on together, a long pre-token alone."""
        raw = [piece.encode() for piece in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[bytes] = [b""] * len(raw)
        size, done = 4, sizes == 0
        for k in np.flatnonzero(sizes > LONG_PIECE).tolist():
            out[k], done[k] = self._merge_long(raw[k]), True
        while not done.all():
            fits = np.flatnonzero(~done & (sizes <= size))
            for at in range(0, len(fits), step := max(1, TREE_NODES // size)):
                taken = fits[at : at + step]
                for k, ids in zip(taken.tolist(), self._merge_trees([raw[k] for k in taken], sizes[taken], size), strict=True):
                    out[k] = ids
            done[fits] = True
            size *= 2
        return out

    def _merge_long(self, raw: bytes) -> bytes:
        """A long pre-token by itself, with a tree in plain Python."""
        ids = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)].tolist()
        count, mask = len(ids), (1 << POSITION_BITS) - 1
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        pairs, size = self.pair_table, self.size

        def key(at: int, behind: int) -> int:
            rank = pairs.get(ids[at] * size + ids[behind])
            return NONE if rank is None else (rank << POSITION_BITS) + at

        tree = PairTree([key(k, k + 1) for k in range(count - 1)])
        while tree.nodes[1] < NONE:
            at = tree.nodes[1] & mask
            gone = after[at]
            behind = after[at] = after[gone]
            ids[at], ids[gone] = int(self.merged[tree.nodes[1] >> POSITION_BITS]), -1
            if gone < count - 1:
                tree.put(gone, NONE)
            if behind < count:
                before[behind] = at
            tree.put(at, key(at, behind) if behind < count else NONE)
            if before[at] >= 0:
                tree.put(before[at], key(before[at], at))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _merge_trees(self, raw: list[bytes], sizes: np.ndarray, size: int) -> list[bytes]:
        """One segment tree of ``size`` leaves per row; each round merges the pair at the root of every row that has one."""
        rows = len(raw)
        own = np.arange(size)[None] < sizes[:, None]
        ids = np.full((rows, size), -1, dtype=np.int64)
        ids[own] = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        after, before = np.tile(np.arange(1, size + 1), (rows, 1)), np.tile(np.arange(-1, size - 1), (rows, 1))
        tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
        tree[:, size:-1] = self._keys(ids[:, :-1], ids[:, 1:], np.arange(size - 1)[None])
        width = size
        while width > 1:
            tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width //= 2
        live = np.arange(rows)
        while len(live := live[tree[live, 1] < NONE]):
            root = tree[live, 1]
            at = root & ((1 << POSITION_BITS) - 1)
            gone = after[live, at]
            behind = after[live, gone]
            ids[live, at], ids[live, gone] = self.merged[root >> POSITION_BITS], -1
            after[live, at] = behind
            more, left = behind < sizes[live], before[live, at]
            before[live[more], behind[more]] = at[more]
            tree[live, size + gone] = NONE
            tree[live, size + at] = NONE
            tree[live[more], size + at[more]] = self._keys(ids[live[more], at[more]], ids[live[more], behind[more]], at[more])
            held = left >= 0
            tree[live[held], size + left[held]] = self._keys(ids[live[held], left[held]], ids[live[held], at[held]], left[held])
            row = np.concatenate((live, live, live[held]))
            node = size + np.concatenate((gone, at, left[held]))
            while node[0] > 1:
                node >>= 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = 4 * np.cumsum(kept.sum(axis=1))
        return [flat[to - n : to] for to, n in zip(ends.tolist(), (4 * kept.sum(axis=1)).tolist(), strict=True)]

    def _keys(self, first: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of pairs at their places, ``NONE`` where they never merge."""
        pair = first * self.size + second
        place = np.minimum(np.searchsorted(self.pair_codes, pair), len(self.pair_codes) - 1)
        fits = (self.pair_codes[place] == pair) & (first >= 0) & (second >= 0)
        return np.where(fits, (self.pair_ranks[place] << POSITION_BITS) + at, NONE)

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        parts, at = [], 0
        for found in self.cut.finditer(text) if self.cut else ():
            parts += map(self.merge, self.split(text[at : found.start()]))
            parts.append(self.added[found.group()].to_bytes(4, "little"))
            at = found.end()
        parts += map(self.merge, self.split(text[at:]))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that are not UTF-8 become replacement characters, unknown ids nothing."""
        by_id, size = self.by_id, self.size
        numbers = np.frombuffer(ids, dtype="<u4")
        if len(numbers) and int(numbers.max()) >= size:
            numbers = numbers[numbers < size]
        return b"".join(map(by_id.__getitem__, numbers.tolist())).decode("utf-8", "replace")


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker and key; a worker runs many tasks."""
    holder = sys.modules.setdefault("_llm_worker_objects", types.ModuleType("_llm_worker_objects"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def codec(path: str) -> BytePairCodec:
    return per_worker(("byte pairs", path), lambda: BytePairCodec(path))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _with(piece: pa.RecordBatch, target: str, values: pa.Array) -> pa.RecordBatch:
    """The rows with ``target`` as last column, in place of a column of that name."""
    kept = [i for i, name in enumerate(piece.schema.names) if name != target]
    fields = [*(piece.schema.field(i) for i in kept), pa.field(target, values.type)]
    return pa.RecordBatch.from_arrays([*map(piece.column, kept), values], schema=pa.schema(fields))


def _plain(df: DataFrame, target: str, kind: str) -> str:
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name != target]
    return ", ".join([*fields, f"`{target}` {kind}"])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``ids_col`` (binary): the ids of each whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty value).  All other columns stay, in place of ``ids_col`` if there was one;
    rows stay in place, without a shuffle.
    """
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path).batches
        for batch in batches:
            for piece in W.slices(batch, text_col, SLICE_BYTES):
                ids, offsets = own.encode_batch(piece.column(text_col))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids)])
                yield _with(piece, ids_col, packed.cast(pa.binary()))

    return docs.mapInArrow(work, _plain(docs, ids_col, "binary"))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``text_col``: the text of each row's packed ids; null ids give an empty text."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for piece in W.slices(batch, ids_col, SLICE_BYTES):
                yield _with(piece, text_col, pa.array([own.decode(ids or b"") for ids in piece.column(ids_col).to_pylist()], pa.string()))

    return rows.mapInArrow(work, _plain(rows, text_col, "string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded texts."""
    encoded = encode(docs.select("doc_id", "text"), path=path)
    packed = encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(packed, path=path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Words, word hashes and shingles of Arrow text columns, in numpy over the flat bytes of a batch.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``.  A word's hash is a polynomial of its bytes modulo 2**64,
mixed; a shingle's hash is a weighted sum of its words' hashes, mixed.  Both depend on the words alone, not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_BYTES = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 18
SHINGLE = 5

SPACE = np.zeros(256, dtype=bool)
SPACE[list(SPACE_BYTES)] = True
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER = KEEP_CASE.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
STEP = np.uint64(0x9E3779B97F4A7C15)
WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
SHORT = np.array([0x589965CC75374CC3 * (k + 1) % (1 << 64) for k in range(SHINGLE)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts behind each other, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return (held[ends[0] : ends[-1]], ends - ends[0]) if len(texts) else (held[:0], np.zeros(1, dtype=np.int64))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; a word never crosses the end of a text."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def _powers(step: int, count: int) -> np.ndarray:
    """step ** 0 to step ** (count - 1), modulo 2**64."""
    out = np.full(count, step, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(int(STEP), CHUNK_BYTES + 1), _powers(pow(int(STEP), -1, 1 << 64), CHUNK_BYTES + 1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes or code points, in ascending order without overlap.

    A span's polynomial is the difference of two running sums, divided by the power of its place.  Sums begin anew every
    ``CHUNK_BYTES``, so memory stays small; a longer span has a sum of its own.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        size = int(ends[to - 1]) - base
        up = UP if size < len(UP) else _powers(int(STEP), size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((data[base : base + size].astype(np.uint64) + np.uint64(1)) * up[1 : size + 1], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * (DOWN[starts[at:to] - base] if to > at + 1 else np.uint64(1))
        at = to
    return mix(out + lengths.astype(np.uint64) * WEIGHTS[0])


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words behind each other, and the n + 1 offsets of the texts in them."""
    data, offsets = flat(texts)
    starts, ends = spans(data, offsets)
    data = (LOWER if lower else KEEP_CASE)[data]
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def one_hash(word: str) -> int:
    """The hash of one word, as ``word_hashes`` gives it."""
    return int(word_hashes(pa.array([word]))[0][0])


def shingle_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each text in order; a shorter text is one shingle, an empty one has none."""
    counts = np.diff(offsets)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(int(at[-1]), dtype=np.uint64)
    if len(words) >= SHINGLE:
        every = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            every += words[k : k + len(every)] * WEIGHTS[k]
        every = mix(every)
        long = np.flatnonzero(counts >= SHINGLE)
        taken = np.repeat(offsets[long] - at[long], made[long])
        slots = np.repeat(counts >= SHINGLE, made)
        out[slots] = every[np.flatnonzero(slots) + taken]
    for k in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[offsets[k] : offsets[k + 1]]
        out[at[k]] = mix(np.sum(own * WEIGHTS[: len(own)], keepdims=True) + SHORT[len(own) : len(own) + 1])[0]
    return out, at


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    shingles, at = shingle_hashes(*word_hashes(texts))
    for k in range(len(at) - 1):
        yield np.unique(shingles[at[k] : at[k + 1]])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.concatenate(([0], np.cumsum(sizes)))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(filled, filled[at] + limit, side="right")) - 1)
        to = min(to, rows)
        yield batch.slice(at, to - at)
        at = to

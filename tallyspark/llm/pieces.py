"""Cutting Arrow batches of texts into the pre-tokens of byte-level tokenizers, and encoding each distinct one once.

The cut is the fixed pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

worked out on arrays of code points: a pre-token begins where the class (letter, number, space, other) changes; the last
space character before something else belongs to what follows if it is a blank, else it stands alone; and an apostrophe
that begins a pre-token takes its ending along.  Pre-tokens are told apart by 64-bit hashes within a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from tallyspark.llm import words as W

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
KNOWN_PIECES = 150_000
KNOWN_CHARS = 64
SLICE_BYTES = 1 << 20


def code_classes() -> np.ndarray:
    """The class of every code point."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            found = np.frombuffer(run.group().encode("utf-32-le"), dtype="<u4")
            classes[found] = kind
    return classes


def piece_starts(codes: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places in ``codes`` where a pre-token begins; ``offsets`` are the n + 1 places where texts begin and end."""
    count = len(codes)
    if not count:
        return np.zeros(0, dtype=np.int64)
    kind = classes[codes]
    edge = np.zeros(count + 1, dtype=bool)
    edge[offsets] = True
    begins = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:-1]
    space = kind == SPACE
    # The last space character before another class in the same text.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
    begins[last] = True
    begins[last[codes[last] == ord(" ")] + 1] = False
    # An apostrophe on its own at the beginning of a pre-token, and the letters that go with it.
    marks = np.flatnonzero((codes[:-1] == ord("'")) & begins[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(marks):
        first = codes[marks + 1]
        beyond = np.minimum(marks + 2, count - 1)
        second = np.where((marks + 2 < count) & ~edge[marks + 2], codes[beyond], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        for taken, size in ((one, 2), (two, 3)):
            begins[marks[taken] + 1] = False
            after = marks[taken] + size
            begins[after[after < count]] = True
    return np.flatnonzero(begins)


class PieceEncoder:
    """Encodes batches of texts through ``encode_pieces`` (list of strings to list of packed ids).

    The ids of short pre-tokens are kept in two generations of ``KNOWN_PIECES`` each: one that is used again moves to the
    younger, and a full younger one takes the place of the elder, so that common pre-tokens never have to be encoded anew.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], added: list[str]):
        self.encode_pieces, self.encode_text = encode_pieces, encode_text
        self.added = [content.encode() for content in added]
        self.classes = code_classes()
        self.known: dict[int, bytes] = {}
        self.known_before: dict[int, bytes] = {}

    def starts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces that are encoded apart begin."""
        return piece_starts(codes, offsets, self.classes)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and the n + 1 offsets of the texts; null counts as empty."""
        data, byte_offsets = W.flat(texts)
        raw = data.tobytes()
        if any(content in raw for content in self.added):
            return self._one_by_one(raw, byte_offsets)
        text = raw.decode()
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        offsets = leads[byte_offsets]
        starts = self.starts(codes, offsets)
        ends = np.concatenate((starts[1:], [len(codes)]))[: len(starts)]
        hashes = W.hash_spans(codes, starts, ends)
        coded = pa.array(hashes).dictionary_encode()
        kinds, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        first = np.empty(len(kinds), dtype=np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        packed = self._look_up(kinds, text, starts[first], ends[first])
        sizes = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        pool = np.frombuffer(b"".join(packed), dtype="<u4")
        from_pool = np.cumsum(sizes) - sizes
        own = sizes[which]
        filled = np.concatenate(([0], np.cumsum(own)))
        ids = pool[np.arange(filled[-1]) - np.repeat(filled[:-1] - from_pool[which], own)]
        return ids, filled[np.searchsorted(starts, offsets)]

    def _look_up(self, kinds: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        if len(self.known) > KNOWN_PIECES:
            self.known, self.known_before = {}, self.known
        names = kinds.tolist()
        found = list(map(self.known.get, names))
        missing = [k for k, ids in enumerate(found) if ids is None]
        fresh = []
        for k in missing:
            ids = self.known_before.get(names[k])
            if ids is None:
                fresh.append(k)
            else:
                found[k] = self.known[names[k]] = ids
        if fresh:
            pieces = [text[at:to] for at, to in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
            for k, piece, ids in zip(fresh, pieces, self.encode_pieces(pieces), strict=True):
                found[k] = ids
                if len(piece) <= KNOWN_CHARS:
                    self.known[names[k]] = ids
        return found

    def _one_by_one(self, raw: bytes, byte_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the rare batch with the string of an added token in it: its texts apart, those without that string as ever."""
        parts, sizes = [], []
        for at, to in zip(byte_offsets[:-1].tolist(), byte_offsets[1:].tolist(), strict=True):
            text = raw[at:to]
            if any(content in text for content in self.added):
                ids = np.frombuffer(self.encode_text(text.decode()), dtype="<u4")
            else:
                ids = self.encode_batch(pa.array([text.decode()]))[0]
            parts.append(ids)
            sizes.append(len(ids))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

"""Byte pairs and token shards against the tokenizers library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import bpe, pieces, token_store, words
from tallyspark.llm.shared import shared_folder

LIBRARY = Tokenizer.from_file(bpe.vocabulary_path())
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'r", "'re", "'", "1", "²", "é", "ß", "\x1c", "\x85", "​", "　", "😀", "<|endoftext|>", "<|end", "漢", "_", "!", "\x00",
         "ǅ", "the", " th", "aaaa", "'d", "'ve", "T"]
ROWS = [(5, "Hello world's end"), (1, None), (2, ""), (None, "no id"), (3, "it<|endoftext|>is"), (4, " \n\n  x"), (4, "second text"), (5, "Hello world's end"),
        (7, "ab" * 3000 + " " + "x y " * 2000), (6, "é" * 400)]


def want_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def numbers(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_match_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    own = bpe.codec(bpe.vocabulary_path())
    for at in range(0, len(texts), 30):
        part = texts[at : at + 30] if at % 60 else [t.replace("<|endoftext|>", "") for t in texts[at : at + 30]]
        ids, offsets = own.batches.encode_batch(pa.array(part))
        for k, text in enumerate(part):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == want_ids(text), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_round_trips(text):
    own = bpe.codec(bpe.vocabulary_path())
    packed = own.encode(text)
    assert numbers(packed) == want_ids(text)
    assert own.decode(packed) == text


def test_decoding_any_ids_matches_the_library():
    rng, own = random.Random(4), bpe.codec(bpe.vocabulary_path())
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([4_000_000_000], "<u4").tobytes()) == ""


@pytest.mark.parametrize("size", [250, 260, 5000])
def test_long_pieces(size):
    own = bpe.codec(bpe.vocabulary_path())
    for text in ("ab" * size, "a" * (2 * size + 1), "thereis" * size):
        assert numbers(own.merge(text)) == want_ids(text)


def test_encode_and_decode_tables(make):
    docs = make(ROWS, ("ids", "keep"))
    encoded = bpe.encode(docs)
    decoded = bpe.decode(encoded).collect()
    assert set(encoded.columns) == {"doc_id", "text", "keep", "ids"}
    assert sorted((r.doc_id or 0, numbers(r.ids), r.decoded) for r in decoded) == sorted((i or 0, want_ids(t), t or "") for i, t in ROWS)
    digests = bpe.digests(docs).collect()
    want = sorted((i or 0, len(want_ids(t)), hashlib.sha256(np.array(want_ids(t), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == want


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    packed = token_store.pack(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert (token_store.unpack(np.frombuffer(packed, np.uint8), 1001, bits) == ids).all()


def test_shard_random_access():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, 50).tolist()
    ids = rng.integers(0, 50257, sum(sizes)).astype("<u4")
    data = token_store.shard_bytes([None, *range(49)], sizes, ids, token_store.bits_for(50257), block_ids=64)
    shard = token_store.Shard(data)
    assert shard.bits == 16 and shard.doc_ids == [None, *range(49)]
    for start, stop in ((0, 0), (0, 1), (63, 65), (100, 900), (0, len(ids))):
        assert (shard.ids(start, stop) == ids[start:stop]).all()
    ends = np.cumsum(sizes)
    for k, (_, at, own) in enumerate(shard.documents()):
        assert at == ends[k] - sizes[k]
        assert own.tolist() == ids[at : ends[k]].tolist() == shard.document(k).tolist()


def test_vocabulary_bits():
    assert [token_store.bits_for(n) for n in (1, 2, 3, 4, 5, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 22])
def test_store_round_trip(make, spark, shard_ids):
    docs = make(ROWS, ("start", "file"))
    folder = shared_folder(spark, "test-tokens")
    manifest = token_store.write_shards(docs, folder, shard_ids=shard_ids, block_ids=64)
    got = sorted(token_store.read_shards(spark, folder, manifest).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    packed = sorted((i or 0, len(want_ids(t)) + 1, zlib.crc32(np.array([*want_ids(t), 0], "<u4").tobytes())) for i, t in ROWS)
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == packed


def test_empty_store(make, spark):
    empty = make([(1, "x")]).where("doc_id < 0")
    folder = shared_folder(spark, "test-tokens")
    manifest = token_store.write_shards(empty, folder)
    assert token_store.read_shards(spark, folder, manifest).count() == 0
    assert bpe.digests(empty).count() == 0


def test_common_pieces_are_encoded_once_though_more_pieces_come_than_are_kept(monkeypatch):
    asked = []

    def encode(texts):
        asked.extend(texts)
        return [np.array([len(t)], dtype="<u4").tobytes() for t in texts]

    monkeypatch.setattr(pieces, "KNOWN_PIECES", 20)
    encoder = pieces.PieceEncoder(encode, lambda text: b"", [])
    for k in range(30):
        ids, offsets = encoder.encode_batch(pa.array(["the" + "".join(f" {chr(97 + j)}{'x' * k}" for j in range(10)), None]))
        assert ids.tolist() == [3] + [k + 2] * 10 and offsets.tolist() == [0, 11, 11]
    assert asked.count("the") == 1 and len(encoder.known) + len(encoder.known_before) <= 64


def test_token_store_pieces_have_the_ids_of_the_library():
    texts = ["", " ", "it's  a\tdog's 12 día   x\n\n y", "<|endoftext|>a <|endoftext|>", "漢字 👩‍👩‍👧 'll 're'veil", "a" * 300, None, "\x00\x7f \x85z"]
    encoder, _ = token_store._tokenizer(bpe.vocabulary_path())
    for some in (texts, [t for t in texts if t is None or "<|" not in t]):
        ids, offsets = encoder.encode_batch(pa.array(some))
        want = [want_ids(t) for t in some]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want


def test_hashes_of_spans_depend_on_the_span_alone():
    data = np.random.default_rng(5).integers(0, 256, 3 * words.CHUNK_BYTES, dtype=np.uint8)
    starts = np.array([0, 7, 20, words.CHUNK_BYTES + 30, 2 * words.CHUNK_BYTES + 40])
    ends = np.array([7, 11, words.CHUNK_BYTES + 25, 2 * words.CHUNK_BYTES + 30, 2 * words.CHUNK_BYTES + 45])
    alone = [int(words.hash_spans(data[a:b].copy(), np.array([0]), np.array([b - a]))[0]) for a, b in zip(starts, ends, strict=True)]
    assert words.hash_spans(data, starts, ends).tolist() == alone
    mask, value = (1 << 64) - 1, 0
    for k, byte in enumerate(data[7:11].tolist()):
        value += (byte + 1) * pow(int(words.STEP), k + 1, 1 << 64)
    assert alone[1] == int(words.mix(np.array([(value + 4 * int(words.WEIGHTS[0])) & mask], dtype=np.uint64))[0])

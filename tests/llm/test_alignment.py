"""Cross-tokenizer alignment against the tokenizer libraries and plain Python."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import alignment, bpe

A = Tokenizer.from_file(bpe.vocabulary_path())
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
LETTERS = bpe.byte_letters()
ROWS = [(1, "Hello world's end"), (2, None), (3, ""), (None, "no id here"), (4, "it<|endoftext|>is <s> and </s> <0x41>"), (5, "has ▁ in it"),
        (6, "é漢字 😀 naïve ​"), (7, "Hello world's end"), (7, "other text of one id"), (8, "ab" * 3000 + " " + "x y " * 3000), (9, " \n\t  x"), (10, "a\x00b")]


def side_a(text):
    found = A.encode(" " + text, add_special_tokens=False)
    return found.ids, [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in found.ids]


def side_b(text):
    ids = B.encode(text)
    return ids, [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def want_of(text):
    """(ids of A, ids of B, groups, links) by going over all pairs of a text's tokens."""
    if not text:
        return [], [], [], []
    (a, bytes_a), (b, bytes_b) = side_a(text), side_b(text)
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], [], []
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, at_a, at_b = [], [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        to_a, to_b = ends_a.index(end, at_a) + 1, ends_b.index(end, at_b) + 1
        groups.append((a[at_a:to_a], b[at_b:to_b]))
        for i in range(at_a, to_a):
            for j in range(at_b, to_b):
                if max(ends_a[i] - len(bytes_a[i]), ends_b[j] - len(bytes_b[j])) < min(ends_a[i], ends_b[j]):
                    links.append((a[i], b[j]))
        at_a, at_b = to_a, to_b
    return a, b, groups, links


def statistics(rows):
    every = [(i, want_of(text)) for i, text in rows]
    counts = collections.Counter(link for _, found in every for link in found[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, (a, b, groups, links) in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i or 0, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400), unique=True, max_size=300), st.lists(st.integers(0, 400), unique=True, max_size=300))
def test_galloping_ranks(short, long):
    short, long = np.array(sorted(short), dtype=np.int64), np.array(sorted(long), dtype=np.int64)
    assert alignment.ranks(short, long).tolist() == np.searchsorted(long, short).tolist()


def test_long_jumps():
    long = np.arange(100_000)
    short = np.array([0, 1, 2, 50_000, 50_001, 99_999, 200_000])
    assert alignment.ranks(short, long).tolist() == [0, 1, 2, 50_000, 50_001, 99_999, 100_000]


@pytest.mark.parametrize("slice_bytes", [1, 40, 4 << 20])
def test_statistics_against_all_pairs(make, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "PAIRS_BYTES", slice_bytes)
    rng = random.Random(slice_bytes)
    rows = ROWS + [(20 + k, " ".join(rng.choice(["the", "Thing", "naïve", "x1", "2024", "été", "\n", "foo_bar", "ation"]) for _ in range(rng.randint(0, 40)))) for k in range(30)]
    docs = make(rows, ("slice", "held", "n_a", "pair"))
    got = alignment.link_statistics(docs).collect()
    found = sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert found == statistics(rows)


def test_groups(make):
    got = {(r.doc_id, tuple(r.a_ids)): r for r in alignment.align(make(ROWS, ("a_ids", "b_ids", "keep"))).collect()}
    for i, text in ROWS:
        a, b, groups, _ = want_of(text)
        r = got[(i, tuple(a))]
        assert r.b_ids == b
        assert r.a_ends == np.cumsum([len(x) for x, _ in groups], dtype=int).tolist() and r.b_ends == np.cumsum([len(y) for _, y in groups], dtype=int).tolist()


def test_texts_without_tokens(make, spark):
    zeros = alignment.link_statistics(make([(1, None), (2, ""), (3, "▁")])).collect()
    assert sorted(tuple(r) for r in zeros) == [(k, 0, 0, 0, 0, "", 0, 0) for k in (1, 2, 3)]
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.link_statistics(empty).count() == 0
    assert alignment.align(empty).schema["doc_id"].dataType.simpleString() == "string"


def test_query_columns_and_test_table(spark):
    from tallyspark.llm import queries

    df = queries.QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 4000).collect()]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.link_statistics(small).collect())
    assert got == statistics(rows)


def test_pieces_between_blanks_match_the_library():
    rng, own = random.Random(8), alignment._worker(*alignment.tokenizers_of(None, None))
    parts = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "the", " the", "1", "é", "　", "\xa0", "😀", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "ing", "\x00", "\x85", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, a, b in zip(part, *own.encode(part), strict=True):
            want = want_of(text)
            assert (a.tolist(), b.tolist()) == (want[0], want[1]), repr(text)

"""Spelling variants against plain Python, with states of every size."""

import collections
import random
import re
import zlib

import pytest

from tallyspark.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def counts_of(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def want_of(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def shown(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def random_words(seed, letters, sizes, count):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(count)})


@pytest.mark.parametrize(("letters", "sizes", "count"), [("ab", (6, 9), 400), ("abé", (6, 8), 500), ("ab😀", (6, 7), 300), ("abcdefghij", (6, 7), 400)])
@pytest.mark.parametrize("state_words", [1, 3, 20_000])
def test_pairs_against_all_pairs(spark, letters, sizes, count, state_words):
    words = random_words(count, letters, sizes, count)
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n bigint").repartition(3)
    got = sorted((r.word, r.n, r.near, r.near_n) for r in variants.near_pairs(df, state_words=state_words).collect())
    assert got == sorted((a, i, b, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b))


def test_acceptor_is_minimal():
    acceptor = variants.Acceptor()
    start = acceptor.add(["aab", "abb", "bab", "bbb"])
    assert len(acceptor.states) == 4 and acceptor.common(start, start) == ["aab", "abb", "bab", "bbb"]
    assert acceptor.add([]) is None


def documents():
    rng = random.Random(2)
    words = random_words(9, "abé", (6, 8), 60)
    weighted = [w for k, w in enumerate(words) for _ in range(1 + (k % 7) ** 3)]
    text = [" ".join(rng.choice([w, w.upper(), w.capitalize()]) for w in rng.choices(weighted, k=40)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(text)]
    rows += [(900 + k, " ".join([word] * n)) for k, (word, n) in enumerate([("querty", 6), ("quarty", 40), ("quarts", 400), ("quartz", 2500)])]
    return [*rows, (None, text[0]), (1, None), (2, ""), (3, "x" * 5000 + " short Été-ÉTÉ " + "abc×÷abc " * 9), (4, text[4]), (4, text[5]), (4, text[4])]


def test_variants_against_plain_python(make):
    rows = documents()
    words = counts_of(rows)
    want = want_of(words)
    assert any(w[3] for w in want) and any(w[5] != w[3] and w[3] for w in want)
    docs = make(rows, ("word", "n", "root", "state"))
    assert shown(variants.variants(docs)) == want
    assert shown(variants.variants(docs, state_words=2)) == want


def test_held_words_are_flushed(make, monkeypatch):
    rows = documents()
    monkeypatch.setattr(variants, "HELD_WORDS", 3)
    assert {r.word: r.n for r in variants.word_counts(make(rows)).collect()} == counts_of(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert variants.variants(empty).count() == 0

"""Line dedup and quality rules against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, quality_rules

SPACE = " \t\n\x0b\x0c\r"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least):
    keys = [[line.strip(SPACE).translate(AZ) for line in (text or "").split("\n")] for _, text in rows]
    found = Counter(k for (i, t), own in {(i, t): k for (i, t), k in zip(rows, keys, strict=True)}.items() for k in set(own) if k)
    out = []
    for (doc_id, text), own in zip(rows, keys, strict=True):
        left = [line for line, k in zip((text or "").split("\n"), own, strict=True) if not (k and found[k] >= least)]
        kept = "\n".join(left)
        out.append((doc_id, len(own), len(own) - len(left), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ROWS = [
    (1, "Header\nalpha\n\nFooter"), (2, " header \nbeta\nFOOTER\t"), (3, "HEADER\ngamma\nfooter\nheader"), (4, None), (5, ""), (None, "header\nnull id"),
    (6, "É header\nÉ HEADER"), (7, "é header"), (8, "header"), (8, "header"), (9, "\n" * 200 + "footer\r\n" + "x" * 70_000 + "\nheader\n"), (8, "other text\nfooter"),
]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


@pytest.mark.parametrize("least", [2, 3, 6])
def test_lines_match_plain_python(make, least):
    left = line_dedup.dedup_lines(make(ROWS, ("keep", "pos", "line", "key", "h1", "word")), min_documents=least)
    got = left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert by_row(map(tuple, got)) == by_row(brute_lines(ROWS, least))
    assert {"keep", "pos", "line", "key", "h1", "word"} <= set(left.columns)


def test_first_occurrence_may_stay(make):
    left = line_dedup.dedup_lines(make([(1, "a\nb"), (2, "b\na"), (3, "c\nA")]), min_documents=2, keep_first=True)
    assert {r.doc_id: r.text for r in left.collect()} == {1: "a\nb", 2: "", 3: "c"}


def test_bitmaps_hold_only_cleared_words(make):
    text = "\n".join(f"own {i}" for i in range(130)) + "\nshared"
    maps = line_dedup.keep_bitmaps(make([(1, text), (2, "shared")]), min_documents=2).collect()
    assert {r.doc_id: [(w.word, w.bits) for w in r.keep] for r in maps} == {1: [(2, ~(1 << 2))], 2: [(0, ~1)]}


def test_empty_table(make, spark):
    empty = make([(1, "x")]).where("doc_id < 0")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert quality_rules.quality_scores(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


GOOD = "The quick brown fox jumps over the lazy dog, and then it sleeps. Nobody minds it at all today."
TEXTS = [
    (1, GOOD), (2, None), (3, ""), (4, "one two"), (5, "spam ham " * 40), (6, "a b c d e a b c d e f g h i j k l m n o p"), (None, GOOD + "\n" + GOOD + "\n\n\x0b\n "),
    (7, "BUY!! NOW!! " * 30), (8, " ".join(f"wo{i}rd###" for i in range(50))), (9, "é ü 漢 😀 " + GOOD), (1, GOOD), (10, "\t".join(f"w{i}" for i in range(20_000))),
    (11, "a a a a a a a"), (12, "x" * 100_000), (13, GOOD.replace(" ", "\x0c")),
]


def brute_em(patterns, rounds=100, prior=0.8, trust=1.0):
    """Expectation-maximisation over single rows instead of counted ones."""
    beliefs, total = quality_rules.BELIEFS, len(patterns)
    odds = [{v: math.log(g[v] / b[v]) for v in g} for g, b in beliefs]
    for _ in range(rounds):
        odds = [{v: (min(x, 0) if v < 0 else max(x, 0) if v > 0 else x) for v, x in o.items()} for o in odds]
        share = [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(odds[k][v] for k, v in enumerate(p))))) for p in patterns]
        mass, odds = sum(share), []
        for k, (g, b) in enumerate(beliefs):
            good = {v: (sum(s for s, p in zip(share, patterns, strict=True) if p[k] == v) + trust * total * g[v]) / (mass + trust * total) for v in g}
            bad = {v: (sum(1 - s for s, p in zip(share, patterns, strict=True) if p[k] == v) + trust * total * b[v]) / (total - mass + trust * total) for v in b}
            odds.append({v: math.log(good[v] / bad[v]) for v in g})
        prior = (mass + trust * total * 0.8) / (total + trust * total)
    odds = [{v: (min(x, 0) if v < 0 else max(x, 0) if v > 0 else x) for v, x in o.items()} for o in odds]
    return [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(odds[k][v] for k, v in enumerate(p))))) for p in patterns]


def test_measures_and_verdicts_match_plain_python(make):
    docs = make(TEXTS, ("n_words", "kept", "measures", "votes"))
    got = quality_rules.quality_scores(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r.doc_id or 0, *(r[n] for n in names)) for r in got) == sorted((i or 0, *brute_measures(t)) for i, t in TEXTS)
    measured = quality_rules.with_measures(docs)
    votes = measured.select("doc_id", *[v.alias(f"v{k}") for k, v in enumerate(quality_rules.rule_votes(F.col("__measures")).values())]).collect()
    chances = brute_em([tuple(r)[1:] for r in votes])
    want = sorted((r.doc_id or 0, round(c, 6)) for r, c in zip(votes, chances, strict=True))
    assert sorted((r.doc_id or 0, round(r.probability, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.probability >= 0.5) for r in got)
    kept = {r.doc_id for r in got if r.kept}
    assert {1, 9} <= kept and not kept & {2, 3, 4, 5, 7, 8}


def test_kept_rows_are_unchanged(make):
    docs = make(TEXTS, ("kept", "__x"))
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(r.doc_id or 0 for r in quality_rules.quality_scores(docs).where("kept").collect())
    assert sorted(r.doc_id or 0 for r in kept.collect()) == want

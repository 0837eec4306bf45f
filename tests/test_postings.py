"""Top-k over the inverted index against brute force, with early stopping and cut postings."""

import random
from collections import defaultdict

import pytest

from tallyspark.functions.postings import top_items


def data(seed, negative):
    rng = random.Random(seed)
    items, asked = [], []
    vocabulary = [f"t{k}" for k in range(30)]
    for g in "ab":
        for i in range(60):
            # Frequent terms come first in the vocabulary and weigh little, as in BM25.
            for k, t in enumerate(vocabulary):
                if rng.random() < 0.9 / (k + 1) + 0.02:
                    items.append((f"{g}{i}", g, t, round(rng.uniform(-0.2 if negative and k < 4 else 0.0, 0.2 + k / 10), 2)))
        for q in range(12):
            for t in rng.sample(vocabulary, rng.randint(1, 12)):
                asked.append((f"q{g}{q}", g, t, float(rng.randint(1, 3))))
    return asked, items


def brute(asked, items, k):
    scores = defaultdict(lambda: defaultdict(float))
    held = defaultdict(list)
    for i, g, t, w in items:
        held[g, t].append((i, w))
    for q, g, t, c in asked:
        for i, w in held[g, t]:
            scores[q][i] += c * w
    return sorted((q, i, round(s, 6) + 0.0, r) for q, found in scores.items()
                  for r, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k], 1))


@pytest.mark.parametrize(("seed", "negative", "part_rows", "head"), [(1, False, 1000, 0.1), (2, True, 7, 0.1), (3, False, 5, 0.5), (4, True, 1000, 0.0), (5, True, 6, 1.0)])
def test_top_items_match_brute_force(spark, seed, negative, part_rows, head):
    asked, items = data(seed, negative)
    queries = spark.createDataFrame(asked, "query_id string, db string, term string, weight double")
    postings = spark.createDataFrame(items, "item_id string, db string, term string, weight double").repartition(3)
    for k in (1, 4, 500):
        got = top_items(queries, postings, k, ["db"], part_rows=part_rows, head=head).collect()
        assert sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in got) == brute(asked, items, k)


def test_frequent_terms_are_not_read_for_every_item(spark):
    """A query with one rare, heavy term: the frequent one is looked up for the items that hold the rare one only."""
    postings = [(i, "the", 0.01) for i in range(2000)] + [(i, "rare", 5.0) for i in range(3)]
    df = top_items(spark.createDataFrame([(1, "the", 1.0), (1, "rare", 1.0)], "query_id int, term string, weight double"),
                   spark.createDataFrame(postings, "item_id int, term string, weight double"), 2)
    assert [(r.item_id, r.score) for r in df.orderBy("rank").collect()] == [(0, 5.01), (1, 5.01)]


def test_no_queries_and_no_items(spark):
    asked = spark.createDataFrame([(1, "a", 1.0)], "query_id int, term string, weight double")
    postings = spark.createDataFrame([(1, "b", 1.0)], "item_id int, term string, weight double")
    assert top_items(asked, postings, 3).count() == 0
    assert top_items(asked.limit(0), postings, 3).count() == 0
    assert top_items(asked, postings.limit(0), 3).count() == 0

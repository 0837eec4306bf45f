"""Exact joins and block retrieval against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions.blocks import block_topk, vector_scorer
from tallyspark.functions.editjoin import edit_join
from tallyspark.operators import joins as J
from tallyspark.operators import retrieval as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.8, 0.88])
def test_edit_join_finds_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    def noisy(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(3)
            p = rng.randrange(len(s) + 1)
            if k == 0:
                s.insert(p, rng.choice("abc"))
            elif k == 1 and len(s) > 1:
                s.pop(min(p, len(s) - 1))
            elif s:
                s[min(p, len(s) - 1)] = rng.choice("abc")
        return "".join(s)
    lefts = sorted({noisy(s) for s in base for _ in range(2)} - {""})
    rights = sorted(set(base))
    got = edit_join(spark.createDataFrame([(s,) for s in lefts], "left_text string"),
                    spark.createDataFrame([(s,) for s in rights], "right_text string"), cutoff)
    found = {(r["left_text"], r["right_text"]) for r in got.collect()}
    expected = {(a, b) for a in lefts for b in rights if distance(a, b) <= int((1 - cutoff) * max(len(a), len(b)) + 1e-9)}
    assert found == expected


@pytest.mark.parametrize("block_rows", [7, 64, 1000])
def test_block_topk_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(3)
    q, i = rng.normal(size=(45, 8)), rng.normal(size=(80, 8))
    queries = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(q)], "query_id int, vector array<double>")
    items = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(i)], "item_id int, vector array<double>")
    rows = block_topk(queries, items, vector_scorer("cosine"), 5, block_rows=block_rows).collect()
    m = np.round((q @ i.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(i, axis=1)[None, :]), 6)
    for n in range(len(q)):
        expected = sorted(range(len(i)), key=lambda c: (-m[n, c], c))[:5]
        assert [r["item_id"] for r in sorted((r for r in rows if r["query_id"] == n), key=lambda r: r["rank"])] == expected


def test_block_topk_stays_inside_groups(spark):
    queries = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0]), (3, "c", [1.0])], "query_id int, db_id string, vector array<double>")
    items = spark.createDataFrame([(n, "a" if n < 30 else "b", [float(n)]) for n in range(60)], "item_id int, db_id string, vector array<double>")
    rows = block_topk(queries, items, vector_scorer("dot"), 2, ["db_id"], block_rows=4).collect()
    assert sorted((r["query_id"], r["item_id"]) for r in rows) == [(1, 28), (1, 29), (2, 58), (2, 59)]


def test_similar_values_by_substring(spark):
    rows = [("d", "t", "c", v) for v in ("New York", "york", "Yorkshire", "Paris", "x" * 60 + "york")] + [("e", "t", "c", "Yorktown")]
    values = spark.createDataFrame(rows, "db_id string, table_name string, column_name string, value string")
    literals = spark.createDataFrame([("d", "york"), ("d", "a"), ("f", "york")], "db_id string, literal string")
    got = {(r["literal"], r["value"]) for r in J.find_similar_values(values, literals).collect()}
    assert got == {("york", "New York"), ("york", "york"), ("york", "Yorkshire")}


def test_ngram_link_prefers_exact(spark):
    q = spark.createDataFrame([(1, "d", "show the song name of singer")], "query_id int, db_id string, question string")
    names = spark.createDataFrame([("d", "col", "song_name", "song_name"), ("d", "col", "name", "name"), ("d", "tab", "singer_in_concert", "singer_in_concert")], "db_id string, kind string, item string, name string")
    got = {(r["pos"], r["item"]): r["flag"] for r in R.ngram_link(q, names).collect()}
    assert got == {(2, "song_name"): "CEM", (3, "song_name"): "CEM", (3, "name"): "CEM", (5, "singer_in_concert"): "TPM"}


def test_resolve_overlaps_reuses_choices(spark):
    rows = [(1, 2, "col", "song_name", "CEM"), (1, 3, "col", "song_name", "CEM"), (1, 3, "col", "name", "CEM"), (1, 5, "tab", "a", "TPM"), (1, 5, "tab", "b", "TEM")]
    m = spark.createDataFrame(rows, "query_id int, pos int, kind string, item string, flag string")
    got = {(r["pos"], r["item"]) for r in R.resolve_overlaps(m).collect()}
    assert got == {(2, "song_name"), (3, "song_name"), (5, "b")}


def test_cell_runs(spark):
    q = spark.createDataFrame([(1, "d", "songs from new york by york")], "query_id int, db_id string, question string")
    values = spark.createDataFrame([("d", "t", "city", "New York"), ("d", "t", "city", "Paris"), ("e", "t", "city", "songs")],
                                   "db_id string, table_name string, column_name string, value string")
    got = {(r["pos"], r["flag"]) for r in R.cell_value_link(q, values).collect()}
    assert got == {(2, "EXACTMATCH"), (3, "EXACTMATCH"), (5, "PARTIALMATCH")}


def test_random_few_shot_draws_distinct_foreign_rows(spark):
    from tallyspark.operators.sampling import random_few_shot

    pool = spark.range(50).select(F.col("id").alias("pool_id"), (F.col("id") % 5).alias("db_id"))
    targets = spark.range(40).select(F.col("id").alias("instance_id"), (F.col("id") % 5).alias("db_id"))
    rows = random_few_shot(targets, pool, 6, cross_domain=True).join(targets, "instance_id").collect()
    by_target = {}
    for r in rows:
        assert r["pool_id"] % 5 != r["db_id"]
        by_target.setdefault(r["instance_id"], set()).add(r["pool_id"])
    assert len(by_target) == 40 and all(len(v) == 6 for v in by_target.values())


def test_fuzzy_values_of_the_own_database(spark):
    schema = "db_id string, table_name string, column_name string, value string"
    values = spark.createDataFrame([
        ("d", "t", "film", "The Lord of the Rings Return"), ("d", "t", "country", "Germany"), ("d", "t", "season_name", "Summertimes"), ("d", "t", "season", "Summertimes"),
        ("d", "t", "code", "SUMMERTIMES"), ("e", "t", "country", "summertime")], schema)
    q = spark.createDataFrame([(1, "d", "show the lord of the rings return"), (2, "d", "germany's cup"), (3, "d", "in summertime"), (4, "d", "germanys's cup")],
                              "query_id int, db_id string, question string")
    got = {(r["query_id"], r["column_name"], r["value"], round(r["score"], 3)) for r in R.fuzzy_value_match(q, values).collect()}
    assert got == {(1, "film", "The Lord of the Rings Return", 1.0), (2, "country", "Germany", 1.0), (3, "season", "Summertimes", 0.909)}


def test_column_samples_fill_up(spark):
    values = spark.createDataFrame([("d", "t", "c", f"value{k}") for k in range(10)] + [("e", "t", "c", f"other{k}") for k in range(10)],
                                   "db_id string, table_name string, column_name string, value string")
    q = spark.createDataFrame([(1, "d", "nothing in common"), (2, "d", "about value7")], "query_id int, db_id string, question string")
    rows = R.bm25_column_samples(q, values, 3).collect()
    got = {n: [r["value"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == n] for n in (1, 2)}
    assert got == {1: ["value0", "value1", "value2"], 2: ["value7", "value0", "value1"]}


def test_names_are_cut_at_every_word_boundary(spark):
    q = spark.createDataFrame([(1, "d", "list free meal counts (k-12) of été"), (2, "d", "count - k")], "query_id int, db_id string, question string")
    names = spark.createDataFrame([("d", "col", "a", "Free-Meal Count (K-12)"), ("d", "col", "b", "Free Meal"), ("d", "tab", "c", "l'Été_x")], "db_id string, kind string, item string, name string")
    got = {(r["query_id"], r["pos"], r["item"]): r["flag"] for r in R.ngram_link(q, names).collect()}
    assert got == {(1, 1, "a"): "CPM", (1, 2, "a"): "CPM", (1, 1, "b"): "CEM", (1, 2, "b"): "CEM", (1, 6, "c"): "TPM", (2, 0, "a"): "CPM", (2, 2, "a"): "CPM"}
    assert sorted(spark.range(1).select(R.boundary_stretches(F.lit("(a-b) c)"))).first()[0]) == sorted(["a", "a-", "a-b", "a-b) ", "a-b) c", "-", "-b", "-b) ", "-b) c", "b", "b) ", "b) c", ") ", ") c", "c"])


def test_similar_values_against_all_pairs(spark):
    rng = random.Random(12)
    def word():
        return "".join(rng.choice("abABé ") for _ in range(rng.randint(0, 9)))
    cells = sorted({(f"d{k % 2}", "t", f"c{k % 3}", word()) for k in range(300)}) + [("d0", "t", "c0", "x" * 20_000 + "abab" + "y" * 20_000), ("d0", "t", "c0", None)]
    asked = sorted({(f"d{k % 2}", word()[:5]) for k in range(120)}) + [("d0", "xaba"), ("d0", "aba"), ("d9", "ab"), ("d0", "zz"), ("d0", None)]
    values = spark.createDataFrame(cells, "db_id string, table_name string, column_name string, value string")
    literals = spark.createDataFrame(asked, "db_id string, literal string")
    for most in (50, None):
        got = {(r["literal"], r["db_id"], r["column_name"], r["value"]) for r in J.find_similar_values(values, literals, 10**6, most).collect()}
        assert got == {(s, d, c, v) for d, _, c, v in cells if v is not None and (most is None or len(v) < most) for e, s in asked if s and len(s) > 1 and e == d and s.lower() in v.lower()}

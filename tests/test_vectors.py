"""The partitioned vector index against brute force."""

import numpy as np
import pytest

from tallyspark.functions import vectors as V
from tallyspark.operators import retrieval as R
from tallyspark.session import checkpoint_dir


def points(seed, count, dims=12, clumps=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clumps, dims)) * 4
    return centres[rng.integers(0, clumps, count)] + rng.normal(size=(count, dims)) * rng.choice([0.2, 1.0], size=(count, 1))


def scores_of(q, i, metric):
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(i, axis=1)[None]
        return np.divide(q @ i.T, norms, out=np.zeros((len(q), len(i))), where=norms > 0)
    return q @ i.T if metric == "dot" else -np.linalg.norm(q[:, None] - i[None], axis=2)


def frames(spark, q, i, groups=1):
    queries = spark.createDataFrame([(n, f"g{n % groups}", v.tolist()) for n, v in enumerate(q)], "query_id int, g string, vector array<double>")
    items = spark.createDataFrame([(n, f"g{n % groups}", v.tolist()) for n, v in enumerate(i)], "item_id int, g string, vector array<double>").repartition(3)
    return queries, items


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("groups", [1, 3])
def test_search_is_exact(spark, metric, groups):
    q, i = points(1, 40), points(2, 300)
    i[5] = 0
    i[7] = i[8]
    queries, items = frames(spark, q, i, groups)
    index = V.build_index(items, metric, cells=15, sample_rows=100)
    m = np.round(scores_of(q, i, metric), 6)
    got = V.search(index, queries, 6, ["g"]).collect()
    for n in range(len(q)):
        own = [c for c in range(len(i)) if c % groups == n % groups]
        want = sorted(own, key=lambda c: (-m[n, c], c))[:6]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_id"] == n), key=lambda r: r["rank"])] == want


def test_thresholds_and_exclusions(spark):
    q, i = points(3, 25), points(4, 200)
    queries, items = frames(spark, q, i)
    m = np.round(scores_of(q, i, "cosine"), 6)
    index = V.build_index(items.withColumn("vec_id", items["item_id"]), "cosine", cells=10)
    got = V.search(index, queries.withColumn("vec_id", queries["query_id"]), 5, exclude_same=["vec_id"], min_score=0.7).collect()
    for n in range(len(q)):
        want = sorted((c for c in range(len(i)) if c != n and m[n, c] > 0.7), key=lambda c: (-m[n, c], c))[:5]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_id"] == n), key=lambda r: r["rank"])] == want


def test_bounds_rule_cells_out_and_probes_find_most(spark):
    q, i = points(5, 60, clumps=20), points(5, 800, clumps=20)
    queries, items = frames(spark, q, i)
    index = V.build_index(items, "euclidean", cells=20)
    m = np.round(scores_of(q, i, "euclidean"), 6)
    want = {(n, c) for n in range(len(q)) for c in sorted(range(len(i)), key=lambda c: (-m[n, c], c))[:5]}
    near = {(r["query_id"], r["item_id"]) for r in V.search(index, queries, 5, probes=3).collect()}
    assert len(near & want) >= 0.9 * len(want)
    bounds = np.array([r[0] for r in queries.select(V._bounds(index)("vector")).collect()])
    kth = np.sort(m, axis=1)[:, -5]
    assert (bounds >= kth[:, None]).mean() < 0.5  # most cells need not be read
    cells = {r["item_id"]: r["_cell"] for r in index.rows.collect()}
    assert len(cells) == len(i) and all(bounds[n, cells[c]] >= m[n, c] - 1e-6 for n in range(len(q)) for c in range(len(i)))


def test_written_index(spark):
    q, i = points(6, 10), points(7, 100)
    queries, items = frames(spark, q, i)
    index = V.build_index(items, "cosine")
    path = f"{checkpoint_dir(spark)}/vector-index-{id(index)}"
    V.write_index(index, path)
    again = V.read_index(spark, path)
    assert sorted(map(tuple, V.search(index, queries, 3).collect())) == sorted(map(tuple, V.search(again, queries, 3).collect()))


def test_empty_sides(spark):
    queries, items = frames(spark, points(8, 3), points(9, 5))
    assert V.search(V.build_index(items.limit(0), "dot"), queries, 3).count() == 0
    assert V.search(V.build_index(items, "dot"), queries.limit(0), 3).count() == 0


def test_similar_skeletons(spark):
    texts = ["select _ from _", "select _ from _ where _", "select _ , _ from _ where _ and _", "insert _", "a b c d e f", "a b c d e g", "a b c d e f g", ""]
    df = spark.createDataFrame([(t,) for t in texts], "skeleton string")
    for threshold in (0.5, 0.7, 0.85, 1.0):
        got = {tuple(r) for r in R.similar_skeletons(df, df, threshold).collect()}
        sets = {t: set(t.split()) for t in texts}
        assert got == {(a, b) for a in texts for b in texts if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_queries_are_sent_to_parts_not_to_cells(spark, monkeypatch):
    rng = np.random.default_rng(10)
    queries, items = frames(spark, rng.normal(size=(50, 12)), rng.normal(size=(400, 12)))
    sent, scorer = spark.sparkContext.accumulator(0), V.vector_scorer

    def counted(*args):
        own = scorer(*args)

        def score(q, i):
            sent.add(len(q))
            return own(q, i)

        return score

    monkeypatch.setattr(V, "vector_scorer", counted)
    index = V.build_index(items, "euclidean", cells=20)
    assert V.search(index, queries, 5).count() == 250
    assert sent.value <= 2 * 50  # once for each phase, as all cells fit one part; it was once for each cell


def test_parts_hold_whole_cells_up_to_a_block(spark):
    rows = spark.createDataFrame([(c, c % 2) for c in (0, 1, 1, 2, 4, 5, 5, 5) for _ in range(500)], "_cell int, g int")
    index = V.VectorIndex(rows, np.zeros((7, 2)), np.zeros(7), "dot")
    assert V._parts(index, ["g"], 32768) == [0, 1, 2, 2, 2, 3, 4]  # 500, 1000, 500, 0, 500, 1500, 0

"""Result comparison against plain-Python loops on random small results."""

import math
import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import compare as C
from tallyspark.operators import selection as S

CELLS = "instance_id int, candidate int, row_no bigint, col_no int, num_value double, str_value string"
SHAPES = "instance_id int, candidate int, n_rows bigint, n_cols bigint"


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-2)
    return a == b


def order_key(x):
    return (x is None, type(x).__name__, str(x))


def column(rows, c, ignore_order):
    values = [r[c] for r in rows]
    return sorted(values, key=order_key) if ignore_order else values


def match(pred, gold, ignore_order=False, reuse=False):
    """Greedy (or sharing) column assignment."""
    (pr, pw), (gr, gw) = pred, gold
    used = set()
    for g in range(gw):
        left = column(gr, g, ignore_order)
        found = None
        for p in range(pw):
            right = column(pr, p, ignore_order)
            if (reuse or p not in used) and len(left) == len(right) and all(close(a, b) for a, b in zip(left, right)):
                found = p
                break
        if found is None:
            return 0
        used.add(found)
    return 1


def norm(x):
    return None if x is None else round(x, 2) if isinstance(x, float) else x


def rowset(pred, gold):
    (pr, pw), (gr, gw) = pred, gold
    if (len(pr), pw) != (len(gr), gw):
        return 0
    return int({tuple(map(norm, r)) for r in pr} == {tuple(map(norm, r)) for r in gr})


def multiset(pred, gold, ordered=False):
    (pr, pw), (gr, gw) = pred, gold
    if len(pr) != len(gr):
        return 0
    if not pr:
        return 1
    if pw != gw:
        return 0
    for perm in permutations(range(pw)):
        moved = [tuple(r[i] for i in perm) for r in pr]
        if moved == gr or (not ordered and sorted(moved, key=str) == sorted(gr, key=str)):
            return 1
    return 0


def soft(pred, gold):
    def text(r):
        return "\x1f".join("0" if x is None else f"n{x}" if isinstance(x, float) else f"s{x}" for x in r)

    pr, gr = sorted(set(pred[0]), key=text), sorted(set(gold[0]), key=text)
    if not pr and not gr:
        return 1.0
    if not pr or not gr:
        return 0.0
    tp = fp = fn = 0.0
    for i, g in enumerate(gr):
        if i >= len(pr):
            fn += 1
            continue
        p = pr[i]
        tp += sum(any(close(a, b) for b in g) for a in p) / len(g)
        fp += sum(not any(close(a, b) for b in g) for a in p) / len(g)
        fn += sum(not any(close(a, b) for b in p) for a in g) / len(g)
    fp += max(0, len(pr) - len(gr))
    p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def value(rng):
    return rng.choice([None, 1.0, 1.004, 2.0, 2.5, "a", "b"])


def random_results(seed, instances=60):
    rng = random.Random(seed)
    results = {}
    for i in range(instances):
        width, height = rng.randint(1, 3), rng.randint(0, 3)
        gold = [tuple(value(rng) for _ in range(width)) for _ in range(height)]
        results[i, 0] = (gold, width)
        for c in range(1, 5):
            rows, w = list(gold), width
            kind = rng.randrange(6)
            if kind == 1:
                rng.shuffle(rows)
            elif kind == 2:
                perm = list(range(width))
                rng.shuffle(perm)
                rows = [tuple(r[k] for k in perm) for r in rows]
            elif kind == 3:
                rows, w = [r + (value(rng),) for r in rows], width + 1
            elif kind == 4:
                rows = [tuple(x + 0.003 if isinstance(x, float) else x for x in r) for r in rows]
            elif kind == 5:
                w = rng.randint(1, 3)
                rows = [tuple(value(rng) for _ in range(w)) for _ in range(rng.randint(0, 3))]
            results[i, c] = (rows, w)
    return results


@pytest.fixture(scope="module")
def results():
    return random_results(5)


@pytest.fixture(scope="module")
def frames(spark, results):
    cells, shapes = [], []
    for (i, c), (rows, width) in results.items():
        shapes.append((i, c, len(rows), width))
        for n, row in enumerate(rows):
            for k, x in enumerate(row):
                cells.append((i, c, n, k, x if isinstance(x, float) else None, x if isinstance(x, str) else None))
    return spark.createDataFrame(cells, CELLS).cache(), spark.createDataFrame(shapes, SHAPES).cache()


def scores(df, name="score"):
    return {(r["instance_id"], r["candidate"]): r[name] for r in df.collect()}


@pytest.mark.parametrize("ignore_order,reuse", [(False, False), (True, False), (False, True), (True, True)])
def test_execution_match(results, frames, ignore_order, reuse):
    got = scores(C.execution_match(frames[0], ignore_order=ignore_order, reuse_columns=reuse, shapes=frames[1]))
    expected = {k: match(v, results[k[0], 0], ignore_order, reuse) for k, v in results.items() if k[1]}
    assert got == expected


def test_rowset_equal(results, frames):
    got = scores(C.rowset_equal(frames[0], frames[1]))
    assert got == {k: rowset(v, results[k[0], 0]) for k, v in results.items() if k[1]}


@pytest.mark.parametrize("ordered", [False, True])
def test_multiset_equal(results, frames, ordered):
    got = scores(C.multiset_equal_any_column_order(frames[0], ordered, frames[1]))
    assert got == {k: multiset(v, results[k[0], 0], ordered) for k, v in results.items() if k[1]}


def test_soft_f1(results, frames):
    got = scores(C.soft_f1(frames[0], frames[1]))
    for k, v in results.items():
        if k[1]:
            assert got[k] == pytest.approx(soft(v, results[k[0], 0])), (k, v, results[k[0], 0])


def test_strict_needs_same_width(spark):
    rows = [(1, 0, 0, 0, 1.0, None), (1, 1, 0, 0, 1.0, None), (1, 1, 0, 1, 9.0, None), (1, 2, 0, 0, 1.001, None)]
    cells = spark.createDataFrame(rows, CELLS)
    assert scores(C.execution_match(cells)) == {(1, 1): 1, (1, 2): 1}
    assert scores(C.execution_match(cells, strict_columns=True)) == {(1, 1): 0, (1, 2): 1}


def test_set_equality_ignores_repeats(spark):
    a, b = [1.0, 1.0, 2.0], [1.0, 2.0, 2.0]
    rows = [(1, c, n, 0, x, None) for c, xs in ((0, a), (1, b)) for n, x in enumerate(xs)]
    cells = spark.createDataFrame(rows, CELLS)
    assert scores(C.rowset_equal(cells)) == {(1, 1): 1}
    assert scores(C.multiset_equal_any_column_order(cells)) == {(1, 1): 0}


def test_self_consistency_counts_failures(spark):
    rows = [(1, c, 0, 0, x, None) for c, x in ((1, 1.0), (2, 1.0), (3, 2.0))] + [(2, 1, 0, 0, 1.0, None)]
    cells = spark.createDataFrame(rows, CELLS)
    attempts = spark.createDataFrame([(1, 4), (2, 3), (3, 1)], "instance_id int, n bigint")
    got = {r["instance_id"]: r["sc"] for r in C.self_consistency(cells, attempts).collect()}
    assert got == {1: pytest.approx(1 / 6), 2: 0.0, 3: None}


def test_tolerant_clusters_follow_leaders(results, frames):
    got = {}
    for r in S.cluster_by_result(frames[0], tolerant=True).collect():
        got[r["instance_id"], r["candidate"]] = r["cluster"]
    for i in {k[0] for k in results}:
        leaders = []
        for c in range(5):
            rows, width = results[i, c]
            if not rows:
                assert (i, c) not in got  # no cells: nothing to cluster
                continue
            home = next((x for x in leaders if len(results[i, x][0]) == len(rows) and match((rows, width), results[i, x], True, True)), None)
            if home is None:
                leaders.append(c)
                home = c
            assert got[i, c] == home, (i, c)


def test_majority_rules(spark):
    runs = spark.createDataFrame(
        [(1, 1, 1, 5.0), (1, 2, 1, 3.0), (1, 3, 3, 1.0), (2, 1, 1, 5.0), (2, 2, 2, 4.0)],
        "instance_id int, candidate int, cluster int, elapsed double")
    fastest = {r["instance_id"]: r["chosen"] for r in S.select_majority_fastest(runs).collect()}
    assert fastest == {1: 2, 2: 2}
    first = {r["instance_id"]: (r["chosen"], r["votes"]) for r in S.select_majority_first(runs).collect()}
    assert first == {1: (1, 2), 2: (1, 1)}


def test_vote_tables_counts_every_prefix(spark):
    rankings = spark.createDataFrame([(1, 1, ["b", "a"]), (1, 2, ["b", "x", "c"])], "instance_id int, ranking_no int, tables array<string>")
    catalogs = spark.createDataFrame([(1, ["A", "B", "C"]), (2, ["A", "B"])], "instance_id int, known array<string>")
    got = {r["instance_id"]: r["tables"] for r in S.vote_tables(rankings, catalogs, 2).collect()}
    assert got == {1: ["B", "A"], 2: ["A", "B"]}  # {b} is seen three times; the rest is padding


def test_hot_instance_spreads(spark):
    rows = spark.range(3000).select(F.lit(1).alias("instance_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("candidate"),
                                    F.col("id").alias("row_no"), F.lit(0).alias("col_no"), F.col("id").cast("double").alias("num_value"),
                                    F.lit(None).cast("string").alias("str_value"))
    assert scores(C.execution_match(rows)) == {(1, 1): 1}


def test_prints_keep_every_column_that_may_agree(spark):
    """Columns shifted by almost the tolerance, huge and odd numbers, and texts: pairs that agree cell by cell are never left out."""
    rng = random.Random(8)
    rows, columns = 40, {}
    for c in range(12):
        kind = c % 4
        base = [rng.choice([None, rng.uniform(-5, 5), rng.uniform(-1e12, 1e12), 0.0]) if kind < 3 else rng.choice(["a", "b", None]) for _ in range(rows)]
        columns[0, c] = base
        columns[1, c] = [v if v is None or isinstance(v, str) else v + rng.choice([-1, 1]) * max(0.00999, 0.99e-9 * abs(v)) for v in base]
        columns[2, c] = [v if rng.random() < 0.97 else "z" if isinstance(v, str) else 77.0 for v in base]
    cells = [("q", k, r, c, v if isinstance(v, float) else None, v if isinstance(v, str) else None) for (k, c), values in columns.items() for r, v in enumerate(values)]
    df = spark.createDataFrame(cells, "instance_id string, candidate int, row_no bigint, col_no int, num_value double, str_value string")
    got = {(r["candidate"], r["l_col"], r["r_col"]) for r in C.alike_columns(C.column_prints(df)).collect()}

    def same(a, b):
        if isinstance(a, float) and isinstance(b, float):
            return abs(a - b) <= max(1e-9 * max(abs(a), abs(b)), 0.01)
        return a == b

    agree = {(k, c, g) for (k, c), values in columns.items() if k for g in range(12) if all(map(same, values, columns[0, g]))}
    assert agree <= got and {(1, c, c) for c in range(12)} <= agree
    assert len(got) < len(agree) + 40


def test_columns_with_odd_numbers_stay_candidates(spark):
    inf, nan = float("inf"), float("nan")
    cells = [("q", k, r, 0, v, None) for k, values in enumerate([[1.0, inf], [1.0, inf], [1.0, -inf], [1.0, nan], [1.001, 1e308]]) for r, v in enumerate(values)]
    df = spark.createDataFrame(cells, "instance_id string, candidate int, row_no bigint, col_no int, num_value double, str_value string")
    assert {r["candidate"] for r in C.alike_columns(C.column_prints(df)).collect()} == {1, 2, 3, 4}

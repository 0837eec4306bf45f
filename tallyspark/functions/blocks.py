"""Exact top-k retrieval as a join of blocks.

Queries and items are cut into blocks (per group, when both carry one); every
pair of blocks is scored in one task, a tile of the matrix at a time, and only
the best k of each query leave it.  The number of blocks does not grow until
they are as large as memory allows, so each row is copied a fixed number of
times.  No row-level cross join is formed and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# For a pair of blocks, a function from positions of queries and of items to their scores.
Scorer = Callable[[pd.DataFrame, pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]]

BLOCKS = 16  # blocks of a side, unless they would leave these bounds
LEAST_ROWS, MOST_ROWS = 1024, 32768
TILE = 1 << 22  # scores that a task holds at a time


def _best(rows: np.ndarray, scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of each row, ties by name."""
    order = np.lexsort((names, -scores, rows))
    ordered = rows[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


def _hits(scores: np.ndarray, least: np.ndarray, names: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and rounded score of the k best finite scores of each row that reach its least one."""
    scores[~np.isfinite(scores)] = -np.inf
    least, spare = least.copy(), scores.shape[1] - k
    free = np.flatnonzero(least == -np.inf)
    if spare > 0 and len(free):
        least[free] = np.partition(scores[free], spare, axis=1)[:, spare] - 10.0**-digits
    rows, columns = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    rounded = np.round(scores[rows, columns], digits) + 0.0
    best = _best(rows, rounded, names[columns], k)
    return rows[best], columns[best], rounded[best]


def _meetings(q: pd.DataFrame, i: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of queries and of the items that they are compared with, a tile at a time."""
    if "_asked" not in q.columns:
        met = [(np.arange(len(q)), np.arange(len(i)))]
    else:
        asked = q["_asked"].to_numpy()
        who, cells, placed = np.repeat(np.arange(len(q)), [len(a) for a in asked]), np.concatenate(asked), i["_cell"].to_numpy()
        met = ((who[cells == c], np.flatnonzero(placed == c)) for c in np.unique(placed))
    for rows, columns in met:
        step = max(1, TILE // len(columns))
        for at in range(0, len(rows), step):
            yield rows[at : at + step], columns


def block_topk(
    queries: DataFrame,
    items: DataFrame,
    scorer: Scorer,
    k: int,
    group: Sequence[str] = (),
    block_rows: int | None = None,
    digits: int = 6,
    parts: Sequence[int] | None = None,
) -> DataFrame:
    """Best k items per query: ``query_id, item_id, score, rank``.

    ``queries`` carry ``query_id``, ``items`` carry ``item_id``; all columns
    reach the scorer, which scores excluded pairs as NaN.  Scores are rounded
    before ranking, ties go to the smaller ``item_id``.  Blocks hold at most
    about ``block_rows``.

    ``parts`` gives the part of each cell of an index.  Items then carry their
    ``_cell``; queries the cells ``_asked``, and ``_least``, a score that hits
    have to reach.  A query is sent once to each part that it asks a cell of.
    """
    most = block_rows or MOST_ROWS
    keys = list(group) or ["_g"]
    if not group:
        queries, items = queries.withColumn("_g", F.lit(0)), items.withColumn("_g", F.lit(0))

    def part(cell: Column) -> Column:
        return F.element_at(F.array(*[F.lit(p) for p in parts]), cell + 1)

    if parts is None:
        queries, items = queries.withColumn("_part", F.lit(0)), items.withColumn("_part", F.lit(0))
    else:
        items = items.withColumn("_part", part(F.col("_cell")))
    rows = F.count(F.lit(1))
    asking = F.greatest(F.least(F.lit(BLOCKS), F.ceil(rows / min(LEAST_ROWS, most))), F.ceil(rows / most)).cast("bigint")
    largest = items.groupBy(*keys, "_part").agg(rows.alias("_n")).groupBy(*keys).agg(F.ceil(F.max("_n") / most).cast("bigint").alias("_ni"))
    layout = queries.groupBy(*keys).agg(asking.alias("_nq")).join(largest, keys)
    if not group:
        layout = F.broadcast(layout)  # exactly one row
    left = queries.join(layout, keys).withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")))
    if parts is not None:
        left = left.withColumn("_part", F.explode(F.array_distinct(F.transform("_asked", part))))
        left = left.withColumn("_asked", F.filter("_asked", lambda c: part(c) == F.col("_part")))
    left = left.withColumn("_ib", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ni") - 1))).drop("_nq", "_ni")
    right = (
        items.join(layout, keys)
        .withColumn("_ib", F.pmod(F.xxhash64("item_id"), F.col("_ni")))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq") - 1)))
        .drop("_nq", "_ni")
    )
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def score(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if q.empty or i.empty:
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []})
        names, asked, pair = i["item_id"].to_numpy(), q["query_id"].to_numpy(), scorer(q, i)
        least = q["_least"].to_numpy(dtype=float) if "_least" in q.columns else np.full(len(q), -np.inf)
        found = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
        for at, columns in _meetings(q, i):
            r, c, s = _hits(pair(at, columns), least[at], names[columns], k, digits)
            found.append((at[r], columns[c], s))
        r, c, s = (np.concatenate(f) for f in zip(*found, strict=True))
        best = _best(r, s, names[c], k)
        return pd.DataFrame({"query_id": asked[r[best]], "item_id": names[c[best]], "score": s[best]})

    cogroup = [*keys, "_part", "_qb", "_ib"]
    local = left.groupBy(*cogroup).cogroup(right.groupBy(*cogroup)).applyInPandas(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in column])


def _codes(left: pd.Series, right: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The values of both sides as they are if numeric, else numbered, as those are compared faster."""
    a, b = left.to_numpy(), right.to_numpy()
    if a.dtype != object and b.dtype != object:
        return a, b
    codes = pd.factorize(np.concatenate([a.astype(object), b.astype(object)]))[0]
    return codes[: len(a)], codes[len(a) :]


def vector_scorer(metric: str, exclude_same: Sequence[str] = (), min_score: float | None = None) -> Scorer:
    """Cosine similarity, or negated Euclidean distance, of ``vector`` columns; pairs that agree in a named column are excluded."""
    if metric not in ("cosine", "dot", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")

    def prepare(q: pd.DataFrame, i: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        left, right = _vectors(q["vector"]), _vectors(i["vector"])
        same = [_codes(q[name], i[name]) for name in exclude_same]

        def score(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            a, b = left[rows], right[columns]
            if metric == "cosine":
                norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                m = np.divide(a @ b.T, norms, out=np.zeros((len(a), len(b))), where=norms > 0)
            elif metric == "dot":
                m = a @ b.T
            else:
                squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                m = -np.sqrt(np.maximum(squared, 0))
            for x, y in same:
                m[x[rows][:, None] == y[columns][None, :]] = np.nan
            if min_score is not None:
                m[~(m > min_score)] = np.nan
            return m

        return score

    return prepare

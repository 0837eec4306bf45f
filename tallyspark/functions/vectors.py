"""Vector search over a partitioned index, exact by the triangle inequality or approximate by a number of probes.

Centroids are fitted on a bounded sample; every item is placed in the cell of its nearest centroid, and a cell knows the
greatest distance of an item to its centroid.  That bounds the score of all items of a cell for a query.  A query first
searches the cells of the best bounds; the k-th score found there rules out all cells whose bound is lower, and only the
others are searched.  Cells are packed into parts as large as a block, and a query goes once to each part that it asks, not
once to each cell.  The index is written once and serves any number of searches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.blocks import BLOCKS, LEAST_ROWS, MOST_ROWS, block_topk, vector_scorer
from tallyspark.session import written

#: Rows on which centroids are fitted: the ones with the smallest hash of their id.
SAMPLE_ROWS = 4096
ROUNDS = 8
PROBES = 4
BLOCK_NUMBERS = 1 << 21  # numbers in the vectors of a block


class VectorIndex(NamedTuple):
    """Placed items (their columns and ``_cell``), one centroid and radius per cell, and the measure they are for."""

    rows: DataFrame
    centroids: np.ndarray
    radii: np.ndarray
    metric: str


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    """Rows of numbers; for the cosine in unit length, a null vector as it is."""
    m = np.vstack([np.asarray(v, dtype=float) for v in vectors])
    if metric == "cosine":
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    return m


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Means of a few rounds of nearest-centroid grouping, from evenly spaced rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squares(sample, centroids).argmin(axis=1)
        counts = np.bincount(nearest, minlength=cells)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def build_index(items: DataFrame, metric: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Place all ``items`` (``item_id, vector`` and more columns) in cells; ``metric`` is cosine, dot or euclidean.

    At most ``sample_rows`` vectors reach the driver; without ``cells`` their number is the root of the sample's size.
    """
    drawn = items.select("item_id", "vector").orderBy(F.xxhash64("item_id"), "item_id").limit(sample_rows).select("vector").toPandas()
    if drawn.empty:
        return VectorIndex(items.withColumn("_cell", F.lit(0)), np.zeros((1, 1)), np.zeros(1), metric)
    sample = _matrix(drawn["vector"], metric)
    centroids = fit_centroids(sample, min(cells or math.isqrt(len(sample)), len(sample)))

    @F.pandas_udf("cell int, gap double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        gaps = _squares(_matrix(vectors, metric), centroids)
        cell = gaps.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": np.sqrt(gaps[np.arange(len(cell)), cell])})

    rows = written(items.withColumn("_p", place("vector")).select(*items.columns, F.col("_p.cell").alias("_cell"), F.col("_p.gap").alias("_gap")), "placed")
    radii = np.full(len(centroids), -1.0)  # a cell without items
    for r in rows.groupBy("_cell").agg(F.max("_gap").alias("radius")).collect():
        radii[r["_cell"]] = r["radius"]
    return VectorIndex(rows.drop("_gap"), centroids, radii, metric)


def write_index(index: VectorIndex, path: str) -> None:
    """The index as two tables: items partitioned by cell, and the cells."""
    spark = index.rows.sparkSession
    index.rows.write.partitionBy("_cell").parquet(f"{path}/items")
    cells = [(k, c.tolist(), float(r), index.metric) for k, (c, r) in enumerate(zip(index.centroids, index.radii, strict=True))]
    spark.createDataFrame(cells, "cell int, centroid array<double>, radius double, metric string").coalesce(1).write.parquet(f"{path}/cells")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # as many as were fitted
    return VectorIndex(spark.read.parquet(f"{path}/items"), np.array([c["centroid"] for c in cells]), np.array([c["radius"] for c in cells]), cells[0]["metric"])


def _bounds(index: VectorIndex):
    """For each vector, the best score that an item of each cell can have; empty cells have none."""
    centroids, radii, metric = index.centroids, index.radii, index.metric

    @F.pandas_udf("array<double>")
    def bounds(vectors: pd.Series) -> pd.Series:
        m = _matrix(vectors, metric)
        if metric == "euclidean":
            best = -np.maximum(np.sqrt(_squares(m, centroids)) - radii[None], 0)
        else:
            best = m @ centroids.T + np.linalg.norm(m, axis=1)[:, None] * radii[None]
        best[:, radii < 0] = -np.inf
        return pd.Series(list(best))

    return bounds


def _parts(index: VectorIndex, group: Sequence[str], most: int) -> list[int]:
    """The part of each cell: neighbouring cells share one, up to the size of a block."""
    per_cell = index.rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("n")).groupBy("_cell").agg(F.max("n").alias("n"))
    sizes = {r["_cell"]: r["n"] for r in per_cell.collect()}  # as many as were fitted
    room = min(max(LEAST_ROWS, math.ceil(sum(sizes.values()) / BLOCKS)), most)
    parts, part, held = [], 0, 0
    for cell in range(len(index.centroids)):
        size = sizes.get(cell, 0)
        if held and held + size > room:
            part, held = part + 1, 0
        held += size
        parts.append(part)
    return parts


def search(index: VectorIndex, queries: DataFrame, k: int, group: Sequence[str] = (), exclude_same: Sequence[str] = (),
           min_score: float | None = None, probes: int | None = None, digits: int = 6) -> DataFrame:
    """Best ``k`` items per query: ``query_id, item_id, score, rank``; ties go to the smaller ``item_id``.

    ``queries``: ``query_id, vector`` and the ``group`` and ``exclude_same`` columns, which items have too: a query meets
    items of its own group, and none that agrees with it in an excluded column.  With ``probes`` only the cells of so many
    best bounds are searched, and items may be missed; without, the result is exact.
    """
    error = 10.0**-digits
    scorer = vector_scorer(index.metric, exclude_same, min_score)
    kept = list(dict.fromkeys([*group, *exclude_same]))
    items = index.rows.select("item_id", "vector", *kept, "_cell")
    most = min(max(LEAST_ROWS, BLOCK_NUMBERS // index.centroids.shape[1]), MOST_ROWS)
    parts = _parts(index, group, most)
    bounded = F.transform(_bounds(index)("vector"), lambda b, i: F.struct(b.alias("bound"), i.alias("cell")))
    useful = F.filter(bounded, lambda c: c["bound"] >= (-math.inf if min_score is None else min_score - error))
    cells = F.sort_array(F.filter(useful, lambda c: c["bound"] > F.lit(-math.inf)), asc=False)

    def hits(requests: DataFrame, asked: Column) -> DataFrame:
        requests = requests.withColumn("_cells", cells).select("query_id", "vector", *kept, asked.alias("_asked"), "_least")
        return block_topk(requests, items, scorer, k, group, most, digits, parts).select("query_id", "item_id", "score", "rank")

    asked = queries.select("query_id", "vector", *kept)
    first = hits(asked.withColumn("_least", F.lit(-math.inf)), F.slice("_cells", 1, probes or PROBES)["cell"])
    if probes is not None:
        return first
    first = written(first, "hits")
    # Cells whose bound, and hits whose score, is below the k-th score found cannot change the result.
    kth = first.where(F.col("rank") == k).select("query_id", (F.col("score") - error).alias("_least"))
    further = asked.join(kth, "query_id", "left").withColumn("_least", F.coalesce("_least", F.lit(-math.inf)))
    others = F.filter(F.slice("_cells", PROBES + 1, F.greatest(F.size("_cells"), F.lit(1))), lambda c: c["bound"] >= F.col("_least"))
    second = hits(further, others["cell"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

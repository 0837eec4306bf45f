"""User-defined metrics and named transforms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

MetricFn = Callable[[pd.DataFrame], "float | dict[str, float] | None"]
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}


def custom_metric(rows: DataFrame, fn: MetricFn, key: str = "instance_id") -> DataFrame:
    """Apply ``fn`` to the rows of each sample: ``(key, metric, score, error)``.

    ``fn`` sees one sample's attempts.  A number, a dict of numbers or None is
    allowed; an exception is recorded for that sample only.
    """
    kind = rows.schema[key].dataType.simpleString()

    def apply(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            value, error = fn(frame), None
        except Exception as problem:  # noqa: BLE001 - errors are isolated per sample
            value, error = None, str(problem)
        items = value.items() if isinstance(value, dict) else [("score", value)]
        return pd.DataFrame(
            [(keys[0], name, None if v is None else float(v), error) for name, v in items],
            columns=[key, "metric", "score", "error"])

    return rows.groupBy(key).applyInPandas(apply, f"{key} {kind}, metric string, score double, error string")


def custom_metric_summary(scores: DataFrame) -> DataFrame:
    """Mean, valid, total and error counts per metric."""
    return scores.groupBy("metric").agg(
        F.avg("score").alias("avg"), F.count("score").alias("valid"), F.count(F.lit(1)).alias("total"),
        F.count("error").alias("errors"))


def row_metric(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], name: str = "score") -> DataFrame:
    """Vectorised metric over batches of rows (one row per sample, no shuffle)."""
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: fn(batch).astype(float)})

    return rows.mapInPandas(apply, schema)


def register_transform(name: str, fn: Callable[..., DataFrame]) -> None:
    """Name a DataFrame → DataFrame function; names are unique."""
    if name in TRANSFORMS:
        raise ValueError(f"transform {name} already registered")
    TRANSFORMS[name] = fn


def apply_transforms(df: DataFrame, *names: str) -> DataFrame:
    """Chain registered transforms in order."""
    for name in names:
        if name not in TRANSFORMS:
            raise KeyError(f"unknown transform {name!r}")
        df = df.transform(TRANSFORMS[name])
    return df

"""Declarations of metrics and slice axes; aggregation code is generated from them."""

from __future__ import annotations

from dataclasses import dataclass

LAYERS = ("L1", "L2", "L3", "L4", "L5", "L6")
FOLDS = ("mean", "rate", "sum", "percentile", "distribution", "derived")
INTERVALS = (None, "wilson", "bootstrap")
PUBLICATION = ("public", "aggregate_only", "private")

# Fixed values.
HARDNESS = ("easy", "medium", "hard", "extra")
COMPONENTS = ("select", "where", "group", "order", "join", "iuen", "keywords")


@dataclass(frozen=True)
class Metric:
    id: str
    layer: str
    source: str
    aggregation: str
    interval: str | None = None
    publication: str = "public"
    sliceable: bool = True
    higher_is_better: bool = True

    def __post_init__(self) -> None:
        kind, _, point = self.aggregation.partition(":")
        if self.layer not in LAYERS:
            raise ValueError(f"{self.id}: unknown layer {self.layer!r}")
        if kind not in FOLDS or (kind == "percentile") != bool(point):
            raise ValueError(f"{self.id}: unknown aggregation {self.aggregation!r}")
        if self.interval not in INTERVALS:
            raise ValueError(f"{self.id}: unknown interval {self.interval!r}")
        if self.publication not in PUBLICATION:
            raise ValueError(f"{self.id}: unknown publication {self.publication!r}")

    @property
    def kind(self) -> str:
        return self.aggregation.partition(":")[0]

    @property
    def point(self) -> float:
        return float(self.aggregation.partition(":")[2])


@dataclass(frozen=True)
class Slice:
    id: str
    field: str
    labels: tuple[str, ...] = ()
    min_samples: int = 1


class Registry:
    """Metrics and slice axes by unique id."""

    def __init__(self) -> None:
        self._metrics: dict[str, Metric] = {}
        self._slices: dict[str, Slice] = {}

    def register(self, *metrics: Metric) -> Registry:
        for metric in metrics:
            if metric.id in self._metrics:
                raise ValueError(f"metric {metric.id} already registered")
            self._metrics[metric.id] = metric
        return self

    def register_slice(self, *slices: Slice) -> Registry:
        for axis in slices:
            if axis.id in self._slices:
                raise ValueError(f"slice {axis.id} already registered")
            self._slices[axis.id] = axis
        return self

    def metrics(self, layer: str | None = None) -> list[Metric]:
        return [m for m in self._metrics.values() if layer in (None, m.layer)]

    def folded(self, layer: str | None = None) -> list[Metric]:
        """Metrics folded straight from sample rows."""
        return [m for m in self.metrics(layer) if m.kind != "derived"]

    def slices(self) -> list[Slice]:
        return list(self._slices.values())

    def __getitem__(self, metric_id: str) -> Metric:
        return self._metrics[metric_id]


def default_registry() -> Registry:
    registry = Registry()
    registry.register(
        Metric("ex", "L1", "ex", "rate", interval="wilson"),
        Metric("em", "L1", "em", "rate", interval="wilson"),
        Metric("sf1", "L1", "sf1", "mean", interval="bootstrap"),
        Metric("sc", "L1", "sc", "mean"),
        Metric("ves", "L1", "ves", "mean", interval="bootstrap"),
        Metric("rves", "L1", "rves", "mean", interval="bootstrap"),
    )
    cost = {"publication": "aggregate_only", "higher_is_better": False}
    registry.register(
        Metric("latency_avg", "L2", "act_elapsed_s", "mean", interval="bootstrap", **cost),
        Metric("latency_p50", "L2", "act_elapsed_s", "percentile:50", **cost),
        Metric("latency_p95", "L2", "act_elapsed_s", "percentile:95", **cost),
        *[
            Metric(name, "L2", f"derived:{name}", "derived", sliceable=False, **cost)
            for name in ("token_total", "token_avg_per_sample", "cost_per_correct")
        ],
    )
    registry.register(
        *[Metric(f"cf1_{c}", "L3", f"cf1.cf1_{c}", "mean", publication="aggregate_only") for c in COMPONENTS],
        Metric("sl_recall", "L3", "sl_recall", "mean", publication="aggregate_only"),
        Metric("fd", "L3", "derived:fd", "derived", publication="aggregate_only", sliceable=False),
        Metric("error_root_distribution", "L4", "derived:error_root_distribution", "derived",
               sliceable=False, higher_is_better=False),
    )
    return registry.register_slice(Slice("hardness", "hardness", HARDNESS), Slice("db_type", "db_type"))

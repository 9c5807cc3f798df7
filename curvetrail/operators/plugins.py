"""Window features from outside: functions over tracks and frames that the gate listens to like its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvetrail.config import Gate
from curvetrail.functions.geometry import num

#: Gives (video_id, window_id, <name>) from tracks, frames and the window's size; windows without a row count 0.
Feature = Callable[[DataFrame, DataFrame, int], DataFrame]


@dataclass
class FeatureSet:
    """Features by name, each with its weight in the gate."""

    features: dict[str, tuple[Feature, float]] = field(default_factory=dict)

    def register(self, name: str, weight: float = 1.0) -> Callable[[Feature], Feature]:
        """Decorates a feature."""

        def put(feature: Feature) -> Feature:
            if name in self.features:
                raise ValueError(f"there is a feature {name} already")
            self.features[name] = (feature, weight)
            return feature

        return put

    def extend(self, windows: DataFrame, tracks: DataFrame, frames: DataFrame, size: int = 8) -> DataFrame:
        """windows (video_id, window_id, ...) with a column for each feature. All meet in one aggregation."""
        keys = ["video_id", "window_id"]
        if clash := set(self.features) & set(windows.columns):
            raise ValueError(f"columns that are there already: {', '.join(sorted(clash))}")
        rows = None
        for name, (feature, _) in self.features.items():
            part = feature(tracks, frames, size).select(*keys, F.col(name).cast("double").alias(name))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        if rows is None:
            return windows
        found = rows.groupBy(*keys).agg(*[F.max(n).alias(n) for n in self.features])
        return windows.join(found, keys, "left").select(*windows.columns, *[F.coalesce(n, num(0)).alias(n) for n in self.features])

    def gate(self, cfg: Gate = Gate()) -> Gate:
        """The gate's settings with these features as further experts."""
        return replace(cfg, weights=(*cfg.weights, *[(n, w) for n, (_, w) in self.features.items()]))

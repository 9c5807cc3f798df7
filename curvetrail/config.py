"""Settings: defaults as frozen dataclasses, and layers of overrides, field by field."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Sampling:
    source_fps: float = 25.0
    target_fps: float = 12.0
    window: int = 8
    step: int = 1


@dataclass(frozen=True)
class Detection:
    min_score: float = 0.2
    classes: tuple[int, ...] = (0, 1)


@dataclass(frozen=True)
class Refinement:
    max_gap: int = 6
    max_dist: float = 0.12
    max_scale_ratio: float = 2.5
    min_cos: float = -0.1
    max_speed_ratio: float = 3.5
    gap_relax: float = 0.25
    min_len: int = 6
    min_span: int = 12
    min_area: float = 20.0
    min_area_ratio: float = 0.0005


@dataclass(frozen=True)
class Motion:
    """Fixed values of the motion features; they must be these for equal results."""

    fit_degree: int = 2
    history: int | None = None
    point_height: float = 0.60
    static_ratio: float = 0.30
    edge_ratio: float = 0.03
    max_area_ratio: float = 1.5
    max_step_ratio: float = 1.0
    near_ratio: float = 0.06
    near_iou: float = 0.05
    far_from: float = 0.03
    far_to: float = 0.18
    lookahead: int = 2
    min_seen: int = 3
    turn_limit: float = 0.5
    min_turn_speed: float = 0.03
    min_dir_ratio: float = 0.03
    min_dir_px: float = 2.0
    speed_factor: float = 15.0
    top_k: int = 3


@dataclass(frozen=True)
class Gate:
    """Weights of the experts and fixed values of the gate; they must be these for equal results."""

    weights: tuple[tuple[str, float], ...] = (
        ("dir_turn_rates_sum", 1.0),
        ("speed_turn_rates_sum", 1.0),
        ("turn_active_ratio", 0.2),
        ("pred_center_sum_err", 1.0),
        ("pred_iou_sum_err", 1.0),
        ("collision_warning", 0.2),
        ("disappear_far_sum", 0.2),
    )
    dead_zone: float = 1.0
    cap: float = 8.0
    active_from: float = 0.20
    evidence_mid: float = 1.80
    steepness: float = 6.0
    top_k: int = 3
    min_confidence: float = 0.04
    min_active: int = 2
    strong: float = 3.0
    lone_scale: float = 0.30
    prominence: float = 0.5
    dominance: float = 2.0
    max_active_ratio: float = 0.35


@dataclass(frozen=True)
class Boundary:
    high_z: float = 0.85
    min_peak: float = 0.15
    peak_gap: int = 4
    expand: tuple[int, int] = (4, 8)
    merge_gap: int = 12
    anchors: int = 4
    smooth: int = 3


@dataclass(frozen=True)
class Spans:
    min_confidence: float = 0.35
    positive_from: float = 0.5
    merge_gap: int = 10


@dataclass(frozen=True)
class Chunks:
    window: int = 60
    stride: int = 45
    max_stride_ratio: float = 0.75
    chunks: int = 4
    frames_per_chunk: int = 4
    savgol_window: int = 11
    savgol_order: int = 2
    average_window: int = 9
    threshold: float = 0.5
    min_len: int = 10
    merge_gap: int = 8

    @property
    def step(self) -> int:
        """The stride, held to a share of the window (half to even)."""
        return min(max(1, self.stride), max(1, round(self.window * max(0.05, self.max_stride_ratio))))


@dataclass(frozen=True)
class EngineConfig:
    sampling: Sampling = field(default_factory=Sampling)
    detection: Detection = field(default_factory=Detection)
    refinement: Refinement = field(default_factory=Refinement)
    motion: Motion = field(default_factory=Motion)
    gate: Gate = field(default_factory=Gate)
    boundary: Boundary = field(default_factory=Boundary)
    spans: Spans = field(default_factory=Spans)
    chunks: Chunks = field(default_factory=Chunks)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def build(kind: type, *layers: Mapping[str, Any]) -> Any:
    """A dataclass from layers of settings, the last one first: a field takes the value of the last layer that names it, a
    group of settings is built from what all layers say of it. Unknown names are refused."""
    defaults = kind()
    names = [f.name for f in fields(kind)]
    unknown = sorted({str(key) for layer in layers for key in layer} - set(names))
    if unknown:
        raise KeyError(f"unknown settings: {', '.join(unknown)}")
    return kind(**{name: _setting(getattr(defaults, name), [layer[name] for layer in layers if name in layer]) for name in names})


def _setting(default: Any, given: list[Any]) -> Any:
    """What a field becomes: its default, the last of the given values, or a group of them."""
    if not given:
        return default
    if is_dataclass(default) and all(isinstance(value, Mapping) for value in given):
        return build(type(default), *given)
    last = given[-1]
    if isinstance(default, tuple) and isinstance(last, list):
        return tuple(tuple(x) if isinstance(x, list) else x for x in last)
    return last


def load_config(overrides: Mapping[str, Any] | None = None, path: str | None = None) -> EngineConfig:
    """Defaults, then a YAML file, then overrides."""
    layers: list[Mapping[str, Any]] = []
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            layers.append(yaml.safe_load(f) or {})
    return build(EngineConfig, *layers, overrides or {})

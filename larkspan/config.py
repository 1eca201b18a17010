"""Parameters. Results depend on them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Signal:
    sample_rate: int = 40_000
    window: int = 2_560
    hop: int = 1_280
    shifts: int = 4


@dataclass(frozen=True)
class Landmarks:
    saliency_threshold: float = 5.0
    magnitude_threshold: float = 10.0
    min_bin: int = 50
    max_bin: int = 350
    radius_f: int = 2
    radius_t: int = 3
    fine: tuple[float, float] = (1.0, 1.5)
    background: tuple[float, float] = (8.0, 16.0)
    normalization: tuple[float, float] = (6.0, 12.0)
    contrast_floor: float = 0.75
    contrast_weight: float = 3.0
    magnitude_weight: float = 0.015
    rate: float = 22.0
    min_rate: float = 6.0
    max_rate: float = 44.0
    window_seconds: float = 2.0
    background_seconds: float = 8.0
    exponent: float = 0.75


@dataclass(frozen=True)
class Triangles:
    scale_f: int = 10
    scale_t: int = 14
    min_span: int = 1
    max_span: int = 63
    min_area: float = 0.025
    max_edge: float = 6.0
    max_radius: float = 4.0
    quant_anchor: int = 2
    quant_f: int = 3
    quant_t: int = 2
    hops: int = 2
    neighbours: int = 12
    per_anchor: int = 24
    probe_radius: int = 1


@dataclass(frozen=True)
class Matching:
    smoothing: float = 1.0
    power: float = 1.0
    radius: int = 1
    neighbour_weight: float = 0.5
    topn: int = 2
    min_hits: int = 8
    min_margin: float = 0.40

    def __post_init__(self):
        if self.smoothing <= 0 or self.power < 0:
            raise ValueError("smoothing must be positive and power not negative")
        if self.radius < 0 or self.topn < 1:
            raise ValueError("radius must not be negative and topn at least 1")


@dataclass(frozen=True)
class Config:
    signal: Signal = field(default_factory=Signal)
    landmarks: Landmarks = field(default_factory=Landmarks)
    triangles: Triangles = field(default_factory=Triangles)
    matching: Matching = field(default_factory=Matching)

    def to_dict(self) -> dict:
        return asdict(self)


DEFAULT = Config()

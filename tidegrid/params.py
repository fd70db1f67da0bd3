"""Immutable parameter sets, with range errors."""

from __future__ import annotations

import math
from dataclasses import dataclass


def _finite(*values: float) -> bool:
    return all(math.isfinite(v) for v in values)


@dataclass(frozen=True)
class Gates:
    """Masks before detection and gates after it."""

    coastal_zones: int = 2
    border: int = 64
    open_water_class: int = 1
    exclude_ice: bool = False
    seams: bool = True
    seam_margin: int = 8
    seam_sigma: float = 6.0
    seam_groups: int = 6
    min_pixels: int = 4
    max_pixels: int = 20_000
    max_aspect: float = 8.0
    min_contrast_db: float = 3.0
    min_peak_db: float = -30.0
    max_ratio_db: float = 18.0

    def __post_init__(self) -> None:
        if min(self.coastal_zones, self.border, self.seam_margin, self.seam_groups) < 0:
            raise ValueError("margins and the number of seams must not be negative")
        if not 1 <= self.min_pixels <= self.max_pixels:
            raise ValueError("pixel limits must be positive and ordered")
        if not _finite(self.max_aspect, self.min_contrast_db, self.min_peak_db, self.max_ratio_db) or self.max_aspect < 1:
            raise ValueError("gate limits must be finite, and the aspect limit at least 1")


@dataclass(frozen=True)
class Window:
    """Half-widths of a threshold's windows, its design false-alarm rate, and the training cells that it needs."""

    guard: tuple[int, int] = (1, 1)
    background: tuple[int, int] = (5, 5)
    pfa: float = 1e-5
    floor: float = 1e-6
    training_fraction: float = 0.5

    def __post_init__(self) -> None:
        if min(*self.guard, *self.background) < 0:
            raise ValueError("half-widths must not be negative")
        if self.guard[0] >= self.background[0] or self.guard[1] >= self.background[1]:
            raise ValueError("the guard must be smaller than the background")
        if not 0 < self.pfa < 1 or not _finite(self.floor) or self.floor <= 0 or not 0 < self.training_fraction <= 1:
            raise ValueError("rates, floors and fractions are out of range")

    @property
    def nominal(self) -> int:
        return (2 * self.background[0] + 1) * (2 * self.background[1] + 1) - (2 * self.guard[0] + 1) * (2 * self.guard[1] + 1)

    def needed(self, least: int) -> int:
        return max(least, math.ceil(self.nominal * self.training_fraction))


@dataclass(frozen=True)
class Quality:
    max_nonpositive: float = 0.05
    min_valid: float = 0.1
    min_incidence: float = 15.0
    max_incidence: float = 50.0
    max_geolocation_m: float = 20.0

    def __post_init__(self) -> None:
        if not 0 <= self.max_nonpositive < 1 or not 0 < self.min_valid <= 1:
            raise ValueError("quality fractions are out of range")


@dataclass(frozen=True)
class Pairing:
    search_hours: float = 12.0
    speed_m_s: float = 0.5
    radar_allowance_m: float = 100.0
    optical_allowance_m: float = 20.0
    visible: float = 0.8
    items: int = 3

    def __post_init__(self) -> None:
        if not 0 < self.search_hours <= 24 or not 0 <= self.speed_m_s <= 5 or not 0 < self.visible <= 1 or not 1 <= self.items <= 10:
            raise ValueError("pairing limits are out of range")


@dataclass(frozen=True)
class Sampling:
    seed: int = 17
    min_size_samples: int = 20
    other_samples: int = 8
    repeat_fraction: float = 0.1
    edges_db: tuple[float, float] = (-28.0, -22.0)

    def __post_init__(self) -> None:
        if self.seed < 0 or min(self.min_size_samples, self.other_samples) < 2 or not 0 < self.repeat_fraction <= 1 or not self.edges_db[0] < self.edges_db[1]:
            raise ValueError("sampling limits are out of range")

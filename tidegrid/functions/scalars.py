"""Scalar expressions on columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: reviewers' verdicts to displayed classes, and to the classes of training chips.
DISPLAY = {"CONFIRMED_ICEBERG": "iceberg", "VESSEL": "ship", "REJECTED_CLUTTER": "clutter", "OFFSHORE_STRUCTURE": "offshore_structure", "SEA_ICE": "sea_ice_feature"}
CHIP = {"CONFIRMED_ICEBERG": "iceberg", "VESSEL": "ship", "REJECTED_CLUTTER": "clutter", "OFFSHORE_STRUCTURE": "offshore_structure", "SEA_ICE_FEATURE": "sea_ice_feature"}


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def decibel(power: Column, floor: float = 1e-12) -> Column:
    return 10.0 * F.log10(F.greatest(power, F.lit(floor)))


def known(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def closed(condition: Column) -> Column:
    """Gates fail closed: unknown counts as failed."""
    return F.coalesce(condition, F.lit(False))


def per(amount: Column, base: Column, scale: float = 1.0) -> Column:
    """scale * amount / base, 0 where base isn't positive."""
    return F.when(base > 0, scale * amount / base).otherwise(F.lit(0.0))


def mapped(value: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    got = F.create_map(*map(F.lit, chain.from_iterable(table.items())))[value]
    return F.coalesce(got, F.lit(otherwise)) if otherwise is not None else got


def drift_radius(seconds: Column, speed: float = 0.5, least: float = 500.0) -> Column:
    return F.greatest(F.lit(least), speed * F.abs(seconds))


def review_radius(seconds: Column, extent: Column, speed: float = 0.5, radar: float = 100.0, optical: float = 20.0) -> Column:
    return radar + optical + F.greatest(F.lit(0.0), extent) / 2 + speed * F.abs(seconds)


def stratum_key(scene: Column, stage: Column, pixels: Column, peak: Column, edges: tuple[float, float]) -> Column:
    size = F.when(pixels <= 3, pixels.cast("string")).when(pixels < 16, "4-15").otherwise("16+")
    bright = F.when(peak < edges[0], "low").when(peak < edges[1], "mid").otherwise("high")
    return F.concat_ws("|", scene.cast("string"), stage, size, bright)


def clock(text: Column) -> Column:
    """Times of day without a colon, padded to four digits."""
    return F.lpad(F.regexp_replace(text, ":", ""), 4, "0")


def heuristic(peak_hv: Column, peak_hh: Column, ratio: Column, pixels: Column) -> tuple[Column, Column]:
    """Class and uncalibrated score of a candidate by brightness and ratio."""
    bright = closed((peak_hv >= -24.0) & (ratio <= 15.0))
    ship = closed((peak_hh >= -10.0) & (ratio > 15.0) & (pixels <= 10))
    score = F.when(bright, F.least(F.lit(0.95), 0.5 + F.greatest(F.lit(0.0), (peak_hv + 24.0) * 0.03))).when(ship, F.least(F.lit(0.90), 0.5 + F.greatest(F.lit(0.0), (peak_hh + 10.0) * 0.03))).otherwise(F.lit(0.5))
    return F.when(bright, "iceberg").when(ship, "ship").otherwise("clutter"), score


def hashed(*parts: Column) -> Column:
    """SHA-256 of the parts' texts joined by bars."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)

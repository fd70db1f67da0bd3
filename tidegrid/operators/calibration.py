"""Array kernels of calibration and geometry, each a function of NumPy arrays that runs on tiles through Arrow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.spatial import FLATTENING, MAJOR_M


def lut(lines: np.ndarray, pixels: np.ndarray, values: np.ndarray, at_line: np.ndarray, at_pixel: np.ndarray, extrapolate: bool = False) -> np.ndarray:
    """Separable linear interpolation of (line, pixel, value) triples: along pixels, then along lines.

    Holes of a line are filled along it first. Outside the knots: the edge value, or the edge's line if extrapolate.
    """
    ls, ps = np.unique(lines), np.unique(pixels)
    table = np.full((len(ls), len(ps)), np.nan)
    table[np.searchsorted(ls, lines), np.searchsorted(ps, pixels)] = values
    for row in table:
        good = np.isfinite(row)
        if not good.any():
            raise ValueError("a line without values")
        row[~good] = np.interp(ps[~good], ps[good], row[good])

    def weights(knots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(knots) == 1:
            return np.zeros(len(at), int), np.zeros(len(at))
        k = np.clip(np.searchsorted(knots, at, "right") - 1, 0, len(knots) - 2)
        f = (at - knots[k]) / (knots[k + 1] - knots[k])
        return k, f if extrapolate else np.clip(f, 0, 1)

    i, fi = weights(ls, np.asarray(at_line, float))
    j, fj = weights(ps, np.asarray(at_pixel, float))
    i2, j2 = np.minimum(i + 1, len(ls) - 1), np.minimum(j + 1, len(ps) - 1)
    top = table[np.ix_(i, j)] * (1 - fj) + table[np.ix_(i, j2)] * fj
    low = table[np.ix_(i2, j)] * (1 - fj) + table[np.ix_(i2, j2)] * fj
    return top * (1 - fi[:, None]) + low * fi[:, None]


def noise_power(blocks: list[dict], vectors: dict[int, tuple[np.ndarray, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """Noise of azimuth blocks: the nearest range vector of a block's middle line, times the block's azimuth factor.

    blocks: first and last line and pixel, knots `line` and `factor`. Cells in no block are NaN; zero knots count as unknown.
    """
    out = np.full(shape, np.nan)
    known = np.array(sorted(vectors))
    for b in blocks:
        inside = known[(known >= b["line0"]) & (known <= b["line1"])]
        pool = inside if len(inside) else known
        nearest = pool[np.argmin(np.abs(pool - (b["line0"] + b["line1"]) / 2))]
        pixel, value = vectors[int(nearest)]
        good = np.asarray(value) > 0
        if not good.any():
            continue
        cols, rows = np.arange(b["pixel0"], b["pixel1"] + 1), np.arange(b["line0"], b["line1"] + 1)
        out[np.ix_(rows, cols)] = np.interp(rows, b["line"], b["factor"])[:, None] * np.interp(cols, np.asarray(pixel)[good], np.asarray(value)[good])[None]
    return out


def earth_fixed(lon: np.ndarray, lat: np.ndarray, height: np.ndarray | float = 0.0) -> np.ndarray:
    e2 = FLATTENING * (2 - FLATTENING)
    p, l = np.radians(lat), np.radians(lon)
    n = MAJOR_M / np.sqrt(1 - e2 * np.sin(p) ** 2)
    return np.stack([(n + height) * np.cos(p) * np.cos(l), (n + height) * np.cos(p) * np.sin(l), (n * (1 - e2) + height) * np.sin(p)], -1)


def hermite(times: np.ndarray, position: np.ndarray, velocity: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cubic Hermite positions and velocities between state vectors; times outside are NaN."""
    k = np.clip(np.searchsorted(times, at, "right") - 1, 0, len(times) - 2)
    h = (times[k + 1] - times[k])[:, None]
    s = ((at - times[k])[:, None]) / h
    p0, p1, v0, v1 = position[k], position[k + 1], velocity[k] * h, velocity[k + 1] * h
    x = (2 * s**3 - 3 * s**2 + 1) * p0 + (s**3 - 2 * s**2 + s) * v0 + (-2 * s**3 + 3 * s**2) * p1 + (s**3 - s**2) * v1
    v = ((6 * s**2 - 6 * s) * p0 + (3 * s**2 - 4 * s + 1) * v0 + (6 * s - 6 * s**2) * p1 + (3 * s**2 - 2 * s) * v1) / h
    out = ((at < times[0]) | (at > times[-1]))[:, None]
    return np.where(out, np.nan, x), np.where(out, np.nan, v)


def zero_doppler(lon: np.ndarray, lat: np.ndarray, times: np.ndarray, position: np.ndarray, velocity: np.ndarray, steps: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(time, slant range) at which the sensor is abeam of each point, by Newton's steps on the orbit."""
    target = earth_fixed(np.asarray(lon, float), np.asarray(lat, float))
    t = np.full(len(target), float(times.mean()))
    for _ in range(steps):
        x, v = hermite(times, position, velocity, t)
        f = ((target - x) * v).sum(-1)
        t = t + np.clip(f / np.maximum((v * v).sum(-1), 1e-9), -(times[-1] - times[0]), times[-1] - times[0])
        t = np.clip(t, times[0], times[-1])
    x, v = hermite(times, position, velocity, t)
    off = np.abs(((target - x) * v).sum(-1)) > 1e-3 * np.linalg.norm(v, axis=-1) * np.linalg.norm(target - x, axis=-1)
    return np.where(off, np.nan, t), np.where(off, np.nan, np.linalg.norm(target - x, axis=-1))


def geocoded(points: DataFrame, orbit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """points (lon, lat, ...) with time and slant range; the orbit's few vectors go with the function."""

    def run(frames):
        for f in frames:
            t, r = zero_doppler(f.lon.to_numpy(), f.lat.to_numpy(), *orbit)
            yield f.assign(time=t, slant_m=r)

    return points.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema), "time double", "slant_m double"]))


def shift(reference: np.ndarray, moving: np.ndarray, mask: np.ndarray | None = None) -> tuple[int, int]:
    """Rows and columns by which `moving` is displaced, by phase correlation of masked, centred arrays."""
    ok = np.isfinite(reference) & np.isfinite(moving) & (True if mask is None else mask)
    if not ok.any():
        raise ValueError("nothing to compare")
    a, b = (np.where(ok, v - v[ok].mean(), 0.0) for v in (reference, moving))
    cross = np.fft.fft2(b) * np.conj(np.fft.fft2(a))
    peak = np.unravel_index(np.argmax(np.abs(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))), a.shape)
    return tuple(int(p - n if p > n // 2 else p) for p, n in zip(peak, a.shape, strict=True))  # type: ignore[return-value]


def shifts(tiles: DataFrame, key: str) -> DataFrame:
    """(key, rows, cols) of tiles (key, h, w, reference, moving): each tile is one task's work."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        x = f.iloc[0]
        r, c = shift(np.array(x.reference, float).reshape(x.h, x.w), np.array(x.moving, float).reshape(x.h, x.w))
        return pd.DataFrame({key: [x[key]], "rows": [r], "cols": [c]})

    return tiles.groupBy(key).applyInPandas(one, f"{key} {dict(tiles.dtypes)[key]}, rows int, cols int")


def calibrated(dn: pd.Series | F.Column, gain):
    """Power of digital numbers; what isn't positive is unknown."""
    return F.when(dn > 0, dn * dn / (gain * gain))


def fixed_windows(height: int, width: int, size: int, fractions=((0.1, 0.1), (0.1, 0.5), (0.1, 0.9), (0.5, 0.1), (0.5, 0.5), (0.5, 0.9), (0.9, 0.1), (0.9, 0.5), (0.9, 0.9))) -> list[tuple[int, int]]:
    """Origins of sampling windows, rounded half to even; two at one place are an error."""
    out = [(round((height - size) * a), round((width - size) * b)) for a, b in fractions]
    if len(set(out)) != len(out) or height < size or width < size:
        raise ValueError("windows coincide or don't fit")
    return out

"""Local regression on evenly spaced values, and the decomposition into trend and season that is built from it.

A point's fit is a weighted line over its nearest values, the weights falling off with the cube of the distance. Away from the
ends of a series every point sees the same distances, so that its five moments (sums of weights, distances, squared distances,
values, and their product) are convolutions; at the ends the window stays where it is. Values may be a stretch of a longer
series; points whose window leaves the stretch, but not the series, become NaN, and so does whatever is made from them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def _weights(distance: np.ndarray, reach: np.ndarray) -> np.ndarray:
    w = (1 - (distance / np.maximum(reach, 1e-300)) ** 3) ** 3
    return np.where(distance <= 0.001 * reach, 1.0, np.where(distance <= 0.999 * reach, w, 0.0))


def _line(s0, s1, s2, t0, t1, n: int, plain: np.ndarray) -> np.ndarray:
    """The line at distance 0; a constant where the distances hardly differ, measured by the length of the series; `plain` where
    no value has a weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, a = t0 / s0, s1 / s0
        c = s2 / s0 - a * a
        sloped = np.sqrt(np.maximum(c, 0.0)) > 0.001 * (n - 1)
        return np.where(s0 <= 0, plain, np.where(sloped, mean - a * (t1 / s0 - a * mean) / np.where(sloped, c, 1.0), mean))


def fit_at(y: np.ndarray, given: np.ndarray, first: int, n: int, q: int, x: np.ndarray, low: np.ndarray, width: int,
           plain: np.ndarray | None = None) -> np.ndarray:
    """Fits at positions x from the `width` values that start at positions `low`; y starts at position `first` of n. Without any
    weight the fit is `plain`, by default the value itself."""
    at = low[:, None] + np.arange(width)
    u = at - x[:, None]
    reach = np.maximum(x - low, low + width - 1 - x) + (max(q - n, 0) // 2)
    w = _weights(np.abs(u), reach[:, None].astype(float)) * given[at - first]
    values = y[at - first]
    wy = w * values
    return _line(w.sum(1), (w * u).sum(1), (w * u * u).sum(1), wy.sum(1), (wy * u).sum(1), n, y[x - first] if plain is None else plain)


def smooth(y: np.ndarray, given: np.ndarray, first: int, n: int, q: int) -> np.ndarray:
    """Fits over the nearest q values (q odd), each with its own weight `given`, at positions first, first + 1, ... of a series of n."""
    size, last = len(y), first + len(y) - 1
    if q >= n:
        if first > 1 or last < n:
            return np.full(size, np.nan)
        x = np.arange(1, n + 1)
        return fit_at(y, given, 1, n, q, x, np.ones(n, np.int64), n)
    half = (q - 1) // 2
    out = np.full(size, np.nan)
    if size >= q:
        u = np.arange(-half, half + 1)
        k = _weights(np.abs(u), np.full(q, float(half)))
        sums = [np.convolve(v, (k * u ** p)[::-1], "valid") for v, p in ((given, 0), (given, 1), (given, 2), (given * y, 0), (given * y, 1))]
        out[half:size - half] = _line(*sums, n, y[half:size - half])
        if first == 1:
            x = np.arange(1, half + 1)
            out[:half] = fit_at(y, given, first, n, q, x, np.ones(half, np.int64), q)
        if last == n:
            x = np.arange(n - half + 1, n + 1)
            out[size - half:] = fit_at(y, given, first, n, q, x, np.full(half, n - q + 1), q)
    return out


@dataclass(frozen=True)
class Stl:
    """Window widths (odd) and rounds of the decomposition."""

    period: int
    seasonal: int
    trend: int
    low_pass: int
    inner: int
    outer: int

    @classmethod
    def of(cls, period: int, seasonal: int | None = None, trend: int | None = None, low_pass: int | None = None, robust: bool = False,
           inner: int | None = None, outer: int | None = None) -> Stl:
        seasonal = 7 if seasonal is None else int(seasonal)
        if period < 2:
            raise ValueError("period must be at least 2")
        if seasonal < 3 or seasonal % 2 == 0:
            raise ValueError("seasonal must be odd and at least 3")
        trend = math.ceil(1.5 * period / (1 - 1.5 / seasonal)) | 1 if trend is None else int(trend)
        low_pass = (period + 1) | 1 if low_pass is None else int(low_pass)
        for name, width in (("trend", trend), ("low_pass", low_pass)):
            if width < 3 or width % 2 == 0 or width <= period:
                raise ValueError(f"{name} must be odd, at least 3 and larger than the period")
        return cls(int(period), seasonal, trend, low_pass, (2 if robust else 5) if inner is None else inner, (15 if robust else 0) if outer is None else outer)

    @property
    def reach(self) -> int:
        """Values to either side that a value can depend on after all rounds."""
        return (self.seasonal * self.period + 2 * self.period + self.low_pass + self.trend + 4) * self.inner * (self.outer + 1)

    def cycles(self, d: np.ndarray, given: np.ndarray, first: int, n: int) -> np.ndarray:
        """Every phase smoothed on its own, from one period before the first to one after the last position."""
        p, out = self.period, np.full(len(d) + 2 * self.period, np.nan)
        for phase in range(min(p, n)):
            at = (phase - (first - 1)) % p
            part, weights = d[at::p], given[at::p]
            if not len(part):
                continue
            start, count = (first + at - 1) // p + 1, (n - phase - 1) // p + 1
            fits = smooth(part, weights, start, count, self.seasonal)
            out[at + p:at + p + len(part) * p:p] = fits
            width = min(self.seasonal, count)
            if start == 1 and len(part) >= width:
                out[at] = fit_at(part, weights, start, count, self.seasonal, np.array([0]), np.array([1]), width, fits[:1])[0]
            if start + len(part) - 1 == count and len(part) >= width:
                out[at + p + len(part) * p] = fit_at(part, weights, start, count, self.seasonal, np.array([count + 1]), np.array([count - width + 1]), width, fits[-1:])[0]
        return out

    def rounds(self, y: np.ndarray, given: np.ndarray, trend: np.ndarray, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Season and trend after the inner rounds. `y` starts at position `first` of a series of n values."""
        ones, season = np.ones(len(y)), np.zeros(len(y))
        for _ in range(self.inner):
            cycle = self.cycles(y - trend, given, first, n)
            low = cycle
            for width in (self.period, self.period, 3):
                low = np.convolve(low, np.full(width, 1.0 / width), "valid")
            season = cycle[self.period:-self.period] - smooth(low, ones, first, n, self.low_pass)
            trend = smooth(y - season, given, first, n, self.trend)
        return season, trend


def robust_weights(residual: np.ndarray, scale: float) -> np.ndarray:
    """Weights that fall to 0 at `scale`, six medians of the absolute residuals."""
    r = np.abs(residual)
    if not scale > 0:
        return np.ones(len(r))
    return np.where(r <= 0.001 * scale, 1.0, np.where(r <= 0.999 * scale, (1 - (r / scale) ** 2) ** 2, 0.0))

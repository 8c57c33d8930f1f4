"""Two-peak fits of spectra, a fit per row, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import smoothing_weights

SCHEMA = "id string, ea double, eb double, wa double, wb double, aa double, ab double, noise double, split_mev double, snr double"


def model(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Two Gaussians ``(centre, width, height)`` on a quadratic ground."""
    u = x - x.mean()
    return p[2] * np.exp(-((x - p[0]) ** 2) / (2 * p[1] ** 2)) + p[5] * np.exp(-((x - p[3]) ** 2) / (2 * p[4] ** 2)) + p[6] + p[7] * u + p[8] * u * u


def _slopes(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    u, out = x - x.mean(), np.empty((len(x), 9))
    for i in (0, 3):
        d = x - p[i]
        e = np.exp(-(d**2) / (2 * p[i + 1] ** 2))
        out[:, i], out[:, i + 1], out[:, i + 2] = p[i + 2] * e * d / p[i + 1] ** 2, p[i + 2] * e * d**2 / p[i + 1] ** 3, e
    out[:, 6], out[:, 7], out[:, 8] = 1.0, u, u * u
    return out


def levenberg(x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Damped least squares inside bounds: a parameter at a bound that would leave it stays there for the step, and
    steps are cut at the bounds."""
    p, damp = np.clip(start, low, high), 1.0
    error = float(((model(p, x) - y) ** 2).sum())
    for _ in range(rounds):
        j = _slopes(p, x)
        a, g = j.T @ j, j.T @ (y - model(p, x))
        free = np.flatnonzero(~(((p <= low) & (g < 0)) | ((p >= high) & (g > 0))))
        part = a[np.ix_(free, free)]
        step = np.zeros_like(p)
        step[free] = np.linalg.lstsq(part + damp * np.diag(np.maximum(np.diag(part), 1e-12)), g[free], rcond=None)[0]
        tried = np.clip(p + step, low, high)
        now = float(((model(tried, x) - y) ** 2).sum())
        if now < error:
            small = error - now <= 1e-12 * error
            p, error, damp = tried, now, max(1e-9, damp / 3)
            if small:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return p


# The window of energies, the least points, each peak's bounds of centre and width, their starts, and the
# guards: peaks above so many deviations of the rest, centres so far from their bounds.
WINDOW, POINTS = (1.72, 2.14), 150
CENTRES, WIDTHS = ((1.76, 1.92), (1.90, 2.10)), ((0.012, 0.07), (0.012, 0.08))
STARTS = ((1.86, 0.03), (2.00, 0.035))
ABOVE, INSIDE = 2.5, 0.008


def fit_one(x: np.ndarray, y: np.ndarray) -> dict | None:
    """The fit of a spectrum: two Gaussians in their bounds on a quadratic ground, from fixed starts with heights of three
    tenths of the smoothed range. None with too few points inside the window, a peak lost in the noise, or a centre
    near one of its bounds."""
    inside = np.isfinite(x) & np.isfinite(y) & (x > WINDOW[0]) & (x < WINDOW[1])
    x, y = x[inside], y[inside]
    if len(x) < POINTS:
        return None
    smooth = _smooth(y)
    range_ = float(smooth.max() - smooth.min())
    start, low, high = [], [], []
    for (centre, width), bounds, widths, top in zip(STARTS, CENTRES, WIDTHS, (5.0, 5.0), strict=True):
        start += [centre, width, 0.3 * range_]
        low += [bounds[0], widths[0], 0.001 * range_]
        high += [bounds[1], widths[1], top * range_]
    free = [-np.inf] * 3, [np.inf] * 3
    p = levenberg(x, y, np.array([*start, float(smooth.min()), 0.0, 0.0]), np.array(low + free[0]), np.array(high + free[1]))
    noise = float(np.std(y - model(p, x)))
    for i, (a, b) in zip((0, 3), CENTRES, strict=True):
        if p[i + 2] < ABOVE * noise or min(p[i] - a, b - p[i]) < INSIDE:
            return None
    return {"ea": p[0], "eb": p[3], "wa": p[1], "wb": p[4], "aa": p[2], "ab": p[5], "noise": noise, "split_mev": 1000 * (p[3] - p[0]), "snr": min(p[2], p[5]) / max(noise, 1e-12)}


def _smooth(y: np.ndarray, size: int = 21, degree: int = 3) -> np.ndarray:
    """A cubic over a moving window, the ends on the first and last window's."""
    weights, half, n = np.array(smoothing_weights(size, degree)), size // 2, len(y)
    starts = np.clip(np.arange(n) - half, 0, n - size)
    return (weights[np.arange(n) - starts] * y[starts[:, None] + np.arange(size)]).sum(axis=1)


def fit_spectra(spectra: DataFrame, ident: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """One row per spectrum; the fit's columns are null where there is none."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [{"id": r.id} | (fit_one(np.asarray(r.x, float), np.asarray(r.y, float)) or {}) for r in b.itertuples()]
            yield pd.DataFrame(out, columns=names)

    return spectra.select(F.col(ident).cast("string").alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).mapInPandas(run, SCHEMA)

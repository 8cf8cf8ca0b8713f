"""Signal functions of traces (array<double>), as Arrow-fed pandas UDFs: whole
batches of equal-length traces go through one FFT."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ARRAY = "array<double>"


def analytic(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the last axis: one-sided spectrum, doubled."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def _by_length(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[pd.Series], pd.Series]:
    """``f`` over the traces of each length at once; nulls and empties stay."""

    def run(s: pd.Series) -> pd.Series:
        out: list = [None] * len(s)
        groups: dict[int, list[int]] = {}
        for k, v in enumerate(s):
            if v is not None:
                groups.setdefault(len(v), []).append(k)
        for n, rows in groups.items():
            got = f(np.stack([s.iloc[k] for k in rows]).astype(float)) if n else np.empty((len(rows), 0))
            for k, r in zip(rows, got, strict=True):
                out[k] = r
        return pd.Series(out)

    return run


def _udf(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    run = _by_length(f)

    def apply(s: pd.Series) -> pd.Series:
        return run(s)

    return F.pandas_udf(apply, ARRAY)


def envelope(col) -> Column:
    """Instantaneous amplitude."""
    return _udf(lambda x: np.abs(analytic(x)))(col)


def phase(col, continuous: bool = False) -> Column:
    """angle mod 2 pi less pi; its absolute value if ``continuous``."""
    f = lambda x: np.mod(np.angle(analytic(x)), 2 * np.pi) - np.pi
    return _udf((lambda x: np.abs(f(x))) if continuous else f)(col)


def instantaneous_frequency(col, rate: float = 1.0) -> Column:
    """Phase difference over 2 pi times the rate, the first 0."""

    def f(x: np.ndarray) -> np.ndarray:
        p = np.unwrap(np.angle(analytic(x)))
        return np.concatenate([np.zeros((len(x), 1)), np.diff(p) / (2 * np.pi) * rate], axis=1)

    return _udf(f)(col)


def amplitude_spectrum(col) -> Column:
    return _udf(lambda x: np.abs(np.fft.rfft(x)))(col)


def ricker(width: float, length: int) -> np.ndarray:
    t = np.arange(length) - (length - 1) / 2
    a = 2 / (np.sqrt(3 * width) * np.pi**0.25)
    return a * (1 - (t / width) ** 2) * np.exp(-((t / width) ** 2) / 2)


def wavelet(col, width: float) -> Column:
    """Convolution with a Ricker wavelet, of the trace's length."""

    def f(x: np.ndarray) -> np.ndarray:
        w = ricker(width, min(int(10 * width) | 1, 2 * x.shape[1] - 1))
        n = x.shape[1] + len(w) - 1
        full = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(w, n), n)
        return full[:, len(w) // 2 : len(w) // 2 + x.shape[1]]

    return _udf(f)(col)


def modified(x: np.ndarray, shift: float = 0.0, angle: float = 0.0, gain: float = 1.0) -> np.ndarray:
    """Phase rotation (of a degree or more), shift by interpolation, gain."""
    if abs(angle) >= 1:
        s = np.fft.rfft(x) * np.exp(1j * np.deg2rad(angle))
        x = np.fft.irfft(s, x.shape[-1])
    n = np.arange(x.shape[-1])
    return gain * np.stack([np.interp(n - shift, n, r) for r in x])


def modify_trace(col, shift: float = 0.0, angle: float = 0.0, gain: float = 1.0) -> Column:
    return _udf(lambda x: modified(x, shift, angle, gain))(col)


def lowpass(col, share: float) -> Column:
    """Zero-phase low-pass: frequencies over ``share`` of Nyquist roll off as of order 4."""

    def f(x: np.ndarray) -> np.ndarray:
        w = np.fft.rfftfreq(x.shape[1]) * 2 / share
        return np.fft.irfft(np.fft.rfft(x) / (1 + w**8), x.shape[1])

    return _udf(f)(col)


def bandpass(col, low: float | None = None, high: float | None = None, sign: bool = False) -> Column:
    """Zero-phase band-pass, ``low`` and ``high`` as shares of Nyquist, rolling
    off as of order 4; with ``sign`` only the sign of what passes."""

    def f(x: np.ndarray) -> np.ndarray:
        w = np.fft.rfftfreq(x.shape[1]) * 2
        g = np.ones(len(w))
        if high is not None:
            g = g / (1 + (w / high) ** 8)
        if low is not None:
            g = g * (1 - 1 / (1 + (w / low) ** 8))
        out = np.fft.irfft(np.fft.rfft(x) * g, x.shape[1])
        return np.sign(out) if sign else out

    return _udf(f)(col)


def gaussian(col, sigma: float = 2.0) -> Column:
    """Gaussian along the trace, cut at 4 sigma, weights of present samples normalised."""

    def f(x: np.ndarray) -> np.ndarray:
        k = int(4 * sigma + 0.5)
        w = np.exp(-np.arange(-k, k + 1) ** 2 / (2 * sigma * sigma))
        full = lambda v: np.apply_along_axis(np.convolve, 1, v, w)[:, k : k + x.shape[1]]
        return full(x) / full(np.ones_like(x))

    return _udf(f)(col)


def prominent_peaks(x: np.ndarray, prominence: float, threshold: float, distance: int) -> np.ndarray:
    """1 at peaks (no neighbour larger) of at least ``threshold`` that rise
    ``prominence`` over the higher of the lows towards larger samples; of peaks
    closer than ``distance`` the higher one (ties: the first)."""
    n = len(x)
    padded = np.concatenate([[-np.inf], x, [-np.inf]])
    peaks = np.flatnonzero((x >= padded[:-2]) & (x >= padded[2:]) & (x >= threshold))
    kept = []
    for p in peaks:
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        lo = x[(left[-1] if len(left) else 0) : p + 1].min()
        hi = x[p : (p + 1 + right[0] if len(right) else n - 1) + 1].min()
        if x[p] - max(lo, hi) >= prominence:
            kept.append(p)
    out, taken = np.zeros(n), []
    for p in sorted(kept, key=lambda p: (-x[p], p)):
        if all(abs(p - q) >= distance for q in taken):
            taken.append(p)
    out[taken] = 1
    return out


def skeletonize(col, prominence: float = 0.05, threshold: float = 0.05, distance: int = 5) -> Column:
    """1 at prominent peaks of each trace, 0 elsewhere."""
    return _udf(lambda x: np.stack([prominent_peaks(r, prominence, threshold, distance) for r in x]))(col)


def local_similarity(a: np.ndarray, b: np.ndarray, window: int = 9, strength: float = 0.5) -> np.ndarray:
    """Regularised local similarity: the two least-squares ratios of a to b and
    b to a, each smoothed by a triangle of ``window`` (shaping), solved
    exactly; the square root of their product with the sign of the first."""
    n = len(a)
    h = np.convolve(np.ones(window), np.ones(window))
    h = h / h.sum()
    s = np.stack([np.convolve(e, h, "same") for e in np.eye(n)], axis=1)

    def ratio(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        lam = strength * (q @ q) / n
        return np.linalg.solve(lam * np.eye(n) + s @ (np.diag(q * q) - lam * np.eye(n)), s @ (q * p))

    c, d = ratio(a, b), ratio(b, a)
    return np.sign(c) * np.sqrt(np.clip(c * d, 0, None))


def similarity(a, b, window: int = 9, strength: float = 0.5) -> Column:
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else local_similarity(np.asarray(p, float), np.asarray(q, float), window, strength) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(apply, ARRAY)(a, b)


def match(a: np.ndarray, b: np.ndarray, reach: int = 100, parts: int = 10, taper: float = 0.1) -> tuple[float, float, float, float]:
    """(shift, angle in degrees, gain, correlation) that bring b to a: peak of
    the envelope of the correlation over shifts -reach..reach by 1 / parts, and
    the phase there. A Hann taper lowers the envelope over half its share at
    each end. Outside its samples a trace is 0, hence shifts without overlap
    have correlation 0. Moved between samples, b is a mix of two whole lags, so
    that products of whole lags give all shifts."""
    padded = np.pad(b, (reach + 1, reach + 1))
    lags = np.lib.stride_tricks.sliding_window_view(padded, len(b))[::-1][1:]  # lags -reach..reach + 1
    dot, own, next_ = lags @ a, (lags * lags).sum(axis=1), (lags[:-1] * lags[1:]).sum(axis=1)
    step = np.arange(2 * reach * parts + 1)
    k, f = step // parts, step % parts / parts
    k1 = np.minimum(k + 1, len(lags) - 1)
    energy = (1 - f) ** 2 * own[k] + 2 * f * (1 - f) * next_[np.minimum(k, len(next_) - 1)] + f**2 * own[k1]
    norm = np.sqrt((a * a).sum() * np.maximum(energy, 0))
    z = analytic(((1 - f) * dot[k] + f * dot[k1]) / np.where(norm > 0, norm, 1))
    envelope = np.abs(z)
    n = int(taper * len(envelope))
    window = np.ones(len(envelope))
    if n > 1:
        hann = np.hanning(n)
        window[: n // 2], window[-(n // 2) :] = hann[: n // 2], hann[-(n // 2) :]
    at = int(np.argmax(envelope * window))
    rms = np.sqrt((b * b).mean())
    return float(step[at] / parts - reach), float(np.rad2deg(np.angle(z[at]))), float(np.sqrt((a * a).mean()) / rms) if rms > 0 else 0.0, float(envelope[at])


def match_pair(a, b) -> Column:
    """array(shift, angle, gain, correlation) for two trace columns."""

    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else list(match(np.asarray(p, float), np.asarray(q, float))) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(apply, ARRAY)(a, b)

"""Small numpy kernels for one waveform segment; Spark partitions and shuffles the work."""

from __future__ import annotations

import numpy as np


def zero_phase_butterworth(x: np.ndarray, fs: float, low: float | None, high: float | None, order: int = 3) -> np.ndarray:
    """Forward-backward Butterworth response (squared magnitude) applied in the frequency domain."""
    n = len(x)
    padded = np.concatenate([2 * x[0] - x[1:][::-1], x, 2 * x[-1] - x[:-1][::-1]]) if n > 1 else x
    f = np.fft.rfftfreq(len(padded), 1.0 / fs)
    gain = np.ones_like(f)
    if high is not None:
        gain = gain / (1.0 + (f / high) ** (2 * order))
    if low is not None:
        with np.errstate(divide="ignore"):
            gain = gain / (1.0 + np.where(f > 0, low / np.maximum(f, 1e-12), np.inf) ** (2 * order))
    out = np.fft.irfft(np.fft.rfft(padded) * gain, len(padded))
    return out[n - 1 : 2 * n - 1] if n > 1 else out


def peaks(x: np.ndarray, distance: int, prominence: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and prominences of local maxima, the higher one winning within ``distance``."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    prom = np.zeros(len(at))
    for i, p in enumerate(at):
        higher = np.flatnonzero(x > x[p])
        left = higher[higher < p].max(initial=-1)
        right = higher[higher > p].min(initial=len(x))
        prom[i] = x[p] - max(x[left + 1 : p + 1].min(), x[p:right].min())
    at, prom = at[prom >= prominence], prom[prom >= prominence]
    keep = np.ones(len(at), dtype=bool)
    for i in np.argsort(-x[at], kind="stable"):
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep], prom[keep]


def sample_entropy(x: np.ndarray, m: int = 2, tolerance: float = 0.2) -> float:
    """-log of the share of template matches of length m that also match at m + 1 (Chebyshev)."""
    n, r = len(x), tolerance * np.std(x)
    if n < m + 2 or r == 0:
        return np.nan

    def matches(k: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, k)[: n - m]
        close = np.max(np.abs(t[:, None, :] - t[None, :, :]), axis=2) <= r
        return int(close.sum() - len(t))

    a, b = matches(m + 1), matches(m)
    return float(-np.log(a / b)) if a and b else np.nan


#: Window lengths of the fluctuation analysis and the fewest values it needs.
DFA_SCALES, DFA_MIN_COUNT = (4, 6, 8, 10, 12, 16), 40


def dfa_alpha(x: np.ndarray, scales: tuple[int, ...] = DFA_SCALES, min_count: int = DFA_MIN_COUNT) -> float:
    """Slope of log fluctuation against log scale of the detrended walk; NaN for too few or constant values."""
    if len(x) < min_count or np.std(x) < 1e-8:
        return np.nan
    walk = np.cumsum(x - x.mean())
    sizes, flucts = [], []
    for s in scales:
        k = len(walk) // s
        if k < 2:
            continue
        parts = walk[: k * s].reshape(k, s)
        t = np.arange(s) - (s - 1) / 2.0
        trend = (parts @ t / (t @ t))[:, None] * t + parts.mean(axis=1, keepdims=True)
        f = np.sqrt(np.mean((parts - trend) ** 2))
        if f > 0:
            sizes.append(np.log(s))
            flucts.append(np.log(f))
    return float(np.polyfit(sizes, flucts, 1)[0]) if len(sizes) >= 3 else np.nan


def lomb_scargle(t: np.ndarray, x: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """Normalised periodogram of unevenly sampled values."""
    y = x - x.mean()
    w = 2 * np.pi * frequencies[:, None]
    tau = np.arctan2(np.sin(2 * w * t).sum(1), np.cos(2 * w * t).sum(1))[:, None] / (2 * w)
    c, s = np.cos(w * (t - tau)), np.sin(w * (t - tau))
    with np.errstate(divide="ignore", invalid="ignore"):
        power = (c @ y) ** 2 / (c * c).sum(1) + (s @ y) ** 2 / (s * s).sum(1)
    return np.nan_to_num(power) / max(2 * y.var(), 1e-12)


def welch(x: np.ndarray, fs: float, size: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Averaged spectrum of half-overlapping Hann windows."""
    size = min(size, len(x))
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(size // 2, 1)]
    window = np.hanning(size)
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window, axis=1)) ** 2
    return np.fft.rfftfreq(size, 1.0 / fs), power.mean(0) / (fs * (window**2).sum())


def savgol_derivative(x: np.ndarray, window: int = 7, degree: int = 3, step: float = 1.0) -> np.ndarray:
    """First derivative by local polynomials (edges by the nearest full window)."""
    half = window // 2
    if len(x) < window:
        return np.full(len(x), np.nan)
    t = np.arange(-half, half + 1)
    design = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    fits = np.lib.stride_tricks.sliding_window_view(x, window) @ design.T
    powers = np.arange(1, degree + 1)

    def slope(coeff: np.ndarray, at: float) -> float:
        return float((coeff[1:] * powers * at ** (powers - 1)).sum())

    middle = fits[:, 1]
    left = [slope(fits[0], i - half) for i in range(half)]
    right = [slope(fits[-1], i + 1) for i in range(half)]
    return np.concatenate([left, middle, right]) / step


def max_lagged_correlation(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[float, int]:
    """Greatest absolute correlation over lags -reach..reach, and its lag."""
    best, at = 0.0, 0
    for lag in range(-reach, reach + 1):
        u, v = (a[lag:], b[: len(b) - lag]) if lag >= 0 else (a[:lag], b[-lag:])
        if len(u) >= 5 and u.std() > 0 and v.std() > 0:
            r = float(np.corrcoef(u, v)[0, 1])
            if abs(r) > abs(best):
                best, at = r, lag
    return best, at


def width_at_level(x: np.ndarray, peak: int, level: float) -> float:
    """Width of a pulse where it crosses ``level`` of its height above the segment's minimum."""
    cut = x.min() + level * (x[peak] - x.min())
    left, right = peak, peak
    while left > 0 and x[left] >= cut:
        left -= 1
    while right < len(x) - 1 and x[right] >= cut:
        right += 1
    return float(right - left)


def decay_constant(x: np.ndarray) -> tuple[float, float]:
    """Time constant and R2 of an exponential decay towards the minimum (log-linear fit)."""
    y = x - x.min()
    use = y > 1e-9
    if use.sum() < 4:
        return np.nan, np.nan
    t, z = np.flatnonzero(use).astype(float), np.log(y[use])
    k, c = np.polyfit(t, z, 1)
    rest = z - (k * t + c)
    r2 = 1.0 - rest.var() / z.var() if z.var() > 0 else np.nan
    return (float(-1.0 / k) if k < 0 else np.nan), float(r2)

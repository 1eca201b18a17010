"""Dense kernels in NumPy: spectrogram, smoothing, saliency, peaks, landmarks of a signal."""

from __future__ import annotations

import numpy as np

from larkspan.config import Config, Landmarks
from larkspan.operators.greedy import select_dense

TOP_DB = 80.0


def spectrogram(samples: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Magnitudes in dB below the maximum plus 80, (bins, frames); frames are centred, edges padded with zeros."""
    x = np.pad(np.asarray(samples, np.float64) / 32767.0, window // 2)
    if len(x) < window:
        x = np.pad(x, (0, window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    power = np.abs(np.fft.rfft(frames * hann, axis=1).T) ** 2
    ceiling = max(float(power.max(initial=0.0)), 1e-10)
    db = 10 * np.log10(np.maximum(power, 1e-10) / ceiling)
    return np.maximum(db, db.max(initial=-TOP_DB) - TOP_DB) + TOP_DB


def gaussian(x: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    """Gaussian smoothing along an axis, cut at four deviations, edges repeated."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), 2 * r + 1, axis=axis)
    return view @ (k / k.sum())


def smooth(x: np.ndarray, sigmas: tuple[float, float]) -> np.ndarray:
    return gaussian(gaussian(x, sigmas[0], 0), sigmas[1], 1)


def saliency(band: np.ndarray, c: Landmarks = Landmarks()) -> np.ndarray:
    """Local contrast over local energy, with a little of the level itself, within -12 and 12. The finely smoothed band takes the
    place of the band throughout: as the level, and under the background."""
    level = smooth(band, c.fine)
    contrast = level - smooth(level, c.background)
    energy = smooth(contrast**2, c.normalization)
    score = c.contrast_weight * contrast / np.sqrt(energy + c.contrast_floor**2) + c.magnitude_weight * np.maximum(level - c.magnitude_threshold, 0)
    return np.clip(score, -12, 12)


def peaks(field: np.ndarray, radius_f: int, radius_t: int) -> list[tuple[int, int]]:
    """(f, t) of box maxima, one for every plateau: the first of its connected cells."""
    if not field.size:
        return []
    pad = np.pad(field, ((radius_f, radius_f), (radius_t, radius_t)), constant_values=-np.inf)
    top = np.lib.stride_tricks.sliding_window_view(pad, (2 * radius_f + 1, 2 * radius_t + 1)).max(axis=(2, 3))
    cells = set(map(tuple, np.argwhere(field == top).tolist()))
    out = []
    while cells:
        first = min(cells)
        stack = [first]
        cells.discard(first)
        while stack:
            f, t = stack.pop()
            for g in (f - 1, f, f + 1):
                for u in (t - 1, t, t + 1):
                    if (g, u) in cells and field[g, u] == field[f, t]:
                        cells.discard((g, u))
                        stack.append((g, u))
        out.append(first)
    return sorted(out)


#: Added to both energies, so that silence has the ratio 1.
QUIET = 0.25


def energy_rates(field: np.ndarray, seconds_per_frame: float, c: Landmarks = Landmarks()) -> np.ndarray:
    """Landmarks per second allowed at every frame: rate * (local over background energy) ^ exponent within bounds. A smoothing's deviation is
    a quarter of its seconds, one frame at least, and the background's is no less than the local one."""
    strongest = -np.sort(-np.maximum(field, 0), axis=0)[: max(1, field.shape[0] // 20)]
    energy = strongest.mean(axis=0)[None, :]
    local = max(1.0, c.window_seconds / seconds_per_frame / 4)
    near = gaussian(energy, local, 1)[0]
    far = gaussian(energy, max(local, c.background_seconds / seconds_per_frame / 4), 1)[0]
    return np.clip(c.rate * ((near + QUIET) / (far + QUIET)) ** c.exponent, c.min_rate, c.max_rate)


def landmarks(samples: np.ndarray, config: Config = Config(), shift: int = 0, magnitude: bool = False) -> list[tuple[int, int, float]]:
    """(f, t, score) of a signal. ``magnitude`` ranks peaks by level instead of saliency (the control)."""
    s, c = config.signal, config.landmarks
    spec = spectrogram(np.asarray(samples)[shift * (s.hop // s.shifts) :], s.window, s.hop)
    low, high = max(0, c.min_bin), min(spec.shape[0], c.max_bin)
    band = spec[low:high].astype(np.float32)
    field = band if magnitude else saliency(band, c)
    limit = c.magnitude_threshold if magnitude else c.saliency_threshold
    found = [(f + low, t, float(field[f, t])) for f, t in peaks(field, c.radius_f, c.radius_t) if field[f, t] > limit]
    seconds = s.hop / s.sample_rate
    rates = energy_rates(field, seconds, c)
    return select_dense(found, lambda t: max(1, round(float(rates[t]) * c.window_seconds)), c.window_seconds / seconds)

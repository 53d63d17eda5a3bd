"""Band energies of frames: one transform a frame serves all bands."""

from __future__ import annotations

import numpy as np


def band_energies(frames: np.ndarray, sr: float, centres: np.ndarray, half_width: float, harmonics: int = 1, scaled: bool = True) -> np.ndarray:
    """frames x centres: sums of |rfft|^2 (of |rfft / n|^2 if scaled) over bins within half_width of h * centre, h = 1..harmonics, bounds included."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames, axis=1) / (n if scaled else 1)) ** 2
    f = np.fft.rfftfreq(n, 1 / sr)
    weights = np.zeros((len(f), len(centres)))
    for h in range(1, harmonics + 1):
        weights += np.abs(f[:, None] - h * centres[None, :]) <= half_width
    return power @ weights


def total_energy(frames: np.ndarray, scaled: bool = True) -> np.ndarray:
    n = frames.shape[1]
    return (np.abs(np.fft.rfft(frames, axis=1) / (n if scaled else 1)) ** 2).sum(axis=1)


def time_features(x: np.ndarray) -> dict[str, float]:
    """rms, peak, crest factor, peak to peak, kurtosis (Pearson) and skewness of one recording; the last two are NaN for a constant one."""
    x = np.asarray(x, float)
    rms, peak = float(np.sqrt(np.mean(x * x))), float(np.abs(x).max())
    d = x - x.mean()
    m2 = float(np.mean(d * d)) if x.max() > x.min() else np.nan
    return {"rms": rms, "peak": peak, "crest_factor": peak / rms if rms > 0 else 0.0, "peak_to_peak": float(x.max() - x.min()), "kurtosis": float(np.mean(d**4)) / m2**2, "skewness": float(np.mean(d**3)) / m2**1.5}

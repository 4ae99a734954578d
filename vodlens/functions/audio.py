"""Acoustic features of PCM samples, over many frames at once: rows are frames, samples are numbers of any float kind."""

from __future__ import annotations

import numpy as np

#: Fixed values of the quality gate: a peak that counts as clipped, the share of the quietest samples, their energy without noise and its ratio.
CLIPPED, QUIET_SHARE, NO_NOISE, CLEAN_DB, LEAST_DB = 0.999, 0.10, 1e-10, 40.0, 12.0


def framed(x: np.ndarray, size: int, hop: int | None = None) -> np.ndarray:
    """All whole frames of `size` samples every `hop` (side by side by default), without a copy."""
    if len(x) < size:
        return np.empty((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[:: hop or size]


def rms(frames: np.ndarray) -> np.ndarray:
    return np.sqrt((frames * frames).mean(1))


def zero_crossing_rate(frames: np.ndarray) -> np.ndarray:
    """The share of neighbouring samples of which one is negative and the other is not."""
    if frames.shape[1] < 2:
        return np.zeros(len(frames))
    return np.diff(frames < 0, axis=1).mean(1)


def spectral_centroid(frames: np.ndarray, rate: float) -> np.ndarray:
    """The mean frequency, weighted by the magnitudes of the Fourier transform."""
    size = np.abs(np.fft.rfft(frames, axis=1))
    return (size * np.fft.rfftfreq(frames.shape[1], 1.0 / rate)).sum(1) / (size.sum(1) + 1e-8)


def subbands(x: np.ndarray, dim: int) -> np.ndarray:
    """The mean magnitude in `dim` bands of the spectrum, at unit length; of silence the first unit vector."""
    bands = np.array([b.mean() if len(b) else 0.0 for b in np.array_split(np.abs(np.fft.rfft(x)), dim)])
    size = np.sqrt(bands @ bands)
    return bands / size if size > 0 else np.eye(1, dim)[0]


def quality(x: np.ndarray) -> tuple[bool, float]:
    """Whether samples are good enough for a voiceprint, and their ratio of signal to noise in dB.

    Clipped samples are not; noise is the mean energy of the quietest tenth.
    """
    if not len(x) or np.abs(x).max() >= CLIPPED:
        return False, 0.0
    energy = x * x
    cut = max(1, int(len(x) * QUIET_SHARE))
    noise = float(np.partition(energy, cut - 1)[:cut].mean())
    db = CLEAN_DB if noise <= NO_NOISE else 10 * float(np.log10(max(1e-9, energy.mean() / noise)))
    return db >= LEAST_DB, round(db, 2)

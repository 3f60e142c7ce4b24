"""Signal features of audio kernels."""

from __future__ import annotations

import numpy as np


def mel_filters(n_mels: int, n_fft: int, rate: int) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale: (n_mels, n_fft/2 + 1)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - f) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def deltas(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """Regression slopes over ``reach`` frames on both sides, edges repeated."""
    p = np.pad(x, ((reach, reach), (0, 0)), "edge")
    n = len(x)
    return sum(d * (p[reach + d : reach + d + n] - p[reach - d : reach - d + n]) for d in range(1, reach + 1)) / (2 * sum(d * d for d in range(1, reach + 1)))


def mfcc(signal: np.ndarray, rate: int = 16000, n_mfcc: int = 13, n_mels: int = 40, window_ms: float = 25, hop_ms: float = 10, preemphasis: float = 0.97, orders: int = 2) -> np.ndarray:
    """(frames, n_mfcc * (1 + orders)) cepstra with their deltas."""
    x = np.append(signal[:1], signal[1:] - preemphasis * signal[:-1])
    size, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * np.hamming(size)
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames, n_fft)) ** 2 / n_fft
    log = np.log(np.maximum(power @ mel_filters(n_mels, n_fft, rate).T, 1e-10))
    k = np.arange(n_mfcc)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n_mels) + 1) / (2 * n_mels)) * np.sqrt(2 / n_mels)
    basis[0] /= np.sqrt(2)
    out = [log @ basis.T]
    for _ in range(orders):
        out.append(deltas(out[-1]))
    return np.concatenate(out, 1)

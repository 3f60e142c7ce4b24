"""Numeric functions for kernels: digamma, log-sum-exp, resampling, embeddings."""

from __future__ import annotations

import numpy as np


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def logsumexp(a: np.ndarray, axis: int = -1, keepdims: bool = False) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(a - top).sum(axis, keepdims=True)) + top
    return out if keepdims else out.squeeze(axis)


def resample(y: np.ndarray, n: int) -> np.ndarray:
    """Fourier resampling of each column of (T, D) to ``n`` points."""
    t = len(y)
    spec = np.fft.rfft(y, axis=0)
    keep = min(n, t) // 2 + 1
    out = np.zeros((n // 2 + 1, y.shape[1]), complex)
    out[:keep] = spec[:keep]
    if min(n, t) % 2 == 0 and n != t:  # the shared Nyquist bin
        out[keep - 1] *= 2 if n < t else 0.5
    return np.fft.irfft(out, n, axis=0) * (n / t)


def embed(y: np.ndarray, n: int, technique: str = "resample") -> np.ndarray:
    """A (T, D) segment as a vector of n x D: ``resample``, ``interpolate``
    or ``rasanen`` (block means); flattened dimension by dimension."""
    y = np.asarray(y, float)
    if technique == "rasanen" and len(y) >= n:
        step = len(y) // n
        z = y[: step * n].reshape(n, step, -1).mean(1)
    elif technique == "resample" and len(y) > 1:
        z = resample(y, n)
    else:
        at = np.linspace(0, len(y) - 1, n)
        z = np.stack([np.interp(at, np.arange(len(y)), y[:, d]) for d in range(y.shape[1])], 1)
    return z.T.ravel()


def log_gaussian(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """P25 for stacks: diagonal (``var`` of the mean's shape)."""
    return -0.5 * (np.log(2 * np.pi * var) + (x - mean) ** 2 / var).sum(-1)


def log_gaussian_full(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """P25 with a full covariance matrix."""
    d = x - mean
    sign, logdet = np.linalg.slogdet(cov)
    return -0.5 * (len(mean) * np.log(2 * np.pi) + logdet + np.einsum("...i,...i->...", d, np.linalg.solve(cov, d[..., None])[..., 0]))

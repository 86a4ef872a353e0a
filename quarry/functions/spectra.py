"""Signals as array columns, part two: transforms, spectra and filters in Arrow batches.

Each function makes a Column through lifted(): a pandas UDF that gives every row's
arrays to a numpy kernel. Rows are independent, so work is in proportion to the
samples, without a shuffle; null signals give null. Complex results are
structs of arrays re and im; designs of filters (from numbers alone) are plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.waves import frequency_bins, windowed

ARRAY, COMPLEX, ROWS = "array<double>", "struct<re:array<double>,im:array<double>>", "array<array<double>>"
_c = lambda x: F.col(x) if isinstance(x, str) else x


def lifted(kernel: Callable, ddl: str, *columns: Column | str) -> Column:
    """kernel(arrays...) for each row; a kernel gives a number, an array, a tuple of arrays (a struct) or rows of arrays."""
    fields = [f.split(":")[0].strip() for f in _fields(ddl)] if ddl.startswith("struct") else None

    def packed(x):
        # results stay arrays of eight bytes a number until Arrow takes them
        return list(x) if isinstance(x, np.ndarray) and x.ndim == 2 else x

    def run(*series):
        import pandas as pd

        out = [[] for _ in fields or [ddl]]
        for values in zip(*series):
            found = (None,) * len(out)
            if all(v is not None for v in values):
                arrays = [np.array([np.asarray(r, float) for r in v]) if len(v) and isinstance(v[0], (np.ndarray, list)) else np.asarray(v, float) for v in values]
                found = kernel(*arrays) if fields else (kernel(*arrays),)
            for column, x in zip(out, found):
                column.append(packed(x))
        return pd.DataFrame({f: column for f, column in zip(fields, out)}) if fields else pd.Series(out[0])

    import pandas as pd

    result = pd.DataFrame if ddl.startswith("struct") else pd.Series

    # a UDF's inputs are read from its signature
    def one(a: pd.Series) -> result:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> result:
        return run(a, b)

    for f in (one, two):
        f.__annotations__ = {k: pd.Series for k in ("a", "b")[:f.__code__.co_argcount]} | {"return": result}
    return F.pandas_udf({1: one, 2: two}[len(columns)], ddl)(*map(_c, columns))


def _fields(ddl: str) -> list[str]:
    inner, depth, out = ddl[ddl.index("<") + 1:-1], 0, [""]
    for ch in inner:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _window(n: int, kind: str) -> np.ndarray:
    return np.array(windowed(n, kind))


def _pair(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return z.real, z.imag


# Fourier transforms of whole signals.


def fft_signal(x, n_fft: int | None = None) -> Column:
    return lifted(lambda s: _pair(np.fft.fft(s, n_fft)), COMPLEX, x)


def ifft_signal(spectrum, length: int | None = None) -> Column:
    """From a struct of re and im, back to re and im."""
    z = _c(spectrum)
    return lifted(lambda a, b: _pair(np.fft.ifft(a + 1j * b)[:length]), COMPLEX, z["re"], z["im"])


def rfft_signal(x, n_fft: int | None = None) -> Column:
    return lifted(lambda s: _pair(np.fft.rfft(s, n_fft)), COMPLEX, x)


def irfft_signal(spectrum, n_fft: int | None = None, length: int | None = None) -> Column:
    z = _c(spectrum)
    return lifted(lambda a, b: np.fft.irfft(a + 1j * b, n_fft)[:length], ARRAY, z["re"], z["im"])


def _spectrum(s: np.ndarray, n_fft: int | None, window: str) -> np.ndarray:
    return np.fft.rfft(s * _window(len(s), window), n_fft)


def fft_spectrum(x, n_fft: int | None = None, window: str = "hann") -> Column:
    return lifted(lambda s: _pair(_spectrum(s, n_fft, window)), COMPLEX, x)


def _scaled(v: np.ndarray, normalize: bool) -> np.ndarray:
    top = v.max(initial=0.0)
    return v / top if normalize and top > 0 else v


def amplitude_spectrum(x, n_fft: int | None = None, window: str = "hann", normalize: bool = False) -> Column:
    return lifted(lambda s: _scaled(np.abs(_spectrum(s, n_fft, window)), normalize), ARRAY, x)


def power_spectrum(x, n_fft: int | None = None, window: str = "hann", normalize: bool = False) -> Column:
    return lifted(lambda s: _scaled(np.abs(_spectrum(s, n_fft, window)) ** 2, normalize), ARRAY, x)


def phase_spectrum(x, n_fft: int | None = None, window: str = "hann", unwrap: bool = False) -> Column:
    return lifted(lambda s: (np.unwrap if unwrap else np.asarray)(np.angle(_spectrum(s, n_fft, window))), ARRAY, x)


def top_frequency_peaks(x, rate: float = 1.0, n_fft: int | None = None, window: str = "hann", top_k: int = 5, ignore_dc: bool = True) -> Column:
    """Rows (frequency, amplitude) of the largest amplitudes, the largest first."""
    def kernel(s):
        a = np.abs(_spectrum(s, n_fft, window))
        bins = np.arange(len(a))[int(ignore_dc):]
        best = bins[np.argsort(-a[bins], kind="stable")[:top_k]]
        return np.stack([best * rate / (n_fft or len(s)), a[best]], axis=1)

    return lifted(kernel, ROWS, x)


def dominant_frequency(x, rate: float = 1.0, **more) -> Column:
    return top_frequency_peaks(x, rate, top_k=1, **more)[0][0]


def band_energy(x, bands: list[tuple[float, float]], rate: float = 1.0, n_fft: int | None = None, window: str = "hann", normalize: bool = False) -> Column:
    """Sum of power with low <= frequency < high, by band."""
    def kernel(s):
        p = np.abs(_spectrum(s, n_fft, window)) ** 2
        f = np.array(frequency_bins(n_fft or len(s), rate))
        e = np.array([p[(f >= lo) & (f < hi)].sum() for lo, hi in bands])
        return e / p.sum() if normalize and p.sum() > 0 else e

    return lifted(kernel, ARRAY, x)


# Short-time transforms.


def _frames(s: np.ndarray, length: int, hop: int, pad_end: bool) -> np.ndarray:
    count = max(-(-(len(s) - length) // hop) + 1, 1) if pad_end else (len(s) - length) // hop + 1
    if not len(s) or count < 1:
        return np.zeros((0, length))
    full = np.concatenate([s, np.zeros(max(0, (count - 1) * hop + length - len(s)))])
    return np.lib.stride_tricks.sliding_window_view(full, length)[::hop][:count]


def _stft(s, length, hop, window, n_fft, pad_end=True) -> np.ndarray:
    return np.fft.rfft(_frames(s, length, hop or length // 2, pad_end) * _window(length, window), n_fft or length, axis=1)


def stft(x, length: int = 256, hop: int | None = None, window: str = "hann", n_fft: int | None = None, pad_end: bool = True) -> Column:
    """struct of re and im, a row a frame."""
    def kernel(s):
        z = _stft(s, length, hop, window, n_fft, pad_end)
        return z.real, z.imag

    return lifted(kernel, "struct<re:array<array<double>>,im:array<array<double>>>", x)


def overlapped(frames: np.ndarray, hop: int, window: np.ndarray | None, length: int | None) -> np.ndarray:
    """Frames added where they overlap, divided by the sum of squared windows."""
    count, size = frames.shape
    if not count:
        return np.zeros(0)
    w = np.ones(size) if window is None else window
    out, norm = np.zeros((count - 1) * hop + size), np.zeros((count - 1) * hop + size)
    for k in range(count):
        out[k * hop:k * hop + size] += frames[k] * w
        norm[k * hop:k * hop + size] += w * w
    return (out / np.where(norm > 1e-12, norm, 1.0))[:length]


def overlap_add(frames, hop: int, window: str | None = None, length: int | None = None) -> Column:
    return lifted(lambda f: overlapped(np.atleast_2d(f), hop, None if window is None else _window(np.atleast_2d(f).shape[1], window), length), ARRAY, frames)


def istft(spectrogram, length: int = 256, hop: int | None = None, window: str = "hann", samples: int | None = None) -> Column:
    """From stft()'s struct back to samples."""
    z = _c(spectrogram)
    return lifted(lambda a, b: overlapped(np.fft.irfft(np.atleast_2d(a + 1j * b), length, axis=1), hop or length // 2, _window(length, window), samples), ARRAY, z["re"], z["im"])


def spectral_power(x, length: int = 256, hop: int | None = None, window: str = "hann", n_fft: int | None = None) -> Column:
    return lifted(lambda s: np.abs(_stft(s, length, hop, window, n_fft)) ** 2, ROWS, x)


def _by_frame(measure: Callable):
    def column(x, rate: float = 1.0, length: int = 256, hop: int | None = None, window: str = "hann", n_fft: int | None = None, **more) -> Column:
        f = np.array(frequency_bins(n_fft or length, rate))
        return lifted(lambda s: measure(np.abs(_stft(s, length, hop, window, n_fft)) ** 2, f, **more), ARRAY, x)

    return column


def _centroid(p, f):
    return (p @ f) / np.maximum(p.sum(axis=1), 1e-12)


spectral_centroid = _by_frame(_centroid)
spectral_bandwidth = _by_frame(lambda p, f: np.sqrt((p * (f[None, :] - _centroid(p, f)[:, None]) ** 2).sum(axis=1) / np.maximum(p.sum(axis=1), 1e-12)))
spectral_flatness = _by_frame(lambda p, f, eps=1e-12: np.exp(np.log(p + eps).mean(axis=1)) / (p + eps).mean(axis=1))
spectral_rolloff = _by_frame(lambda p, f, share=0.85: f[np.minimum((np.cumsum(p, axis=1) < share * p.sum(axis=1, keepdims=True)).sum(axis=1), len(f) - 1)])


def mel_filter_bank(rate: float, n_fft: int, n_mels: int = 26, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles on the mel scale: a row a band, a column a frequency bin."""
    mel = lambda h: 2595 * np.log10(1 + h / 700)
    edges = 700 * (10 ** (np.linspace(mel(low), mel(high or rate / 2), n_mels + 2) / 2595) - 1)
    bins = np.floor((n_fft + 1) * edges / rate).astype(int)
    k = np.arange(n_fft // 2 + 1)[None, :]
    left, middle, right = (bins[i:i + n_mels, None] for i in range(3))
    up, down = (k - left) / np.maximum(middle - left, 1), (right - k) / np.maximum(right - middle, 1)
    return np.where((k >= left) & (k < middle), up, np.where((k >= middle) & (k < right), down, 0.0))


def _mel(s, rate, length, hop, n_fft, n_mels, low, high, window):
    return np.abs(_stft(s, length, hop, window, n_fft)) ** 2 @ mel_filter_bank(rate, n_fft or length, n_mels, low, high).T


def mel_spectrogram(x, rate: float, length: int = 256, hop: int | None = None, n_fft: int | None = None, n_mels: int = 26, low: float = 0.0, high: float | None = None, window: str = "hann") -> Column:
    return lifted(lambda s: _mel(s, rate, length, hop, n_fft, n_mels, low, high, window), ROWS, x)


def log_mel_spectrogram(x, rate: float, length: int = 256, hop: int | None = None, n_fft: int | None = None, n_mels: int = 26, low: float = 0.0, high: float | None = None, window: str = "hann", eps: float = 1e-12) -> Column:
    return lifted(lambda s: np.log(np.maximum(_mel(s, rate, length, hop, n_fft, n_mels, low, high, window), eps)), ROWS, x)


def mfcc(x, rate: float, n_mfcc: int = 13, n_mels: int = 26, length: int = 256, hop: int | None = None, window: str = "hann", eps: float = 1e-12) -> Column:
    """First coefficients of the orthonormal cosine transform of log mel power, a row a frame."""
    k = np.arange(n_mfcc)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n_mels)[None, :] + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))
    return lifted(lambda s: np.log(np.maximum(_mel(s, rate, length, hop, None, n_mels, 0.0, None, window), eps)) @ basis.T, ROWS, x)


# Spectral densities.


def _segments(s, size, overlap, detrend):
    size = min(size, len(s))
    step = size - (size // 2 if overlap is None else min(overlap, size - 1))
    parts = _frames(s, size, step, False)
    return parts - parts.mean(axis=1, keepdims=True) if detrend else parts


def _cross(a, b, rate, size, overlap, window, detrend, scaling, n_fft=None):
    p, q = _segments(a, size, overlap, detrend), _segments(b, size, overlap, detrend)
    w, n = _window(p.shape[1], window), n_fft or p.shape[1]
    z = (np.conj(np.fft.rfft(p * w, n)) * np.fft.rfft(q * w, n)).mean(axis=0)
    z = z / (rate * (w * w).sum() if scaling == "density" else w.sum() ** 2)
    z[1:(-1 if n % 2 == 0 else None)] *= 2
    return z


def welch_psd(x, rate: float = 1.0, size: int = 256, overlap: int | None = None, window: str = "hann", detrend: bool = True, scaling: str = "density") -> Column:
    """One-sided mean of the segments' periodograms."""
    return lifted(lambda s: _cross(s, s, rate, size, overlap, window, detrend, scaling).real, ARRAY, x)


def periodogram(x, rate: float = 1.0, window: str = "boxcar", detrend: bool = True, scaling: str = "density") -> Column:
    return lifted(lambda s: _cross(s, s, rate, len(s), 0, window, detrend, scaling).real, ARRAY, x)


def cross_spectrum(x, y, rate: float = 1.0, size: int = 256, overlap: int | None = None, window: str = "hann", detrend: bool = True, scaling: str = "density") -> Column:
    return lifted(lambda a, b: _pair(_cross(a, b, rate, size, overlap, window, detrend, scaling)), COMPLEX, x, y)


def coherence(x, y, rate: float = 1.0, size: int = 256, overlap: int | None = None, window: str = "hann", detrend: bool = True) -> Column:
    """Squared cross spectrum over the product of both densities, 0 where that is 0."""
    def kernel(a, b):
        own = lambda u, v: _cross(u, v, rate, size, overlap, window, detrend, "density")
        both = own(a, a).real * own(b, b).real
        return np.where(both > 1e-300, np.abs(own(a, b)) ** 2 / np.maximum(both, 1e-300), 0.0)

    return lifted(kernel, ARRAY, x, y)


def real_cepstrum(x, n_fft: int | None = None, eps: float = 1e-12) -> Column:
    return lifted(lambda s: np.fft.irfft(np.log(np.maximum(np.abs(np.fft.rfft(s, n_fft)), eps)), n_fft or len(s)), ARRAY, x)


def complex_cepstrum(x, n_fft: int | None = None, eps: float = 1e-12) -> Column:
    """Inverse transform of log magnitude and unwrapped phase without its straight part."""
    def kernel(s):
        z = np.fft.fft(s, n_fft)
        n = len(z)
        phase = np.unwrap(np.angle(z))
        turns = np.round(phase[n // 2] / np.pi)
        return np.fft.ifft(np.log(np.maximum(np.abs(z), eps)) + 1j * (phase - np.pi * turns * np.arange(n) / max(n // 2, 1))).real

    return lifted(kernel, ARRAY, x)


# The analytic signal.


def _analytic(s: np.ndarray, n_fft: int | None = None) -> np.ndarray:
    n = n_fft or len(s)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1:(n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(s, n) * gain)[:len(s)]


def analytic_signal(x, n_fft: int | None = None) -> Column:
    return lifted(lambda s: _pair(_analytic(s, n_fft)), COMPLEX, x)


def hilbert_transform(x, n_fft: int | None = None) -> Column:
    return lifted(lambda s: _analytic(s, n_fft).imag, ARRAY, x)


def instantaneous_amplitude(x, n_fft: int | None = None) -> Column:
    return lifted(lambda s: np.abs(_analytic(s, n_fft)), ARRAY, x)


def instantaneous_phase(x, n_fft: int | None = None, unwrap: bool = True) -> Column:
    return lifted(lambda s: (np.unwrap if unwrap else np.asarray)(np.angle(_analytic(s, n_fft))), ARRAY, x)


def instantaneous_frequency(x, rate: float = 1.0, n_fft: int | None = None) -> Column:
    return lifted(lambda s: np.gradient(np.unwrap(np.angle(_analytic(s, n_fft)))) * rate / (2 * np.pi), ARRAY, x)


# Filters.


def _taps(low: float | None, high: float | None, rate: float, taps: int, window: str) -> np.ndarray:
    """A windowed sinc that passes frequencies from low to high."""
    t = np.arange(taps) - (taps - 1) / 2
    ideal = lambda f: 2 * f / rate * np.sinc(2 * f / rate * t)
    return ((ideal(high) if high else np.sinc(t)) - (ideal(low) if low else 0.0)) * _window(taps, window)


def bandpass_filter(x, low: float, high: float, rate: float, taps: int = 101, window: str = "hann") -> Column:
    return lifted(lambda s: np.convolve(s, _taps(low, high, rate, taps, window), "same")[:len(s)], ARRAY, x)


def bandstop_filter(x, low: float, high: float, rate: float, taps: int = 101, window: str = "hann") -> Column:
    def kernel(s):
        h = -_taps(low, high, rate, taps, window)
        h[(taps - 1) // 2] += 1
        return np.convolve(s, h, "same")[:len(s)]

    return lifted(kernel, ARRAY, x)


def notch_filter(x, frequency: float, bandwidth: float, rate: float, taps: int = 101, window: str = "hann") -> Column:
    return bandstop_filter(x, max(frequency - bandwidth / 2, 1e-9), frequency + bandwidth / 2, rate, taps, window)


def _recursive(s: np.ndarray, b, a) -> np.ndarray:
    b, a = np.asarray(b, float) / a[0], np.asarray(a, float) / a[0]
    driven = np.convolve(s, b)[:len(s)]
    if len(a) == 1:
        return driven
    out, back = np.zeros(len(s) + len(a) - 1), a[:0:-1]
    for t in range(len(s)):
        out[t + len(a) - 1] = driven[t] - back @ out[t:t + len(a) - 1]
    return out[len(a) - 1:]


def iir_filter(x, b, a=(1.0,)) -> Column:
    """The causal difference equation a * y = b * x, from rest."""
    return lifted(lambda s: _recursive(s, b, a), ARRAY, x)


def zero_phase_filter(x, b, a=(1.0,)) -> Column:
    """Forwards, then backwards."""
    return lifted(lambda s: _recursive(_recursive(s, b, a)[::-1], b, a)[::-1].copy(), ARRAY, x)


def de_emphasis(x, coef: float = 0.97) -> Column:
    """Undoes pre_emphasis."""
    return iir_filter(x, (1.0,), (1.0, -coef))


def butterworth(order: int, cutoff: float | tuple[float, float], rate: float, kind: str = "lowpass") -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of a digital filter: analogue poles on a circle, moved by the bilinear map with warped edges."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if order < 1 or (edges <= 0).any() or (edges >= rate / 2).any() or (len(edges) == 2) != (kind in ("bandpass", "bandstop")):
        raise ValueError("order and edges must suit the kind and the rate")
    w = 2 * np.tan(np.pi * edges / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "lowpass":
        zeros, poles = np.zeros(0), poles * w[0]
    elif kind == "highpass":
        zeros, poles = np.zeros(order), w[0] / poles
    else:
        middle, width = w[0] * w[1], w[1] - w[0]
        half = poles * width / 2 if kind == "bandpass" else width / (2 * poles)
        root = np.sqrt(half**2 - middle)
        poles = np.concatenate([half + root, half - root])
        zeros = np.zeros(order) if kind == "bandpass" else np.tile([1j, -1j], order) * np.sqrt(middle)
    z = np.concatenate([(2 + zeros) / (2 - zeros), -np.ones(len(poles) - len(zeros))])
    p = (2 + poles) / (2 - poles)
    b, a = np.poly(z).real, np.poly(p).real
    at = {"lowpass": 0.0, "highpass": np.pi, "bandstop": 0.0}.get(kind, 2 * np.arctan(np.sqrt(w.prod()) / 2))
    u = np.exp(-1j * at * np.arange(len(a)))
    return b * abs((a @ u) / (b @ u[:len(b)])), a


def frequency_response(b, a=(1.0,), n: int = 512, rate: float = 1.0, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and H on a uniform grid of half the circle, or of all of it."""
    w = np.arange(n) * (2 if whole else 1) * np.pi / n
    z = lambda c: np.exp(-1j * np.outer(w, np.arange(len(c)))) @ np.asarray(c, float)
    return w * rate / (2 * np.pi), z(b) / z(a)


def magnitude_response(b, a=(1.0,), n: int = 512, rate: float = 1.0, db: bool = False):
    f, h = frequency_response(b, a, n, rate)
    return f, 20 * np.log10(np.maximum(np.abs(h), 1e-12)) if db else np.abs(h)


def phase_response(b, a=(1.0,), n: int = 512, rate: float = 1.0, unwrap: bool = True):
    f, h = frequency_response(b, a, n, rate)
    return f, np.unwrap(np.angle(h)) if unwrap else np.angle(h)


def group_delay(b, a=(1.0,), n: int = 512, rate: float = 1.0):
    f, phase = phase_response(b, a, n, rate)
    return f, -np.gradient(phase, np.pi / n)


def pole_zero(b, a=(1.0,)):
    """Zeros, poles and the leading gain."""
    return np.roots(b), np.roots(a), b[0] / a[0]


def is_stable(a, margin: float = 0.0) -> bool:
    return bool((np.abs(np.roots(a)) < 1 - margin).all())


def verify_filter(b, a=(1.0,), rate: float = 1.0, passband=None, stopband=None, n: int = 2048, tolerance_db: float = 1.0, stopband_db: float = 40.0) -> dict:
    """Stability, and how far the response strays within the passband and reaches in the stopband."""
    f, m = magnitude_response(b, a, n, rate, db=True)
    out = {"stable": is_stable(a), "max_db": float(m.max())}
    if passband:
        out["ripple_db"] = float(np.abs(m[(f >= passband[0]) & (f <= passband[1])]).max())
        out["passband_ok"] = out["ripple_db"] <= tolerance_db
    if stopband:
        out["leak_db"] = float(m[(f >= stopband[0]) & (f <= stopband[1])].max())
        out["stopband_ok"] = out["leak_db"] <= -stopband_db
    return out


def envelope_demodulate(x, rate: float = 1.0, band: tuple[float, float] | None = None, order: int = 4) -> Column:
    """Magnitude of the analytic signal, of a band of it where one is given."""
    b, a = butterworth(order, band, rate, "bandpass") if band else ((1.0,), (1.0,))
    return lifted(lambda s: np.abs(_analytic(_recursive(_recursive(s, b, a)[::-1], b, a)[::-1])), ARRAY, x)


def envelope_spectrum(x, n_fft: int | None = None, window: str = "hann") -> Column:
    """Amplitudes of the centred envelope."""
    def kernel(s):
        e = np.abs(_analytic(s))
        return np.abs(_spectrum(e - e.mean(), n_fft, window))

    return lifted(kernel, ARRAY, x)


# Parametric spectra.


def _yule_walker(s, order):
    s = s - s.mean()
    r = np.array([s[:len(s) - k] @ s[k:] for k in range(order + 1)]) / len(s)
    lags = np.abs(np.subtract.outer(np.arange(order), np.arange(order)))
    phi = np.linalg.solve(r[lags] + 1e-12 * np.eye(order), r[1:])
    return phi, float(r[0] - phi @ r[1:])


def fit_ar(x, order: int = 8) -> Column:
    """Coefficients of x[t - 1], ..., x[t - order] by the Yule-Walker equations, then the noise's variance."""
    return lifted(lambda s: np.append(*_yule_walker(s, order)), ARRAY, x)


def ar_spectrum(x, order: int = 8, rate: float = 1.0, n_fft: int = 512) -> Column:
    def kernel(s):
        phi, noise = _yule_walker(s, order)
        _, h = frequency_response((1.0,), np.concatenate([[1.0], -phi]), n_fft // 2 + 1, rate)
        k = np.exp(-2j * np.pi * np.outer(np.arange(n_fft // 2 + 1), np.arange(1, order + 1)) / n_fft)
        return noise / rate / np.abs(1 - k @ phi) ** 2

    return lifted(kernel, ARRAY, x)


def prony(x, order: int, rate: float = 1.0) -> Column:
    """Rows (frequency, damping, amplitude) of damped exponentials, by linear prediction and least squares."""
    def kernel(s):
        past = np.lib.stride_tricks.sliding_window_view(s[:-1], order)[:, ::-1]
        phi = np.linalg.lstsq(past, s[order:], rcond=None)[0]
        z = np.roots(np.concatenate([[1.0], -phi]))
        amplitude = np.linalg.lstsq(z[None, :] ** np.arange(len(s))[:, None], s.astype(complex), rcond=None)[0]
        return np.stack([np.angle(z) * rate / (2 * np.pi), np.log(np.maximum(np.abs(z), 1e-300)) * rate, np.abs(amplitude)], axis=1)[np.argsort(-np.abs(amplitude))]

    return lifted(kernel, ROWS, x)


# Wavelets.


def wavelet_scales(n: int = 32, low: float = 1.0, high: float = 64.0, spacing: str = "log") -> list[float]:
    return (np.geomspace if spacing == "log" else np.linspace)(low, high, n).tolist()


def cwt(x, scales: list[float], w0: float = 6.0) -> Column:
    """Morlet coefficients: re and im, a row a scale, with mirrored ends."""
    def kernel(s):
        n, rows = len(s), []
        full = np.pad(s, n - 1, mode="reflect") if n > 1 else s
        f = 2 * np.pi * np.fft.fftfreq(len(full))
        z = np.fft.fft(full)
        for a in scales:
            wave = np.pi**-0.25 * np.exp(-0.5 * (a * f - w0) ** 2) * (f > 0) * np.sqrt(2 * np.pi * a)
            rows.append(np.fft.ifft(z * wave)[n - 1:2 * n - 1] if n > 1 else np.fft.ifft(z * wave))
        z = np.array(rows)
        return z.real, z.imag

    return lifted(kernel, "struct<re:array<array<double>>,im:array<array<double>>>", x)


def wavelet_power(coefficients) -> Column:
    z = _c(coefficients)
    return F.zip_with(z["re"], z["im"], lambda a, b: F.zip_with(a, b, lambda u, v: u * u + v * v))


def extract_ridge(power, smoothness: float = 1.0) -> Column:
    """The row of most log power at each time, with a price for each step between rows: the best path over all times."""
    def kernel(p):
        gain = np.log(np.maximum(np.atleast_2d(p), 1e-12))
        rows, price = np.arange(len(gain)), smoothness * np.abs(np.subtract.outer(np.arange(len(gain)), np.arange(len(gain))))
        best, came = gain[:, 0], []
        for t in range(1, gain.shape[1]):
            options = best[None, :] - price
            came.append(options.argmax(axis=1))
            best = options[rows, came[-1]] + gain[:, t]
        at = [int(best.argmax())]
        for back in reversed(came):
            at.append(int(back[at[-1]]))
        return np.array(at[::-1], float)

    return lifted(kernel, ARRAY, power)

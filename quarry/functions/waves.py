"""Signals as array columns, part one: what built-in array functions express.

A signal is an array<double> column of one row. Everything here is a Column
expression, so it runs in the JVM, within the projection it stands in. Null
signals give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def total(x: Column) -> Column:
    """Sum in order."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def deviation(x: Column) -> Column:
    """Population deviation."""
    return let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def doubles(x: Column | str) -> Column:
    return F.transform(_c(x), lambda v: v.cast("double"))


def windowed(n: int, kind: str = "hann") -> list[float]:
    """Symmetric window values: hann, hamming or boxcar; one sample weighs 1."""
    a = {"hann": 0.5, "hamming": 0.54, "boxcar": 1.0}[kind]
    return [1.0] * n if n < 2 else [a - (1 - a) * math.cos(2 * math.pi * k / (n - 1)) for k in range(n)]


def hann_window(n: int) -> Column:
    return F.array(*map(F.lit, windowed(n, "hann")))


def hamming_window(n: int) -> Column:
    return F.array(*map(F.lit, windowed(n, "hamming")))


def normalize_signal(x: Column | str, eps: float = 1e-12) -> Column:
    """(x - mean) / (population deviation + eps)."""
    return let(_c(x), lambda s: let(F.struct(mean(s).alias("m"), deviation(s).alias("d")), lambda p: F.transform(s, lambda v: (v - p["m"]) / (p["d"] + eps))))


def pre_emphasis(x: Column | str, coef: float = 0.97) -> Column:
    """Each sample less coef times the one before."""
    # the inner lambda names no outer variable: Spark 4.1 may leave a Python UDF on such an argument unevaluated
    return let(_c(x), lambda s: F.zip_with(s, F.slice(F.concat(F.array(F.lit(0.0)), s), F.lit(1), F.size(s)), lambda v, before: v - coef * before))


def scale_amplitude(x: Column | str, factor: float) -> Column:
    return F.transform(_c(x), lambda v: v * factor)


def time_shift(x: Column | str, shift: int, fill: float = 0.0) -> Column:
    """Samples move right by shift (left if negative); what opens is filled."""
    return let(_c(x), lambda s: F.transform(s, lambda v, i: F.coalesce(F.when(i - shift >= 0, F.get(s, i - shift)), F.lit(fill))))


def pad_signal(x: Column | str, length: int, fill: float = 0.0) -> Column:
    """Filled on the right, or cut, to the length."""
    s = _c(x)
    return F.slice(F.concat(s, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(length) - F.size(s)))), 1, length)


def trim_signal(x: Column | str, length: int) -> Column:
    return F.slice(_c(x), 1, length)


def convolve1d(x: Column | str, kernel: list[float], mode: str = "full") -> Column:
    """Convolution with a fixed kernel: full, same (the middle, as long as the longer one) or valid."""
    m = len(kernel)

    def run(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: sum((F.lit(float(w)) * F.coalesce(F.when((i - k >= 0) & (i - k < n), F.get(s, i - k)), F.lit(0.0)) for k, w in enumerate(kernel)), F.lit(0.0))
        first = {"full": F.lit(0), "same": F.floor((F.least(n, F.lit(m)) - 1) / 2).cast("int"), "valid": F.least(n, F.lit(m)) - 1}[mode]
        count = {"full": n + m - 1, "same": F.greatest(n, F.lit(m)), "valid": F.greatest(n, F.lit(m)) - F.least(n, F.lit(m)) + 1}[mode]
        return F.transform(F.sequence(first, first + count - 1), at)

    return let(_c(x), run)


def moving_average(x: Column | str, width: int, mode: str = "valid") -> Column:
    return convolve1d(x, [1.0 / width] * width, mode)


def frame_signal(x: Column | str, length: int, hop: int, pad_end: bool = False) -> Column:
    """Frames of length samples every hop; a last short one only with pad_end, filled with 0."""
    def run(s: Column) -> Column:
        n = F.size(s)
        count = F.greatest(F.ceil((n - length) / hop) + 1, F.lit(1)) if pad_end else F.floor((n - length) / hop) + 1
        starts = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: pad_signal(F.slice(s, k * hop + 1, F.lit(length)), length))

    return let(_c(x), run)


def chunk_signal(x: Column | str, size: int, step: int | None = None, drop_last: bool = False, pad_end: bool = False, fill: float = 0.0) -> Column:
    """Pieces of size samples every step; the last short one stays, goes, or is filled."""
    step = step or size

    def run(s: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(s) - 1) / step).cast("int"))), lambda k: F.slice(s, k * step + 1, F.lit(size)))
        pieces = F.filter(pieces, lambda p: (F.size(p) == size) if drop_last else F.size(p) > 0)
        return F.transform(pieces, lambda p: pad_signal(p, size, fill)) if pad_end else pieces

    return let(_c(x), run)


def autocorrelation(x: Column | str, max_lag: int, normalize: bool = True, demean: bool = True) -> Column:
    """Sums of products with the signal moved by 0 to max_lag samples; of the centred signal, divided by lag 0."""
    def run(s: Column) -> Column:
        lag = lambda k: total(F.zip_with(F.slice(s, 1, F.size(s) - k), F.slice(s, k + 1, F.size(s)), lambda a, b: a * b))
        lags = F.transform(F.sequence(F.lit(0), F.least(F.lit(max_lag), F.size(s) - 1)), lag)
        return let(lags, lambda r: F.transform(r, lambda v: F.when(r[0] != 0, v / r[0]).otherwise(F.lit(0.0)))) if normalize else lags

    return let(let(_c(x), lambda s: let(mean(s), lambda m: F.transform(s, lambda v: v - m))) if demean else _c(x), run)


def cross_correlation(x: Column | str, y: Column | str, max_lag: int) -> Column:
    """Sums of x[t + lag] * y[t] for lags from -max_lag to max_lag, of centred signals, divided by the product of their norms."""
    centred = lambda c: let(_c(c), lambda s: let(mean(s), lambda m: F.transform(s, lambda v: v - m)))

    def run(p: Column) -> Column:
        a, b = p["a"], p["b"]
        norm = F.sqrt(total(F.transform(a, lambda v: v * v)) * total(F.transform(b, lambda v: v * v)))
        one = lambda k: total(F.zip_with(F.slice(a, F.greatest(k, F.lit(0)) + 1, F.size(a)), F.slice(b, F.greatest(-k, F.lit(0)) + 1, F.size(b)), lambda u, v: F.coalesce(u * v, F.lit(0.0))))
        return let(norm, lambda n: F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), lambda k: F.when(n > 0, one(k) / n).otherwise(F.lit(0.0))))

    return let(F.struct(centred(x).alias("a"), centred(y).alias("b")), run)


def resample_linear(x: Column | str, source_rate: float, target_rate: float) -> Column:
    """Straight between samples, at the target rate, over the same span."""
    ratio = source_rate / target_rate

    def run(s: Column) -> Column:
        n = F.size(s)
        count = F.greatest(F.lit(1), F.round(n / ratio).cast("int"))

        def at(k: Column) -> Column:
            t = F.least(k * ratio, (n - 1).cast("double"))
            low = F.floor(t).cast("int")
            return F.get(s, low) + (t - low) * (F.get(s, F.least(low + 1, n - 1)) - F.get(s, low))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(s)

    return let(_c(x), run)


def frame_energy(x: Column | str) -> Column:
    return mean(F.transform(_c(x), lambda v: v * v))


def rms_energy(x: Column | str) -> Column:
    return F.sqrt(frame_energy(x))


def zero_crossing_rate(x: Column | str) -> Column:
    """Share of steps whose samples have different signs (0 counts as positive)."""
    return let(_c(x), lambda s: F.try_divide(F.size(F.filter(F.transform(F.slice(s, 2, F.size(s)), lambda v, i: (v >= 0) != (F.get(s, i) >= 0)), lambda d: d)), F.size(s) - 1))


def signal_snr(reference: Column | str, estimate: Column | str, eps: float = 1e-12) -> Column:
    """Decibels of the reference's power over the error's."""
    error = F.zip_with(_c(reference), _c(estimate), lambda a, b: (a - b) * (a - b))
    return 10 * F.log10((frame_energy(reference) + eps) / (mean(error) + eps))


def signal_psnr(reference: Column | str, estimate: Column | str, peak: float | None = None, eps: float = 1e-12) -> Column:
    """Decibels of the squared peak (the reference's largest magnitude) over the error's power."""
    top = F.lit(float(peak)) if peak is not None else F.array_max(F.transform(_c(reference), F.abs))
    error = F.zip_with(_c(reference), _c(estimate), lambda a, b: (a - b) * (a - b))
    return 10 * F.log10((top * top + eps) / (mean(error) + eps))


def hz_to_mel(x: Column | str) -> Column:
    return 2595 * F.log10(1 + _c(x) / 700)


def mel_to_hz(x: Column | str) -> Column:
    return 700 * (F.pow(F.lit(10.0), _c(x) / 2595) - 1)


def frequency_bins(n_fft: int, rate: float = 1.0) -> list[float]:
    """Frequencies of the one-sided transform."""
    return [k * rate / n_fft for k in range(n_fft // 2 + 1)]


def peaks(x: Column | str, threshold: float = 0.0) -> Column:
    """Places of samples at least the threshold, not under the one before and above the one after."""
    return let(_c(x), lambda s: F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - 2)), lambda i: F.coalesce((F.get(s, i) >= threshold) & (F.get(s, i) >= F.get(s, i - 1)) & (F.get(s, i) > F.get(s, i + 1)), F.lit(False))))


def energy_events(x: Column | str, length: int, hop: int, threshold: float) -> Column:
    """Numbers of the frames whose root mean square reaches the threshold."""
    frames = F.transform(frame_signal(x, length, hop), rms_energy)
    return F.filter(F.transform(frames, lambda v, i: F.when(v >= threshold, i)), lambda i: i.isNotNull())


def quality(x: Column | str, saturation: float | None = None) -> Column:
    """struct: n, missing share, mean, rms, peak, crest factor, clipped share, share of repeated samples."""
    def run(s: Column) -> Column:
        good = F.filter(s, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

        def of(g: Column) -> Column:
            peak, rms, n = F.array_max(F.transform(g, F.abs)), rms_energy(g), F.size(g)
            top = F.lit(float(saturation)) if saturation is not None else F.array_max(F.transform(g, F.abs))
            flat = F.size(F.filter(F.transform(F.slice(g, 2, F.size(g)), lambda v, i: v == F.get(g, i)), lambda d: d))
            return F.struct(
                F.size(s).alias("n"), (1 - F.try_divide(n, F.size(s))).alias("missing"), mean(g).alias("mean"), rms.alias("rms"), peak.alias("peak"), F.try_divide(peak, rms).alias("crest"),
                F.try_divide(F.size(F.filter(g, lambda v: F.abs(v) >= top)), n).alias("clipped"), F.try_divide(flat, n - 1).alias("flat"))

        return let(good, of)

    return let(_c(x), run)


def noise(x: Column | str, kind: str, scale: float, seed: int, key: Column | str) -> Column:
    """Seeded noise for augmentation: gauss, uniform, laplace (added), jitter (times 1 + gauss),
    dropout (zero with chance scale), salt_pepper (the row's extremes with chance scale). The draw
    hangs on the row's key, the place and the seed, so reruns and other partitionings agree."""
    k = _c(key)
    unit = lambda i, salt: (F.pmod(F.xxhash64(k, i, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gauss = lambda i: F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * math.pi * unit(i, 1))
    laplace = lambda i: let(unit(i, 0) - 0.5, lambda u: -F.signum(u) * F.log(1 - 2 * F.abs(u)))

    def run(s: Column) -> Column:
        change = {
            "gauss": lambda v, i: v + scale * gauss(i), "uniform": lambda v, i: v + scale * (2 * unit(i, 0) - 1), "laplace": lambda v, i: v + scale * laplace(i),
            "jitter": lambda v, i: v * (1 + scale * gauss(i)), "dropout": lambda v, i: F.when(unit(i, 0) < scale, F.lit(0.0)).otherwise(v),
            "salt_pepper": lambda v, i: F.when(unit(i, 0) < scale / 2, F.array_min(s)).when(unit(i, 0) < scale, F.array_max(s)).otherwise(v),
        }[kind]
        return F.transform(s, change)

    return let(_c(x), run)


def mixup(x: Column | str, y: Column | str, weight: Column | float) -> Column:
    """weight * x + (1 - weight) * y, sample by sample."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.zip_with(_c(x), _c(y), lambda a, b: w * a + (1 - w) * b)


def cutmix(x: Column | str, y: Column | str, start: int, length: int) -> Column:
    """x with y's samples from start on, length of them."""
    return let(_c(y), lambda other: F.transform(_c(x), lambda v, i: F.when((i >= start) & (i < start + length), F.get(other, i)).otherwise(v)))


def shuffled(x: Column | str, seed: int, key: Column | str) -> Column:
    """Samples in a seeded order."""
    return F.transform(F.array_sort(F.transform(_c(x), lambda v, i: F.struct(F.xxhash64(_c(key), i, F.lit(seed)).alias("h"), i.alias("i"), v.alias("v")))), lambda p: p["v"])


# Made signals: arrays of round(rate * duration) samples.


def _times(rate: float, duration: float, at) -> Column:
    n = round(rate * duration)
    return F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda i: at(i / float(rate)))


def sine_wave(frequency: float = 440.0, rate: float = 16000, duration: float = 1.0, amplitude: float = 1.0, phase: float = 0.0) -> Column:
    return _times(rate, duration, lambda t: amplitude * F.sin(2 * math.pi * frequency * t + phase))


def multi_tone(frequencies: list[float], rate: float = 16000, duration: float = 1.0, amplitudes: list[float] | None = None) -> Column:
    weights = amplitudes or [1.0] * len(frequencies)
    return _times(rate, duration, lambda t: sum((a * F.sin(2 * math.pi * f * t) for f, a in zip(frequencies, weights)), F.lit(0.0)))


def chirp(low: float = 100.0, high: float = 1000.0, rate: float = 16000, duration: float = 1.0) -> Column:
    """The frequency grows straight from low to high."""
    return _times(rate, duration, lambda t: F.sin(2 * math.pi * (low * t + (high - low) / (2 * duration) * t * t)))


def impulse_train(period: int, rate: float = 16000, duration: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(round(rate * duration) - 1)), lambda i: F.when(i % period == 0, 1.0).otherwise(0.0))

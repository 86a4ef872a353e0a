"""Queries on signals as array columns: each embedding is a signal of its components."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import spectra as S
from quarry.functions import waves as W
from quarry.plans.common import rounded, table


def _x(spark, d):
    return table(spark, d, "embeddings").select("vec_id", W.doubles("embedding").alias("x"))


def digest(a):
    """Sum of entries by place: one number that tells arrays apart."""
    return W.total(F.transform(a, lambda v, i: v * (i + 1)))


def _by_row(digits=6, **columns):
    return lambda spark, d: rounded(_x(spark, d).select("vec_id", *(f().alias(k) for k, f in columns.items())), digits)


def _frames(x):
    return W.frame_signal(x, 16, 8)


def _round_trips(rows):
    back = {"fft": S.ifft_signal("z")["re"], "rfft": S.irfft_signal("r"), "emphasis": S.de_emphasis("e"), "stft": S.istft("s", 16, 8, "hamming", 64)}
    there = rows.select("vec_id", "x", S.fft_signal("x").alias("z"), S.rfft_signal("x").alias("r"), W.pre_emphasis("x").alias("e"), S.stft("x", 16, 8, "hamming").alias("s"))
    again = there.select("vec_id", "x", *(f.alias(k) for k, f in back.items()))
    return again.select("vec_id", *((F.array_max(F.zip_with(k, "x", lambda a, b: F.abs(a - b))) < 1e-9).alias(k) for k in back))


QUERIES = {
    "wave_elementwise": _by_row(
        6, normalized=lambda: digest(W.normalize_signal("x")), emphasised=lambda: digest(W.pre_emphasis("x")), scaled=lambda: digest(W.scale_amplitude("x", 2.5)), shifted=lambda: digest(W.time_shift("x", 3)),
        padded=lambda: digest(W.pad_signal("x", 70, 1.0)), trimmed=lambda: digest(W.trim_signal("x", 10)), averaged=lambda: digest(W.moving_average("x", 5)), rms=lambda: W.rms_energy("x"), energy=lambda: W.frame_energy("x"),
        crossings=lambda: W.zero_crossing_rate("x"), snr=lambda: W.signal_snr("x", W.scale_amplitude("x", 0.9)), psnr=lambda: W.signal_psnr("x", W.scale_amplitude("x", 0.9))),
    "wave_frames": _by_row(
        6, n_frames=lambda: F.size(_frames("x")).cast("long"), framed=lambda: digest(F.transform(_frames("x"), digest)), n_padded=lambda: F.size(W.frame_signal("x", 30, 20, True)).cast("long"),
        n_chunks=lambda: F.size(W.chunk_signal("x", 10)).cast("long"), n_whole=lambda: F.size(W.chunk_signal("x", 10, drop_last=True)).cast("long"),
        peaks=lambda: F.aggregate(F.transform(W.peaks("x", 0.1), lambda i: i.cast("long")), F.lit(0).cast("long"), lambda a, i: a + i), loud=lambda: F.size(W.energy_events("x", 16, 8, 0.12)).cast("long")),
    "wave_correlation": _by_row(6, own=lambda: digest(W.autocorrelation("x", 8)), raw=lambda: digest(W.autocorrelation("x", 8, normalize=False, demean=False)), other=lambda: digest(W.cross_correlation("x", F.reverse("x"), 4))),
    "wave_convolve": _by_row(6, full=lambda: digest(W.convolve1d("x", [0.5, 0.3, 0.2])), valid=lambda: digest(W.convolve1d("x", [0.5, 0.3, 0.2], "valid")), same=lambda: digest(W.convolve1d("x", [0.5, 0.3, 0.2], "same"))),
    "wave_resample": _by_row(6, half=lambda: digest(W.resample_linear("x", 64, 32)), more=lambda: digest(W.resample_linear("x", 64, 96))),
    "wave_quality": _by_row(6, q=lambda: W.quality("x")),
    "wave_augment": _by_row(6, mixed=lambda: digest(W.mixup("x", F.reverse("x"), 0.25)), cut=lambda: digest(W.cutmix("x", F.reverse("x"), 10, 20)), same_values=lambda: digest(F.array_sort(W.shuffled("x", 7, "vec_id")))),
    "wave_spectrum": _by_row(
        6, amplitude=lambda: digest(S.amplitude_spectrum("x")), power=lambda: digest(S.power_spectrum("x")), frequency=lambda: S.dominant_frequency("x", 64.0), bands=lambda: digest(S.band_energy("x", [(0, 8), (8, 20), (20, 33)], 64.0)),
        real_part=lambda: digest(S.rfft_signal("x")["re"]), imaginary=lambda: digest(S.fft_spectrum("x")["im"])),
    "wave_stft": _by_row(5, power=lambda: digest(F.transform(S.spectral_power("x", 16, 8), digest)), centroid=lambda: digest(S.spectral_centroid("x", 16.0, 16, 8)), bandwidth=lambda: digest(S.spectral_bandwidth("x", 16.0, 16, 8)), flatness=lambda: digest(S.spectral_flatness("x", 16.0, 16, 8))),
    "wave_periodogram": _by_row(6, density=lambda: digest(S.periodogram("x", 64.0)), welch=lambda: digest(S.welch_psd("x", 64.0, 64))),
    "wave_hilbert": _by_row(6, quadrature=lambda: digest(S.hilbert_transform("x")), envelope=lambda: digest(S.instantaneous_amplitude("x"))),
    "wave_recursive": _by_row(6, undone=lambda: digest(S.de_emphasis("x")), filtered=lambda: digest(S.iir_filter("x", (0.5, 0.25), (1.0, -0.5)))),
    "wave_round_trips": lambda spark, d: _round_trips(_x(spark, d)),
    "wave_made": lambda spark, d: rounded(table(spark, d, "region").filter("r_regionkey = 0").select(
        digest(W.sine_wave(5.0, 100, 0.5)).alias("sine"), digest(W.multi_tone([3.0, 7.0], 100, 0.5, [1.0, 0.5])).alias("tones"), digest(W.chirp(1.0, 20.0, 100, 0.5)).alias("chirp"), digest(W.impulse_train(7, 100, 0.5)).alias("impulses"),
        digest(W.hann_window(9)).alias("hann"), digest(W.hamming_window(9)).alias("hamming")), 6),
    "wave_mel_scale": lambda spark, d: rounded(table(spark, d, "part").select("p_partkey", W.hz_to_mel("p_retailprice").alias("mel"), W.mel_to_hz(W.hz_to_mel("p_retailprice")).alias("hz")), 4),
}
QUERIES["wave_quality"] = lambda spark, d: rounded(_x(spark, d).select("vec_id", W.quality("x").alias("q")).select("vec_id", F.col("q.n").cast("long").alias("n"), *(f"q.{c}" for c in ("missing", "mean", "rms", "peak", "crest", "clipped", "flat"))), 6)

_S = "WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), t AS (SELECT *, len(x) AS n, list_avg(x) AS m, list_aggregate(x, 'stddev_pop') AS d FROM s)"
_C = _S + ", c AS (SELECT *, list_transform(x, lambda v: v - m) AS y FROM t)"


def _d(expr):
    return f"list_sum(list_transform({expr}, lambda dv, di: dv * di))"


def _dft(signal, n, bins, use, window="1"):
    """use: an expression of re and im; one entry a bin."""
    part = lambda f: f"list_sum(list_transform({signal}, lambda fv, fi: fv * ({window}) * {f}(2 * pi() * k * (fi - 1) / {n})))"
    return f"list_transform(range(0, {bins}), lambda k: {use.replace('RE', part('cos')).replace('IM', '(-' + part('sin') + ')')})"


_HANN = "(0.5 - 0.5 * cos(2 * pi() * (fi - 1) / 63.0))"
_HANN16 = "(0.5 - 0.5 * cos(2 * pi() * (fi - 1) / 15.0))"
_P = _dft("x", "64", 33, "(RE) ^ 2 + (IM) ^ 2", _HANN)
_F16 = "list_transform(range(0, 7), lambda f: list_slice(x, f * 8 + 1, f * 8 + 16))"
_conv = lambda first, count: f"list_transform(range({first}, {first} + {count}), lambda i: 0.5 * (CASE WHEN i BETWEEN 0 AND n - 1 THEN x[i + 1] ELSE 0 END) + 0.3 * (CASE WHEN i - 1 BETWEEN 0 AND n - 1 THEN x[i] ELSE 0 END) + 0.2 * (CASE WHEN i - 2 BETWEEN 0 AND n - 1 THEN x[i - 1] ELSE 0 END))"
_lin = lambda count, ratio: f"list_transform(range(0, {count}), lambda k: x[CAST(floor(least(k * {ratio}, n - 1.0)) AS INT) + 1] + (least(k * {ratio}, n - 1.0) - floor(least(k * {ratio}, n - 1.0))) * (x[CAST(least(floor(least(k * {ratio}, n - 1.0)) + 1, n - 1) AS INT) + 1] - x[CAST(floor(least(k * {ratio}, n - 1.0)) AS INT) + 1]))"
_made = lambda count, e: _d(f"list_transform(range(0, {count}), lambda i: {e})")

ORACLES = {
    "wave_elementwise": f"""{_S} SELECT vec_id, round({_d('list_transform(x, lambda v: (v - m) / (d + 1e-12))')}, 6) AS normalized, round({_d('list_transform(x, lambda v, i: CASE WHEN i = 1 THEN v ELSE v - 0.97 * x[i - 1] END)')}, 6) AS emphasised,
 round({_d('x')} * 2.5, 6) AS scaled, round({_d('list_transform(x, lambda v, i: CASE WHEN i > 3 THEN x[i - 3] ELSE 0 END)')}, 6) AS shifted, round({_d('x')} + 65 + 66 + 67 + 68 + 69 + 70, 6) AS padded, round({_d('list_slice(x, 1, 10)')}, 6) AS trimmed,
 round({_d('list_transform(range(1, 61), lambda i: (x[i] + x[i + 1] + x[i + 2] + x[i + 3] + x[i + 4]) / 5)')}, 6) AS averaged, round(sqrt(list_avg(list_transform(x, lambda v: v * v))), 6) AS rms, round(list_avg(list_transform(x, lambda v: v * v)), 6) AS energy,
 round(len(list_filter(range(2, 65), lambda i: (x[i] >= 0) <> (x[i - 1] >= 0))) / 63.0, 6) AS crossings, round(10 * log10((list_avg(list_transform(x, lambda v: v * v)) + 1e-12) / (0.01 * list_avg(list_transform(x, lambda v: v * v)) + 1e-12)), 6) AS snr,
 round(10 * log10((list_max(list_transform(x, lambda v: abs(v))) ^ 2 + 1e-12) / (0.01 * list_avg(list_transform(x, lambda v: v * v)) + 1e-12)), 6) AS psnr FROM t""",
    "wave_frames": f"""{_S} SELECT vec_id, CAST(7 AS BIGINT) AS n_frames, round({_d(f'list_transform({_F16}, lambda fr: ' + _d('fr') + ')')}, 6) AS framed, CAST(3 AS BIGINT) AS n_padded, CAST(7 AS BIGINT) AS n_chunks, CAST(6 AS BIGINT) AS n_whole,
 CAST(coalesce(list_sum(list_filter(range(1, 63), lambda i: x[i + 1] >= 0.1 AND x[i + 1] >= x[i] AND x[i + 1] > x[i + 2])), 0) AS BIGINT) AS peaks, CAST(len(list_filter({_F16}, lambda fr: sqrt(list_avg(list_transform(fr, lambda v: v * v))) >= 0.12)) AS BIGINT) AS loud FROM t""",
    "wave_correlation": f"""{_C} SELECT vec_id, round({_d('list_transform(range(0, 9), lambda k: list_sum(list_transform(range(1, 65 - k), lambda i: y[i] * y[i + k])) / list_sum(list_transform(y, lambda v: v * v)))')}, 6) AS own,
 round({_d('list_transform(range(0, 9), lambda k: list_sum(list_transform(range(1, 65 - k), lambda i: x[i] * x[i + k])))')}, 6) AS raw,
 round({_d('list_transform(range(-4, 5), lambda k: list_sum(list_transform(list_filter(range(1, 65), lambda i: i + k BETWEEN 1 AND 64), lambda i: y[i + k] * y[65 - i])) / list_sum(list_transform(y, lambda v: v * v)))')}, 6) AS other FROM c""",
    "wave_convolve": f"{_S} SELECT vec_id, round({_d(_conv('0', '66'))}, 6) AS full, round({_d(_conv('2', '62'))}, 6) AS valid, round({_d(_conv('1', '64'))}, 6) AS same FROM t",
    "wave_resample": f"{_S} SELECT vec_id, round({_d(_lin('32', '2.0'))}, 6) AS half, round({_d(_lin('96', '(64 / 96.0)'))}, 6) AS more FROM t",
    "wave_quality": f"""{_S}, p AS (SELECT *, list_max(list_transform(x, lambda v: abs(v))) AS top, sqrt(list_avg(list_transform(x, lambda v: v * v))) AS r FROM t) SELECT vec_id, CAST(n AS BIGINT) AS n, 0.0::DOUBLE AS missing, round(m, 6) AS mean, round(r, 6) AS rms, round(top, 6) AS peak,
 round(top / r, 6) AS crest, round(len(list_filter(x, lambda v: abs(v) >= top)) / 64.0, 6) AS clipped, round(len(list_filter(range(2, 65), lambda i: x[i] = x[i - 1])) / 63.0, 6) AS flat FROM p""",
    "wave_augment": f"""{_S} SELECT vec_id, round({_d('list_transform(x, lambda v, i: 0.25 * v + 0.75 * x[65 - i])')}, 6) AS mixed, round({_d('list_transform(x, lambda v, i: CASE WHEN i - 1 BETWEEN 10 AND 29 THEN x[65 - i] ELSE v END)')}, 6) AS cut, round({_d('list_sort(x)')}, 6) AS same_values FROM t""",
    "wave_spectrum": f"""{_S}, p AS (SELECT *, {_P} AS p, {_dft('x', '64', 33, 'RE')} AS re, {_dft('x', '64', 33, 'IM', _HANN)} AS im FROM t) SELECT vec_id, round({_d('list_transform(p, lambda v: sqrt(v))')}, 6) AS amplitude, round({_d('p')}, 6) AS power,
 CAST(list_position(p, list_max(list_slice(p, 2, 33))) - 1 AS DOUBLE) AS frequency, round(list_sum(list_slice(p, 1, 8)) + 2 * list_sum(list_slice(p, 9, 20)) + 3 * list_sum(list_slice(p, 21, 33)), 6) AS bands, round({_d('re')}, 6) AS real_part, round({_d('im')}, 6) AS imaginary FROM p""",
    "wave_stft": f"""{_S}, f AS (SELECT vec_id, unnest(range(0, 7)) AS f, unnest({_F16}) AS fr FROM t), p AS (SELECT vec_id, f, {_dft('fr', '16', 9, '(RE) ^ 2 + (IM) ^ 2', _HANN16)} AS p FROM f),
 q AS (SELECT *, list_sum(list_transform(p, lambda v, i: v * (i - 1))) / list_sum(p) AS c FROM p)
 SELECT vec_id, round(sum((f + 1) * {_d('p')}), 5) AS power, round(sum((f + 1) * c), 5) AS centroid, round(sum((f + 1) * sqrt(list_sum(list_transform(p, lambda v, i: v * (i - 1 - c) ^ 2)) / list_sum(p))), 5) AS bandwidth,
 round(sum((f + 1) * exp(list_avg(list_transform(p, lambda v: ln(v + 1e-12)))) / list_avg(list_transform(p, lambda v: v + 1e-12))), 5) AS flatness FROM q GROUP BY vec_id""",
    "wave_periodogram": f"""{_C}, p AS (SELECT *, {_dft('y', '64', 33, '(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * ((RE) ^ 2 + (IM) ^ 2)')} AS p, {_dft('y', '64', 33, '(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END) * ((RE) ^ 2 + (IM) ^ 2)', _HANN)} AS h FROM c)
 SELECT vec_id, round({_d('p')} / (64 * 64.0), 6) AS density, round({_d('h')} / (64.0 * list_sum(list_transform(range(0, 64), lambda i: (0.5 - 0.5 * cos(2 * pi() * i / 63.0)) ^ 2))), 6) AS welch FROM p""",
    "wave_hilbert": f"""{_S}, h AS (SELECT *, list_transform(range(0, 64), lambda a: list_sum(list_transform(list_filter(range(0, 64), lambda b: (a - b) % 2 <> 0), lambda b: x[b + 1] / tan(pi() * (a - b) / 64.0))) / 32.0) AS h FROM t)
 SELECT vec_id, round({_d('h')}, 6) AS quadrature, round({_d('list_transform(h, lambda v, i: sqrt(v * v + x[i] * x[i]))')}, 6) AS envelope FROM h""",
    "wave_recursive": f"""{_S} SELECT vec_id, round({_d('list_transform(range(1, 65), lambda t: list_sum(list_transform(range(1, t + 1), lambda j: x[j] * 0.97 ^ (t - j))))')}, 6) AS undone,
 round({_d('list_transform(range(1, 65), lambda t: list_sum(list_transform(range(1, t + 1), lambda j: (0.5 * x[j] + (CASE WHEN j > 1 THEN 0.25 * x[j - 1] ELSE 0 END)) * 0.5 ^ (t - j))))')}, 6) AS filtered FROM t""",
    "wave_round_trips": "SELECT vec_id, true AS fft, true AS rfft, true AS emphasis, true AS stft FROM embeddings",
    "wave_made": f"""SELECT round({_made(50, 'sin(2 * pi() * 5 * i / 100.0)')}, 6) AS sine, round({_made(50, 'sin(2 * pi() * 3 * i / 100.0) + 0.5 * sin(2 * pi() * 7 * i / 100.0)')}, 6) AS tones, round({_made(50, 'sin(2 * pi() * (i / 100.0 + 19.0 * (i / 100.0) ^ 2))')}, 6) AS chirp,
 round({_made(50, 'CASE WHEN i % 7 = 0 THEN 1.0 ELSE 0.0 END')}, 6)::DOUBLE AS impulses, round({_made(9, '0.5 - 0.5 * cos(2 * pi() * i / 8.0)')}, 6) AS hann, round({_made(9, '0.54 - 0.46 * cos(2 * pi() * i / 8.0)')}, 6) AS hamming""",
    "wave_mel_scale": "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 4) AS mel, round(CAST(p_retailprice AS DOUBLE), 4) AS hz FROM part",
}

"""Streams of signals give what the whole signals give, however they are cut in files."""

import uuid

import numpy as np
import pytest

from quarry.functions import spectra as S
from quarry.functions.waves import windowed
from quarry.streaming import filters, monitors


@pytest.fixture
def stream(spark, tmp_path):
    def made(values, pieces=4):
        for k, part in enumerate(np.array_split(np.arange(len(values)), pieces)):
            spark.createDataFrame([(c, int(i), float(values[i]) * (1 if c == "a" else 2)) for i in part for c in "ab"], "c string, i long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        return monitors.file_stream(spark, str(tmp_path / "in"), schema)

    return made


def rows(df):
    return monitors.run_to_end(df, f"t_{uuid.uuid4().hex}").collect()


def test_filters_and_spectra_match_whole_signals(stream):
    x = np.sin(np.arange(90) / 3)
    source = stream(x)
    b, a = S.butterworth(2, 10.0, 64.0)
    got = sorted((r.c, r.i, r.filtered) for r in rows(filters.filtered(source, "c", "i", "v", b.tolist(), a.tolist())))
    want = S._recursive(x, b, a)
    assert np.allclose([y for c, _, y in got if c == "a"], want) and np.allclose([y for c, _, y in got if c == "b"], 2 * want)
    frames = {(r.c, r.frame): r.power for r in rows(filters.spectra(source, "c", "i", "v", 16, 8))}
    assert len(frames) == 2 * ((90 - 16) // 8 + 1)
    w = np.array(windowed(16))
    assert all(np.allclose(frames["a", k], np.abs(np.fft.rfft(x[8 * k:8 * k + 16] * w)) ** 2) for k in range(9))


def test_a_monitored_channel_alerts_and_recovers(stream):
    r = np.random.default_rng(0)
    x = r.standard_normal(120)
    x[60:70] += 30
    got = [(r.i, r.state) for r in sorted(rows(filters.monitored(stream(x), "c", "i", "v", 20, 4.0, 0.05, 3))) if r.c == "a"]
    assert got == [(19, "normal"), (62, "alert"), (72, "normal")]

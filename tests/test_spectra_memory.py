"""Results of the Arrow batches stay arrays of eight bytes a number."""

import numpy as np
import pandas as pd

from quarry.functions import spectra as S


def test_results_are_arrays_not_lists_of_numbers(spark, monkeypatch):
    made = []
    monkeypatch.setattr(S.F, "pandas_udf", lambda f, ddl: (made.append(f), lambda *c: c[0])[1])
    S.fft_spectrum("x")
    S.power_spectrum("x")
    S.top_frequency_peaks("x", top_k=2)
    x = pd.Series([np.arange(8.0), None])
    pair, power, peaks = (f(x) for f in made)
    assert all(isinstance(v, np.ndarray) for v in (pair["re"][0], pair["im"][0], power[0], peaks[0][0])) and len(peaks[0]) == 2
    assert pair["re"][1] is None and pair["im"][1] is None and power[1] is None and peaks[1] is None

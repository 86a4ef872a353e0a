"""Structured Streaming of signals: filters, short-time spectra and monitored channels.

State a key is a few numbers (a filter's memory, the samples a later frame needs, a
baseline), so it stays bounded however long the stream runs. Rows of one trigger are
taken in the given order; a gap in the order's numbers larger than most_gap starts a key anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame


def _ordered(batches: Iterator, order: str):
    import pandas as pd

    return pd.concat(list(batches)).sort_values(order)


def filtered(events: DataFrame, by: str, order: str, value: str, b: Sequence[float], a: Sequence[float] = (1.0,), most_gap: float | None = None) -> DataFrame:
    """by, order, filtered: the causal difference equation a * y = b * x over the whole stream of a key."""
    b, a = [float(v) / a[0] for v in b], [float(v) / a[0] for v in a]
    n_in, n_out = len(b) - 1, len(a) - 1

    def step(key, batches: Iterator, state):
        import pandas as pd

        past, made, last = state.get if state.exists else ([0.0] * n_in, [0.0] * n_out, None)
        past, made, rows, out = list(past), list(made), _ordered(batches, order), []
        for at, x in zip(rows[order], map(float, rows[value])):
            if last is not None and most_gap is not None and at - last > most_gap:
                past, made = [0.0] * n_in, [0.0] * n_out
            y = b[0] * x + sum(w * v for w, v in zip(b[1:], past)) - sum(w * v for w, v in zip(a[1:], made))
            past, made, last = [x, *past][:n_in], [y, *made][:n_out], float(at)
            out.append((key[0], at, y))
        state.update((past, made, last))
        yield pd.DataFrame(out, columns=[by, order, "filtered"])

    types = dict(events.dtypes)
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"{by} {types[by]}, {order} {types[order]}, filtered double", "past array<double>, made array<double>, last double", "append", "NoTimeout")


def spectra(events: DataFrame, by: str, order: str, value: str, length: int = 256, hop: int | None = None, window: str = "hann", rate: float = 1.0) -> DataFrame:
    """by, frame, seconds, power: the power spectrum of each full frame; samples that a later
    frame needs wait in the state, fewer than a frame."""
    hop = hop or length // 2

    def step(key, batches: Iterator, state):
        import numpy as np
        import pandas as pd

        from quarry.functions.waves import windowed

        held, frame = state.get if state.exists else ([], 0)
        held, out, w = [*held, *map(float, _ordered(batches, order)[value])], [], np.array(windowed(length, window))
        while len(held) >= length:
            out.append((key[0], frame, frame * hop / rate, (np.abs(np.fft.rfft(np.array(held[:length]) * w)) ** 2).tolist()))
            held, frame = held[hop:], frame + 1
        state.update((held, frame))
        yield pd.DataFrame(out, columns=[by, "frame", "seconds", "power"])

    types = dict(events.dtypes)
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"{by} {types[by]}, frame long, seconds double, power array<double>", "held array<double>, frame long", "append", "NoTimeout")


def monitored(events: DataFrame, by: str, order: str, value: str, warm: int = 20, limit: float = 3.0, alpha: float = 0.05, hold: int = 3) -> DataFrame:
    """by, order, state of each change of a channel's state: "normal" after warm rows, "alert" once hold
    rows in turn lie more than limit deviations from the baseline, "normal" again once hold rows in turn
    don't. The baseline (mean and variance, weighed by 1 - alpha a step) stands still in an alert."""

    def step(key, batches: Iterator, state):
        import pandas as pd

        n, m, q, run, now = state.get if state.exists else (0, 0.0, 0.0, 0, "warming")
        rows, out = _ordered(batches, order), []
        for at, x in zip(rows[order], map(float, rows[value])):
            n += 1
            away = now != "warming" and abs(x - m) > limit * q**0.5
            if now == "warming" and n >= warm:
                now, run = "normal", 0
                out.append((key[0], at, now))
            elif now != "warming":
                run = run + 1 if away == (now == "normal") else 0
                if run >= hold:
                    now, run = "alert" if now == "normal" else "normal", 0
                    out.append((key[0], at, now))
            if not away and now != "alert":
                d = x - m
                share = 1.0 / n if now == "warming" else alpha
                m, q = m + share * d, (1 - share) * (q + share * d * d)
        state.update((n, m, q, run, now))
        yield pd.DataFrame(out, columns=[by, order, "state"])

    types = dict(events.dtypes)
    return events.select(by, order, value).groupBy(by).applyInPandasWithState(step, f"{by} {types[by]}, {order} {types[order]}, state string", "n long, m double, q double, run long, now string", "append", "NoTimeout")

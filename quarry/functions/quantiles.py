"""Exact quantiles in bounded memory."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values between a rank's bounds that are sorted at once, and the accuracy of a sketch of the others.
SORTED, ACCURACY = 50_000, 4_000


def exact_quantiles(df: DataFrame, columns: dict[str, tuple[Column, Sequence[float]]]) -> dict[str, list[float | None]]:
    """Of each named column the quantiles at its shares, linear between ranks as in percentile(); None without values.

    A sketch of bounded size gives two values around each rank; rows below and between
    them are counted, and what lies between is sorted or, if it's much, sketched again.
    So neither a task nor the driver holds the distinct values. NaN is the largest value.
    """
    names = list(columns)
    rows = df.select(*(columns[c][0].cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    first = rows.agg(*(x for i in range(len(names)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.count_if(F.isnan(f"v{i}")).alias(f"x{i}")))).first()
    # a rank to find: column, rank from 1; then the values it lies between (None: no bound), the rows below and between them
    found, open_ranks = {}, {}
    for i, c in enumerate(names):
        n, plain = first[f"n{i}"], first[f"n{i}"] - first[f"x{i}"]
        for p in columns[c][1] if n else ():
            for rank in {math.floor((n - 1) * p) + 1, math.ceil((n - 1) * p) + 1}:
                if rank > plain:
                    found[i, rank] = math.nan
                else:
                    open_ranks[i, rank] = (None, None, 0, plain)

    def inside(span):
        v = F.col(f"v{span[0]}")
        kept = ~F.isnan(v)
        for bound in ([] if span[1] is None else [v > span[1]]) + ([] if span[2] is None else [v < span[2]]):
            kept = kept & bound
        return F.when(kept, v)

    while open_ranks:
        asked = {}
        for (i, rank), span in open_ranks.items():
            asked.setdefault((i, *span), []).append(rank)
        small, large = [s for s in asked if s[4] <= SORTED], [s for s in asked if s[4] > SORTED]
        if small:
            got = rows.agg(*(F.sort_array(F.collect_list(inside(s))).alias(f"s{k}") for k, s in enumerate(small))).first()
            for k, s in enumerate(small):
                for rank in asked[s]:
                    found[s[0], rank] = got[f"s{k}"][rank - s[3] - 1]
                    del open_ranks[s[0], rank]
        if not large:
            continue
        step, shares = 2.0 / ACCURACY, {}
        for s in large:
            ranks, shares[s] = sorted(asked[s]), []
            for j, rank in enumerate(ranks):
                at = (rank - s[3]) / s[4]
                shares[s] += [max(0.0, at - step)] if not j or ranks[j - 1] + 1 < rank else []
                shares[s] += [min(1.0, at + step)] if j + 1 == len(ranks) or rank + 1 < ranks[j + 1] else []
        cuts = rows.agg(*(F.percentile_approx(inside(s), F.array(*map(F.lit, shares[s])), F.lit(ACCURACY)).alias(f"c{k}") for k, s in enumerate(large))).first()
        edges = {s: sorted(set(cuts[f"c{k}"])) for k, s in enumerate(large)}
        got = rows.agg(*(F.count_if(f(inside(s), e)).alias(f"{m}{k}_{j}") for k, s in enumerate(large) for j, e in enumerate(edges[s]) for m, f in (("a", lambda v, e: v < e), ("b", lambda v, e: v <= e)))).first()
        for k, s in enumerate(large):
            for rank in asked[s]:
                low, least, most, high = s[1], 0, s[4], s[2]
                for j, e in enumerate(edges[s]):
                    under, upto = got[f"a{k}_{j}"], got[f"b{k}_{j}"]
                    if rank - s[3] <= under:
                        high, most = e, under
                        break
                    if rank - s[3] <= upto:
                        found[s[0], rank] = e
                        break
                    low, least = e, upto
                if (s[0], rank) in found:
                    del open_ranks[s[0], rank]
                else:
                    open_ranks[s[0], rank] = (low, high, s[3] + least, most - least)
    out = {}
    for i, c in enumerate(names):
        n, out[c] = first[f"n{i}"], []
        for p in columns[c][1]:
            at = (n - 1) * p
            low, high = math.floor(at), math.ceil(at)
            if not n:
                out[c].append(None)
            elif low == high or found[i, low + 1] == found[i, high + 1]:
                out[c].append(found[i, low + 1])
            else:
                out[c].append((high - at) * found[i, low + 1] + (at - low) * found[i, high + 1])
    return out


def as_literals(values: Sequence[float | None]) -> Column:
    return F.array(*(F.lit(v).cast("double") for v in values))

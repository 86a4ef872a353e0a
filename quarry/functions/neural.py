"""Layers, losses, optimisers and schedules as column expressions.

An activation is an array<double> column (or a number), a weight matrix a literal
table of rows: scoring a trained network over a table is a projection in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.waves import deviation, let, mean, total

_c = lambda x: F.col(x) if isinstance(x, str) else x


def sigmoid(v: Column | str) -> Column:
    """Of a number; both halves stay in range for large magnitudes."""
    v = _c(v)
    return F.when(v >= 0, 1 / (1 + F.exp(-v))).otherwise(F.exp(v) / (1 + F.exp(v)))


def each(x: Column | str, f) -> Column:
    return F.transform(_c(x), f)


def relu(x) -> Column:
    return each(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(x, slope: float = 0.01) -> Column:
    return each(x, lambda v: F.when(v > 0, v).otherwise(slope * v))


def tanh(x) -> Column:
    return each(x, F.tanh)


def sigmoids(x) -> Column:
    return each(x, sigmoid)


def gelu(x) -> Column:
    """By the hyperbolic tangent."""
    return each(x, lambda v: 0.5 * v * (1 + F.tanh(math.sqrt(2 / math.pi) * (v + 0.044715 * v * v * v))))


def log_sum_exp(x) -> Column:
    return let(_c(x), lambda s: let(F.array_max(s), lambda m: m + F.log(total(F.transform(s, lambda v: F.exp(v - m))))))


def softmax(x) -> Column:
    return let(_c(x), lambda s: let(log_sum_exp(s), lambda z: F.transform(s, lambda v: F.exp(v - z))))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in rows))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def dense(x, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """weights: a row an output."""
    b = F.array(*(F.lit(float(v)) for v in (bias or [0.0] * len(weights))))
    return let(_c(x), lambda s: F.zip_with(F.transform(matrix(weights), lambda row: dot(row, s)), b, lambda u, v: u + v))


def layer_norm(x, gain: float = 1.0, shift: float = 0.0, eps: float = 1e-5) -> Column:
    return let(_c(x), lambda s: let(F.struct(mean(s).alias("m"), deviation(s).alias("d")), lambda p: F.transform(s, lambda v: gain * (v - p["m"]) / F.sqrt(p["d"] * p["d"] + eps) + shift)))


def batch_norm(x, means: Sequence[float], variances: Sequence[float], eps: float = 1e-5) -> Column:
    """With the moments learnt in training."""
    stats = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(v)).alias("v")) for m, v in zip(means, variances)))
    return F.zip_with(_c(x), stats, lambda v, p: (v - p["m"]) / F.sqrt(p["v"] + eps))


def dropout(x, rate: float, seed: int, key: Column | str) -> Column:
    """Zeroes entries with chance rate, by a hash of key, place and seed, and lifts the rest."""
    keep = lambda i: F.pmod(F.xxhash64(_c(key), i, F.lit(seed)), F.lit(1 << 30)) >= int(rate * (1 << 30))
    return F.transform(_c(x), lambda v, i: F.when(keep(i), v / (1 - rate)).otherwise(F.lit(0.0)))


def embedding(ids, vectors: Sequence[Sequence[float]]) -> Column:
    """A row of vectors for each id."""
    return let(matrix(vectors), lambda m: F.transform(_c(ids), lambda i: F.get(m, i)))


def flatten(x) -> Column:
    return F.flatten(_c(x))


def average_pool(rows) -> Column:
    """Mean of a sequence of vectors, by position."""
    return let(_c(rows), lambda r: F.transform(F.aggregate(F.slice(r, 2, F.size(r)), r[0], lambda a, v: F.zip_with(a, v, lambda p, q: p + q)), lambda v: v / F.size(r)))


def pooled(x, size: int, kind: str = "max") -> Column:
    """Maximum or mean of runs of size entries, a short last run left out."""
    f = {"max": F.array_max, "avg": mean}[kind]
    return let(_c(x), lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / size).cast("int") - 1), lambda k: f(F.slice(s, k * size + 1, F.lit(size)))))


def attention_pool(rows, query: Sequence[float]) -> Column:
    """Vectors of a sequence weighed by the softmax of their products with the query."""
    q = F.array(*(F.lit(float(v)) for v in query))
    weights = lambda r: softmax(F.transform(r, lambda v: dot(v, q)))
    return let(_c(rows), lambda r: let(weights(r), lambda w: F.transform(F.sequence(F.lit(0), F.size(r[0]) - 1), lambda i: total(F.zip_with(r, w, lambda v, p: F.get(v, i) * p)))))


def attention(queries, keys, values) -> Column:
    """Scaled dot-product attention: sequences of vectors, a row a query."""
    def one(q, k, v):
        w = softmax(F.transform(k, lambda x: dot(q, x) / F.sqrt(F.size(q).cast("double"))))
        return let(w, lambda p: F.transform(F.sequence(F.lit(0), F.size(v[0]) - 1), lambda i: total(F.zip_with(v, p, lambda x, y: F.get(x, i) * y))))

    return let(F.struct(_c(keys).alias("k"), _c(values).alias("v")), lambda s: F.transform(_c(queries), lambda q: one(q, s["k"], s["v"])))


def positions(length: int, width: int) -> list[list[float]]:
    """Sines and cosines of places, at falling frequencies."""
    angle = lambda p, i: p / 10000 ** (2 * (i // 2) / width)
    return [[math.cos(angle(p, i)) if i % 2 else math.sin(angle(p, i)) for i in range(width)] for p in range(length)]


def rnn(x, w_in: float, w_state: float, bias: float = 0.0) -> Column:
    """Last state of a recurrent unit of one number over a sequence of numbers."""
    return F.aggregate(_c(x), F.lit(0.0), lambda h, v: F.tanh(w_in * v + w_state * h + bias))


# Losses of a row.


def mse_loss(y, found) -> Column:
    return mean(F.zip_with(_c(y), _c(found), lambda a, b: (a - b) * (a - b)))


def cross_entropy(logits, label) -> Column:
    return let(_c(logits), lambda s: log_sum_exp(s) - F.get(s, _c(label)))


def binary_cross_entropy(p, y, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    return -(_c(y) * F.log(q) + (1 - _c(y)) * F.log(1 - q))


def clip_gradients(g, most: float) -> Column:
    """Scaled to a norm of most, where it is longer."""
    return let(_c(g), lambda s: let(F.sqrt(dot(s, s)), lambda n: F.transform(s, lambda v: F.when(n > most, v * most / n).otherwise(v))))


# Schedules and steps of optimisers, as plain functions of the step.


def step_lr(step: int, base: float, every: int = 10, factor: float = 0.1) -> float:
    return base * factor ** (step // every)


def cosine_lr(step: int, base: float, steps: int, least: float = 0.0) -> float:
    return least + (base - least) * (1 + math.cos(math.pi * min(step, steps) / steps)) / 2


class ReduceOnPlateau:
    """Multiplies the rate by factor when the loss hasn't fallen by more than least for patience calls."""

    def __init__(self, rate: float, factor: float = 0.5, patience: int = 3, least: float = 1e-4):
        self.rate, self.factor, self.patience, self.least, self.best, self.bad = rate, factor, patience, least, math.inf, 0

    def __call__(self, loss: float) -> float:
        if loss < self.best - self.least:
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
            if self.bad > self.patience:
                self.rate, self.bad = self.rate * self.factor, 0
        return self.rate


class EarlyStop(ReduceOnPlateau):
    """True once the loss hasn't fallen for patience calls."""

    def __init__(self, patience: int = 5, least: float = 0.0):
        super().__init__(1.0, 1.0, patience, least)

    def __call__(self, loss: float) -> bool:
        if loss < self.best - self.least:
            self.best, self.bad = loss, 0
        else:
            self.bad += 1
        return self.bad >= self.patience


class Optimizer:
    """Steps over numpy parameters, updated in place: "sgd" (momentum, decay), "rmsprop", "adagrad", "adam", "adamw"."""

    def __init__(self, parameters: list, kind: str = "adam", rate: float = 0.001, momentum: float = 0.0, decay: float = 0.0, betas: tuple[float, float] = (0.9, 0.999), rho: float = 0.9, eps: float = 1e-8):
        import numpy as np

        if kind not in ("sgd", "rmsprop", "adagrad", "adam", "adamw"):
            raise ValueError(f"unknown optimiser {kind!r}")
        self.parameters, self.kind, self.rate, self.momentum, self.decay, self.betas, self.rho, self.eps, self.count = parameters, kind, rate, momentum, decay, betas, rho, eps, 0
        self.first, self.second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list) -> None:
        import numpy as np

        self.count += 1
        a, b = self.betas
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second):
            if self.decay and self.kind != "adamw":
                g = g + self.decay * p
            if self.kind == "sgd":
                m[...] = self.momentum * m + g
                change = m
            elif self.kind in ("rmsprop", "adagrad"):
                v[...] = self.rho * v + (1 - self.rho) * g * g if self.kind == "rmsprop" else v + g * g
                change = g / (np.sqrt(v) + self.eps)
            else:
                m[...], v[...] = a * m + (1 - a) * g, b * v + (1 - b) * g * g
                change = (m / (1 - a**self.count)) / (np.sqrt(v / (1 - b**self.count)) + self.eps)
                if self.kind == "adamw":
                    change = change + self.decay * p
            p -= self.rate * change

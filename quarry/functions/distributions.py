"""Distributions as column expressions: densities, cumulative shares, moments and seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_c = lambda x: F.col(x) if isinstance(x, str) else x
# Coefficients of Lanczos' series for the logarithm of the gamma function (g = 7, n = 9).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# Abramowitz and Stegun 7.1.26, the error function to 1.5e-7.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def log_gamma(x: Column | str) -> Column:
    """For x > 0, to twelve digits or so."""
    z = _c(x) - 1
    series = sum((F.lit(g) / (z + k) for k, g in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def digamma(x: Column | str) -> Column:
    """Derivative of log_gamma for x > 0: moved up by six, then its asymptotic series."""
    v = _c(x)
    y = v + 6
    tail = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0))) + 1 / (240 * F.pow(y, F.lit(8.0)))
    return tail - sum((1 / (v + k) for k in range(6)), F.lit(0.0))


def erf(x: Column | str) -> Column:
    v = _c(x)
    t = 1 / (1 + 0.3275911 * F.abs(v))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(v) * (1 - poly * F.exp(-v * v))


def unit_draw(key: Column | str, seed: int, salt: int = 0) -> Column:
    """A number between 0 and 1 that hangs on the key and the seed alone."""
    return (F.pmod(F.xxhash64(_c(key), F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


class Distribution:
    """mean and variance are numbers; the methods make columns."""

    mean: float
    variance: float

    def log_density(self, x) -> Column:
        raise NotImplementedError

    def density(self, x) -> Column:
        return F.exp(self.log_density(x))


class Normal(Distribution):
    def __init__(self, mean: float = 0.0, deviation: float = 1.0):
        self.mean, self.deviation, self.variance = mean, deviation, deviation**2

    def log_density(self, x):
        return -0.5 * F.pow((_c(x) - self.mean) / self.deviation, 2) - math.log(self.deviation * math.sqrt(2 * math.pi))

    def share(self, x):
        return 0.5 * (1 + erf((_c(x) - self.mean) / (self.deviation * math.sqrt(2))))

    def draw(self, key, seed: int = 0):
        return self.mean + self.deviation * F.sqrt(-2 * F.log(unit_draw(key, seed))) * F.cos(2 * math.pi * unit_draw(key, seed, 1))

    @staticmethod
    def fitted(df, column: str) -> Normal:
        row = df.agg(F.avg(column), F.stddev_pop(column)).first()
        return Normal(row[0], row[1])


class Uniform(Distribution):
    def __init__(self, low: float = 0.0, high: float = 1.0):
        self.low, self.high, self.mean, self.variance = low, high, (low + high) / 2, (high - low) ** 2 / 12

    def log_density(self, x):
        return F.when(_c(x).between(self.low, self.high), -math.log(self.high - self.low)).otherwise(F.lit(float("-inf")))

    def share(self, x):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_c(x) - self.low) / (self.high - self.low)))

    def draw(self, key, seed: int = 0):
        return self.low + (self.high - self.low) * unit_draw(key, seed)


class Exponential(Distribution):
    def __init__(self, rate: float = 1.0):
        self.rate, self.mean, self.variance = rate, 1 / rate, rate**-2

    def log_density(self, x):
        return F.when(_c(x) >= 0, math.log(self.rate) - self.rate * _c(x)).otherwise(F.lit(float("-inf")))

    def share(self, x):
        return F.when(_c(x) >= 0, 1 - F.exp(-self.rate * _c(x))).otherwise(0.0)

    def draw(self, key, seed: int = 0):
        return -F.log(unit_draw(key, seed)) / self.rate


class LogNormal(Normal):
    def __init__(self, mean: float = 0.0, deviation: float = 1.0):
        super().__init__(mean, deviation)
        self.centre, self.mean = mean, math.exp(mean + deviation**2 / 2)
        self.variance = (math.exp(deviation**2) - 1) * math.exp(2 * mean + deviation**2)

    def log_density(self, x):
        v = _c(x)
        return F.when(v > 0, Normal(self.centre, self.deviation).log_density(F.log(v)) - F.log(v)).otherwise(F.lit(float("-inf")))

    def share(self, x):
        return F.when(_c(x) > 0, Normal(self.centre, self.deviation).share(F.log(_c(x)))).otherwise(0.0)

    def draw(self, key, seed: int = 0):
        return F.exp(Normal(self.centre, self.deviation).draw(key, seed))


class Gamma(Distribution):
    def __init__(self, shape: float, rate: float = 1.0):
        self.shape, self.rate, self.mean, self.variance = shape, rate, shape / rate, shape / rate**2

    def log_density(self, x):
        v = _c(x)
        return F.when(v > 0, self.shape * math.log(self.rate) - math.lgamma(self.shape) + (self.shape - 1) * F.log(v) - self.rate * v).otherwise(F.lit(float("-inf")))


class Chi2(Gamma):
    def __init__(self, freedom: float):
        super().__init__(freedom / 2, 0.5)


class Beta(Distribution):
    def __init__(self, a: float, b: float):
        self.a, self.b, self.mean, self.variance = a, b, a / (a + b), a * b / ((a + b) ** 2 * (a + b + 1))

    def log_density(self, x):
        v = _c(x)
        return F.when((v > 0) & (v < 1), math.lgamma(self.a + self.b) - math.lgamma(self.a) - math.lgamma(self.b) + (self.a - 1) * F.log(v) + (self.b - 1) * F.log(1 - v)).otherwise(F.lit(float("-inf")))


class Dirichlet(Distribution):
    """Of an array of shares."""

    def __init__(self, weights: list[float]):
        self.weights, self.mean = weights, [w / sum(weights) for w in weights]

    def log_density(self, x):
        norm = math.lgamma(sum(self.weights)) - sum(map(math.lgamma, self.weights))
        return norm + sum(((w - 1) * F.log(_c(x)[k]) for k, w in enumerate(self.weights)), F.lit(0.0))


class StudentT(Distribution):
    def __init__(self, freedom: float):
        self.freedom, self.mean, self.variance = freedom, 0.0, freedom / (freedom - 2) if freedom > 2 else math.inf

    def log_density(self, x):
        n = self.freedom
        return math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi) - (n + 1) / 2 * F.log(1 + _c(x) * _c(x) / n)


class Poisson(Distribution):
    def __init__(self, rate: float):
        self.rate, self.mean, self.variance = rate, rate, rate

    def log_density(self, x):
        return _c(x) * math.log(self.rate) - self.rate - log_gamma(_c(x) + 1)


class Bernoulli(Distribution):
    def __init__(self, p: float):
        self.p, self.mean, self.variance = p, p, p * (1 - p)

    def log_density(self, x):
        return F.when(_c(x) == 1, math.log(self.p)).otherwise(math.log(1 - self.p))

    def draw(self, key, seed: int = 0):
        return (unit_draw(key, seed) < self.p).cast("int")


def entropy(counts: Column | str, base: float = math.e) -> Column:
    """Of an array of counts."""
    n = F.aggregate(_c(counts), F.lit(0.0), lambda a, v: a + v)
    terms = lambda n: F.transform(F.filter(_c(counts), lambda v: v > 0), lambda v: -(v / n) * F.log(v / n) / math.log(base))
    return F.transform(F.array(n), lambda n: F.aggregate(terms(n), F.lit(0.0), lambda a, v: a + v))[0]

"""Exact tails of the binomial and the normal law as columns."""

from __future__ import annotations

from math import log, log1p, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_gamma(x: Column) -> Column:
    """Stirling's series, moved up by eight so that it holds from 1 on."""
    y = x + F.lit(8.0)
    below = F.lit(0.0)
    for i in range(8):
        below = below + F.log(x + F.lit(float(i)))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return (y - 0.5) * F.log(y) - y + 0.5 * log(2 * pi) + series - below


def log_pmf(n: Column, k: Column, p: float) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p)


def _outward(n: Column, k: Column, p: float, up: bool) -> Column:
    """pmf(k) and the terms beyond it, away from the mean; a dozen standard deviations hold all that a double can tell."""
    odds, d = p / (1.0 - p), n.cast("double")
    reach = F.least(n - k if up else k, (60 + 12 * F.sqrt(d * (p * (1 - p)))).cast("bigint"))
    # From k to k + i: the ratio of neighbouring terms.
    ratio = (lambda i: (d - k - i + 1) / (k + i) * odds) if up else (lambda i: (k - i + 1) / (d - k + i) / odds)
    steps = F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(reach, F.lit(0).cast("bigint"))), lambda i: i > 0)
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.exp(log_pmf(n, k, p)) * total


def binomial_lower(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) of n trials at p."""
    n, k = n.cast("bigint"), k.cast("bigint")
    below = F.when(k < n * p, _outward(n, F.least(k, (n * p).cast("bigint")), p, up=False))
    rest = 1 - F.when(k < n, _outward(n, F.greatest(k + 1, (n * p).cast("bigint")), p, up=True)).otherwise(0.0)
    return F.least(F.lit(1.0), F.when(k < 0, 0.0).otherwise(F.coalesce(below, rest)))


def binomial_upper(n: Column, k: Column, p: float) -> Column:
    """P(X >= k) of n trials at p."""
    n, k = n.cast("bigint"), k.cast("bigint")
    above = F.when(k > n * p, _outward(n, F.greatest(k, (n * p).cast("bigint")), p, up=True))
    return F.least(F.lit(1.0), F.when(k <= 0, 1.0).otherwise(F.coalesce(above, 1 - binomial_lower(n, k - 1, p))))


def normal_two_sided(z: Column) -> Column:
    """2 P(Z >= |z|), to about 1e-15, by the series of the error function with positive terms; 0 beyond eight."""
    x = F.least(F.abs(z), F.lit(8.0)) / sqrt(2.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda a, n: F.struct((a["term"] * 2 * x * x / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * x * x / (2 * n + 1)).alias("sum")),
        lambda a: a["sum"],
    )
    p = 1 - 2 / sqrt(pi) * F.exp(-x * x) * series
    return F.when(F.abs(z) >= 8, 0.0).otherwise(F.greatest(p, F.lit(0.0)))

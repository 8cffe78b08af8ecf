"""Probabilities moved by one logit so that they add up to a given number."""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities stay this far from 0 and 1; sums are met to TOLERANCE.
EDGE, TOLERANCE = 1e-9, 1e-12


def project(p: np.ndarray, total: float = 5.0) -> np.ndarray:
    """Each row of p moved to the sum total: Newton's method, kept inside a bracket that each step narrows.

    Were all logits the largest one, the least shift of the bracket would do; were they the least, the largest.
    """
    p = np.clip(p, EDGE, 1 - EDGE)
    x = np.log(p) - np.log1p(-p)
    even = log(total / (p.shape[-1] - total))
    low, high = even - x.max(axis=-1), even - x.min(axis=-1)
    s = np.clip(np.zeros_like(low), low, high)
    while True:
        q = 1 / (1 + np.exp(-x - s[..., None]))
        over = q.sum(axis=-1) - total
        if (np.abs(over) <= TOLERANCE * total).all() or (high - low <= 4e-16 * np.maximum(1, np.abs(s))).all():
            return q
        low, high = np.where(over < 0, s, low), np.where(over > 0, s, high)
        t = s - over / np.maximum((q * (1 - q)).sum(axis=-1), 1e-300)
        # A step of nothing ends at the value it has.
        s = np.where((t > low) & (t < high), t, np.where(over == 0, s, (low + high) / 2))


def projected(ps: Column, total: float = 5.0, steps: int = 60) -> Column:
    """The same of an array column; a row whose sum is met takes no further steps."""
    kept = F.transform(ps, lambda p: F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p)))
    x = F.transform(kept, lambda p: F.log(p) - F.log1p(-p))
    even = F.log(total / (F.size(ps) - F.lit(total)))
    q = lambda s: F.transform(x, lambda y: 1 / (1 + F.exp(-y - s)))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda u, v: u + v)

    def newton(state: Column, _: Column) -> Column:
        s, now = state["s"], q(state["s"])
        over = add(now) - total
        slope = add(F.transform(now, lambda v: v * (1 - v)))
        low, high = F.when(over < 0, s).otherwise(state["low"]), F.when(over > 0, s).otherwise(state["high"])
        t = s - over / F.greatest(slope, F.lit(1e-300))
        to = F.when((t > low) & (t < high), t).otherwise((low + high) / 2)
        return F.when(F.abs(over) <= TOLERANCE * total, state).otherwise(F.struct(low.alias("low"), high.alias("high"), to.alias("s")))

    low, high = even - F.array_max(x), even - F.array_min(x)
    start = F.struct(low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, F.lit(0.0))).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton, lambda a: q(a["s"]))

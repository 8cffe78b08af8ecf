"""The exact law of summed Top-5 hits under uniform draws, ties included."""

from __future__ import annotations

from math import comb, gcd, lcm, sqrt

import numpy as np

from urnspark.functions.probability import DRAWN, POOL

#: Cells of the grid that the law is summed on, at most.
CELLS = 1 << 20


def hits_law(above: int, tied: int, left: int) -> dict[tuple[int, int], float]:
    """(hits above the tie, hits within it) -> chance, of five drawn numbers; left of the tied ones are chosen."""
    rest = POOL - above - tied
    return {(a, t): comb(above, a) * comb(tied, t) * comb(rest, DRAWN - a - t) / comb(POOL, DRAWN) for a in range(min(above, DRAWN) + 1) for t in range(min(tied, DRAWN - a) + 1) if DRAWN - a - t <= rest}


def upper_tail(structures: dict[tuple[int, int, int], int], total: float) -> tuple[float, bool]:
    """P(sum of expected hits >= total), and whether it is exact, over draws that have these (above, tied, left).

    Hits are above's and left/tied of the tie's.
    """
    value = lambda s, a, t: a + s[2] * t / s[1] if s[1] else float(a)
    laws = []
    for s, m in structures.items():
        law: dict[float, float] = {}
        for k, p in hits_law(*s).items():
            law[value(s, *k)] = law.get(value(s, *k), 0.0) + p
        laws.append((law, s[1] // gcd(s[1], s[2]) if s[1] else 1, m))
    return summed_tail(laws, total)


def summed_tail(laws: list[tuple[dict[float, float], int, int]], total: float) -> tuple[float, bool]:
    """P(sum >= total), and whether it is exact, of independent values: (value -> chance, denominator of the values, how many).

    All sums lie on a grid of the denominators' least multiple. Laws are convolved as powers of their transforms, on a
    circle as wide as twelve deviations each way: what lies beyond is less than 1e-32. Where the grid would have too many
    cells, a coarser one takes each value's chance at its two neighbours so that the mean stays, and the result is near.
    """
    mean = variance = span = 0.0
    grid = 1
    for law, denominator, m in laws:
        x = np.array(list(law.items()))
        mu = (x[:, 0] * x[:, 1]).sum()
        mean, variance, span = mean + m * mu, variance + m * ((x[:, 0] - mu) ** 2 * x[:, 1]).sum(), span + m * (x[:, 0].max() - x[:, 0].min())
        grid = lcm(grid, denominator)
    reach = min(12 * sqrt(variance) + DRAWN, span + 1)
    exact = 2 * reach * grid + 2 <= CELLS
    if not exact:
        grid = int((CELLS - 2) / (2 * reach))
    cells = 1 << int(np.ceil(np.log2(2 * reach * grid + 2)))
    whole = np.ones(cells // 2 + 1, dtype=complex)
    for values, _, m in laws:
        law = np.zeros(cells)
        for v, p in values.items():
            at = v * grid
            first = round(at) if exact else int(np.floor(at))
            law[first % cells] += p if exact else p * (first + 1 - at)
            if not exact:
                law[(first + 1) % cells] += p * (at - first)
        whole *= np.fft.rfft(law) ** m
    law = np.fft.irfft(whole, cells)
    # The circle holds one turn around the mean.
    low = int(np.floor((mean - reach) * grid))
    places = low + np.arange(cells)
    first = int(np.ceil(total * grid - 1e-6))
    p = float(law[places[places >= first] % cells].sum()) if first > low else 1.0
    return min(1.0, max(0.0, p)), bool(exact)

"""Closed-form odds of the ticket's nine ranks."""

from __future__ import annotations

from math import comb

POOL, DRAWN, CHANCES = 49, 5, 10
TOTAL = comb(POOL, DRAWN) * CHANCES

#: (rank, main matches, chance match); rank 9 is the chance with 0 or 1 matches.
RANKS = ((1, 5, True), (2, 5, False), (3, 4, True), (4, 4, False), (5, 3, True), (6, 3, False), (7, 2, True), (8, 2, False), (9, -1, True))


def outcomes(matches: int, chance: bool) -> int:
    ways = lambda m: comb(DRAWN, m) * comb(POOL - DRAWN, DRAWN - m)
    main = ways(0) + ways(1) if matches < 0 else ways(matches)
    return main * (1 if chance else CHANCES - 1)


def rank_probability(rank: int) -> float:
    return next(outcomes(m, c) for r, m, c in RANKS if r == rank) / TOTAL


def any_prize() -> float:
    return sum(rank_probability(r) for r, _, _ in RANKS)


def one_in(rank: int) -> float:
    return 1 / rank_probability(rank)


def expected_budget(draws: int, tickets: int, price: float = 2.2, returned: float = 0.5435) -> dict[str, float]:
    """What is staked, returned on average and lost on average."""
    stake = draws * tickets * price
    return {"stake": stake, "expected_return": stake * returned, "expected_loss": stake * (1 - returned)}


def alpha_budget(index: int, alpha: float = 0.05) -> float:
    """The level of a cohort's test: alpha over i(i+1), which sums to alpha."""
    if index < 1:
        raise ValueError("cohorts count from 1")
    return alpha / (index * (index + 1))


def holm(values: list[float]) -> list[float]:
    """Holm's step-down adjustment, in the order given."""
    order = sorted(range(len(values)), key=values.__getitem__)
    out, top = [0.0] * len(values), 0.0
    for k, i in enumerate(order):
        top = max(top, min(1.0, (len(values) - k) * values[i]))
        out[i] = top
    return out

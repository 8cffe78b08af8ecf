from __future__ import annotations

from math import comb

import pytest

from urnspark.functions import probability as p


def test_closed_forms():
    assert p.TOTAL == 19_068_840
    assert sum(p.outcomes(m, c) for _, m, c in p.RANKS) == round(p.any_prize() * p.TOTAL)
    assert 1 / p.any_prize() == pytest.approx(5.9852484626)
    assert p.one_in(1) == p.TOTAL
    assert p.outcomes(-1, True) == comb(44, 5) + 5 * comb(44, 4)


def test_holm_and_levels():
    assert p.holm([0.01, 0.02, 0.5]) == pytest.approx([0.03, 0.04, 0.5])
    assert p.holm([]) == []
    assert p.alpha_budget(1) == pytest.approx(0.025)
    assert p.alpha_budget(2) == pytest.approx(0.05 / 6)
    with pytest.raises(ValueError):
        p.alpha_budget(0)


def test_budget():
    assert p.expected_budget(10, 1)["expected_loss"] == pytest.approx(22 * (1 - 0.5435))

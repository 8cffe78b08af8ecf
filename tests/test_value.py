"""Participation and value reports against NumPy programs on the collected rows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from urnspark.functions.probability import TOTAL, rank_probability
from urnspark.operators import participation, value
from urnspark.operators.models import FEATURES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def evaluated(spark):
    return participation.evaluate(spark, SF, min_train=200, n=2, trees=3, replicates=200)


def test_participation(spark, evaluated):
    rows, forecaster = evaluated
    x = participation.participation(spark, SF).toPandas().sort_values(["draw_date", "game", "draw_id"]).reset_index(drop=True)
    dates, y, v = x["draw_date"].to_numpy(), x["y"].to_numpy(), x[list(FEATURES)].to_numpy(float)
    weekday = np.array([d.weekday() for d in dates])

    def ridge(use, alpha):
        z = np.c_[np.ones(use.sum()), v[use]]
        beta = np.linalg.solve(z.T @ z + alpha * np.diag(np.r_[0, np.ones(v.shape[1])]), z.T @ y[use])
        return np.c_[np.ones(len(v)), v] @ beta

    def median(use, i):
        own, game = y[use & (x["game"] == x["game"][i]) & (weekday == weekday[i])], y[use & (x["game"] == x["game"][i])]
        return np.median(own if len(own) >= 10 else game if len(game) else y[use])

    predicted, base, truth, smears, alphas, level = [], [], [], [], [], []
    for part in np.array_split(np.unique(dates[200:]), 2):
        train, test = dates < part[0], np.isin(dates, part)
        days = np.unique(dates[train])
        split = days[max(1, int(len(days) * 0.8))]
        inner, late = dates < split, (dates >= split) & train
        alpha = min(participation.ALPHAS, key=lambda a: np.mean((ridge(inner, a)[late] - y[late]) ** 2))
        smear = np.mean(np.exp(y[late] - ridge(inner, alpha)[late]))
        p = ridge(train, alpha)[test]
        predicted += [*p]
        level += [*np.exp(p) * smear]
        base += [median(train, i) for i in np.flatnonzero(test)]
        truth += [*y[test]]
        smears.append(smear)
        alphas.append(f"alpha={alpha:g}")
    p, b, t = map(np.array, (predicted, base, truth))
    r = next(r for r in rows if r["model"] == "ridge")
    assert r["parameters"] == "; ".join(alphas) and r["test_observations"] == len(t)
    assert r["smearing"] == pytest.approx(smears, abs=1e-8)
    want = (np.sqrt(np.mean((p - t) ** 2)), np.sqrt(np.mean((b - t) ** 2)), np.mean(np.abs(np.exp(p - t) - 1)), np.mean((p - t) ** 2 - (b - t) ** 2), np.exp(p).sum() / np.exp(t).sum() - 1, np.sum(level) / np.exp(t).sum() - 1)
    assert tuple(r[c] for c in ("log_rmse", "baseline_log_rmse", "mape", "mse_delta", "bias", "calibrated_bias")) == pytest.approx(want, abs=1e-9)
    assert r["delta_low"] < r["mse_delta"] < r["delta_high"]
    champion = forecaster.champion["model"]
    if champion == "ridge" and forecaster.predictor is not None:
        ratio = np.exp(t - p)
        assert forecaster.multipliers == pytest.approx(np.quantile(ratio / ratio.mean(), np.linspace(0, 1, participation.STEPS + 1)), abs=1e-9)
    assert forecaster.quantile(0.025) < 1 < forecaster.quantile(0.975)


def test_boosted_value_is_a_plain_boosters(spark):
    """Least squares trees on observations: one tree's root split, found by trying all of them."""
    from urnspark.operators import learners

    rows = participation.participation(spark, SF)
    x = rows.toPandas()
    v, y = x[list(FEATURES)].to_numpy(float), x["y"].to_numpy()
    last = learners.day_of(max(x["draw_date"])) + 1
    from pyspark.sql import functions as F

    m = learners.fit_boosted(rows.withColumn("n", F.lit(1)), FEATURES, [learners.Boosted(last, 0.5, 2, 5.0, value=True)], trees=2, bins=16, data=learners.observed(rows, FEATURES, "y"))[0]
    b = learners.binned(v[:, None, :], m.edges)
    score = np.full(len(y), y.mean())
    for _ in range(2):
        g, best = score - y, (0.0, None)
        for c in range(len(FEATURES)):
            for t in range(b[c].max()):
                left = b[c] <= t
                if min(left.sum(), (~left).sum()) >= 20:
                    gain = g[left].sum() ** 2 / (left.sum() + 5) + g[~left].sum() ** 2 / ((~left).sum() + 5) - g.sum() ** 2 / (len(g) + 5)
                    if gain > best[0] * (1 + 1e-9) + 1e-12:
                        best = (gain, left)
        for side in (best[1], ~best[1]):
            score[side] -= 0.5 * g[side].sum() / (side.sum() + 5)
    assert m.predict(None, v[:, None, :]).ravel() == pytest.approx(score, abs=1e-9)


def test_forecaster(evaluated):
    f = evaluated[1]
    day = f.last + timedelta(days=3)
    assert f.tickets(5e6, day, "loto") > 0
    with pytest.raises(ValueError):
        f.tickets(5e6, f.last, "loto")
    plain = participation.Forecaster(f.champion, None, 1.0, f.baseline, f.multipliers, f.span, f.observations, f.last)
    assert plain.tickets(1e6, day, "no such game") == pytest.approx(np.exp(f.baseline["", -1]))


def test_value_report(spark):
    rows = value.history(spark, SF).toPandas()
    jackpots = {"loto": 5e6, "super_loto": 1e7, "grand_loto": 1.5e7}
    got = {r["game"]: r for r in value.value_report(spark, SF, jackpots=jackpots, co_winners=0.3).collect()}
    assert set(got) == set(jackpots)
    p1 = rank_probability(1)
    for game, r in got.items():
        v = rows[rows["game"] == game].sort_values("i")["lower_ev"].to_numpy()
        n, cut = len(v), max(10, int(len(v) * 0.8))
        assert (rows[rows["game"] == game]["i"].sort_values().to_numpy() == np.arange(n)).all()
        best = None
        for w in sorted({min(w, cut) for w in (50, 100, 250, cut)}):
            own = np.sort(v[cut - w : cut])
            for tail in (0.01, 0.025, 0.05):
                low, high = own[round(tail * (w - 1))], own[round((1 - tail) * (w - 1))]
                c = np.mean((v[cut:] >= low - 1e-12) & (v[cut:] <= high + 1e-12))
                goal = (round(abs(c - 0.95), 12), high - low)
                if best is None or goal < best[0]:
                    best = (goal, w, tail, c)
        assert (r["payout_window"], r["tail"], r["coverage"]) == (best[1], best[2], pytest.approx(best[3], abs=1e-9))
        mean = v.mean() + p1 * jackpots[game] / 1.3
        assert (r["lower_rank_ev"], r["estimated_ev"], r["return_rate"]) == pytest.approx((v.mean(), mean, mean / value.PRICES[game]), abs=1e-9)
        assert r["fair_jackpot"] == pytest.approx((value.PRICES[game] - v.mean()) * 1.3 / p1, rel=1e-8)
        assert r["ev_low"] < mean < r["ev_high"] and r["conservative_jackpot"] > r["fair_jackpot"]
        assert r["decision"] == ("eligible" if r["ev_low"] > value.PRICES[game] else "no_bet")
    with pytest.raises(ValueError):
        value.value_report(spark, SF, jackpots={"loto": -1.0})
    assert value.value_report(spark, SF, jackpots=jackpots, target=date(1900, 1, 1), co_winners=0.0).count() == 0


def test_break_even():
    """Found for a curve with a bend, at once where the price is met already, never where it can't be."""
    curve = lambda j: 0.5 + j / TOTAL * value.share(2e6 / TOTAL * (1 + j / 1e7))
    j = value.least(curve, 2.2, 1e6)
    assert curve(j) == pytest.approx(2.2, abs=1e-7) and curve(j * (1 - 1e-6)) < 2.2
    assert value.least(lambda j: 3.0, 2.2, 5.0) == 1.0
    assert value.least(lambda j: 0.1, 2.2, 5.0) is None

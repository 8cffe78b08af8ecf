"""The walk-forward value backtest against plain programs on the collected rows."""

from __future__ import annotations

from math import expm1

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.functions.probability import TOTAL, rank_probability
from urnspark.operators import participation, value, value_backtest
from urnspark.plans.staging import stage

SF = "/root/testdata/sf0.001"
GAME, TRAIN, FOLDS, SAMPLES, INTERVAL = "loto", 300, 2, 100, 52
NUMBERS = ("observations", "bias", "mae", "rmse", "naive_mae", "improvement", "coverage", "width", "eligible", "positive", "false_positive", "false_negative")


@pytest.fixture(scope="module")
def walked(spark):
    seen = participation.participation(spark, SF)
    seen = stage(seen.withColumn("jackpot_level", F.expm1(F.col("jackpot") * 20)), "observations")
    rows = value.history(spark, SF).where(F.col("game") == GAME)
    found = value_backtest.refits(spark, SF, rows, seen, game=GAME, min_train=TRAIN, folds=FOLDS, interval=INTERVAL)
    return seen, rows, found, participation.walk(seen, [r["first"] for r in found], replicates=SAMPLES, models=("ridge",))


@pytest.fixture(scope="module")
def reported(spark):
    out = value_backtest.value_backtest(spark, SF, game=GAME, min_train=TRAIN, folds=FOLDS, samples=SAMPLES, interval=INTERVAL, models=("ridge",)).collect()
    return {r["period"]: r.asDict() for r in out}


def test_refits(walked):
    """Dates, and what lies before them, by plain loops."""
    seen, rows, found, _ = walked
    x, h = seen.toPandas().sort_values("draw_date"), rows.toPandas().sort_values("i")
    want = []
    for fold, dates in enumerate(np.array_split(np.unique(x["draw_date"].to_numpy()[TRAIN:]), FOLDS), 1):
        for at in range(0, len(dates), INTERVAL):
            own = h[h["draw_date"].isin(dates[at : at + INTERVAL])]
            if len(own) and (before := h[h["draw_date"] < own["draw_date"].min()]).shape[0] >= 5:
                paid = before["pool"][before["pool"] > 0]
                want.append((fold, own["draw_date"].min(), len(before), before["lower_ev"].mean(), paid.mean() if len(paid) else 0.0, before["pool"].notna().sum()))
    assert len(want) == len(found) > 3
    for w, r in zip(want, found):
        assert (r["fold"], r["first"], r["n"], r["known"]) == (w[0], w[1], w[2], w[5]) and r["last"] < r["first"]
        assert (r["lower"], r["code"]) == pytest.approx((w[3], w[4]), rel=1e-12)
    assert (h["known"].to_numpy() == np.r_[0, np.cumsum(h["pool"].notna())[:-1]]).all()


def test_walk_is_each_date_by_itself(spark, walked):
    """The forecasters of all dates at once equal the one that is made for a date alone."""
    seen, _, found, many = walked
    for r in (found[0], found[-1]):
        count = seen.where(F.col("draw_date") < F.lit(r["first"])).count()
        _, one = participation.evaluate(spark, SF, before=r["first"], min_train=max(100, count // 2), n=2, replicates=SAMPLES, models=("ridge",))
        f = many[r["first"]]
        assert (f.champion["qualified"], f.champion["parameters"], f.observations, f.last) == (one.champion["qualified"], one.champion["final_parameters"], one.observations, one.last)
        assert f.smearing == pytest.approx(one.smearing, rel=1e-9) and f.multipliers == pytest.approx(one.multipliers, rel=1e-9)
        day = r["dates"][-1]
        assert f.tickets(3e6, day, GAME) == pytest.approx(one.tickets(3e6, day, GAME), rel=1e-9)
    with pytest.raises(ValueError):
        participation.walk(seen, [min(seen.toPandas()["draw_date"])], models=("ridge",))


def test_errors(walked, reported):
    """Forecasts, errors and rates of every period and of all, draw by draw from the definition."""
    seen, rows, found, forecasters = walked
    x, h = seen.toPandas().set_index("draw_id"), rows.toPandas().sort_values("i")
    first, price, share = rank_probability(1), value.PRICES[GAME], lambda r: 1.0 if r == 0 else -expm1(-r) / r
    period, every = 0, []
    for r in found:
        f, own = forecasters[r["first"]], h[h["draw_date"].isin(r["dates"]) & h["draw_id"].isin(x.index)]
        if own.empty:
            continue
        period += 1
        assert reported[period]["fold"] == r["fold"] and reported[period]["training_last_date"] == str(r["last"])
        errors = []
        for d in own.itertuples():
            o = x.loc[d.draw_id]
            n, sold, j = f.tickets(o["jackpot_level"], d.draw_date, GAME), np.exp(o["y"]), o["jackpot_level"]
            pool = r["code"] if np.isnan(d.pool) else d.pool
            seen_value = d.lower_ev + pool / sold + first * j * share(sold / TOTAL)
            errors.append((r["lower"] + r["code"] / n + first * j * share(n / TOTAL) - seen_value, r["lower"] + first * j - seen_value, seen_value > price))
        e, naive, won = map(np.array, zip(*errors))
        got = reported[period]
        assert (got["observations"], got["positive"]) == (len(e), won.sum())
        assert (got["bias"], got["mae"], got["naive_mae"], got["improvement"]) == pytest.approx((e.mean(), np.abs(e).mean(), np.abs(naive).mean(), 1 - np.abs(e).mean() / np.abs(naive).mean()), abs=1e-8)
        assert got["eligible"] - got["false_positive"] == got["positive"] - got["false_negative"]
        every += errors
    e, naive, _ = map(np.array, zip(*every))
    all_ = reported[0]
    assert (all_["refits"], len(reported), all_["observations"]) == (period, period + 1, len(e))
    delta = np.abs(e) - np.abs(naive)
    assert (all_["mae"], all_["rmse"], all_["naive_rmse"], all_["mae_delta"]) == pytest.approx((np.abs(e).mean(), np.sqrt((e**2).mean()), np.sqrt((naive**2).mean()), delta.mean()), abs=1e-8)
    assert all_["delta_low"] < all_["mae_delta"] < all_["delta_high"]
    assert all_["coverage_low"] <= all_["coverage"] <= all_["coverage_high"]
    assert sum(reported[p]["observations"] * reported[p]["coverage"] for p in range(1, period + 1)) == pytest.approx(all_["observations"] * all_["coverage"], abs=1e-6)
    assert all_["better_periods"] == sum(reported[p]["mae"] < reported[p]["naive_mae"] for p in range(1, period + 1))
    assert all_["qualified"] == (all_["better_than_naive"] and all_["coverage_compatible"])


def test_intervals(spark, walked):
    """An interval lies where a plain sample of the window puts it; samples are the window's own values."""
    seen, rows, found, forecasters = walked
    r = dict(found[-1])
    r |= value.windows(rows, [(r["key"], GAME, r["n"])])[r["key"]]
    value_backtest._samples(rows, [r], 2000, 0)
    h = rows.toPandas().sort_values("i")
    own = h[(h["i"] >= r["n"] - r["window"]) & (h["i"] < r["n"])]
    assert set(r["lowers"]) <= set(own["lower_ev"]) and set(r["pools"]) <= set(own["pool"].dropna())
    assert r["lowers"].mean() == pytest.approx(own["lower_ev"].mean(), rel=0.02)
    got = value_backtest.evaluated(rows, seen, [r], forecasters, samples=2000, seed=0).toPandas()
    rng, f, x = np.random.default_rng(1), forecasters[r["first"]], seen.toPandas().set_index("draw_id")
    for d in got.head(3).itertuples():
        j = x.loc[d.draw_id]["jackpot_level"]
        n = f.tickets(j, d.draw_date, GAME) * f.draw(rng.random(20000))
        v = rng.choice(own["lower_ev"], 20000) + rng.choice(own["pool"].dropna(), 20000) / n + rank_probability(1) * j * value.share(n / TOTAL)
        low, high = np.quantile(v, (r["tail"], 1 - r["tail"]))
        assert (d.low, d.high) == pytest.approx((low, high), abs=0.15 * (high - low))


def test_refuses(spark):
    for bad in ({"game": "none"}, {"min_train": 10}, {"folds": 1}, {"samples": 5}, {"interval": 0}, {"min_train": 10**6}):
        with pytest.raises(ValueError):
            value_backtest.value_backtest(spark, SF, models=("ridge",), **bad)

"""Sums by date and kind, trees grown from them, and values at exact places, against plain programs on the collected rows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urnspark.operators import calendar_cells, calendar_trees, participation, value, value_backtest
from urnspark.operators.calendar_trees import grow
from urnspark.operators.learners import day_of
from urnspark.operators.models import FEATURES
from urnspark.operators.ranks import ranked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def gathered(spark):
    rows = participation.participation(spark, SF)
    x = rows.toPandas().sort_values("draw_date")
    cells, data = calendar_cells.gathered(rows, sorted(set(x["draw_date"])), float(x["y"].mean()))
    return x, cells, data


def _plain(x, y, parameters, trees):
    """A booster that holds all rows and tries every split of every leaf, the best gain of all leaves first; x's columns are FEATURES."""
    rate, leaves, l2 = parameters
    cuts = [calendar_trees.thresholds(x[:, c], np.ones(len(x))) for c in range(x.shape[1])]
    score, grown = np.full(len(y), y.mean()), []

    def split(at, g):
        best = None
        for c, edges in enumerate(cuts):
            for cut in edges:
                left, right = at[x[at, c] <= cut], at[x[at, c] > cut]
                if min(len(left), len(right)) >= 20:
                    gain = g[left].sum() ** 2 / (len(left) + l2) + g[right].sum() ** 2 / (len(right) + l2) - g[at].sum() ** 2 / (len(at) + l2)
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, left, right)
        return best

    for _ in range(trees):
        g = score - y
        ends = [(np.arange(len(y)), split(np.arange(len(y)), g))]
        while len(ends) < leaves and any(s for _, s in ends):
            i = max((i for i, (_, s) in enumerate(ends) if s), key=lambda i: ends[i][1][0])
            _, left, right = ends.pop(i)[1]
            ends += [(at, split(at, g)) for at in (left, right)]
        for at, _ in ends:
            score[at] -= rate * g[at].sum() / (len(at) + l2)
    return score


def test_trees(gathered):
    """Best gains first, bins of the model's own training dates: the same as from the rows; the date's columns come from its day."""
    x, cells, _ = gathered
    first = len(cells.dates) * 3 // 4
    known = (np.arange(len(cells.dates)) < first)[:, None]
    use = (x["draw_date"] < cells.dates[first]).to_numpy()
    v, y = x[list(FEATURES)].to_numpy(float), x["y"].to_numpy() - cells.centre
    v[:, 2:12] = calendar_trees.date_columns(np.array([day_of(d) for d in x["draw_date"]]))  # sines that differ by their last bit are split apart
    kinds = cells.x[0][:, [0, 12, 13, 14]]
    for parameters in participation.BOOSTS:
        rate, leaves, l2 = parameters
        model, score = grow(cells.days, kinds, np.stack([cells.n, cells.s]) * known, cells.tenth * known, rate=rate * 5, leaves=leaves, l2=l2, trees=6)
        assert len(model.trees) == 6 and max(len(t) for t in model.trees) == 2 * leaves - 1
        days = np.array([day_of(d) for d in x["draw_date"]])
        got = model.predict(days, v)
        assert got[use] == pytest.approx(_plain(v[use], y[use], (rate * 5, leaves, l2), 6), abs=1e-9)
        place = {k: i for i, k in enumerate(cells.kinds)}
        at = [cells.dates.index(d) for d in x["draw_date"]], [place[k] for k in zip(x["game"], x["jackpot"])]
        assert got == pytest.approx(score[at], abs=1e-12)


def test_trees_stop():
    """With many observations a random tenth ends the growth; it isn't learnt from."""
    rng = np.random.default_rng(5)
    days, kinds = np.arange(10000, 10120), np.array([[0.5, 1, 0, 0], [0.7, 0, 1, 0]])
    n = np.full((120, 2), 200.0)
    y = rng.normal(0, 1, (120, 2, 200)) + 0.5 * (kinds[:, 0] > 0.6)[None, :, None]
    held = np.arange(200) < 20
    cells, tenth = np.stack([n, y.sum(axis=2)]), np.stack([np.full((120, 2), 20.0), y[:, :, held].sum(axis=2), (y[:, :, held] ** 2).sum(axis=2)])
    model, score = grow(days, kinds, cells, tenth, rate=0.1, leaves=7, l2=5.0)
    assert 11 <= len(model.trees) < 150 and model.base == pytest.approx(y[:, :, ~held].mean())
    assert abs(score[:, 1].mean() - score[:, 0].mean() - 0.5) < 0.2
    # The last ten trees and those before them: the error of the tenth has stopped falling only at the end.
    losses = []
    for trees in range(len(model.trees) + 1):
        p = grow(days, kinds, cells, tenth, rate=0.1, leaves=7, l2=5.0, trees=trees)[1]
        losses.append(((y[:, :, held] - p[:, :, None]) ** 2).mean() / 2)
    assert min(losses[-10:]) >= losses[-11] - 1e-7
    assert all(min(losses[i + 1 : i + 11]) < losses[i] - 1e-7 for i in range(len(losses) - 11))
    few = grow(days[:20], kinds, cells[:, :20], tenth[:, :20], rate=0.1, leaves=7, l2=5.0, trees=12)[0]
    assert len(few.trees) == 12 and few.base == pytest.approx(y[:20].mean())


def test_thresholds():
    """Midpoints of distinct values; of many, midpoints around percentiles of the observations."""
    assert calendar_trees.thresholds(np.array([1.0, 5.0, 1.0, 2.0, 9.0]), np.array([1, 2, 1, 1, 0.0])).tolist() == [1.5, 3.5]
    rng = np.random.default_rng(2)
    v, n = rng.normal(0, 1, 400), rng.integers(1, 9, 400)
    want = np.unique(np.percentile(np.repeat(v, n), np.linspace(0, 100, 256)[1:-1], method="midpoint"))
    assert calendar_trees.thresholds(v, n.astype(float)) == pytest.approx(want)


def test_cells(gathered):
    x, cells, data = gathered
    assert cells.n.sum() == len(x) == data.count() and cells.s.sum() == pytest.approx(0, abs=1e-8)
    own = {(d, g, j): v for (d, g, j), v in x.groupby(["draw_date", "game", "jackpot"])}
    for (d, g, j), v in list(own.items())[:50]:
        at, y = (cells.dates.index(d), cells.kinds.index((g, j))), v["y"].to_numpy() - cells.centre
        assert (cells.n[at], cells.s[at], cells.q[at], cells.e[at], cells.low[at], cells.high[at]) == pytest.approx((len(y), y.sum(), (y * y).sum(), np.exp(y).sum(), y.min(), y.max()))
        assert cells.x[at] == pytest.approx(v[list(FEATURES)].to_numpy(float)[0], abs=1e-12)
    assert 0.02 < cells.tenth[0].sum() / len(x) < 0.2


def test_ranked(spark, monkeypatch):
    """Ties, infinitely near values, one value alone, parts: in many narrow passes and in one."""
    rng = np.random.default_rng(1)
    n = 3000
    x = pd.DataFrame({"s": rng.integers(0, 3, n), "p": rng.integers(0, 4, n), "v": np.where(rng.random(n) < 0.2, 0.25, rng.normal(0, 1, n))})
    x.loc[x["s"] == 1, "v"] = 7.0
    x.loc[(x["s"] == 2) & (x["v"] < 0), "v"] *= 1e-18
    data = spark.createDataFrame(x, "s int, p int, v double").repartition(3)

    def series(b):
        for s in range(3):
            use = (b["s"] == s).to_numpy()
            yield s, b["p"].to_numpy()[use], b["v"].to_numpy()[use]

    asked, sizes, want = {}, {}, {}
    for s in range(3):
        own = x[x["s"] == s]
        parts, places, w = [], [], []
        for p in (0, 2, 3):
            v = np.sort(own[own["p"] <= p]["v"])
            at = np.unique(np.r_[0, len(v) - 1, rng.integers(0, len(v), 40)])
            parts += [p] * len(at)
            places += at.tolist()
            w += v[at].tolist()
        asked[s], sizes[s], want[s] = ((own["v"].min(), own["v"].max()), np.array(parts), np.array(places)), len(own), w
    for rows in (0, 10**6):
        monkeypatch.setattr("urnspark.operators.ranks.ROWS", rows)
        got = ranked(data, series, asked, sizes)
        assert all(got[s].tolist() == want[s] for s in range(3))


def test_medians(gathered):
    """By game and weekday where it has enough of its own, else by game, else of all."""
    x, cells, data = gathered
    starts = [1, 7, len(cells.dates) // 2, len(cells.dates)]
    for start, got in zip(starts, calendar_cells.medians(cells, data, starts, 10)):
        own = x[x["draw_date"].isin(cells.dates[:start])]
        week = np.array([d.weekday() for d in own["draw_date"]])
        for game in {g for g, _ in cells.kinds}:
            of = own[own["game"] == game]["y"]
            whole = of.median() if len(of) else own["y"].median()
            assert got[game, -1] == pytest.approx(whole, rel=1e-12)
            for w in range(7):
                day = own[(own["game"] == game) & (week == w)]["y"]
                assert got[game, w] == pytest.approx(day.median() if len(day) >= 10 else whole, rel=1e-12)


def test_tests(gathered):
    """Errors are exact; intervals and chances agree with plain resampling."""
    x, cells, data = gathered
    z = len(cells.dates) // 2
    shape = (len(cells.dates) - z, len(cells.kinds))
    base, near = np.full(shape, 0.05), np.full(shape, 0.03)
    y = (x[x["draw_date"] >= cells.dates[z]]["y"] - cells.centre).to_numpy()
    (rows,) = calendar_cells.tests(cells, data, [(z, base, np.stack([near, base + 0.01]))], 2000)
    rng = np.random.default_rng(4)
    for r, p in zip(rows, (0.03, 0.06)):
        delta = (p - y) ** 2 - (0.05 - y) ** 2
        assert (r["observed"], r["rmse"]) == pytest.approx((delta.mean(), np.sqrt(((p - y) ** 2).mean())), rel=1e-9)
        means = rng.choice(delta, (4000, len(y))).mean(axis=1)
        signed = (rng.choice((-1.0, 1.0), (4000, len(y))) * delta).mean(axis=1)
        assert (r["low"], r["high"]) == pytest.approx(np.quantile(means, (0.025, 0.975)), abs=0.25 * means.std())
        assert r["p_lower"] == pytest.approx((signed <= delta.mean()).mean(), abs=0.04)


def test_query_has_boosted_trees(spark, monkeypatch):
    """The registered query grows all boosted trees of each refit beside its ridge models, and chooses among both."""
    walked, judged = [], []
    walk, tests = participation.walk, calendar_cells.tests
    monkeypatch.setattr(participation, "walk", lambda *a, **more: walked.append(walk(*a, **more)) or walked[-1])
    monkeypatch.setattr(calendar_cells, "tests", lambda *a: judged.append([len(p) for _, _, p in a[2]]) or tests(*a))
    monkeypatch.setattr(value_backtest, "refits", lambda *a, kept=value_backtest.refits, **k: kept(*a, **k)[::20])
    rows = value_backtest.QUERIES["value_backtest"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(walked[0]) + 1 > 2 and judged == [[2] * len(walked[0])]
    assert {r["participation_model"] for r in rows if r["period"]} <= {"ridge", "gradient_boosting", "baseline"}


def test_boosted_forecasts(spark):
    """Tickets that bend with the jackpot: boosted trees are the champion, and their forecasts are the cells' own."""
    rng, first = np.random.default_rng(6), date(2000, 1, 3)
    made = []
    for i in range(900):
        game, jackpot = ("loto", "super_loto")[i % 2], float(2e6 + 1e6 * rng.integers(0, 9))
        size = np.log1p(jackpot) / 20
        made.append((i, first + timedelta(days=i // 3), game, 14 + (jackpot > 5e6) * (game == "loto") * 0.8 + rng.normal(0, 0.05), size))
    x = pd.DataFrame(made, columns=["draw_id", "draw_date", "game", "y", "jackpot"])
    v = calendar_cells.features(np.array([day_of(d) for d in x["draw_date"]]), x["game"].to_numpy(), x["jackpot"].to_numpy())
    for i, c in enumerate(FEATURES):
        x[c] = v[:, i]
    rows = spark.createDataFrame(x).withColumn("draw_date", F.to_date("draw_date"))
    befores = [first + timedelta(days=200), first + timedelta(days=280)]
    both = participation.walk(rows, befores, replicates=200, trees=100)
    for before in befores:
        f = both[before]
        assert f.champion["model"] == "gradient_boosting" and f.champion["qualified"] and f.champion["log_rmse"] < 0.1
        assert np.log(f.tickets(9e6, before, "loto") / f.tickets(9e6, before, "super_loto")) == pytest.approx(0.8, abs=0.1)
        assert f.tickets(9e6, before, "super_loto") == pytest.approx(np.exp(14), rel=0.1)
    # A date asked by itself has the same forecaster.
    one = participation.walk(rows, befores[1:], replicates=200, trees=100)[befores[1]]
    assert one.champion["parameters"] == both[befores[1]].champion["parameters"] and one.smearing == pytest.approx(both[befores[1]].smearing, rel=1e-9)
    assert one.tickets(6e6, befores[1], "loto") == pytest.approx(both[befores[1]].tickets(6e6, befores[1], "loto"), rel=1e-9)
    assert one.multipliers == pytest.approx(both[befores[1]].multipliers, rel=1e-9)


def test_samples_in_blocks(spark, monkeypatch):
    """Intervals don't depend on how many draws a task holds at once."""
    seen = participation.participation(spark, SF).withColumn("jackpot_level", F.expm1(F.col("jackpot") * 20))
    rows = value.history(spark, SF).where("game = 'loto'")
    found = value_backtest.refits(spark, SF, rows, seen, game="loto", min_train=300, folds=2, interval=52)[-1:]
    forecasters = participation.walk(seen, [found[0]["first"]], replicates=100, models=("ridge",))
    found[0] |= value.windows(rows, [(found[0]["key"], "loto", found[0]["n"])])[found[0]["key"]]
    value_backtest._samples(rows, found, 100, 0)
    out = []
    for size in (1, 128):
        monkeypatch.setattr(value_backtest, "AT_ONCE", size)
        out.append(value_backtest.evaluated(rows, seen, found, forecasters, samples=100, seed=0).orderBy("draw_id").toPandas())
    assert len(out[0]) > 5 and (out[0]["low"] < out[0]["high"]).all()
    pd.testing.assert_frame_equal(*out, rtol=1e-12)

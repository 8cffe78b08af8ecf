"""Nested backtests against a direct program on the collected feature table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.operators import backtests, chance
from urnspark.plans import lift

SF = "/root/testdata/sf0.001"


def _hits(p, y):
    fifth = np.sort(p)[-5]
    over, tie = p > fifth + 1e-12, np.abs(p - fifth) <= 1e-12
    return (over * y).sum() + (5 - over.sum()) * (tie * y).sum() / tie.sum()


def test_nested(spark):
    x = backtests.cells(spark, SF).toPandas().sort_values(["draw_date", "game", "number"])
    draws = lift.table(spark, SF, "draws").toPandas()
    groups = {k: g for k, g in x.groupby(["draw_date", "game"])}
    rows = []  # one for each draw
    for d in draws.sort_values(["draw_date", "game", "draw_id"]).itertuples():
        if (d.draw_date, d.game) in groups:
            g = groups[d.draw_date, d.game]
            rows.append((d.draw_date, g, np.isin(np.arange(1, 50), d.numbers).astype(float)))
    dates = np.array([r[0] for r in rows])
    min_train = 200
    folds = np.array_split(np.unique(dates[min_train:]), 2)
    got = {(r["model"], r["fold"]): r for r in backtests.nested(spark, SF, min_train=min_train, outer=2).collect()}
    feature = lambda g, onehot: np.c_[g[list(backtests.PLAIN)].to_numpy(float), np.eye(49)] if onehot else g[[f"frequency_{w}_delta" for w in backtests.WINDOWS]].to_numpy(float)

    def bayes(w, s, b):
        def p(g):
            h = g["history_draws"].to_numpy(float)
            c = g["count"].to_numpy(float)
            if w:
                h = np.minimum(h, w)
                c = (g[f"frequency_{w}_delta"].to_numpy(float) + 5 / 49) * h
            return 5 / 49 + b * ((c + s * 5 / 49) / (h + s) - 5 / 49)

        return p

    def ridge(at, alpha, onehot):
        a = [feature(rows[i][1], onehot) for i in at]
        a = np.concatenate([z - z.mean(0) for z in a])
        y = np.concatenate([rows[i][2] - 5 / 49 for i in at])
        beta = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ y)
        return lambda g: 5 / 49 + (feature(g, onehot) - feature(g, onehot).mean(0)) @ beta

    score = lambda p, at: (np.mean([((p(rows[i][1]) - rows[i][2]) ** 2).mean() for i in at]), np.mean([_hits(p(rows[i][1]), rows[i][2]) for i in at]))
    for f, part in enumerate(folds, 1):
        train, test = np.flatnonzero(dates < part[0]), np.flatnonzero(np.isin(dates, part))
        days = np.unique(dates[train])
        split = days[max(1, int(len(days) * 0.8))]
        inner, late = train[dates[train] < split], train[dates[train] >= split]
        for model, candidates in (("bayesian", [(0, s, b) for s in backtests.PRIORS for b in backtests.BLENDS]), ("rolling_ridge_ranker", [(a, False) for a in backtests.ALPHAS]), ("ridge_ranker", [(a, True) for a in backtests.ALPHAS])):
            make = (lambda at, c: bayes(*c)) if model == "bayesian" else (lambda at, c: ridge(at, *c))
            tried = [score(make(inner, c), late) for c in candidates]
            order = (lambda i: (round(tried[i][0], 14), -round(tried[i][1], 12), i)) if model == "bayesian" else (lambda i: (-round(tried[i][1], 12), round(tried[i][0], 14), i))
            best = min(range(len(tried)), key=order)
            brier, hits = score(make(train, candidates[best]), test)
            r = got[model, f]
            assert r["n"] == len(test), model
            assert r["validation_brier"] == pytest.approx(tried[best][0], abs=2e-9), model
            assert (r["brier_delta"], r["hits_uplift"]) == pytest.approx((brier - backtests.UNIFORM, hits - 25 / 49), abs=2e-9), model


def test_chance(spark):
    draws = lift.table(spark, SF, "draws").toPandas()
    got = {(r["game"], r["fold"]): r for r in chance.backtest(spark, SF, min_train=100, outer=2).collect()}
    for game, g in draws.groupby("game"):
        g = g.sort_values(["draw_date", "draw_id"])
        y, day = g["chance"].to_numpy() - 1, np.array([d.weekday() for d in g["draw_date"]])
        dates = g["draw_date"].to_numpy()
        if len(y) <= 100:
            assert (game, 1) not in got
            continue
        series = []
        for w, s, a, b in chance.GRID:
            out, moves, week = [], np.zeros((10, 10)), np.zeros((7, 10))
            for i, c in enumerate(y):
                share = lambda n: (n + s / 10) / (n.sum() + s)
                past = np.bincount(y[max(0, i - w) : i] if w else y[:i], minlength=10)
                p = (1 - a - b) * share(past) + a * share(moves[y[i - 1]] if i else np.zeros(10)) + b * share(week[day[i]])
                out.append((((p - np.eye(10)[c]) ** 2).mean(), -np.log(p[c])))
                if i:
                    moves[y[i - 1], c] += 1
                week[day[i], c] += 1
            series.append(np.array(out))
        for f, part in enumerate(np.array_split(np.unique(dates[100:]), 2), 1):
            days = np.unique(dates[dates < part[0]])
            split = days[min(max(1, int(len(days) * 0.8)), len(days) - 1)]
            late, test = (dates >= split) & (dates < part[0]), np.isin(dates, part)
            best = min(range(len(series)), key=lambda k: (round(series[k][late, 1].mean(), 12), round(series[k][late, 0].mean(), 12), k))
            r = got[game, f]
            assert (r["window"], r["prior"], r["transition"], r["weekday"]) == chance.GRID[best]
            assert (r["n"], r["brier_delta"], r["log_loss_delta"]) == (test.sum(), pytest.approx(series[best][test, 0].mean() - 0.09, abs=2e-9), pytest.approx(series[best][test, 1].mean() - np.log(10), abs=2e-9))


def test_chance_settings(spark):
    """The sums of all settings by date are those of the columns, and a fold without two dates before it has the default setting."""
    counts = chance.counted(spark, SF)
    got = {(r["game"], r["draw_date"], r["k"]): r for r in chance.graded(counts).collect()}
    for k in (0, 7, 21, len(chance.GRID) - 1):
        brier, loss, hits, _ = chance._scores(chance.distribution(*chance.GRID[k]))
        for w in counts.groupBy("game", "draw_date").agg(F.count("*").alias("n"), F.sum(brier).alias("b"), F.sum(loss).alias("l"), F.sum(hits).alias("h")).collect():
            r = got[w["game"], w["draw_date"], k]
            assert r["n"] == w["n"] and (r["b"], r["l"], r["h"]) == pytest.approx((w["b"], w["l"], w["h"]), abs=1e-9)
    early = chance.backtest(spark, SF, min_train=0, outer=2).collect()
    first = {r["game"]: (r["window"], r["prior"], r["transition"], r["weekday"]) for r in early if r["fold"] == 1}
    games = {r["game"]: r["n"] for r in counts.groupBy("game").agg(F.count("*").alias("n")).collect()}
    assert first == dict.fromkeys(games, chance.DEFAULT)
    assert {g: sum(r["n"] for r in early if r["game"] == g) for g in games} == games

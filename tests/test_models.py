"""Fitted models against NumPy on the collected features."""

from __future__ import annotations

import numpy as np
import pytest

from urnspark.operators import models

SF = "/root/testdata/sf0.01"


def test_participation_backtest(spark):
    rows = models.participation(spark, SF).toPandas().sort_values(["draw_date", "draw_id"])
    got = models.participation_backtest(spark, SF).toPandas().set_index("draw_id")
    days = sorted(set(rows["draw_date"].iloc[500:]))
    assert set(got.index) == set(rows[rows["draw_date"] >= days[0]]["draw_id"])
    for k, part in enumerate(np.array_split(np.array(days), 3), 1):
        train, test = rows[rows["draw_date"] < part[0]], rows[(rows["draw_date"] >= part[0]) & (rows["draw_date"] <= part[-1])]
        x, y = train[list(models.FEATURES)].to_numpy(float), train["y"].to_numpy()
        mean = x.mean(0)
        b = np.linalg.solve((x - mean).T @ (x - mean) + np.eye(x.shape[1]), (x - mean).T @ (y - y.mean()))
        want = y.mean() + (test[list(models.FEATURES)].to_numpy(float) - mean) @ b
        assert (got.loc[test["draw_id"], "fold"] == k).all()
        assert got.loc[test["draw_id"], "predicted"].to_numpy() == pytest.approx(want, abs=2e-6)


def test_popularity_poisson(spark):
    out = models.popularity_poisson(spark, SF).toPandas()
    # With a free intercept the fitted winners add up to those seen.
    assert out["expected"].sum() == pytest.approx(out["winners"].sum(), rel=1e-6)
    assert (out["expected"] > 0).all()


def test_smearing_and_bias(spark):
    rows = models.participation(spark, SF).toPandas().sort_values(["draw_date", "draw_id"])
    got = models.participation_backtest(spark, SF).toPandas().set_index("draw_id")
    for k, part in got.groupby("fold"):
        first = rows[rows["draw_id"].isin(part.index)]["draw_date"].min()
        dates = sorted(set(rows[rows["draw_date"] < first]["draw_date"]))
        split = dates[max(1, int(len(dates) * 0.8))]
        inner, late = rows[rows["draw_date"] < split], rows[(rows["draw_date"] >= split) & (rows["draw_date"] < first)]
        x, y = inner[list(models.FEATURES)].to_numpy(float), inner["y"].to_numpy()
        b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
        residual = late["y"].to_numpy() - (y.mean() + (late[list(models.FEATURES)].to_numpy(float) - x.mean(0)) @ b)
        assert part["smearing"].iloc[0] == pytest.approx(np.exp(residual).mean(), abs=2e-6)


def test_popularity_backtest(spark):
    rows = models.popularity(spark, SF).toPandas().sort_values(["draw_date", "draw_id"])
    days = sorted(set(rows["draw_date"].iloc[500:]))
    got = models.popularity_backtest(spark, SF).toPandas().set_index("fold")

    def fit(a, alpha):
        mean, std = a[list(models.SHAPE)].mean(), a[list(models.SHAPE)].std(ddof=0).replace(0, 1)
        x = np.c_[np.ones(len(a)), ((a[list(models.SHAPE)] - mean) / std).to_numpy(float)]
        w, e = a["winners"].to_numpy(), a["exposure"].to_numpy()
        beta = np.r_[np.log(w.sum() / e.sum()), np.zeros(len(models.SHAPE))]
        for _ in range(50):
            mu = e * np.exp(x @ beta)
            g = x.T @ (w - mu) - alpha * e.sum() * np.r_[0, beta[1:]]
            h = (x * mu[:, None]).T @ x + alpha * e.sum() * np.diag(np.r_[0, np.ones(len(models.SHAPE))])
            beta = beta + np.linalg.solve(h, g)
        return lambda b: b["exposure"].to_numpy() * np.exp(np.c_[np.ones(len(b)), ((b[list(models.SHAPE)] - mean) / std).to_numpy(float)] @ beta)

    def deviance(b, mu):
        w = b["winners"].to_numpy()
        return 2 * (np.where(w > 0, w * np.log(np.maximum(w, 1) / mu), 0) - (w - mu))

    for k, part in enumerate(np.array_split(np.array(days), 3), 1):
        train, test = rows[rows["draw_date"] < part[0]], rows[(rows["draw_date"] >= part[0]) & (rows["draw_date"] <= part[-1])]
        r = got.loc[k]
        assert r["n"] == len(test)
        assert r["deviance"] == pytest.approx(deviance(test, fit(train, r["alpha"])(test)).mean(), abs=1e-6)
        flat = test["exposure"].to_numpy() * train["winners"].sum() / train["exposure"].sum()
        assert r["uniform"] == pytest.approx(deviance(test, flat).mean(), abs=1e-6)

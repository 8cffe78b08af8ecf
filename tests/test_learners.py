"""Quantiles, logistic regressions, boosted trees and projections against NumPy programs on the collected rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.functions.projection import project, projected
from urnspark.operators import backtests, learners
from urnspark.operators.learners import Boosted, Logistic, day_of
from urnspark.operators.quantiles import exact_quantiles

SF = "/root/testdata/sf0.001"


def test_quantiles(spark):
    """Ties, weights of nothing, nulls, NaN, signs of zero, the least and the widest values, a null group."""
    rng = random.Random(3)
    pick = lambda: rng.choice([1.5, -2.0, 1e300, -1e300, 0.0, -0.0, rng.gauss(0, 1), None, float("nan"), 5e-324, 3.0])
    rows = [(rng.choice(["a", "b", None]), pick(), rng.choice([0, 1, 2, 5])) for _ in range(2000)] + [("one", 7.0, 1), ("none", None, 3)]
    ps = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(4)
    got = {(r["g"], r["p"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", ps, weight="w", buckets=16).collect()}
    for g in ("a", "b", None, "one"):
        v = np.sort(np.concatenate([[x] * w for a, x, w in rows if a == g and x is not None and x == x]))
        for p in ps:
            at = p * (len(v) - 1)
            low, high = v[int(np.floor(at))], v[int(np.ceil(at))]
            assert got[g, p] == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-15), (g, p)
    assert not any(g == "none" for g, _ in got)
    assert exact_quantiles(df.limit(0), ["g"], "v", ps).count() == 0


def test_projection(spark):
    """Sums met, order kept, equal to the column; extremes and equal rows too."""
    rows = [np.random.default_rng(i).random(49) ** k for i, k in enumerate((1, 2, 3))] + [np.full(49, 0.3), np.zeros(49), np.r_[np.ones(4), np.zeros(45)]]
    out = project(np.array(rows))
    assert out.sum(axis=1) == pytest.approx(np.full(len(rows), 5.0), abs=1e-9)
    for p, q in zip(rows[:3], out):
        assert (np.argsort(q) == np.argsort(p)).all()
    # One shift of all logits.
    x = lambda p: np.log(p) - np.log1p(-p)
    assert np.ptp(x(out[0]) - x(rows[0])) < 1e-9
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "i int, p array<double>")
    for r in df.select("i", projected(F.col("p")).alias("q")).collect():
        assert r["q"] == pytest.approx(out[r["i"]], abs=1e-9)


@pytest.fixture(scope="module")
def table(spark):
    cells = backtests.cells(spark, SF)
    x = cells.toPandas().sort_values(["draw_date", "game", "number"])
    days = np.array([day_of(d) for d in x["draw_date"]])
    return cells, x[list(backtests.PLAIN)].to_numpy(float), x["n"].to_numpy(float), x["k"].to_numpy(float), days


def test_logistic(spark, table):
    cells, x, n, k, days = table
    models = [Logistic(int(np.quantile(days, q)), c) for q in (0.5, 0.8) for c in (0.01, 1.0)]
    numbers = np.tile(np.eye(49), (len(x) // 49, 1))
    for m in learners.fit_logistic(learners.blocks(cells, backtests.PLAIN), models):
        use = days < m.first
        z, w = np.c_[x, numbers][use], n[use]
        mean = (z * w[:, None]).sum(0) / w.sum()
        scale = np.sqrt(((z - mean) ** 2 * w[:, None]).sum(0) / w.sum())
        scale[scale < 1e-12] = 1
        z, beta = np.c_[np.ones(len(z)), (z - mean) / scale], np.zeros(z.shape[1] + 1)
        free = np.diag(np.r_[0, np.ones(len(beta) - 1)])
        for _ in range(25):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve(m.c * (z * (w * p * (1 - p))[:, None]).T @ z + free, m.c * z.T @ (w * p - k[use]) + free @ beta)
        assert m.beta == pytest.approx(beta, abs=1e-9)


def _booster(x, n, k, days, m, trees, least=20):
    """Hits' probabilities by a booster that holds all rows and tries every split of every node."""
    use = days < m.first
    b = np.column_stack([*(np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(m.edges)), *(np.tile(np.arange(49), len(x) // 49) == j for j in range(49))]).astype(int)
    rows, w, hits = b[use], n[use], k[use]
    score = np.full(len(b), np.log(hits.sum() / (w.sum() - hits.sum())))

    def split(at, g, h):
        best, whole = None, g[at].sum() ** 2 / (h[at].sum() + m.l2)
        for c in range(b.shape[1]):
            for t in range(rows[at, c].max(initial=0)):
                left, right = at[rows[at, c] <= t], at[rows[at, c] > t]
                if min(w[left].sum(), w[right].sum()) >= least and min(h[left].sum(), h[right].sum()) >= 1e-3:
                    gain = g[left].sum() ** 2 / (h[left].sum() + m.l2) + g[right].sum() ** 2 / (h[right].sum() + m.l2) - whole
                    if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, c, t, left, right)
        return best

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score[use]))
        g, h = w * p - hits, w * p * (1 - p)
        level, done, count = [(np.arange(len(rows)), np.ones(len(b), dtype=bool))], [], 1
        while level:
            tried = [(split(at, g, h), at, where) for at, where in level]
            done += [(at, where) for s, at, where in tried if s is None]
            level = []
            for (_, c, t, left, right), at, where in sorted((x for x in tried if x[0]), key=lambda x: -x[0][0]):
                if count < m.leaves:
                    count += 1
                    level += [(left, where & (b[:, c] <= t)), (right, where & (b[:, c] > t))]
                else:
                    done.append((at, where))
        for at, where in done:
            score[where] -= m.rate * g[at].sum() / (h[at].sum() + m.l2)
    return 1 / (1 + np.exp(-score))


def test_boosted(spark, table):
    cells, x, n, k, days = table
    models = [Boosted(int(np.quantile(days, 0.5)), 0.3, 7, 1.0), Boosted(int(np.quantile(days, 0.8)), 0.1, 15, 5.0)]
    for m in learners.fit_boosted(cells, backtests.PLAIN, models, trees=4, bins=16, refresh=2):
        assert len(m.trees) == 4
        assert m.predict(None, x.reshape(-1, 49, x.shape[1])).ravel() == pytest.approx(_booster(x, n, k, days, m, 4), abs=1e-12)

"""Popularity refits, constrained tickets and weighted samples against direct programs."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest

from urnspark.operators import popularity, tickets
from urnspark.operators.models import SHAPE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    rows = popularity.observations(spark, SF)
    return rows.toPandas().sort_values("i").reset_index(drop=True), popularity.fit_predictor(rows, refits=20, block=12)


def _refit(z, y, e, w, alpha):
    """Newton's method on one weighted sample with standardised features."""
    mean = (z * w[:, None]).sum(0) / w.sum()
    scale = np.sqrt(((z - mean) ** 2 * w[:, None]).sum(0) / w.sum())
    scale[scale <= 1e-12] = 1
    s = np.c_[np.ones(len(z)), (z - mean) / scale]
    beta = np.r_[np.log((w * y).sum() / (w * e).sum()), np.zeros(z.shape[1])]
    free = alpha * (w * e).sum() * np.diag(np.r_[0, np.ones(z.shape[1])])
    for _ in range(60):
        mu = w * e * np.exp(s @ beta)
        beta = beta - np.linalg.solve((s * mu[:, None]).T @ s + free, s.T @ (mu - w * y) + free @ beta)
    raw = beta[1:] / scale
    return np.r_[beta[0] - raw @ mean, raw]


def test_refits_one_by_one(fitted):
    x, predictor = fitted
    z, y, e = x[list(SHAPE)].to_numpy(float), x["winners"].to_numpy(float), x["exposure"].to_numpy(float)
    assert (x["i"].to_numpy() == np.arange(len(x))).all()
    w = popularity.weights(np.arange(len(x)), len(x), 12, 20)
    assert w[1:].sum(axis=1).mean() == pytest.approx(len(x), rel=0.1)
    assert predictor.beta == pytest.approx(_refit(z, y, e, np.ones(len(x)), 1e-3), abs=1e-7)
    for own, weight in zip(predictor.refits, w[1:]):
        want = _refit(z, y, e, weight, 1e-3)
        want[0] -= np.log((weight * y).sum() / (weight * e).sum())
        assert own == pytest.approx(want, abs=1e-7)
    mains = np.array([[1, 2, 3, 4, 5], [7, 13, 20, 40, 49]])
    shape = popularity.shape_of(mains)
    assert shape[0].tolist() == [0, 1, 4, 0, 0.1, 1.1] and shape[1].tolist() == [2, 0, 0, 2, 129 / 150, 0.04]
    relative = np.exp(predictor.refits[:, 0] + shape @ predictor.refits[:, 1:].T)
    assert predictor.conservative(mains) == pytest.approx(predictor.baseline * np.quantile(relative, 0.9, axis=1))


@pytest.mark.parametrize("loss", [0.0, 0.004, 0.03])
def test_least_crowded_is_the_best_of_all(spark, fitted, loss):
    """Every ticket of 49 numbers is tried; chances with ties."""
    predictor = fitted[1]
    p = np.round(np.random.default_rng(3).random(49) * 0.02 + 0.09, 3)
    p *= 5 / p.sum()
    got = popularity.least_crowded(spark, p, predictor, loss=loss).first()
    all_ = np.fromiter(itertools.chain.from_iterable(itertools.combinations(range(1, 50), 5)), dtype=np.int8).reshape(-1, 5).astype(int)
    hits = p[all_ - 1].sum(axis=1)
    most = np.sort(p)[-5:].sum()
    fine = all_[hits >= most - loss - 1e-12]
    c = predictor.conservative(fine)
    best = min(range(len(fine)), key=lambda i: (round(c[i], 12), -round(p[fine[i] - 1].sum(), 12), fine[i].tolist()))
    assert got["admissible"] == len(fine)
    assert got["numbers"] == fine[best].tolist()
    assert (got["conservative_multiplier"], got["hit_loss"]) == pytest.approx((c[best], most - p[fine[best] - 1].sum()), abs=2e-9)
    with pytest.raises(ValueError):
        popularity.least_crowded(spark, p[:48], predictor)


def test_samples_follow_their_keys_and_weights(spark):
    w = [1.0] * 44 + [4.0] * 5
    groups = spark.createDataFrame([("a", w)], "by string, weights array<double>")
    rows = tickets.sampled(groups, 4000, seed=7).collect()
    for r in rows[:20]:
        u = lambda n: (int(hashlib.md5(f"7-a-{r['k']}-{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48  # noqa: B023, E731
        assert r["numbers"] == sorted(sorted(range(1, 50), key=lambda n: -math.log(u(n)) / w[n - 1])[:5])
    # Inclusion shares, by simulating draws one after another.
    rng = np.random.default_rng(1)
    one = np.array([rng.choice(49, 5, replace=False, p=np.array(w) / sum(w)) for _ in range(4000)])
    heavy = np.mean([sum(n > 44 for n in r["numbers"]) for r in rows])
    assert heavy == pytest.approx((one >= 44).sum(axis=1).mean(), abs=0.08)
    with pytest.raises(Exception, match="above 0"):
        tickets.sampled(spark.createDataFrame([("a", [0.0] * 49)], "by string, weights array<double>"), 1).collect()


def test_tickets_are_the_best_of_their_candidates(spark):
    groups = spark.createDataFrame([(1, [1.0] * 49), (2, [2.0] * 49)], "by int, weights array<double>")
    got = tickets.generate(groups, 4, candidates=30, seed=3).collect()
    pool = {by: {r["k"]: r["numbers"] for r in tickets.sampled(groups, 120, seed=3).where(f"by = {by}").collect()} for by in (1, 2)}

    def crowd(m):
        gaps = [b - a for a, b in zip(m, m[1:])]
        return 1.2 * sum(n > 31 for n in m) - 5.0 * (m[-1] <= 31) - 1.5 * gaps.count(1) - 4.0 * (len(set(gaps)) == 1) - 0.5 * (5 - len({n % 10 for n in m})) - 0.4 * sum(n in (7, 13) for n in m)

    for by in (1, 2):
        chosen = []
        for r in sorted((r for r in got if r["by"] == by), key=lambda r: r["ticket"]):
            tried = [pool[by][k] for k in range(30 * r["ticket"], 30 * r["ticket"] + 30)]
            score = lambda m: crowd(m) + 3 * (1 - max((len(set(m) & set(c)) for c in chosen), default=0) / 5)  # noqa: B023, E731
            best = max((m for m in tried if m not in chosen), key=score)
            assert r["numbers"] == best and r["score"] == pytest.approx(score(best), abs=1e-9)
            chosen.append(best)
        assert len({tuple(c) for c in chosen}) == 4
    assert len({r["chance"] for r in got}) == 4

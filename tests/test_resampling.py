"""Bootstrap, sign flips, the null law of hits and Monte Carlo counts against direct programs."""

from __future__ import annotations

import itertools
from math import comb

import duckdb
import numpy as np
import pytest

from urnspark.functions import nulls
from urnspark.operators import nested, resampling, uniformity
from urnspark.operators.backtests import nested as plain_nested

SF = "/root/testdata/sf0.001"


def test_bits_are_those_of_the_sql():
    runs, units = np.arange(3), np.array([0, 5, 2**33 + 7])
    got = [[duckdb.connect().execute("SELECT " + resampling.bits32_sql(str(r), str(u), 2)).fetchone()[0] for u in units] for r in runs]
    assert (np.array(got, dtype=np.uint64) == resampling.bits32(runs, units, 2)).all()
    many = resampling.bits32(np.arange(1000), np.arange(1000), 1) / 2**32
    assert many.mean() == pytest.approx(0.5, abs=2e-3) and many.var() == pytest.approx(1 / 12, abs=1e-3)


@pytest.mark.parametrize("block", [1, 20])
def test_resampled(spark, block):
    """Chunks, blocks that cross them, groups shorter than a block, a null group, nulls; against all weights at once."""
    rng = np.random.default_rng(4)
    rows = [(g, i, None if i == 3 else float(v)) for g, n in (("a", 700), ("b", 5), (None, 1)) for i, v in enumerate(rng.normal(-0.02, 1, n))]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(3)
    got = {r["g"]: r for r in resampling.resampled(df, ["g"], "v", "i", block=block, chunk=64).collect()}
    runs = np.arange(2000)
    for g in ("a", "b", None):
        v = np.array([x or 0.0 for a, _, x in rows if a == g])
        n, size = len(v), min(block, len(v))
        starts = np.arange(n - size + 1)
        sums = np.array([v[s : s + size].sum() for s in starts])
        w = np.searchsorted(np.array(resampling.poisson_ends(-(-n // size) / len(starts)), dtype=np.uint64), resampling.bits32(runs, starts, 1), side="right")
        means = np.where(w.sum(1) > 0, (w @ sums) / np.maximum(1, w.sum(1) * size), v.mean())
        sign = 2.0 * (resampling.bits32(runs, np.arange(-(-n // size)), 2) & np.uint64(1)).astype(float) - 1
        flipped = (sign[:, np.arange(n) // size] * v).mean(axis=1)
        want = (n, v.mean(), *np.quantile(means, (0.025, 0.975)), (np.count_nonzero(flipped <= v.mean() + 1e-12) + 1) / 2001)
        assert tuple(got[g][c] for c in ("n", "observed", "low", "high", "p_lower")) == pytest.approx(want, abs=1e-12)
    # About as wide as the normal interval where rows are independent.
    v = np.array([x or 0.0 for a, _, x in rows if a == "a"])
    assert got["a"]["high"] - got["a"]["low"] == pytest.approx(3.92 * v.std() / np.sqrt(700), rel=0.25)
    assert resampling.resampled(df.limit(0), ["g"], "v", "i").count() == 0
    assert resampling.resampled(df.where("g = 'a'"), [], "v", "i", block=block, chunk=64).first()["low"] == pytest.approx(got["a"]["low"], abs=1e-12)


def test_null_law_of_hits():
    structures = {(4, 1, 1): 1, (3, 4, 2): 1, (0, 49, 5): 1, (2, 6, 3): 1}
    law = [(0.0, 1.0)]
    for s in structures:
        law = [(v + a + s[2] * t / s[1], p * q) for v, p in law for (a, t), q in nulls.hits_law(*s).items()]
    for total in (0, 0.5, 1, 25 / 49 + 1.5, 3, 4.2, 9, 30):
        p, exact = nulls.upper_tail(structures, total)
        assert exact and p == pytest.approx(sum(q for v, q in law if v >= total - 1e-9), abs=1e-12)
    # One draw's law by all draws of three of seven: the same formula on a smaller pool is a count of subsets.
    assert sum(nulls.hits_law(3, 4, 2).values()) == pytest.approx(1)
    assert nulls.hits_law(4, 1, 1)[4, 1] == pytest.approx(1 / comb(49, 5))
    # A coarser grid is near.
    many = {(4, 1, 1): 900, (4, 2, 1): 80, (3, 3, 2): 15, (2, 7, 3): 5, (1, 11, 4): 7, (0, 13, 5): 3, (3, 17, 2): 2, (2, 19, 3): 2}
    fine, coarse = nulls.upper_tail(many, 535.0), None
    cells, nulls.CELLS = nulls.CELLS, 1 << 16
    try:
        coarse = nulls.upper_tail(many, 535.0)
    finally:
        nulls.CELLS = cells
    assert not coarse[1] and coarse[0] == pytest.approx(fine[0], abs=2e-3)


def test_cell_counts_follow_the_law():
    """Few draws of 2 of 4 cells: every outcome as often as by enumeration; many: moments of 5 of 49."""
    got = uniformity.cell_counts(np.random.default_rng(5), 2, 4, 2, 40_000)
    pairs = list(itertools.combinations(range(4), 2))
    want: dict[tuple, float] = {}
    for a in pairs:
        for b in pairs:
            key = tuple((i in a) + (i in b) for i in range(4))
            want[key] = want.get(key, 0) + 1 / 36
    seen, n = np.unique(got, axis=0, return_counts=True)
    assert {tuple(s) for s in seen.tolist()} == set(want)
    for s, c in zip(seen.tolist(), n):
        assert c / 40_000 == pytest.approx(want[tuple(s)], abs=0.01)
    big = uniformity.cell_counts(np.random.default_rng(1), 1000, 49, 5, 3000)
    assert (big.sum(axis=1) == 5000).all()
    assert big.var(axis=0).mean() == pytest.approx(1000 * 5 / 49 * 44 / 49, rel=0.05)


def test_uniformity(spark):
    for query, cells, drawn in ((uniformity.main_uniformity, 49, 5), (uniformity.chance_uniformity, 10, 1)):
        r = query(spark, SF, replicates=1000).first()
        n, e = r["n"], r["n"] * drawn / cells
        sample = np.array([np.bincount(np.argsort(np.random.default_rng(i).random((n, cells)), axis=1)[:, :drawn].ravel(), minlength=cells) for i in range(300)])
        rate = (((sample - e) ** 2).sum(1) / e >= r["chi_square"]).mean()
        assert r["p_value"] == pytest.approx(rate, abs=0.11)


def test_nested_report(spark):
    """Its means are those of the nested backtest that is tested by itself, and the verdict follows from its columns."""
    few = dict(min_train=200, outer=2)
    models = ("bayesian", "rolling_bayesian", "logistic", "gradient_boosting", "ridge_ranker", "rolling_ridge_ranker")
    rows = {r["model"]: r for r in nested.nested_report(spark, SF, models=models, trees=2, replicates=200, **few).collect()}
    folds: dict[str, list] = {}
    for r in plain_nested(spark, SF, **few).collect():
        folds.setdefault(r["model"], []).append(r)
    for model, own in folds.items():
        r, n = rows[model], sum(f["n"] for f in own)
        mean = lambda c: sum(f["n"] * f[c] for f in own) / n  # noqa: E731, B023
        assert r["test_draws"] == n and r["parameters"].startswith(sorted(own, key=lambda f: f["fold"])[0]["parameters"].removeprefix("window=0 ").split(" blend")[0]), model
        assert (r["brier_delta"], r["top5_uplift"]) == pytest.approx((mean("brier_delta"), mean("hits_uplift")), abs=3e-9), model
    for r in rows.values():
        assert r["delta_low"] <= r["delta_high"] and r["uplift_low"] <= r["uplift_high"]
        assert r["adjusted_p"] >= r["p_value"] and r["adjusted_top5_p"] >= r["top5_p"]
        assert r["qualified"] == ((r["delta_high"] < 0 and r["adjusted_p"] < 0.05) or (r["uplift_low"] > 0 and r["adjusted_top5_p"] < 0.05))


def test_next_draw(spark):
    out = nested.next_draw(spark, SF, models=("bayesian", "rolling_bayesian"), min_train=200, outer=2, replicates=100, force=True).first()
    assert out["probability_sum"] == pytest.approx(5) if out["status"] != "abstention" else out["numbers"] is None
    if out["numbers"]:
        assert len(set(out["numbers"])) == 5 and set(out["certain"]) <= set(out["numbers"])
    still = nested.next_draw(spark, SF, models=("bayesian",), min_train=200, outer=2, replicates=100).first()
    assert still["status"] in ("abstention", "qualified")


def test_columns_resampled_together(spark):
    """Each column as by itself; a chunk's weights are drawn once for all columns."""
    rng = np.random.default_rng(6)
    rows = [(g, i, float(v), float(w)) for g, n in (("a", 300), ("b", 5)) for i, (v, w) in enumerate(rng.normal(0, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "g string, i long, v double, w double")
    got = {(r["g"], r["value"]): r for r in resampling.together(df, ["g"], ["v", "w"], "i", block=12, chunk=64).collect()}
    assert len(got) == 4
    for c in "vw":
        for r in resampling.resampled(df, ["g"], c, "i", block=12, chunk=64).collect():
            assert tuple(got[r["g"], c])[2:] == pytest.approx(tuple(r)[1:], abs=1e-12)


def test_weights_are_places_among_the_ends():
    ends = resampling.poisson_ends(1 / 12)
    bits = np.array([[0, 1, 2**32 - 1, *ends, *(e - 1 for e in ends), *(min(e + 1, 2**32 - 1) for e in ends)]], dtype=np.uint32)
    assert (resampling._weights(bits, ends) == np.searchsorted(np.array(ends, dtype=np.uint64), bits.astype(np.uint64), side="right")).all()

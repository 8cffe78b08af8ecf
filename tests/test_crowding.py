"""Models of crowding, their inference and their ledger against NumPy on the collected observations."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.operators import chance_crowding, crowding, crowding_ledger
from urnspark.plans import lift
from urnspark.plans.staging import folder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    x = crowding.observations(spark, SF).toPandas().sort_values(["draw_date", "draw_id"]).reset_index(drop=True)
    x["day"] = [crowding.day_of(d) for d in x["draw_date"]]
    return x


def plain(x: np.ndarray, y: np.ndarray, e: np.ndarray, alpha: float):
    """Intercept and raw coefficients of a penalised Poisson model, by Newton's method on standardised features."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    keep = np.r_[0, np.ones(x.shape[1])] * alpha * e.sum()
    b = np.r_[np.log(y.sum() / e.sum()), np.zeros(x.shape[1])]
    for _ in range(60):
        mu = e * np.exp(z @ b)
        b = b - np.linalg.solve((z * mu[:, None]).T @ z + np.diag(keep), z.T @ (mu - y) + keep * b)
    return np.r_[b[0] - (b[1:] / sd) @ mean, b[1:] / sd]


def shape(m) -> list[float]:
    """The six features of one ticket, from their description."""
    m = sorted(m)
    return [sum(n > 31 for n in m), float(max(m) <= 31), sum(b - a == 1 for a, b in zip(m, m[1:])), sum(n in (7, 13) for n in m), sum(m) / 150, abs(sum(m) - 125) / 100]


def test_features():
    mains = np.array([[7, 8, 13, 40, 41], [1, 2, 3, 30, 31]])
    base = np.array([shape(m) for m in mains])
    assert crowding.features(mains, "base") == pytest.approx(base)
    high, adjacent, total = base[:, 0], base[:, 2], base[:, 4]
    assert crowding.features(mains, "interactions") == pytest.approx(np.c_[base, high * total, adjacent * total, high**2, adjacent**2, total**2])
    effects = crowding.features(mains, "number_effects")
    assert [np.flatnonzero(r[6:] == 1).tolist() for r in effects] == [[6, 7, 12, 39, 40], [0, 1, 2, 29, 30]]
    with pytest.raises(ValueError):
        crowding.features(mains, "other")


def test_fits_of_all_sets_and_cuts(spark, rows):
    data = crowding.blocks(crowding.observations(spark, SF))
    cut = int(np.median(rows["day"]))
    asked = [((t, kind, c), a) for t in crowding.TARGETS for kind in crowding.SETS for c, a in ((cut, 0.001), (1 << 40, 1.0))]
    for ((target, kind, before), alpha), got in zip(asked, crowding.fit(data, asked)):
        part = rows[(rows["day"] < before) & rows[f"y_{target}"].notna()]
        x = crowding.features(np.array(part["numbers"].tolist()), kind)
        want = plain(x, part[f"y_{target}"].to_numpy(), part[f"e_{target}"].to_numpy(), alpha)
        assert got.beta == pytest.approx(want, abs=1e-6)
        assert got.baseline == pytest.approx(part[f"y_{target}"].sum() / part[f"e_{target}"].sum())
    assert crowding.fit(data, [(("jackpot", "base", 0), 1.0)]) == [None]


def test_report(spark, rows):
    got = {(r["target"], r["feature_set"]): r for r in crowding.report(spark, SF, sets=("base", "interactions")).collect()}
    assert len(got) == 4
    for (target, kind), r in got.items():
        x = rows[rows[f"y_{target}"].notna()]
        days = np.array(sorted(set(x["day"].iloc[500:])))
        own, flat = [], []
        z, y, e = crowding.features(np.array(x["numbers"].tolist()), kind), x[f"y_{target}"].to_numpy(), x[f"e_{target}"].to_numpy()
        loss = lambda y, mu: 2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0) - (y - mu))
        for k, run in enumerate(np.array_split(days, 3)):
            train, test = (x["day"] < run[0]).to_numpy(), x["day"].isin(run).to_numpy()
            seen = np.array(sorted(set(x["day"][train])))
            split = seen[max(1, int(len(seen) * 0.8))]
            inner = (x["day"] < split).to_numpy()
            late = train & ~inner
            tried = []
            for a in crowding.ALPHAS:
                b = plain(z[inner], y[inner], e[inner], a)
                tried.append((loss(y[late], e[late] * np.exp(b[0] + z[late] @ b[1:])).mean(), a))
            assert r["alphas"][k] == min(tried)[1]
            b = plain(z[train], y[train], e[train], r["alphas"][k])
            own += loss(y[test], e[test] * np.exp(b[0] + z[test] @ b[1:])).tolist()
            flat += loss(y[test], e[test] * y[train].sum() / e[train].sum()).tolist()
        assert (r["observations"], r["test_observations"]) == (len(x), len(own))
        assert (r["deviance"], r["baseline_deviance"]) == pytest.approx((np.mean(own), np.mean(flat)), abs=1e-7)
        assert r["delta"] == pytest.approx(np.mean(own) - np.mean(flat), abs=1e-7)
        assert r["low"] < r["delta"] < r["high"] and r["adjusted_p"] == pytest.approx(min(1, 6 * r["p_value"]), abs=1e-8)
        assert r["qualified"] == (r["high"] < 0 and r["adjusted_p"] < 0.05)


def test_report_without_enough(spark):
    assert crowding.report(spark, SF, game="none").collect() == []
    with pytest.raises(ValueError):
        crowding.report(spark, SF, min_train=99)


def test_chance_report(spark):
    """Final prior and factors as the whole-history query has them; halves and folds from the collected rows."""
    got = {r["game"]: r for r in chance_crowding.report(spark, SF).collect()}
    obs = chance_crowding.observations(spark, SF, min_train=500, folds=3).toPandas()
    by_fold = {(r["game"], r["fold"]): r for r in chance_crowding.chance_popularity_folds(spark, SF).collect()}
    assert set(got) == {"loto", "super_loto", "grand_loto"}
    for game, r in got.items():
        x = obs[obs["game"] == game].sort_values("i")
        assert x["i"].tolist() == list(range(len(x))) and r["observations"] == len(x)
        share = lambda p: [(p[p["chance"] == c]["s"].sum() + r["final_prior"] / 10) / (p[p["chance"] == c]["t"].sum() + r["final_prior"]) / 0.1 for c in range(1, 11)]  # noqa: E731, B023
        half = len(x) // 2
        assert r["factors"] == pytest.approx(share(x), abs=1e-8)
        assert r["first_half"] == pytest.approx(share(x.iloc[:half]), abs=1e-8)
        assert r["last_half"] == pytest.approx(share(x.iloc[half:]), abs=1e-8)
        assert r["priors"] == [by_fold[game, k]["prior"] for k in (1, 2, 3)]
        n = [by_fold[game, k]["n"] for k in (1, 2, 3)]
        assert r["test_observations"] == sum(n)
        assert r["delta"] == pytest.approx(np.average([by_fold[game, k]["delta"] for k in (1, 2, 3)], weights=n), abs=1e-7)
        assert r["low"] < r["delta"] < r["high"]


@pytest.fixture(scope="module")
def ledger(spark):
    path = folder(spark, "ledger")
    crowding_ledger.record(spark, path, crowding_ledger.proposals(spark, SF))
    left = crowding_ledger.score_pending(spark, path, crowding_ledger.results(spark, SF), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return path, left.toPandas()


def test_ledger(spark, rows, ledger):
    path, left = ledger
    made, told = crowding_ledger.forecasts(spark, path).toPandas(), crowding_ledger.scores(spark, path).toPandas()
    assert len(made) == len(told) + len(left) and set(left["reason"]) == {"incomplete"}
    one = made.groupby("cohort").first()
    for year, m in one.iterrows():
        x = rows[(rows["draw_date"] < date(year, 1, 1)) & rows["y_main_combination"].notna()]
        assert len(x) >= 500 and m["training_last_date"] == x["draw_date"].max()
        assert m["baseline"] == pytest.approx(x["y_main_combination"].sum() / x["e_main_combination"].sum())
    for _, r in told.sample(200, random_state=1).iterrows():
        x, m = rows[rows["draw_id"] == r["draw_id"]].iloc[0], one.loc[r["cohort"]]
        mu = x["e_main_combination"] * np.exp(m["beta"][0] + np.dot(shape(x["numbers"]), m["beta"][1:]))
        y = x["y_main_combination"]
        assert (r["winners"], r["expected"]) == pytest.approx((y, mu), rel=1e-9)
        assert r["deviance"] == pytest.approx(2 * ((y * np.log(y / mu) if y else 0) - (y - mu)), abs=1e-9)
    assert crowding_ledger.verify(spark, path).collect() == []
    got = crowding_ledger.cohorts(spark, path).toPandas().set_index("cohort")
    assert got["cohort_index"].sort_index().tolist() == list(range(1, len(got) + 1))
    for year, r in got.iterrows():
        first = told[told["cohort"] == year].sort_values("target_date").head(100)
        assert r["qualification_scores"] == len(first) and (r["status"] == "insufficient_data") == (len(first) < 100)
        assert r["delta"] == pytest.approx((first["deviance"] - first["baseline_deviance"]).mean(), abs=1e-8)
        assert r["alpha"] == pytest.approx(0.05 / (r["cohort_index"] * (r["cohort_index"] + 1)))


def test_ledger_keeps_and_refuses(spark, ledger):
    """Again: nothing new. Late, unfinished, clashing or untrained models don't enter; a changed record is found."""
    path, _ = ledger
    assert crowding_ledger.record(spark, path, crowding_ledger.proposals(spark, SF)).count() == 0
    before = crowding_ledger.scores(spark, path).count()
    crowding_ledger.score_pending(spark, path, crowding_ledger.results(spark, SF), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    assert crowding_ledger.scores(spark, path).count() == before
    own = folder(spark, "ledger")
    schema = "game string, target_date date, cohort int, target string, feature_set string, beta array<double>, baseline double, training_last_date date, recorded_at timestamp"
    good = ["loto", date(1995, 3, 1), 1, "jackpot", "base", [0.0] * 7, 1.0, date(1995, 2, 1)]
    put = lambda **k: tuple({**dict(zip(("game", "target_date", "cohort", "target", "feature_set", "beta", "baseline", "last"), good)), **k}.values())
    new = [
        put(), put(cohort=2, beta=[0.0] * 6), put(cohort=3, beta=[0.0] * 6 + [float("nan")]), put(cohort=4, baseline=0.0), put(cohort=5, target="other"), put(cohort=6, last=date(1995, 3, 1)), put(cohort=7, beta=None),
        put(cohort=8, feature_set="number_effects", beta=[0.0] * 56), put(cohort=9, feature_set=None),
    ]
    made = spark.createDataFrame([(*r, None) for r in new], schema)
    assert crowding_ledger.record(spark, own, made.withColumn("recorded_at", F.lit("1995-03-02 00:00:00").cast("timestamp"))).count() == 0
    kept = crowding_ledger.record(spark, own, made.withColumn("recorded_at", F.lit("1995-03-01 08:00:00").cast("timestamp")))
    assert sorted(r["cohort"] for r in kept.collect()) == [1, 8]
    draws = spark.createDataFrame([("loto", date(1995, 3, 1), 5, [1, 2, 3, 4, 5], 2, None, 1000)], "game string, draw_date date, draw_id bigint, drawn array<bigint>, w1 bigint, w2 bigint, w9 bigint")
    late, early = (F.lit(t).cast("timestamp") for t in ("1995-03-02 00:00:00", "1995-03-01 08:00:00"))
    assert {r["reason"] for r in crowding_ledger.score_pending(spark, own, draws.limit(0), late).collect()} == {"absent"}
    assert {r["reason"] for r in crowding_ledger.score_pending(spark, own, draws, early).collect()} == {"open"}
    assert crowding_ledger.score_pending(spark, own, draws, late).collect() == []
    got = crowding_ledger.scores(spark, own).collect()
    assert [r["winners"] for r in got] == [2.0, 2.0] and {r["expected"] for r in got} == {got[0]["exposure"]}
    assert crowding_ledger.verify(spark, own).collect() == []
    other = folder(spark, "ledger")
    crowding_ledger.forecasts(spark, own).withColumn("baseline", F.lit(2.0)).write.parquet(f"{other}/crowding-forecasts")
    crowding_ledger.scores(spark, own).write.parquet(f"{other}/crowding-scores")
    assert {(r["kind"], r["problem"]) for r in crowding_ledger.verify(spark, other).collect()} == {("forecast", "columns"), ("score", "value")}


def test_no_draws(spark):
    """Without draws there are no rows, and nothing to freeze."""
    none = lift.only(spark, SF, game="none")
    assert chance_crowding.report(spark, none).collect() == []
    assert chance_crowding.chance_popularity_folds(spark, none).collect() == []
    assert crowding.report(spark, none).collect() == []
    assert crowding_ledger.proposals(spark, none).collect() == []
    path = folder(spark, "ledger")
    assert crowding_ledger.cohorts(spark, path).collect() == [] and crowding_ledger.verify(spark, path).collect() == []


def test_multiplier_of_each_set(spark):
    """The column form against the matrix form, coefficients at random."""
    rng = np.random.default_rng(3)
    mains = np.array([sorted(rng.choice(49, 5, replace=False) + 1) for _ in range(50)])
    for kind, size in crowding_ledger.SIZES.items():
        beta = rng.normal(0, 0.3, size)
        df = spark.createDataFrame([(i, m.tolist(), kind, beta.tolist()) for i, m in enumerate(mains)], "i int, m array<bigint>, kind string, beta array<double>")
        got = [r["x"] for r in df.select("i", crowding_ledger.multiplier(F.col("m"), F.col("kind"), F.col("beta")).alias("x")).orderBy("i").collect()]
        assert got == pytest.approx(np.exp(beta[0] + crowding.features(mains, kind) @ beta[1:]))

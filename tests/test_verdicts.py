"""The chance number's verdict and the ledger's intervals against direct programs."""

from __future__ import annotations

import itertools
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.functions.nulls import summed_tail
from urnspark.operators import chance, ledger, resampling
from urnspark.plans import lift

SF = "/root/testdata/sf0.001"


def test_summed_tail_with_ties():
    laws = [({0.0: 1 - t / 10, 1 / t: t / 10}, t, n) for t, n in ((1, 3), (2, 2), (3, 1))]
    each = [law for law, _, n in laws for _ in range(n)]
    sums = [(sum(v for v, _ in pick), np.prod([p for _, p in pick])) for pick in itertools.product(*(list(law.items()) for law in each))]
    for total in (0.0, 0.3, 1.0, 1.5, 2 + 1 / 3, 9.0):
        p, exact = summed_tail(laws, total)
        assert exact and p == pytest.approx(sum(q for v, q in sums if v >= total - 1e-9), abs=1e-12)


def test_chance_report(spark):
    """Means are those of the backtest's folds; intervals hold them; the verdict follows."""
    few = dict(min_train=40, outer=2)
    folds = chance.backtest(spark, SF, **few).collect()
    got = {r["game"]: r for r in chance.report(spark, SF, replicates=200, **few).collect()}
    assert set(got) == {f["game"] for f in folds} and got
    for game, r in got.items():
        own = [f for f in folds if f["game"] == game]
        n = sum(f["n"] for f in own)
        mean = lambda c: sum(f["n"] * f[c] for f in own) / n  # noqa: B023, E731
        assert r["n"] == n
        assert (r["brier_delta"], r["log_loss_delta"], r["top1_uplift"]) == pytest.approx((mean("brier_delta"), mean("log_loss_delta"), mean("top1_uplift")), abs=3e-9)
        assert r["delta_low"] <= r["delta_high"] and r["adjusted_p"] >= r["p_value"] and r["adjusted_top1_p"] >= r["top1_p"]
        assert (r["qualification"] in ("probability", "probability_and_ranking")) == (r["delta_high"] < 0 and r["adjusted_p"] < 0.05)


def test_intervals(spark, tmp_path):
    """A cohort of 110 scores, of which a hundred count, and one of too few."""
    path = str(tmp_path / "ledger")
    days = [r["draw_date"] for r in lift.table(spark, SF, "days").orderBy("draw_date").limit(130).collect()]
    made = [("loto", d, 1 if i < 110 else 2, [1, 2, 3, 4, 5], 1, d - timedelta(days=1)) for i, d in enumerate(days)]
    rows = spark.createDataFrame(made, "game string, target_date date, cohort int, main array<bigint>, chance bigint, training_last_date date")
    ledger.record(spark, path, rows.withColumn("recorded_at", F.to_timestamp(F.concat(F.col("target_date").cast("string"), F.lit(" 08:00:00")))))
    rng = np.random.default_rng(6)
    drawn = [(i, d, "loto", [int(x) + 1 for x in sorted(rng.choice(49, 5, replace=False))], 1) for i, d in enumerate(days)]
    ledger.score_pending(spark, path, spark.createDataFrame(drawn, "draw_id bigint, draw_date date, game string, numbers array<bigint>, chance bigint"), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    got = ledger.intervals(spark, path, replicates=500).collect()
    assert len(got) == 1 and got[0]["cohort_index"] == 1 and got[0]["scores"] == 100
    v = np.array([len({1, 2, 3, 4, 5} & set(r[3])) for r in drawn[:100]]) - 25 / 49
    w = np.searchsorted(np.array(resampling.poisson_ends(1.0), dtype=np.uint64), resampling.bits32(np.arange(500), np.arange(100), 1), side="right")
    want = np.quantile((w @ v) / w.sum(axis=1), (0.025, 0.975))
    assert (got[0]["uplift"], got[0]["low"], got[0]["high"]) == pytest.approx((v.mean(), *want), abs=2e-9)
    assert got[0]["status"] == ("qualified" if want[0] > 0 and got[0]["p_value"] < got[0]["alpha"] else "not_qualified")

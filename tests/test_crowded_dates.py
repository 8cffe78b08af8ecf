"""Sources whose first date alone has more draws than a fold needs before it."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urnspark.operators import chance_crowding, learners, models, participation, value_backtest
from urnspark.plans.staging import folder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def crowded(spark):
    """The draws of sf0.01, the earlier half of them on one date."""
    path, orders = folder(spark, "crowded"), spark.read.parquet(f"{SF}/orders.parquet")
    (day,) = orders.select(F.to_date("o_orderdate").alias("d")).agg(F.percentile_approx("d", 0.5)).first()
    orders.withColumn("o_orderdate", F.greatest("o_orderdate", F.lit(day).cast("timestamp"))).write.parquet(f"{path}/orders.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_value_backtest(spark, crowded):
    """Refits begin as soon as two dates lie before, one to train on and one to test."""
    rows = {r["period"]: r for r in value_backtest.value_backtest(spark, crowded, folds=2, samples=100, interval=300, models=("ridge",)).collect()}
    seen = participation.participation(spark, crowded)
    days = sorted(r[0] for r in seen.select("draw_date").distinct().collect())
    assert rows[1]["first_test_date"] >= str(days[2]) > rows[1]["training_last_date"] >= str(days[1])
    assert sum(r["observations"] for p, r in rows.items() if p) == rows[0]["observations"] > 500


def test_participation_backtest(spark, crowded):
    """All dates but the first are tested; the first fold learns from the first date."""
    got = models.participation_backtest(spark, crowded).toPandas().set_index("draw_id")
    rows = models.participation(spark, crowded).toPandas()
    days = np.unique(rows["draw_date"])
    assert set(got.index) == set(rows[rows["draw_date"] > days[0]]["draw_id"]) and set(got["fold"]) == {1, 2, 3}
    train, test = rows[rows["draw_date"] == days[0]], rows[rows["draw_date"] == days[1]]
    x, y = train[list(models.FEATURES)].to_numpy(float), train["y"].to_numpy()
    b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean()))
    assert got.loc[test["draw_id"], "predicted"].to_numpy() == pytest.approx(y.mean() + (test[list(models.FEATURES)].to_numpy(float) - x.mean(0)) @ b, abs=2e-6)
    assert (got[got["fold"] == 1]["smearing"] == 1).all()
    assert [r["n"] for r in models.participation_summary(spark, crowded).orderBy("fold").collect()] == got.groupby("fold").size().tolist()


def test_evaluate(spark, crowded):
    """The report and the forecaster come of the same folds."""
    rows, forecaster = participation.evaluate(spark, crowded, models=("ridge",), replicates=100)
    assert rows[0]["folds"] == 3 and rows[0]["smearing"][0] == 1 and forecaster.observations == rows[0]["observations"]


def test_chance_popularity_folds(spark, crowded):
    """Equals its SQL, which leaves a fold without a date before it out."""
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowded.removeprefix('file://')}/{t}.parquet/*.parquet'")
    want = db.execute(chance_crowding.ORACLE_SQL["chance_popularity_folds"]).fetchall()
    got = [tuple(r) for r in chance_crowding.chance_popularity_folds(spark, crowded).collect()]
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in want) and got
    assert [r[4:] for r in sorted(got)] == [pytest.approx(r[4:], abs=2e-9) for r in sorted(want)]


def test_equal_bins_are_one(spark):
    """Boosted values grow the same trees from observations and from their sums."""
    rng = np.random.default_rng(3)
    made = [(d, "loto", float(rng.integers(0, 12)), float(rng.integers(0, 5))) for d in pd.date_range("2000-01-01", periods=40).date for _ in range(20)]
    rows = [(*r, r[2] * 0.3 - r[3] * r[3] * 0.1 + float(rng.normal(0, 0.1))) for r in made]
    df = spark.createDataFrame(rows, "draw_date date, game string, a double, b double, y double").repartition(3)
    blocks, first = learners.observed(df, ("a", "b"), "y"), learners.day_of(rows[-1][0])
    edges = [np.arange(0.5, 11), np.arange(0.5, 4)]
    merged = learners._merged(blocks, edges).collect()
    days = sum(len(r["days"]) // 4 for r in merged)
    assert days == len({(r[0], r[2], r[3]) for r in rows}) < len(rows)
    assert sum(np.frombuffer(r["n"]).sum() for r in merged) == len(rows)
    (model,) = learners.fit_boosted(df.withColumn("n", F.lit(1)), ("a", "b"), [learners.Boosted(first, 0.3, 7, 1.0, value=True)], trees=20, data=blocks)
    x = np.array([r[2:4] for r in rows])[:, None, :]
    y = np.array([r[4] for r in rows])
    error = model.predict(np.zeros(len(x), dtype=int), x)[:, 0] - y
    assert np.sqrt((error**2).mean()) < 0.15 < y.std()

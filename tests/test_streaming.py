from __future__ import annotations

import datetime

from urnspark.streaming import scorer


def test_scores_once_and_goes_on(spark, tmp_path):
    schema = "result_id bigint, observed_at timestamp, outcome int"
    at = datetime.datetime(2024, 1, 1)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    forecasts = spark.createDataFrame([(1, 0.25), (2, 0.5)], "forecast_id bigint, forecast double")
    run = lambda: scorer.drain(scorer.score_results(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), forecasts), str(tmp_path / "out"))
    put([(1, at, 1), (1, at, 1), (9, at, 1), (None, at, 0)])
    assert [(r["forecast_id"], r["brier"]) for r in run().collect()] == [(1, 0.5625)]
    put([(1, at, 1), (2, at, 0)])
    assert sorted((r["forecast_id"], r["brier"]) for r in run().collect()) == [(1, 0.5625), (2, 0.25)]

"""A small ledger: what is recorded, when it is scored, and what verification finds."""

from __future__ import annotations

import datetime
from math import comb

import pytest
from pyspark.sql import functions as F

from urnspark.operators import ledger

DAY = datetime.date(2024, 1, 1)
SCHEMA = "game string, target_date date, cohort int, main array<bigint>, chance bigint, training_last_date date, recorded_at timestamp"


def test_ledger(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    day = lambda i: DAY + datetime.timedelta(days=i)
    at = lambda i, hour: datetime.datetime.combine(day(i), datetime.time(hour), datetime.timezone.utc)
    good = [("loto", day(i), 2024, [5, 4, 3, 2, 1], 1, day(i - 1), at(i, 8)) for i in range(1, 4)]
    bad = [("loto", day(9), 2024, [1, 2, 3, 4, 4], 1, day(8), at(9, 8)), ("loto", day(9), 2024, [1, 2, 3, 4, 5], 1, day(9), at(9, 8)), ("loto", day(9), 2024, [1, 2, 3, 4, 5], 1, day(8), at(9, 23)), ("loto", day(9), 2024, [1, 2, 3, 4, 50], 1, day(8), at(9, 8))]
    assert ledger.record(spark, path, spark.createDataFrame(good[:2] + bad, SCHEMA)).count() == 2
    assert ledger.record(spark, path, spark.createDataFrame(good, SCHEMA)).count() == 1  # the others are there
    later = [("loto", day(5), 2025, [6, 7, 8, 9, 10], 2, day(4), at(5, 8))]
    assert ledger.record(spark, path, spark.createDataFrame(later, SCHEMA)).first()["cohort_index"] == 2
    draws = spark.createDataFrame([("loto", day(1), 1, [1, 2, 3, 40, 41], 1), ("loto", day(1), 2, [1, 2, 9, 40, 41], 1), ("loto", day(5), 3, [1, 2, 3, 4, 5], 1)], "game string, draw_date date, draw_id bigint, numbers array<bigint>, chance bigint")
    now = F.lit("2024-01-05 12:00:00").cast("timestamp")
    left = {(r["target_date"], r["reason"]) for r in ledger.score_pending(spark, path, draws, now).collect()}
    assert left == {(day(2), "absent"), (day(3), "absent"), (day(5), "open")}
    assert [(r["main_hits"], r["chance_hit"]) for r in ledger.scores(spark, path).collect()] == [(2, 1)]
    ledger.score_pending(spark, path, draws, F.lit("2024-02-01 12:00:00").cast("timestamp"))
    assert ledger.scores(spark, path).count() == 2 and ledger.verify(spark, path).count() == 0
    got = {r["cohort_index"]: (r["forecasts"], r["scores"], r["status"]) for r in ledger.cohorts(spark, path).collect()}
    assert got == {1: (3, 1, "insufficient_data"), 2: (1, 1, "insufficient_data")}
    # A copy with one forecast changed and one with a score taken away.
    other = f"file://{tmp_path}/other"
    ledger.forecasts(spark, path).withColumn("record", F.when(F.col("position") == 1, F.lit("{}")).otherwise(F.col("record"))).write.parquet(f"{other}/forecasts")
    ledger.scores(spark, path).where("position > 0").write.parquet(f"{other}/scores")
    assert sorted((r["kind"], r["problem"]) for r in ledger.verify(spark, other).collect()) == [("forecast", "hash"), ("score", "link")]


def test_exact_tail():
    tail = ledger.exact_tail(2)
    one = [comb(5, k) * comb(44, 5 - k) / comb(49, 5) for k in range(6)]
    assert tail[0] == pytest.approx(1) and tail[9] == pytest.approx(2 * one[4] * one[5] + one[5] ** 2)


def test_a_cohort_is_judged_on_its_first_hundred(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    day = lambda i: DAY + datetime.timedelta(days=i)
    rows = [("loto", day(i), 1, [1, 2, 3, 4, 5], 1, day(i - 1), datetime.datetime.combine(day(i), datetime.time(8), datetime.timezone.utc)) for i in range(1, 121)]
    ledger.record(spark, path, spark.createDataFrame(rows, SCHEMA))
    draws = spark.createDataFrame([("loto", day(i), i, [1, 2, 3, 4, 5] if i <= 100 else [11, 12, 13, 14, 15], 1) for i in range(1, 121)], "game string, draw_date date, draw_id bigint, numbers array<bigint>, chance bigint")
    ledger.score_pending(spark, path, draws, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    r = ledger.cohorts(spark, path).first()
    assert (r["scores"], r["hits"], r["status"]) == (120, 500, "qualified")

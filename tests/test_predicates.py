from __future__ import annotations

import datetime
import math

from pyspark.sql import functions as F

from urnspark.functions import predicates as p


def test_versions_hashes_hosts(spark):
    rows = [("0.9", "a" * 64, "https://example.org/x"), ("0.12.3", "G" * 64, "https://www.example.org"), ("0", "a" * 63, "http://example.org"), ("1.0", None, "https://badexample.org"), ("x.1", "a" * 64 + "\n", None), (None, "", "nonsense")]
    got = spark.createDataFrame(rows, "v string, h string, u string").select(p.version_at_least(F.col("v"), 0, 12), p.is_sha256(F.col("h")), p.from_host(F.col("u"), "example.org")).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, False, True), (False, False, False), (True, False, False), (False, False, False), (False, False, False)]


def test_recording_closes_at_the_cutoff_of_the_place(spark):
    utc = datetime.timezone.utc
    day = datetime.date(2024, 7, 1)  # summer: two hours ahead
    times = [datetime.datetime(2024, 7, 1, 18, 14, 59, tzinfo=utc), datetime.datetime(2024, 7, 1, 18, 15, tzinfo=utc), datetime.datetime(2024, 6, 30, 23, 0, tzinfo=utc), datetime.datetime(2024, 7, 2, 0, 0, tzinfo=utc)]
    got = spark.createDataFrame([(day, t) for t in times], "d date, t timestamp").select(p.recording_open(F.col("d"), F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, False]


def test_numbers(spark):
    pairs = [(1.0, 1.0 + 1e-13), (1.0, 1.0 + 1e-11), (0.0, 1e-13), (1e20, 1e20 * (1 + 1e-13)), (float("inf"), float("inf"))]
    got = spark.createDataFrame(pairs, "a double, b double").select("a", "b", p.same_number(F.col("a"), F.col("b"))).collect()
    assert [r[2] for r in got] == [math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for a, b in pairs]
    r = spark.range(1).select(p.share_factor(F.lit(0.0)), p.share_factor(F.lit(1e-9)), p.nearest_quantile(F.array(*map(F.lit, range(6))), 0.5), p.nearest_quantile(F.array(*map(F.lit, range(4))), 0.5)).first()
    assert r[0] == 1.0 and abs(r[1] - (1 - 5e-10)) < 1e-15 and (r[2], r[3]) == (2, 2)

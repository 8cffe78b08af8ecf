"""Tails against sums of exact terms and the error function."""

from __future__ import annotations

from fractions import Fraction
from math import comb, erfc, sqrt

import pytest
from pyspark.sql import functions as F

from urnspark.functions import tails


def test_binomial(spark):
    rows = [(n, k) for n in (1, 7, 60, 500) for k in sorted({0, 1, n // 12, n // 10, n // 3, n - 1, n})]
    df = spark.createDataFrame(rows, "n bigint, k bigint")
    p = Fraction(1, 10)
    for r in df.select("n", "k", tails.binomial_lower(F.col("n"), F.col("k"), 0.1).alias("lower"), tails.binomial_upper(F.col("n"), F.col("k"), 0.1).alias("upper")).collect():
        term = [comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["n"] + 1)]
        assert r["lower"] == pytest.approx(float(sum(term[: r["k"] + 1])), rel=1e-9, abs=1e-300)
        assert r["upper"] == pytest.approx(float(sum(term[r["k"] :])), rel=1e-9, abs=1e-300)


def test_normal(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.3, -1.0, 1.96, 4.5, 7.5, -20.0)], "z double")
    for r in df.select("z", tails.normal_two_sided(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(erfc(abs(r["z"]) / sqrt(2)), abs=1e-13)

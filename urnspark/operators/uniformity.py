"""Monte Carlo tests of uniform draws, on counts of cells instead of draws."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnspark.functions.probability import CHANCES, DRAWN, POOL
from urnspark.plans import lift

#: Replicates of a row: each row has a generator of its own, so any task can draw it again.
ROW = 250


def share(cells: int, left: int, k: int) -> np.ndarray:
    """Of k different cells out of so many, how many fall into the left ones: the chance of 0 to k."""
    return np.array([comb(left, j) * comb(cells - left, k - j) / comb(cells, k) for j in range(k + 1)])


def cell_counts(rng: np.random.Generator, n: int, cells: int, drawn: int, size: int) -> np.ndarray:
    """(size, cells): how often each cell comes in n draws of so many different cells, by the exact law.

    The cells form a binary tree. A node knows how many draws have 0, 1, ... of their cells in it; at a split, draws with
    k there fall apart by the hypergeometric law, all of one k by one multinomial. A leaf's draws with 1 are its count.
    So the work depends on the cells and not on n.
    """
    top = np.zeros((size, drawn + 1), dtype=np.int64)
    top[:, drawn] = n
    out = np.empty((size, cells), dtype=np.int64)
    todo = [(0, cells, top)]
    while todo:
        first, width, held = todo.pop()
        if width == 1:
            out[:, first] = held[:, 1] if held.shape[1] > 1 else 0
            continue
        left = width // 2
        sides = [np.zeros((size, min(drawn, w) + 1), dtype=np.int64) for w in (left, width - left)]
        for k in range(held.shape[1]):
            if held[:, k].any():
                p = share(width, left, k)
                split = rng.multinomial(held[:, k], p / p.sum())
                for j in np.flatnonzero(p):
                    sides[0][:, j] += split[:, j]
                    sides[1][:, k - j] += split[:, j]
        todo += [(first, left, sides[0]), (first + left, width - left, sides[1])]
    return out


def monte_carlo(spark: SparkSession, observed: DataFrame, *, cells: int, drawn: int, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """n, chi_square, p_value, replicates: observed's n and chi_square against so many samples of n draws.

    p_value: the share of samples, the observed one included, whose chi-square is as high. An empty history has no row.
    """
    row = observed.where("n > 0").first()
    kind = "n bigint, chi_square double, p_value double, replicates int"
    if row is None:
        return spark.createDataFrame([], kind)
    n, chi = int(row["n"]), float(row["chi_square"])
    expected = n * drawn / cells

    def run(batches):
        for x in batches:
            for i in x["id"]:
                size = min(ROW, replicates - int(i) * ROW)
                counts = cell_counts(np.random.default_rng([seed, int(i)]), n, cells, drawn, size)
                stat = ((counts - expected) ** 2).sum(axis=1) / expected
                yield pd.DataFrame({"extreme": [int(np.count_nonzero(stat >= chi * (1 - 1e-12)))]})

    rows = -(-replicates // ROW)
    sampled = spark.range(0, rows, 1, min(rows, 40)).mapInPandas(run, "extreme bigint")
    p = (F.sum("extreme") + 1) / F.lit(replicates + 1)
    return sampled.agg(p.alias("p_value")).select(F.lit(n).cast("long").alias("n"), F.lit(chi).alias("chi_square"), "p_value", F.lit(replicates).alias("replicates"))


def _observed(counts: DataFrame, n: DataFrame, cells: int, drawn: int) -> DataFrame:
    """n and the chi-square of counts k over all cells; cells that never came add their expectation each."""
    e = F.col("n") * drawn / F.lit(float(cells))
    parts = counts.crossJoin(F.broadcast(n)).select("n", ((F.col("k") - e) * (F.col("k") - e) / e - e).alias("x"))  # n: one row
    return parts.groupBy("n").agg((F.sum("x") + F.col("n") * drawn).alias("chi_square"))


def main_uniformity(spark: SparkSession, sf_dir: str, *, replicates: int = 10_000) -> DataFrame:
    """Whether the five numbers come equally often."""
    draws = lift.table(spark, sf_dir, "draws")
    counts = draws.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("k"))
    out = monte_carlo(spark, _observed(counts, draws.agg(F.count(F.lit(1)).alias("n")), POOL, DRAWN), cells=POOL, drawn=DRAWN, replicates=replicates)
    return out.withColumn("chi_square", F.round("chi_square", 6)).withColumn("p_value", F.round("p_value", 9))


def chance_uniformity(spark: SparkSession, sf_dir: str, *, replicates: int = 10_000) -> DataFrame:
    """Whether the chance numbers come equally often."""
    draws = lift.table(spark, sf_dir, "draws")
    counts = draws.groupBy("chance").agg(F.count(F.lit(1)).alias("k"))
    out = monte_carlo(spark, _observed(counts, draws.agg(F.count(F.lit(1)).alias("n")), CHANCES, 1), cells=CHANCES, drawn=1, replicates=replicates, seed=1)
    return out.withColumn("chi_square", F.round("chi_square", 6)).withColumn("p_value", F.round("p_value", 9))


QUERIES = {"main_uniformity": main_uniformity, "chance_uniformity": chance_uniformity}

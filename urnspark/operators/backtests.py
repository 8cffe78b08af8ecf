"""Nested backtests of the number models: each fold's parameters come from the end of the dates before it.

Forecasts depend on the date alone and features on the date and game, so all data are rows of the calendar, weighed by how
many draws share them; no step's work grows with the draws beyond counting hits by date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.operators.forecasts import DRAWN, EXPECTED, POOL, TIE, UNIFORM, WINDOWS, features
from urnspark.plans import lift
from urnspark.plans.staging import stage

#: The parameters tried, and the weights of a forecast against the uniform one.
PRIORS = (50.0, 200.0, 1000.0)
ROLLING = tuple((w, s) for w in WINDOWS for s in (20.0, 100.0, 500.0))
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
BLENDS = (0.0, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0)
MODELS = ("bayesian", "rolling_bayesian", "rolling_ridge_ranker", "ridge_ranker")
PLAIN = ("history_draws", "count", "frequency_delta", *(f"frequency_{w}_delta" for w in WINDOWS), "gap", "present", "affinity", "weekday_sin", "weekday_cos", "is_super", "is_grand", "year_trend")


#: By the folder of the lifted tables; a write that died is never read.
_cells: dict[str, DataFrame] = {}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_date, game, number, features, n (draws of the game and date) and k (those with the number), made once for the lifted tables."""
    key = lift.tables(spark, sf_dir)
    if key in _cells:
        return _cells[key]
    draws = lift.table(spark, sf_dir, "draws")
    n = draws.groupBy("draw_date", "game").agg(F.count(F.lit(1)).alias("n"))
    k = draws.select("draw_date", "game", F.explode("numbers").alias("number")).groupBy("draw_date", "game", "number").agg(F.count(F.lit(1)).alias("k"))
    out = features(spark, sf_dir).join(n, ["draw_date", "game"]).join(k, ["draw_date", "game", "number"], "left").na.fill(0, ["k"])
    _cells[key] = stage(out, "cells")
    return _cells[key]


def plan(data: DataFrame, *, min_train: int, outer: int) -> list[tuple]:
    """(fold, first, last, split) of each fold, few rows on the driver: its test dates, and where the last fifth of the dates before begins."""
    order = Window.orderBy("draw_date")  # the calendar
    days = data.groupBy("draw_date").agg(F.sum(F.when(F.col("number") == 1, F.col("n"))).alias("n"))
    days = days.withColumn("upto", F.sum("n").over(order)).withColumn("at", F.row_number().over(order) - 1)
    tested = days.where(F.col("upto") > min_train).withColumn("fold", F.ntile(outer).over(order))
    folds = tested.groupBy("fold").agg(F.min("at").alias("start"), F.min("draw_date").alias("first"), F.max("draw_date").alias("last"))
    cut = folds.withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("start") * 0.8)))
    rows = cut.join(days.select(F.col("at").alias("cut"), F.col("draw_date").alias("split")), "cut").where("cut < start").collect()
    return sorted((r["fold"], r["first"], r["last"], r["split"]) for r in rows)


def _hits(scores: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of rows of 49 scores: the hits of the five best, ties sharing the places left; k: draws with each number."""
    fifth = np.sort(scores, axis=1)[:, [-DRAWN]]
    over, tie = scores > fifth + TIE, np.abs(scores - fifth) <= TIE
    return (over * k).sum(1) + (DRAWN - over.sum(1)) * (tie * k).sum(1) / tie.sum(1)


def _grouped(x: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, ...]:
    """(groups, 49, columns) of whole groups of a date and game, in order of number, with n and k."""
    x = x.sort_values(["draw_date", "game", "number"], kind="stable")
    a = x[columns].to_numpy(float).reshape(-1, POOL, len(columns))
    return a, x["n"].to_numpy(float).reshape(-1, POOL)[:, 0], x["k"].to_numpy(float).reshape(-1, POOL)


def _moments(columns: list[str], onehot: bool):
    """Sums of products of the centred features, and of them with the hits over chance, of each segment of the calendar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for seg, y in x.groupby("segment"):
                a, n, k = _grouped(y, columns)
                if onehot:
                    a = np.concatenate([a, np.broadcast_to(np.eye(POOL), (len(a), POOL, POOL))], axis=2)
                a = a - a.mean(axis=1, keepdims=True)
                xx = np.einsum("gpi,gpj,g->ij", a, a, n, optimize=True)
                xy = np.einsum("gpi,gp->i", a, k - n[:, None] * EXPECTED, optimize=True)
                yield pd.DataFrame({"segment": [seg], "m": [np.c_[xx, xy].tobytes()]})

    return run


def _scored(columns: list[str], onehot: bool, betas: list[np.ndarray]):
    """draws, brier and hits summed over a batch's groups, of each candidate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            a, n, k = _grouped(x, columns)
            if onehot:
                a = np.concatenate([a, np.broadcast_to(np.eye(POOL), (len(a), POOL, POOL))], axis=2)
            a = a - a.mean(axis=1, keepdims=True)
            for c, beta in enumerate(betas):
                yield _sums(c, EXPECTED + a @ beta, n, k)

    return run


def _sums(c: int, p: np.ndarray, n: np.ndarray, k: np.ndarray) -> pd.DataFrame:
    brier = (n[:, None] * p**2 - 2 * p * k + k).sum() / POOL
    return pd.DataFrame({"c": [c], "n": [n.sum()], "brier": [brier], "hits": [_hits(p, k).sum()]})


def _bayes(candidates: list[tuple]):
    """The same of forecasts (window or 0, prior, blend) from counts before the date."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            a, n, k = _grouped(x, ["history_draws", "count", *(f"frequency_{w}_delta" for w in WINDOWS)])
            for c, (w, prior, blend) in enumerate(candidates):
                h = a[:, :, 0] if not w else np.minimum(a[:, :, 0], w)
                count = a[:, :, 1] if not w else (a[:, :, 2 + WINDOWS.index(w)] + EXPECTED) * h
                p = EXPECTED + blend * ((count + prior * EXPECTED) / (h + prior) - EXPECTED)
                yield _sums(c, p, n, k)

    return run


def _whole(data: DataFrame) -> DataFrame:
    """data in batches that don't part a date and game; a group of them has 49 rows."""
    parts = max(1, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return data.repartition(parts, "draw_date", "game").sortWithinPartitions("draw_date", "game", "number")


def _in_groups(function):
    """function over batches that end with a whole group; what a batch has of the next group waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x])
            whole = len(x) // POOL * POOL
            held = x.iloc[whole:]
            yield from function(iter([x.iloc[:whole]]))

    return run


def _total(data: DataFrame, function) -> dict[int, tuple[float, float, float]]:
    """For each candidate, draws, mean Brier and mean hits."""
    sums = _whole(data).mapInPandas(_in_groups(function), "c int, n double, brier double, hits double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("brier").alias("b"), F.sum("hits").alias("h"))
    return {r["c"]: (r["n"], r["b"] / r["n"], r["h"] / r["n"]) for r in sums.collect()}  # a row per candidate


def nested(spark: SparkSession, sf_dir: str, *, min_train: int = 500, outer: int = 3) -> DataFrame:
    """model, fold, parameters, n, validation_brier, brier_delta and hits over chance of each fold's test.

    bayesian and rolling_bayesian take the parameters, and the weight against the uniform forecast, of the least Brier score
    over the fold's last fifth of training dates; the rankers the penalty of the most expected hits. Ridge regressions of
    hits over chance on features centred within a draw come from sums of products between the dates of interest.
    """
    data = cells(spark, sf_dir)
    folds = plan(data, min_train=min_train, outer=outer)
    rows = []
    marks = sorted({d for _, first, _, split in folds for d in (first, split)})
    between = lambda a, b: data.where((F.col("draw_date") >= F.lit(a)) & (F.col("draw_date") < F.lit(b)))
    inside = lambda a, b: data.where((F.col("draw_date") >= F.lit(a)) & (F.col("draw_date") <= F.lit(b)))
    for model, grid in (("bayesian", [(0, s, b) for s in PRIORS for b in BLENDS]), ("rolling_bayesian", [(w, s, b) for w, s in ROLLING for b in BLENDS])):
        for fold, first, last, split in folds:
            tried = _total(between(split, first), _bayes(grid))
            best = min(tried, key=lambda c: (round(tried[c][1], 14), -round(tried[c][2], 12), c))
            n, brier, hits = _total(inside(first, last), _bayes([grid[best]]))[0]
            rows.append((model, fold, f"window={grid[best][0]} prior={grid[best][1]:g} blend={grid[best][2]:g}", int(n), tried[best][1], brier - UNIFORM, hits - DRAWN * EXPECTED))
    for model, columns, onehot in (("rolling_ridge_ranker", [f"frequency_{w}_delta" for w in WINDOWS], False), ("ridge_ranker", list(PLAIN), True)):
        size = len(columns) + POOL * onehot
        segment = sum((F.when(F.col("draw_date") >= F.lit(d), 1).otherwise(0) for d in marks), F.lit(0))
        by = {}
        parts = _whole(data.withColumn("segment", segment)).mapInPandas(_in_groups(_moments(columns, onehot)), "segment int, m binary")
        for r in parts.collect():  # one small matrix for a batch
            by[r["segment"]] = by.get(r["segment"], 0.0) + np.frombuffer(r["m"]).reshape(size, size + 1)
        upto = lambda d: sum((m for k, m in by.items() if k <= marks.index(d)), np.zeros((size, size + 1)))
        solve = lambda m, alpha: np.linalg.solve(m[:, :-1] + alpha * np.eye(len(m)), m[:, -1])
        for fold, first, last, split in folds:
            tried = _total(between(split, first), _scored(columns, onehot, [solve(upto(split), a) for a in ALPHAS]))
            best = min(tried, key=lambda c: (-round(tried[c][2], 12), round(tried[c][1], 14), c))
            n, brier, hits = _total(inside(first, last), _scored(columns, onehot, [solve(upto(first), ALPHAS[best])]))[0]
            rows.append((model, fold, f"alpha={ALPHAS[best]:g}", int(n), tried[best][1], brier - UNIFORM, hits - DRAWN * EXPECTED))
    out = spark.createDataFrame(rows, "model string, fold int, parameters string, n bigint, validation_brier double, brier_delta double, hits_uplift double")
    return out.select("model", "fold", "parameters", "n", *(F.round(c, 9).alias(c) for c in ("validation_brier", "brier_delta", "hits_uplift")))


def nested_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir)


QUERIES = {"nested_backtest": nested_backtest}

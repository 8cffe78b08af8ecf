"""How crowded a ticket is: a Poisson model with its refits, conservative multipliers, and the least crowded ticket under a loss of hits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.projection import projected
from urnspark.operators.forecasts import DRAWN, POOL, smoothed
from urnspark.operators.learners import summed
from urnspark.operators.models import SHAPE, popularity
from urnspark.operators.resampling import bits32, poisson_ends
from urnspark.plans import lift
from urnspark.plans.staging import stage


def shape_of(mains: np.ndarray) -> np.ndarray:
    """SHAPE of rows of five ascending numbers."""
    total = mains.sum(axis=1)
    return np.c_[(mains > 31).sum(axis=1), (mains[:, -1] <= 31), (np.diff(mains, axis=1) == 1).sum(axis=1), ((mains == 7) | (mains == 13)).sum(axis=1), total / 150, np.abs(total - 125) / 100].astype(float)


@dataclass
class Predictor:
    """beta: intercept and coefficients of SHAPE; baseline: winners over exposure; refits: the same of each refit, less its log baseline."""

    beta: np.ndarray
    baseline: float
    refits: np.ndarray
    quantile: float = 0.9

    def multipliers(self, mains: np.ndarray) -> np.ndarray:
        return np.exp(self.beta[0] + shape_of(mains) @ self.beta[1:])

    def conservative(self, mains: np.ndarray) -> np.ndarray:
        """The baseline times the upper quantile of what the refits make of a ticket against their own baselines."""
        relative = np.exp(self.refits[:, 0] + shape_of(mains) @ self.refits[:, 1:].T)
        return self.baseline * np.quantile(relative, self.quantile, axis=1)


def observations(spark: SparkSession, source: str) -> DataFrame:
    """popularity's rows with their place i by date and id."""
    rows = popularity(spark, source)
    days = rows.groupBy("draw_date").agg(F.count(F.lit(1)).alias("n"))
    days = days.select(F.col("draw_date").alias("d"), (F.sum("n").over(Window.orderBy("draw_date")) - F.col("n")).alias("h"))  # the calendar
    within = F.row_number().over(Window.partitionBy("draw_date").orderBy("draw_id")) - 1
    rows = rows.withColumn("r", within).join(days, F.col("draw_date") == F.col("d"))
    return stage(rows.select((F.col("h") + F.col("r")).alias("i"), "winners", "exposure", *SHAPE), "popularity")


def weights(i: np.ndarray, n: int, block: int, refits: int) -> np.ndarray:
    """(1 + refits, rows): 1 for the model itself; then how many of a refit's moving blocks hold each row."""
    size = min(block, n)
    starts = n - size + 1
    ends = np.array(poisson_ends(-(-n // size) / starts), dtype=np.uint64)
    out = np.zeros((1 + refits, len(i)))
    out[0] = 1
    for back in range(size):
        s = i - back
        w = np.searchsorted(ends, bits32(np.arange(refits), np.maximum(s, 0), 5), side="right")
        out[1:] += w * ((s >= 0) & (s < starts))
    return out


def fit_predictor(rows: DataFrame, *, alpha: float = 1e-3, refits: int = 100, block: int = 12, quantile: float = 0.9, steps: int = 50) -> Predictor:
    """A penalised Poisson model of winners given exposure, and its refits on block-bootstrap samples, all in the same passes.

    A row's weight in a refit comes from a hash of both, so a pass over the rows adds up the gradient and curvature of all
    refits. The penalty is on standardised features, by each sample's own scale, and in units of its exposure; the
    intercept is free. Refits without a winner are left out. Rows: i (place), winners, exposure, SHAPE.
    """
    if refits < 20 or not 0.5 <= quantile < 1:
        raise ValueError("at least 20 refits, and a quantile from 0.5 to 1")
    n, size = rows.count(), len(SHAPE) + 1

    def arrays(x) -> tuple[np.ndarray, ...]:
        z = np.c_[np.ones(len(x)), x[list(SHAPE)].to_numpy(float)]
        return z, x["winners"].to_numpy(float), x["exposure"].to_numpy(float), weights(x["i"].to_numpy(), n, block, refits)

    def pack(batches):
        for x in batches:
            for a in range(0, len(x), 4096):
                y = x.iloc[a : a + 4096]
                yield pd.DataFrame({c: [y[c].to_numpy(float).tobytes()] for c in y.columns})

    data = stage(rows.select("i", "winners", "exposure", *SHAPE).mapInPandas(pack, ", ".join(f"{c} binary" for c in ("i", "winners", "exposure", *SHAPE))), "popularity-blocks")
    opened = lambda r: arrays(pd.DataFrame({c: np.frombuffer(getattr(r, c)) for c in ("i", "winners", "exposure", *SHAPE)}).astype({"i": "int64"}))

    def scales(r):
        z, y, e, w = opened(r)
        yield 0, np.c_[w.sum(axis=1), w @ y, w @ e, w @ z[:, 1:], w @ z[:, 1:] ** 2].ravel()

    told = summed(data, scales)
    if not told:
        raise ValueError("no observations")
    told = told[0].reshape(1 + refits, -1)
    if told[0, 1] <= 0:
        raise ValueError("no winners")
    use = told[:, 1] > 0
    told = told[use]
    mean, square = np.split(told[:, 3:] / told[:, :1], 2, axis=1)
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    spread = np.where(spread > 1e-12, spread, 1.0)
    penalty = alpha * told[:, 2, None] * spread**2
    beta = np.zeros((len(told), size))
    beta[:, 0] = np.log(told[:, 1] / told[:, 2])
    for _ in range(steps):

        def sums(r, beta=beta):
            z, y, e, w = opened(r)
            w = w[use]
            mu = w * e * np.exp(beta @ z.T)
            g = mu @ z - (w * y) @ z
            h = np.stack([(z * m[:, None]).T @ z for m in mu])
            yield 0, np.c_[g, h.reshape(len(beta), -1)].ravel()

        v = summed(data, sums)[0].reshape(len(beta), -1)
        g, h = v[:, :size].copy(), v[:, size:].reshape(-1, size, size).copy()
        g[:, 1:] += penalty * beta[:, 1:]
        h[:, np.arange(1, size), np.arange(1, size)] += penalty
        move = np.linalg.solve(h, g[:, :, None])[:, :, 0]
        beta = beta - move
        if np.abs(move * np.c_[np.ones(len(beta)), spread]).max() < 1e-10:
            break
    refit = beta[1:].copy()
    refit[:, 0] -= np.log(told[1:, 1] / told[1:, 2])
    return Predictor(beta[0], float(told[0, 1] / told[0, 2]), refit, quantile)


def admissible(spark: SparkSession, p: np.ndarray, loss: float) -> DataFrame:
    """numbers (ascending), hits: the tickets whose expected hits are within loss of the best ticket's.

    Branch and bound on DataFrames: numbers stand by falling chance, a partial ticket grows by later numbers alone, and is
    kept if with the best that may follow it still reaches. So what is made is little more than what is admissible.
    """
    order = np.argsort(-p, kind="stable")
    v = p[order]
    run = np.r_[0.0, np.cumsum(v)]
    least = float(run[DRAWN] - loss - 1e-12)
    # best[r][j]: the most that r numbers after place j add up to.
    best = [[float(run[min(j + 1 + r, POOL)] - run[j + 1]) if j + 1 + r <= POOL else -1e9 for j in range(POOL)] for r in range(DRAWN)]
    chance, number = F.array(*(F.lit(float(x)) for x in v)), F.array(*(F.lit(int(j) + 1) for j in order))
    reaches = lambda bound: lambda j: (j > F.col("at")) & (F.col("hits") + F.get(chance, j) + F.get(bound, j) >= least)
    rows = spark.createDataFrame([(-1, 0.0, [])], "at int, hits double, places array<int>")
    for k in range(DRAWN):
        bound = F.array(*(F.lit(b) for b in best[DRAWN - 1 - k]))
        rows = rows.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(POOL - 1)), reaches(bound))))
        rows = rows.select(F.col("j").alias("at"), (F.col("hits") + F.get(chance, F.col("j"))).alias("hits"), F.array_append("places", F.col("j")).alias("places"))
        if k == 1:
            rows = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.select(F.array_sort(F.transform("places", lambda j: F.get(number, j))).alias("numbers"), "hits")


CHOICE = (
    "numbers array<int>, expected_hits double, hit_loss double, multiplier double, conservative_multiplier double, top_numbers array<int>, top_expected_hits double, top_conservative_multiplier double, baseline_multiplier double, refits int, admissible bigint"
)


def least_crowded(spark: SparkSession, p: np.ndarray, predictor: Predictor, *, loss: float = 0.005) -> DataFrame:
    """One row: of the tickets within loss of the best one's expected hits, the one with the least conservative multiplier.

    Ties: more hits, then the smaller numbers. p: 49 finite chances.
    """
    p = np.asarray(p, dtype=float)
    if p.shape != (POOL,) or not np.isfinite(p).all() or (p < 0).any() or loss < 0:
        raise ValueError("49 finite chances and a loss that isn't below 0")
    rows = admissible(spark, p, loss)

    def weigh(batches):
        for x in batches:
            if len(x):
                mains = np.array(x["numbers"].tolist())
                c = predictor.conservative(mains)
                # Equal but for the order of sums.
                key = np.lexsort((*mains.T[::-1], -np.round(x["hits"].to_numpy(), 12), np.round(c, 12)))[0]
                yield pd.DataFrame({"numbers": [mains[key].tolist()], "hits": [x["hits"].iloc[key]], "c": [c[key]], "n": [len(x)]})

    best = stage(rows.mapInPandas(weigh, "numbers array<int>, hits double, c double, n bigint"), "least-crowded")
    total = best.agg(F.sum("n")).first()[0]
    r = best.orderBy(F.round("c", 12), -F.round("hits", 12), "numbers").first()
    top = np.sort(np.argsort(p, kind="stable")[-DRAWN:]) + 1
    most = float(p[top - 1].sum())
    mains = np.array([r["numbers"], top.tolist()])
    row = (r["numbers"], r["hits"], most - r["hits"], float(predictor.multipliers(mains)[0]), r["c"], top.tolist(), most, float(predictor.conservative(mains)[1]), predictor.baseline, len(predictor.refits), total)
    out = spark.createDataFrame([row], CHOICE)
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def last_chances(spark: SparkSession, source: str) -> np.ndarray:
    """The smoothed frequencies of the last date, projected to five expected hits."""
    p = smoothed(lift.table(spark, source, "hist"))
    p = p.join(F.broadcast(p.agg(F.max("draw_date").alias("t"))), F.col("draw_date") == F.col("t"))
    one = p.agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "p"))), lambda x: x["p"]).alias("ps"))  # 49
    return np.array(one.select(projected(F.col("ps")).alias("q")).first()["q"])


def value_aware_ticket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return least_crowded(spark, last_chances(spark, sf_dir), fit_predictor(observations(spark, sf_dir)))


def conservative_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_id, multiplier, conservative of every draw's own combination."""
    predictor = fit_predictor(observations(spark, sf_dir))

    def weigh(batches):
        for x in batches:
            if len(x):
                mains = np.sort(np.array(x["numbers"].tolist()), axis=1)
                yield pd.DataFrame({"draw_id": x["draw_id"], "multiplier": predictor.multipliers(mains).round(9), "conservative": predictor.conservative(mains).round(9)})

    return lift.table(spark, sf_dir, "draws").select("draw_id", "numbers").mapInPandas(weigh, "draw_id bigint, multiplier double, conservative double")


QUERIES = {"conservative_multipliers": conservative_multipliers, "value_aware_ticket": value_aware_ticket}

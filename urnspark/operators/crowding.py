"""Whether a ticket's shape tells how crowded it is: walk-forward Poisson models of three feature sets, for two targets, with inference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from itertools import product
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.operators.draws import P9, WIDE
from urnspark.operators.forecasts import POOL
from urnspark.operators.learners import summed
from urnspark.operators.models import ALPHAS
from urnspark.operators.popularity import shape_of
from urnspark.operators.resampling import resampled
from urnspark.plans import lift
from urnspark.plans.staging import stage

#: Whose winners: of the whole ticket, or of its five numbers.
TARGETS = ("jackpot", "main_combination")
SETS = ("base", "interactions", "number_effects")
#: Outcomes that a ticket of each target is one of.
OUTCOMES = {"jackpot": 10 * comb(POOL, 5), "main_combination": comb(POOL, 5)}
BLOCK = 12
#: Rows of a block of the staged table.
ROWS = 4096


def features(mains: np.ndarray, kind: str) -> np.ndarray:
    """Of rows of five ascending numbers: their shape; with its products and squares; or with each number's presence."""
    x = shape_of(mains)
    if kind == "interactions":
        high, adjacent, total = x[:, 0], x[:, 2], x[:, 4]
        return np.c_[x, high * total, adjacent * total, high**2, adjacent**2, total**2]
    if kind == "number_effects":
        return np.c_[x, (mains[:, :, None] == np.arange(1, POOL + 1)).any(axis=1)]
    if kind != "base":
        raise ValueError(f"no feature set {kind}")
    return x


@dataclass(frozen=True)
class Fold:
    """Days since 1970: tests first to last, from what comes before first; the penalty is chosen on split to first, from before split."""

    split: int
    first: int
    last: int


@dataclass(frozen=True)
class Fitted:
    """Intercept and coefficients of the features as they are; baseline: winners over exposure of the training draws."""

    beta: np.ndarray
    baseline: float
    alpha: float


def observations(spark: SparkSession, source: str, game: str = "loto") -> DataFrame:
    """draw_id, draw_date, numbers (ascending), y_ and e_ of each target: winners, and those that chance alone would give.

    A game's draws with known rank-1 winners and some of rank 9. main_combination is null where those of rank 2 aren't known.
    """
    rows = lift.run(
        spark,
        source,
        f"""WITH {lift.PRIZES}, {WIDE} SELECT d.draw_id, draw_date, game, numbers, CAST(w1 AS DOUBLE) AS y_jackpot, CAST(w1 + w2 AS DOUBLE) AS y_main_combination, w9 / {P9} AS tickets
FROM draws d JOIN wide o ON d.draw_id = o.draw_id WHERE w1 IS NOT NULL AND w9 > 0""",
    )
    rows = rows.where(F.col("game") == game)
    return rows.select("draw_id", "draw_date", F.array_sort("numbers").alias("numbers"), *(f"y_{t}" for t in TARGETS), *((F.col("tickets") / n).alias(f"e_{t}") for t, n in OUTCOMES.items()))


def blocks(obs: DataFrame) -> DataFrame:
    """Observations as staged rows of at most ROWS of them, a binary a column; days count from 1970."""
    names = [*(f"y_{t}" for t in TARGETS), *(f"e_{t}" for t in TARGETS)]

    def pack(batches):
        for x in batches:
            for a in range(0, len(x), ROWS):
                p = x.iloc[a : a + ROWS]
                mains = np.array(p["numbers"].tolist(), dtype="<i2")
                yield pd.DataFrame({"n": [len(p)], "ids": [p["draw_id"].to_numpy("<i8").tobytes()], "days": [p["day"].to_numpy("<i8").tobytes()], "mains": [mains.tobytes()], **{c: [p[c].to_numpy("<f8").tobytes()] for c in names}})

    rows = obs.withColumn("day", F.unix_date("draw_date").cast("long"))
    return stage(rows.mapInPandas(pack, "n int, ids binary, days binary, mains binary, " + ", ".join(f"{c} binary" for c in names)), "crowding")


def _opened(r, target: str) -> tuple[np.ndarray, ...]:
    """days, mains, winners, exposure, ids of a block's rows that have the target."""
    y = np.frombuffer(getattr(r, f"y_{target}"))
    ok = ~np.isnan(y)
    part = lambda name, kind="<f8": np.frombuffer(getattr(r, name), dtype=kind)
    return part("days", "<i8")[ok], part("mains", "<i2").reshape(-1, 5)[ok].astype(int), y[ok], part(f"e_{target}")[ok], part("ids", "<i8")[ok]


def calendar(obs: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    """Days with an observation of the target, ascending, and how many each has; the calendar bounds it."""
    rows = obs.where(F.col(f"y_{target}").isNotNull()).groupBy(F.unix_date("draw_date").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort()
    return np.array([r["d"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64)


def split_of(days: np.ndarray) -> int:
    """The first of the last fifth of the days."""
    return int(days[max(1, int(len(days) * 0.8))])


def folds_of(days: np.ndarray, n: np.ndarray, min_train: int, k: int) -> list[Fold]:
    """k runs of the days from that of observation min_train on, the first of them longer by one."""
    late = days[np.searchsorted(np.cumsum(n), min_train, side="right") :]
    runs = [x for x in np.array_split(late, k) if len(x)]
    return [Fold(split_of(days[days < x[0]]), int(x[0]), int(x[-1])) for x in runs if (days < x[0]).sum() > 1]


def deviance(actual: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Poisson deviance of each row."""
    safe = np.maximum(expected, 1e-12)
    return 2 * (actual * np.log(np.where(actual > 0, actual, 1) / np.where(actual > 0, safe, 1)) - (actual - safe))


#: (target, feature set, the day that training ends before).
Sample = tuple[str, str, int]


def fit(data: DataFrame, models: Sequence[tuple[Sample, float]], *, steps: int = 60) -> list[Fitted | None]:
    """Penalised Poisson models of (sample, penalty); all of them take each Newton step in one pass over the blocks.

    Features are centred and scaled by their sample. The penalty is half the squared coefficients' sum times the sample's
    exposure; the intercept is free. None where a sample has no winner.
    """
    samples = list(dict.fromkeys(s for s, _ in models))

    def each(r, wanted: list[Sample]):
        """Place of a sample in wanted, features, winners and exposure of its rows in the block."""
        held: dict[tuple[str, ...], tuple] = {}
        for i, (target, kind, before) in enumerate(wanted):
            if target not in held:
                held[target,] = held[target] = _opened(r, target)
            days, mains, y, e, _ = held[target]
            if (target, kind) not in held:
                held[target, kind] = features(mains, kind)
            use = days < before
            if use.any():
                yield i, held[target, kind][use], y[use], e[use]

    def scales(r):
        for i, z, y, e in each(r, samples):
            yield i, np.r_[len(y), y.sum(), e.sum(), z.sum(axis=0), (z * z).sum(axis=0)]

    told = {samples[i]: v for i, v in summed(data, scales).items()}
    told = {s: v for s, v in told.items() if v[1] > 0 and v[2] > 0}
    mean, spread = {}, {}
    for s, v in told.items():
        mean[s], square = np.split(v[3:] / v[0], 2)
        sd = np.sqrt(np.maximum(square - mean[s] ** 2, 0))
        spread[s] = np.where(sd > 1e-9, sd, 1.0)
    beta = {i: np.r_[np.log(told[s][1] / told[s][2]), np.zeros(len(mean[s]))] for i, (s, _) in enumerate(models) if s in told}
    moving = set(beta)
    for _ in range(steps):
        wanted = list(dict.fromkeys(models[i][0] for i in sorted(moving)))
        of = {s: [i for i in sorted(moving) if models[i][0] == s] for s in wanted}
        now = {i: beta[i] for i in moving}

        def sums(r, wanted=wanted, of=of, now=now):
            for k, z, y, e in each(r, wanted):
                s = wanted[k]
                x = np.c_[np.ones(len(z)), (z - mean[s]) / spread[s]]
                for i in of[s]:
                    mu = e * np.exp(np.minimum(x @ now[i], 50))
                    yield i, np.r_[x.T @ (mu - y), (x.T @ (x * mu[:, None])).ravel()]

        for i, v in summed(data, sums).items():
            size = len(beta[i])
            g, h = v[:size].copy(), v[size:].reshape(size, size).copy()
            weight = models[i][1] * told[models[i][0]][2]
            g[1:] += weight * beta[i][1:]
            h[np.arange(1, size), np.arange(1, size)] += weight
            move = np.linalg.solve(h, g)
            beta[i] = beta[i] - move
            if np.abs(move).max() < 1e-9:
                moving.discard(i)
        if not moving:
            break
    out: list[Fitted | None] = [None] * len(models)
    for i, b in beta.items():
        s, alpha = models[i]
        raw = b[1:] / spread[s]
        out[i] = Fitted(np.r_[b[0] - raw @ mean[s], raw], float(told[s][1] / told[s][2]), alpha)
    return out


def chosen(data: DataFrame, asked: Sequence[tuple[str, str, int, int]]) -> list[float]:
    """The penalty for each (target, feature set, split, end): the least mean deviance from split to end of models from before split; ties to the smaller."""
    models = [((t, kind, split), a) for t, kind, split, _ in asked for a in ALPHAS]
    made = fit(data, models)

    def losses(r):
        for t in TARGETS:
            days, mains, y, e, _ = _opened(r, t)
            z: dict[str, np.ndarray] = {}
            for i, (target, kind, split, end) in enumerate(asked):
                use = (days >= split) & (days < end)
                if target != t or not use.any():
                    continue
                if kind not in z:
                    z[kind] = features(mains, kind)
                own = [m.beta if m is not None else None for m in made[i * len(ALPHAS) : (i + 1) * len(ALPHAS)]]
                yield i, np.array([0.0 if b is None else deviance(y[use], e[use] * np.exp(b[0] + z[kind][use] @ b[1:])).sum() for b in own] + [use.sum()])

    told = summed(data, losses)
    return [ALPHAS[int(np.argmin(np.round(told[i][:-1] / told[i][-1], 12)))] if i in told else ALPHAS[0] for i in range(len(asked))]


SCORES = "target string, feature_set string, fold int, draw_id bigint, day bigint, winners double, expected double, baseline double, deviance double, baseline_deviance double"


def walked(data: DataFrame, folds: dict[str, list[Fold]], sets: Sequence[str] = SETS) -> tuple[DataFrame, dict[tuple[str, str, int], Fitted | None]]:
    """The scores of each fold's draws under the model from before it, and the models by target, feature set and fold (from 1).

    The penalties of all folds, then the models, come from passes that they share.
    """
    asked = [(t, kind, k) for t in folds for kind in sets for k in range(1, len(folds[t]) + 1)]
    of = {a: folds[a[0]][a[2] - 1] for a in asked}
    alphas = chosen(data, [(t, kind, of[t, kind, k].split, of[t, kind, k].first) for t, kind, k in asked])
    made = dict(zip(asked, fit(data, [((t, kind, of[t, kind, k].first), a) for (t, kind, k), a in zip(asked, alphas)])))

    def score(batches):
        for x in batches:
            for r in x.itertuples(index=False):
                for t in folds:
                    days, mains, y, e, ids = _opened(r, t)
                    for kind in sets:
                        z = features(mains, kind)
                        for k, f in enumerate(folds[t], 1):
                            m, use = made[t, kind, k], (days >= f.first) & (days <= f.last)
                            if m is None or not use.any():
                                continue
                            expected, flat = e[use] * np.exp(m.beta[0] + z[use] @ m.beta[1:]), m.baseline * e[use]
                            yield pd.DataFrame({"target": t, "feature_set": kind, "fold": k, "draw_id": ids[use], "day": days[use], "winners": y[use], "expected": expected, "baseline": flat, "deviance": deviance(y[use], expected), "baseline_deviance": deviance(y[use], flat)})

    return stage(data.mapInPandas(score, SCORES), "crowding-scores"), made


REPORT = (
    "target string, feature_set string, observations bigint, test_observations bigint, folds int, alphas array<double>, final_alpha double, deviance double, baseline_deviance double, delta double, low double, high double, p_value double, adjusted_p double, block int, qualified boolean"
)


def report(spark: SparkSession, source: str, *, game: str = "loto", min_train: int = 500, folds: int = 3, replicates: int = 2000, block: int = BLOCK, sets: Sequence[str] = SETS) -> DataFrame:
    """A row per target and feature set: its walk-forward deviance against the plain rate's, the interval of their mean difference, and a test.

    Folds are runs of whole dates after the first min_train observations; a fold's model and penalty come from what lies
    strictly before it. low, high: a moving-block bootstrap's; p_value: a block sign test's; adjusted_p: times all pairs
    of target and feature set. A model qualifies if the interval lies below 0 and adjusted_p below 0.05. final_alpha: the
    penalty that all observations choose. A target without enough observations has no row.
    """
    if min_train < 100 or folds < 2 or replicates < 100 or block < 1:
        raise ValueError("at least 100 observations to train on, 2 folds, 100 replicates and a block of 1")
    obs = stage(observations(spark, source, game), "crowding-observations")
    data = blocks(obs)
    days = {t: calendar(obs, t) for t in TARGETS}
    runs = {t: f for t, (d, n) in days.items() if (f := folds_of(d, n, min_train, folds))}
    if not runs:
        return spark.createDataFrame([], REPORT)
    scores, made = walked(data, runs, sets)
    last = [(t, kind) for t in runs for kind in sets]
    final = dict(zip(last, chosen(data, [(t, kind, split_of(days[t][0]), 1 << 40) for t, kind in last])))
    # A row's place by date and id, from the counts of the days before it: only a date's rows are put in order.
    within = F.row_number().over(Window.partitionBy("target", "feature_set", "day").orderBy("draw_id")) - 1
    by_day = scores.groupBy("target", "feature_set", "day").agg(F.count(F.lit(1)).alias("c"))
    before = by_day.withColumn("h", F.sum("c").over(Window.partitionBy("target", "feature_set").orderBy("day")) - F.col("c")).drop("c")  # the calendar
    rows = scores.withColumn("r", within).join(before, ["target", "feature_set", "day"])
    rows = rows.select("target", "feature_set", (F.col("h") + F.col("r")).alias("i"), (F.col("deviance") - F.col("baseline_deviance")).alias("delta"))
    told = resampled(rows, ["target", "feature_set"], "delta", "i", replicates=replicates, block=block)
    means = scores.groupBy("target", "feature_set").agg(F.avg("deviance").alias("deviance"), F.avg("baseline_deviance").alias("baseline_deviance"))
    known = [(t, kind, int(days[t][1].sum()), len(runs[t]), [m.alpha for k in range(1, len(runs[t]) + 1) if (m := made[t, kind, k]) is not None], final[t, kind]) for t, kind in last]
    head = spark.createDataFrame(known, "target string, feature_set string, observations bigint, folds int, alphas array<double>, final_alpha double")
    out = told.join(means, ["target", "feature_set"]).join(F.broadcast(head), ["target", "feature_set"])  # a row per target and set
    adjusted = F.least(F.lit(1.0), F.col("p_lower") * (len(TARGETS) * len(SETS)))
    r = lambda c: F.round(c, 9).alias(c)
    return out.select(
        "target", "feature_set", "observations", F.col("n").alias("test_observations"), "folds", "alphas", "final_alpha", r("deviance"), r("baseline_deviance"), F.round("observed", 9).alias("delta"), r("low"), r("high"),
        F.round("p_lower", 9).alias("p_value"), F.round(adjusted, 9).alias("adjusted_p"), F.least(F.lit(block), F.col("n").cast("int")).alias("block"), ((F.col("high") < 0) & (adjusted < 0.05)).alias("qualified"),
    )


def day_of(d: date) -> int:
    return (d - date(1970, 1, 1)).days


def popularity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir)


QUERIES = {"popularity_report": popularity_report}

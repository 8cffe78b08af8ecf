"""Tickets sold: a nested backtest of ridge and boosted models against segmented medians, and a forecaster."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from dataclasses import dataclass
from datetime import date, timedelta
from math import cos, log, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.probability import holm
from urnspark.operators import calendar_cells, calendar_trees, learners
from urnspark.operators.learners import EPOCH, Boosted, day_of, summed, unpacked
from urnspark.operators.models import FEATURES, GAMES, _inner, folds, participation
from urnspark.operators.quantiles import exact_quantiles
from urnspark.operators.resampling import resampled
from urnspark.plans.staging import stage

#: The parameters tried, and the observations that a game's weekday needs for a median of its own.
ALPHAS = (1.0, 10.0, 100.0)
BOOSTS = ((0.03, 7, 5.0), (0.05, 15, 5.0))
OWN = 10
MODELS = ("ridge", "gradient_boosting")
#: Quantiles that the multipliers of a forecast are kept by.
STEPS = 1000
#: What makes day_of's numbers weekdays, Monday 0.
WEEKDAY = EPOCH.weekday()


@dataclass
class Linear:
    """Trains on dates before first; the intercept isn't penalised."""

    first: int
    alpha: float
    beta: np.ndarray | None = None

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.beta[0] + x @ self.beta[1:]


def fit_linear(data: DataFrame, models: list[Linear]) -> list[Linear]:
    """Ridge regressions of all dates and penalties from one pass of sums of products."""
    firsts = np.array(sorted({m.first for m in models}))

    def sums(r):
        days, x, _, y = unpacked(r)
        z = np.c_[np.ones(len(x)), x[:, 0], y[:, 0]]
        part = np.searchsorted(firsts, days, side="right")  # the first of firsts that is later
        for i in np.unique(part[part < len(firsts)]):
            use = z[part == i]
            yield int(i), (use.T @ use).ravel()

    # What lies between two dates is added up once; a date's sums are those of all before it.
    parts, size = summed(data, sums), len(FEATURES) + 2
    told = np.cumsum([parts.get(i, np.zeros(size * size)) for i in range(len(firsts))], axis=0)
    for m in models:
        s = told[np.searchsorted(firsts, m.first)].reshape(size, size)
        m.beta = np.linalg.solve(s[:-1, :-1] + m.alpha * np.diag(np.r_[0.0, np.ones(size - 2)]), s[:-1, -1])
    return models


def errors(data: DataFrame, trials: list[tuple[object, int, int]]) -> list[tuple[float, float]]:
    """Of each (predictor, first day, day after the last): the mean squared error, and the mean of exp(residual)."""

    def sums(r):
        days, x, _, y = unpacked(r)
        for i, (p, first, last) in enumerate(trials):
            use = (days >= first) & (days < last)
            if use.any():
                e = (y[use] - p.predict(days[use], x[use]))[:, 0]
                yield i, np.array([len(e), (e * e).sum(), np.exp(e).sum()])

    told = summed(data, sums)
    return [(float(told[i][1] / told[i][0]), float(told[i][2] / told[i][0])) if i in told else (float("nan"), 1.0) for i in range(len(trials))]


def baselines(rows: DataFrame, starts: list[tuple[int, date]]) -> DataFrame:
    """fold, game, weekday, baseline: medians of y over the dates before each fold's first, exact.

    Of the game's weekday where it has ten observations, else of the game, else of all. Weekday -1 of a game has the game's,
    that of the game '' has that of all.
    """
    table = rows.sparkSession.createDataFrame(starts, "fold int, first date")
    past = rows.join(F.broadcast(table), F.col("draw_date") < F.col("first")).select("fold", "game", F.weekday("draw_date").alias("weekday"), "y")  # a row a fold
    level = lambda k, g, d: F.struct(F.lit(k).alias("level"), g.alias("g"), d.alias("d"))
    any_game, any_day = F.lit(None).cast("string"), F.lit(None).cast("int")
    levels = F.array(level(1, F.col("game"), F.col("weekday")), level(2, F.col("game"), any_day), level(3, any_game, any_day))
    long = past.select("fold", "y", F.explode(levels).alias("l")).select("fold", "l.level", "l.g", "l.d", "y")
    m = exact_quantiles(long, ["fold", "level", "g", "d"], "y", [0.5]).select("fold", "level", "g", "d", F.col("quantile").alias("m"))
    n = long.where("level = 1").groupBy(F.col("fold").alias("f"), F.col("g").alias("ng"), F.col("d").alias("nd")).agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array(F.struct("game", F.weekday("draw_date").alias("weekday")), F.struct("game", F.lit(-1).alias("weekday")), F.struct(F.lit("").alias("game"), F.lit(-1).alias("weekday")))
    grid = table.select("fold").crossJoin(rows.select(F.explode(kinds).alias("k")).select("k.*").distinct())  # games by weekdays
    at = lambda level, name: m.where(F.col("level") == level).select(F.col("fold").alias(f"{name}f"), F.col("g").alias(f"{name}g"), F.col("d").alias(f"{name}d"), F.col("m").alias(name))
    out = grid.join(at(1, "a"), (F.col("fold") == F.col("af")) & (F.col("game") == F.col("ag")) & (F.col("weekday") == F.col("ad")), "left")
    out = out.join(at(2, "b"), (F.col("fold") == F.col("bf")) & (F.col("game") == F.col("bg")), "left").join(at(3, "c"), F.col("fold") == F.col("cf"), "left")
    out = out.join(n, (F.col("fold") == F.col("f")) & (F.col("game") == F.col("ng")) & (F.col("weekday") == F.col("nd")), "left")
    return out.select("fold", "game", "weekday", F.when(F.col("n") >= OWN, F.col("a")).otherwise(F.coalesce("b", "c")).alias("baseline"))


@dataclass
class Forecaster:
    """champion: the report's row; predictor: None where no model qualified (baseline: game and weekday -> median, then);
    smearing; multipliers: STEPS + 1 quantiles of temporal residuals' levels over their mean; span: of the jackpots by game."""

    champion: dict
    predictor: object | None
    smearing: float
    baseline: dict[tuple[str, int], float]
    multipliers: np.ndarray
    span: dict[str, tuple[float, float]]
    observations: int
    last: date

    def log_median(self, jackpot: float, target: date, game: str) -> float:
        if self.predictor is None:
            return self.baseline.get((game, target.weekday()), self.baseline.get((game, -1), self.baseline["", -1]))
        return float(self.predictor.predict(np.array([day_of(target)]), features_of(jackpot, target, game)[None, None, :])[0, 0])

    def log_medians(self, days: np.ndarray, games: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of many observations with FEATURES x."""
        if self.predictor is None:
            return np.array([self.baseline.get((g, int(d)), self.baseline.get((g, -1), self.baseline["", -1])) for g, d in zip(games, (days + WEEKDAY) % 7)])
        return self.predictor.predict(days, x[:, None, :])[:, 0]

    def tickets(self, jackpot: float, target: date, game: str) -> float:
        if target <= self.last:
            raise ValueError("the target must lie after all observations")
        return float(np.exp(self.log_median(jackpot, target, game)) * self.smearing)

    def quantile(self, p: float) -> float:
        """Of the multipliers."""
        return float(np.interp(p * STEPS, np.arange(STEPS + 1), self.multipliers))

    def draw(self, u: np.ndarray) -> np.ndarray:
        """Multipliers at shares u, below 1, of their law."""
        at = u * STEPS
        low = at.astype(np.int64)
        return self.multipliers[low] + (at - low) * np.diff(self.multipliers)[low]


def features_of(jackpot: float, day: date, game: str) -> np.ndarray:
    """FEATURES of one observation."""
    size, turn = log(1 + jackpot) / 20, 2 * pi * day.month / 12
    return np.array([size, size * size, (day - date(1990, 1, 1)).days / 3652, sin(turn), cos(turn), *(float(day.weekday() == i) for i in range(7)), *(float(game == g) for g in GAMES)])


def _grid(models: tuple[str, ...]) -> list[tuple]:
    """model, its parameters as text, a maker of one that trains before a day."""
    grid = [("ridge", f"alpha={a:g}", lambda d, a=a: Linear(d, a)) for a in ALPHAS]
    grid += [("gradient_boosting", f"rate={r:g} leaves={v} l2={b:g}", lambda d, r=r, v=v, b=b: Boosted(d, r, v, b, value=True)) for r, v, b in BOOSTS]
    return [g for g in grid if g[0] in models]


REPORT = (
    "model string, observations bigint, test_observations bigint, folds int, log_rmse double, baseline_log_rmse double, mape double, baseline_mape double, improvement double, mse_delta double, delta_low double, delta_high double, "
    "p_value double, adjusted_p double, smearing array<double>, bias double, calibrated_bias double, parameters string, final_parameters string, qualified boolean"
)


def evaluate(spark: SparkSession, source: str, *, before: date | None = None, min_train: int = 500, n: int = 3, replicates: int = 2000, trees: int = 150, models: tuple[str, ...] = MODELS) -> tuple[list[dict], Forecaster]:
    """The report's rows, and a forecaster of the champion: of those that qualify, or of all, the least error.

    before: only what lies before this date. Folds' models see strictly earlier dates; the last fifth of those chooses
    the parameters and gives the smearing factor. Against the medians: squared errors in logs, an IID bootstrap interval,
    IID sign flips, Holm over models; a model qualifies if the interval lies below 0 and its p-value under 5%.
    """
    rows = participation(spark, source)
    if before is not None:
        rows = rows.where(F.col("draw_date") < F.lit(before))
    rows = stage(rows.withColumn("jackpot_level", F.expm1(F.col("jackpot") * 20)), "observations")
    data = stage(folds(rows, min_train=min_train, n=n), "folds")
    marks = _inner(data, n)
    if not marks:
        raise ValueError("too few observations for a test after the training ones")
    days = sorted(r[0] for r in rows.select("draw_date").distinct().collect())  # the calendar
    end, split = days[-1] + timedelta(days=1), days[min(len(days) - 1, max(1, int(len(days) * 0.8)))]
    spans = [(k, day_of(first), day_of(s)) for k, first, s in marks] + [(0, day_of(end), day_of(split))]
    grid = _grid(models)
    made = {(text, d): make(d) for _, text, make in grid for _, first, s in spans for d in (first, s)}
    blocks = learners.observed(data, FEATURES, "y")
    if lines := [p for p in made.values() if isinstance(p, Linear)]:
        fit_linear(blocks, lines)
    if boosts := [p for p in made.values() if isinstance(p, Boosted)]:
        learners.fit_boosted(data.withColumn("n", F.lit(1)), FEATURES, boosts, trees=trees, data=blocks)
    asked = [(k, model, text, first, s) for k, first, s in spans for model, text, _ in grid]
    told = dict(zip(((k, text) for k, _, text, _, _ in asked), errors(blocks, [(made[text, s], s, first) for _, _, text, first, s in asked])))
    chosen = {}
    for model in models:
        for k, first, s in spans:
            texts = [text for m, text, _ in grid if m == model]
            text = texts[0] if s >= first else min(texts, key=lambda t: (round(told[k, t][0], 14), texts.index(t)))
            chosen[model, k] = (text, made[text, first], told[k, text][1] if s < first else 1.0)
    tests = [(k, *[chosen[m, k][1] for m in models]) for k, _, _ in marks]

    def predict(batches):
        for x in batches:
            d = np.array([day_of(v) for v in x["draw_date"]])
            v = x[list(FEATURES)].to_numpy(float)[:, None, :]
            out = np.full((len(x), len(models)), np.nan)
            for k, *ps in tests:
                use = (x["fold"] == k).to_numpy()
                if use.any():
                    for j, p in enumerate(ps):
                        out[use, j] = p.predict(d[use], v[use])[:, 0]
            yield pd.DataFrame({"draw_id": x["draw_id"], "draw_date": x["draw_date"], "game": x["game"], "fold": x["fold"], "y": x["y"], **{f"p{j}": out[:, j] for j in range(len(models))}})

    tested = data.where("fold > 0").mapInPandas(predict, "draw_id bigint, draw_date date, game string, fold int, y double, " + ", ".join(f"p{j} double" for j in range(len(models))))
    starts = [(k, first) for k, first, _ in marks]
    base = stage(baselines(rows, [*starts, (0, end)]), "baselines")
    at = base.select(F.col("fold").alias("_f"), F.col("game").alias("_g"), "weekday", "baseline")
    tested = tested.join(F.broadcast(at), (F.col("fold") == F.col("_f")) & (F.col("game") == F.col("_g")) & (F.weekday("draw_date") == F.col("weekday")))  # folds by games by weekdays
    order = Window.partitionBy("draw_date").orderBy("game", "draw_id")
    seen = tested.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c")).select(F.col("draw_date").alias("_d"), (F.sum("c").over(Window.orderBy("draw_date")) - F.col("c")).alias("_h"))  # the calendar
    tested = tested.withColumn("_r", F.row_number().over(order) - 1).join(seen, F.col("draw_date") == F.col("_d"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"p{j}").alias("p")) for j, m in enumerate(models)))).alias("m")
    long = tested.select("fold", "y", "baseline", (F.col("_h") + F.col("_r")).alias("i"), each).select("fold", "y", "baseline", "i", "m.model", "m.p")
    smear = F.lit(1.0)
    for (model, k), (_, _, factor) in chosen.items():
        smear = F.when((F.col("model") == model) & (F.col("fold") == k), F.lit(float(factor))).otherwise(smear)
    e, b = F.col("p") - F.col("y"), F.col("baseline") - F.col("y")
    long = stage(long.withColumn("delta", e * e - b * b).withColumn("smear", smear), "predicted")
    level = F.exp("y")
    stats = long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(b * b)).alias("base"), F.avg(F.abs(F.expm1(e))).alias("mape"), F.avg(F.abs(F.expm1(b))).alias("base_mape"), F.avg("delta").alias("delta"),
        (F.sum(F.exp("p")) / F.sum(level) - 1).alias("bias"), (F.sum(F.exp("p") * F.col("smear")) / F.sum(level) - 1).alias("calibrated"),
    )
    stats = {r["model"]: r for r in stats.collect()}
    tests_ = {r["model"]: r for r in resampled(long, ["model"], "delta", "i", replicates=replicates).collect()}
    adjusted = holm([tests_[m]["p_lower"] for m in models])
    count, out = rows.count(), []
    for j, m in enumerate(models):
        s, t = stats[m], tests_[m]
        out.append({
            "model": m, "observations": count, "test_observations": s["n"], "folds": len(marks), "log_rmse": s["rmse"], "baseline_log_rmse": s["base"], "mape": s["mape"], "baseline_mape": s["base_mape"], "improvement": 1 - s["rmse"] / s["base"],
            "mse_delta": s["delta"], "delta_low": t["low"], "delta_high": t["high"], "p_value": t["p_lower"], "adjusted_p": adjusted[j], "smearing": [round(float(chosen[m, k][2]), 9) for k, _, _ in marks], "bias": s["bias"], "calibrated_bias": s["calibrated"],
            "parameters": "; ".join(chosen[m, k][0] for k, _, _ in marks), "final_parameters": chosen[m, 0][0], "qualified": bool(t["high"] < 0 and adjusted[j] < 0.05),
        })
    qualified = [r for r in out if r["qualified"]]
    best = min(qualified or out, key=lambda r: r["log_rmse"])
    residual = F.col("y") - (F.col("p") if qualified else F.col("baseline"))
    levels = long.where(F.col("model") == best["model"]).select(F.exp(residual).alias("v"))
    mean = levels.agg(F.avg("v")).first()[0]
    at = exact_quantiles(levels, [], "v", [j / STEPS for j in range(STEPS + 1)]).orderBy("p").collect()
    medians = {(r["game"], r["weekday"]): r["baseline"] for r in base.where("fold = 0").collect()}
    spans_ = {r["game"]: (r["a"], r["b"]) for r in rows.groupBy("game").agg(F.min("jackpot_level").alias("a"), F.max("jackpot_level").alias("b")).collect()}
    forecaster = Forecaster(best, chosen[best["model"], 0][1] if qualified else None, chosen[best["model"], 0][2] if qualified else 1.0, medians, np.array([r["quantile"] for r in at]) / mean, spans_, count, days[-1])
    return out, forecaster


def walk(rows: DataFrame, befores: list[date], *, n: int = 2, replicates: int = 500, trees: int = 150, models: tuple[str, ...] = MODELS) -> dict[date, Forecaster]:
    """The forecasters of many dates at once, each from what lies before its date, in passes that all share.

    rows: participation. Of a date's observations half, or a hundred at least, are before its n folds, and its first
    date always; a date with no more than these is an error. Models are fitted and judged on sums by date and kind
    (calendar_cells), boosted ones each in one task (calendar_trees), which has bins of its own training dates; rows are read
    again for medians, resampling and quantiles alone, however many dates are asked.
    """
    counted = rows.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("y")).orderBy("draw_date").collect()  # the calendar
    days, run = [r["draw_date"] for r in counted], np.cumsum([r["c"] for r in counted])
    befores, spans = sorted(set(befores)), []
    for k, before in enumerate(befores):
        m = bisect_left(days, before)
        seen = int(run[m - 1]) if m else 0
        if m < 2 or seen <= (least := max(100, seen // 2)):
            raise ValueError(f"too few observations before {before}")
        parts = [p for p in np.array_split(np.arange(max(1, np.searchsorted(run, least, side="right")), m), n) if len(p)]
        spans += [(k, j, int(p[0]), int(p[-1]) + 1) for j, p in enumerate(parts, 1)] + [(k, 0, m, m)]
    cells, data = calendar_cells.gathered(rows, days, sum(r["y"] for r in counted) / float(run[-1]))
    # Of each date that a fold begins with: model -> its parameters, smearing, what it predicts up to last, and a predictor.
    last: dict[int, int] = {}
    for _, _, first, end in spans:
        last[first] = max(last.get(first, first), end)
    final = {first for _, j, first, _ in spans if not j}
    fitted = {"ridge": _ridges, "gradient_boosting": _boosted}
    chosen = {m: fitted[m](rows.sparkSession, cells, last, final, trees) for m in models}
    starts = sorted(last)
    medians = dict(zip(starts, calendar_cells.medians(cells, data, starts, OWN)))
    asked = []
    for k in range(len(befores)):
        own = [(first, end) for a, j, first, end in spans if a == k and j]
        base = np.concatenate([calendar_cells.baseline(cells, medians[first], slice(first, end)) for first, end in own])
        predicted = np.stack([np.concatenate([chosen[m][first][2][: end - first] for first, end in own]) for m in models])
        asked.append((own[0][0], base, predicted))
    champions = []
    for tested in calendar_cells.tests(cells, data, asked, replicates):
        adjusted = holm([t["p_lower"] for t in tested])
        qualified = [m for m in range(len(models)) if tested[m]["high"] < 0 and adjusted[m] < 0.05]
        best = min(qualified or range(len(models)), key=lambda m: tested[m]["rmse"])
        champions.append((best, tested[best]["rmse"], bool(qualified)))
    times = calendar_cells.multipliers(cells, data, [(z, p[m] if q else base) for (z, base, p), (m, _, q) in zip(asked, champions)], STEPS)
    out = {}
    for before, (m, rmse, qualified), own in zip(befores, champions, times):
        past = bisect_left(days, before)
        text, factor, _, predictor = chosen[models[m]][past]
        champion = {"model": models[m], "parameters": text, "log_rmse": rmse, "qualified": qualified}
        out[before] = Forecaster(champion, predictor if qualified else None, factor if qualified else 1.0, medians[past], own, {}, int(run[past - 1]), days[past - 1])
    return out


def _inner_first(first: int) -> int:
    """The first of the last fifth of the dates before the first-th; after one date alone there is none, and it is that date."""
    return max(1, int(first * 0.8))


def _ridges(spark: SparkSession, cells: calendar_cells.Cells, last: dict[int, int], final: set[int], trees: int) -> dict[int, tuple]:
    """Of each first date: the best penalty's text, smearing, predictions up to its last date, and a Linear if it is a final one's."""
    at = sorted({d for first in last for d in (first, _inner_first(first))})
    betas = dict(zip([(d, a) for d in at for a in ALPHAS], calendar_cells.ridges(cells, [(d, a) for d in at for a in ALPHAS])))
    value = lambda beta, dates: beta[0] + cells.x[dates] @ beta[1:]
    out = {}
    for first, end in last.items():
        split, alpha, factor = _inner_first(first), ALPHAS[0], 1.0
        if split < first:
            told = {a: cells.errors(value(betas[split, a], slice(split, first)), slice(split, first)) for a in ALPHAS}
            alpha = min(ALPHAS, key=lambda a: (round(told[a][0], 14), a))
            factor = told[alpha][1]
        beta = betas[first, alpha]
        predictor = Linear(0, alpha, np.r_[beta[0] + cells.centre, beta[1:]]) if first in final else None
        out[first] = (f"alpha={alpha:g}", factor, value(beta, slice(first, end)), predictor)
    return out


def _boosted(spark: SparkSession, cells: calendar_cells.Cells, last: dict[int, int], final: set[int], trees: int) -> dict[int, tuple]:
    """_ridges of boosted trees: a task for each first date tries the parameters and fits the best; it holds the cells."""
    firsts = sorted(last, reverse=True)
    days, kinds = cells.days, cells.x[0][:, [0, 12, 13, 14]]
    sums, tenth = np.stack([cells.n, cells.s]), cells.tenth
    q, e = cells.q, cells.e

    def model(upto: int, end: int, parameters: tuple):
        """A model of the dates before upto-th, and its predictions up to the end-th."""
        known = (np.arange(end) < upto)[:, None]
        rate, leaves, l2 = parameters
        return calendar_trees.grow(days[:end], kinds, sums[:, :end] * known, tenth[:, :end] * known, rate=rate, leaves=leaves, l2=l2, trees=trees)

    def fit(batches):
        for x in batches:
            for i in x["id"]:
                first = firsts[i]
                split, choice, factor = _inner_first(first), 0, 1.0
                if split < first:
                    told, n = [], sums[0, split:first]
                    for parameters in BOOSTS:
                        p = model(split, first, parameters)[1][split:]
                        told.append(((q[split:first] - 2 * p * sums[1, split:first] + p * p * n).sum() / n.sum(), (e[split:first] * np.exp(-p)).sum() / n.sum()))
                    choice = min(range(len(BOOSTS)), key=lambda j: (round(told[j][0], 14), j))
                    factor = told[choice][1]
                grown, p = model(first, last[first], BOOSTS[choice])
                yield pd.DataFrame({"first": [first], "choice": [choice], "factor": [factor], "p": [p[first:].tobytes()], "model": [pickle.dumps(grown) if first in final else None]})

    told = spark.range(0, len(firsts), 1, len(firsts)).mapInPandas(fit, "first int, choice int, factor double, p binary, model binary")
    out = {}
    for r in told.collect():  # a row a date asked, with its predictions of the calendar
        predictor = None
        if r["model"] is not None:
            predictor = pickle.loads(r["model"])
            predictor.base += cells.centre
        rate, leaves, l2 = BOOSTS[r["choice"]]
        out[r["first"]] = (f"rate={rate:g} leaves={leaves} l2={l2:g}", r["factor"], np.frombuffer(r["p"]).reshape(-1, len(cells.kinds)), predictor)
    return out


def told(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    names = [c.split()[0] for c in kind.split(", ")]
    out = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kind)
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def participation_report(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    """A row per model: errors against the medians', interval, p-values, biases, parameters."""
    return told(spark, evaluate(spark, sf_dir, **more)[0], REPORT)


QUERIES = {"participation_report": participation_report}

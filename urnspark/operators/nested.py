"""The nested backtest of all seven number models, with intervals, tests, a verdict, and a forecast of the next draw."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnspark.functions.nulls import upper_tail
from urnspark.functions.probability import holm
from urnspark.functions.projection import project
from urnspark.operators import learners
from urnspark.operators.backtests import ALPHAS, BLENDS, PLAIN, PRIORS, ROLLING, plan
from urnspark.operators.forecasts import DRAWN, EXPECTED, POOL, TIE, UNIFORM, WINDOWS, features
from urnspark.operators.learners import EPOCH, Boosted, Logistic, day_of, summed, unpacked
from urnspark.operators.quantiles import exact_quantiles
from urnspark.operators.resampling import together
from urnspark.plans import lift
from urnspark.plans.staging import stage

#: The parameters tried, and the models chosen by hits.
C = (0.01, 0.1, 1.0)
BOOSTS = ((0.03, 7, 1.0), (0.05, 15, 5.0))
MODELS = ("bayesian", "rolling_bayesian", "logistic", "gradient_boosting", "logistic_ranker", "ridge_ranker", "rolling_ridge_ranker")
RANKERS = ("logistic_ranker", "ridge_ranker", "rolling_ridge_ranker")
CLIP, LEVEL = 1e-12, 0.05
ROLLS = [PLAIN.index(f"frequency_{w}_delta") for w in WINDOWS]


@dataclass(frozen=True)
class Bayes:
    """Counts of all draws before, or of the last so many, smoothed by a prior's draws."""

    window: int
    prior: float

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        h, count = x[:, :, 0], x[:, :, 1]
        if self.window:
            h = np.minimum(h, self.window)
            count = (x[:, :, ROLLS[WINDOWS.index(self.window)]] + EXPECTED) * h
        return (count + self.prior * EXPECTED) / (h + self.prior)


@dataclass
class Ridge:
    """Hits over chance on columns centred within a draw; trains on dates before first."""

    first: int
    alpha: float
    rolling: bool
    beta: np.ndarray | None = None

    def design(self, x: np.ndarray) -> np.ndarray:
        x = x[:, :, ROLLS] if self.rolling else learners.with_numbers(x)
        return x - x.mean(axis=1, keepdims=True)

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        return EXPECTED + self.design(x) @ self.beta


def fit_ridge(data: DataFrame, models: list[Ridge]) -> list[Ridge]:
    """Ridge regressions of all dates and penalties from one pass of sums of products."""
    kinds = sorted({(m.rolling, m.first) for m in models})

    def sums(r):
        days, x, n, k = unpacked(r)
        for rolling in {kind[0] for kind in kinds}:
            a = Ridge(0, 0.0, rolling).design(x)
            for i, (own, first) in enumerate(kinds):
                use = days < first
                if own == rolling and use.any():
                    z = a[use].reshape(-1, a.shape[2])
                    yield i, np.c_[(z * np.repeat(n[use], POOL)[:, None]).T @ z, z.T @ (k[use] - n[use, None] * EXPECTED).ravel()].ravel()

    told = summed(data, sums)
    for m in models:
        size = len(WINDOWS) if m.rolling else len(PLAIN) + POOL
        s = told[kinds.index((m.rolling, m.first))].reshape(size, size + 1)
        m.beta = np.linalg.solve(s[:, :-1] + m.alpha * np.eye(size), s[:, -1])
    return models


def structure(p: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows of 49: what each number gives to the Top-5's hits, the numbers above the fifth place, those that tie there, and the places they share."""
    fifth = np.sort(p, axis=1)[:, [-DRAWN]]
    over, tie = p > fifth + TIE, np.abs(p - fifth) <= TIE
    left = DRAWN - over.sum(axis=1)
    return over + tie * (left / tie.sum(axis=1))[:, None], over.sum(axis=1), tie.sum(axis=1), left


def blend(p: np.ndarray, weight: float) -> np.ndarray:
    return EXPECTED + weight * (p - EXPECTED)


@dataclass(frozen=True)
class Trial:
    """A predictor with its blends on the dates from first up to (not including) last."""

    predictor: object
    blends: tuple[float, ...]
    first: int
    last: int


def score(data: DataFrame, trials: list[Trial]) -> list[list[tuple[float, float, float]]]:
    """Of each trial and blend: draws, mean Brier score, mean expected hits."""

    def sums(r):
        days, x, n, k = unpacked(r)
        for i, t in enumerate(trials):
            use = (days >= t.first) & (days < t.last)
            if use.any():
                raw = project(t.predictor.predict(days[use], x[use]))
                out = []
                for b in t.blends:
                    p = blend(raw, b)
                    credit = structure(p)[0]
                    out += [n[use].sum(), (n[use, None] * p**2 - 2 * p * k[use] + k[use]).sum() / POOL, (credit * k[use]).sum()]
                yield i, np.array(out)

    told = summed(data, sums)
    out = []
    for i, t in enumerate(trials):
        v = told[i].reshape(-1, 3) if i in told else np.full((len(t.blends), 3), np.nan)
        out.append([(a, b / a, c / a) for a, b, c in v])
    return out


@dataclass
class Chosen:
    model: str
    fold: int
    text: str
    predictor: object
    blend: float
    brier: float
    hits: float


def grids(models: tuple[str, ...]) -> list[tuple[str, str, object]]:
    """(model, parameters in words, what makes a predictor that trains before a day) of all that is tried."""
    out = []
    for p in PRIORS:
        out.append(("bayesian", f"prior={p:g}", lambda first, p=p: Bayes(0, p)))
    for w, p in ROLLING:
        out.append(("rolling_bayesian", f"window={w} prior={p:g}", lambda first, w=w, p=p: Bayes(w, p)))
    for name in ("logistic", "logistic_ranker"):
        for c in C:
            out.append((name, f"c={c:g}", lambda first, c=c: Logistic(first, c)))
    for rate, leaves, l2 in BOOSTS:
        out.append(("gradient_boosting", f"rate={rate:g} leaves={leaves} l2={l2:g}", lambda first, a=rate, b=leaves, c=l2: Boosted(first, a, b, c)))
    for name, rolling in (("ridge_ranker", False), ("rolling_ridge_ranker", True)):
        for a in ALPHAS:
            out.append((name, f"alpha={a:g}", lambda first, a=a, rolling=rolling: Ridge(first, a, rolling)))
    return [g for g in out if g[0] in models]


def choose(cells: DataFrame, *, models: tuple[str, ...], min_train: int, outer: int, trees: int) -> tuple[DataFrame, list[Chosen], int, int]:
    """Blocks; each model's choice for each fold and, as fold outer + 1, for after all dates; the first test day and the day after the last.

    All predictors of all folds are fitted together, for the training dates before the inner split and for all dates
    before the test, so a pass over the data serves every model. The last fifth of a fold's training dates chooses.
    """
    data = learners.blocks(cells, PLAIN)
    folds = plan(cells, min_train=min_train, outer=outer)
    if not folds:
        raise ValueError("too few draws for a test after the training ones")
    days = sorted(r["draw_date"] for r in cells.select("draw_date").distinct().collect())  # the calendar
    spans = [(f, day_of(first), day_of(last) + 1, day_of(split)) for f, first, last, split in folds]
    end = day_of(days[-1]) + 1
    spans.append((outer + 1, end, end, day_of(days[max(1, int(len(days) * 0.8))])))
    made: dict[tuple, object] = {}
    for model, text, make in grids(models):
        for _, first, _, split in spans:
            for day in (first, split):
                # Rankers share the fits of the models they rank by.
                made.setdefault((model.removesuffix("_ranker") if model == "logistic_ranker" else model, text, day), make(day))
    of = lambda kind: [p for p in made.values() if isinstance(p, kind)]
    if of(Ridge):
        fit_ridge(data, of(Ridge))
    if of(Logistic):
        learners.fit_logistic(data, of(Logistic))
    if of(Boosted):
        learners.fit_boosted(cells, PLAIN, of(Boosted), trees=trees, data=data)
    get = lambda model, text, day: made[model.removesuffix("_ranker") if model == "logistic_ranker" else model, text, day]
    trials, which = [], []
    for fold, first, _, split in spans:
        for model, text, _ in grids(models):
            blends = (1.0,) if model in RANKERS else BLENDS
            trials.append(Trial(get(model, text, split), blends, split, first))
            which.append((fold, model, text, blends))
    best: dict[tuple[int, str], tuple] = {}
    for (fold, model, text, blends), told in zip(which, score(data, trials)):
        for b, (_, brier, hits) in zip(blends, told):
            brier_r, hits_r = round(brier, 14), -round(hits, 12)
            goal = (hits_r, brier_r) if model in RANKERS else (brier_r, hits_r)
            # Equal goals: the one tried first.
            if (fold, model) not in best or goal < best[fold, model][0]:
                best[fold, model] = (goal, text, b, brier, hits)
    chosen = []
    for fold, first, _, _ in spans:
        for model in models:
            _, text, b, brier, hits = best[fold, model]
            chosen.append(Chosen(model, fold, text, get(model, text, first), b, brier, hits))
    return data, chosen, spans[0][1], end


PREDICTED = "model string, fold int, draw_date date, game string, n double, ps array<double>, ks array<double>, credit array<double>, above int, tied int, places int"


def predictions(data: DataFrame, chosen: list[Chosen], spans: dict[int, tuple[int, int]]) -> DataFrame:
    """A row per model, date and game tested: the 49 probabilities, the draws with each number, and the Top-5's structure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                days, v, n, k = unpacked(r)
                games = np.asarray(r.games, dtype=object)
                for c in chosen:
                    first, last = spans[c.fold]
                    use = (days >= first) & (days < last)
                    if use.any():
                        p = blend(project(c.predictor.predict(days[use], v[use])), c.blend)
                        credit, above, tied, left = structure(p)
                        at = [date.fromordinal(EPOCH.toordinal() + int(d)) for d in days[use]]
                        yield pd.DataFrame({"model": c.model, "fold": c.fold, "draw_date": at, "game": games[use], "n": n[use], "ps": list(p), "ks": list(k[use]), "credit": list(credit), "above": above.astype("int32"), "tied": tied.astype("int32"), "places": left.astype("int32")})

    return stage(data.mapInPandas(run, PREDICTED), "predictions")


def by_draw(spark: SparkSession, source: str, predicted: DataFrame) -> DataFrame:
    """model, i (place among the tested draws), delta (Brier score over chance), uplift (hits over chance), loss of each draw."""
    placed = lift.table(spark, source, "placed")
    total = lambda f: F.aggregate(F.col("numbers"), F.lit(0.0), lambda a, j: a + f(F.element_at("ps", j.cast("int")), F.element_at("credit", j.cast("int"))))
    clipped = lambda p: F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    squares = F.aggregate("ps", F.lit(0.0), lambda a, p: a + p * p)
    misses = F.aggregate("ps", F.lit(0.0), lambda a, p: a - F.log(1 - clipped(p)))
    rows = placed.join(predicted, ["draw_date", "game"])
    rows = rows.select(
        "model", "idx",
        ((squares - 2 * total(lambda p, c: p) + DRAWN) / POOL - UNIFORM).alias("delta"),
        (total(lambda p, c: c) - DRAWN * EXPECTED).alias("uplift"),
        ((misses - total(lambda p, c: F.log(clipped(p)) - F.log(1 - clipped(p)))) / POOL).alias("loss"),
    )
    least = rows.agg(F.min("idx").alias("_least"))
    return stage(rows.crossJoin(F.broadcast(least)).select("model", (F.col("idx") - F.col("_least")).alias("i"), "delta", "uplift", "loss"), "scored-draws")  # least: one row


def calibration(predicted: DataFrame, *, bins: int = 10) -> dict[str, float]:
    """Of each model the mean distance of forecast and frequency over bins by quantiles of all its forecasts; equal edges once."""
    long = predicted.select("model", "n", F.explode(F.arrays_zip("ps", "ks")).alias("e")).select("model", F.col("e.ps").alias("p"), F.col("n").cast("long").alias("n"), F.col("e.ks").alias("k"))
    at = exact_quantiles(long, ["model"], "p", [j / bins for j in range(bins + 1)], weight="n")
    edges = at.groupBy("model").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))  # eleven values
    bin_ = F.greatest(F.lit(0), F.least(F.size("edges") - 2, F.size(F.filter("edges", lambda e: e < F.col("p"))) - 1))
    binned = long.join(F.broadcast(edges), "model").groupBy("model", F.when(F.size("edges") > 1, bin_).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("p"), F.sum("k").alias("k"))
    error = F.when(F.max("bin").isNull(), 0.0).otherwise(F.sum(F.abs(F.col("p") - F.col("k"))) / F.sum("n"))
    return {r["model"]: r["e"] for r in binned.groupBy("model").agg(error.alias("e")).collect()}


REPORT = (
    "model string, folds int, test_draws bigint, brier double, brier_delta double, delta_low double, delta_high double, p_value double, adjusted_p double, log_loss double, calibration_error double, "
    "top5_hits double, top5_uplift double, uplift_low double, uplift_high double, top5_p double, adjusted_top5_p double, top5_p_exact boolean, validation_brier double, validation_hits double, tied_draws bigint, parameters string, final_parameters string, qualification string, qualified boolean"
)


@dataclass
class Outcome:
    """rows: of the report, a dict per model; finals: each model's choice for after all dates."""

    rows: list[dict]
    finals: dict[str, Chosen]


def evaluate(spark: SparkSession, source: str, *, models: tuple[str, ...] = MODELS, min_train: int = 500, outer: int = 3, replicates: int = 2000, block: int = 12, trees: int = 100) -> Outcome:
    """The whole backtest. Per draw, forecasts of strictly earlier dates only; per model, over all folds' tests:

    mean Brier score, log loss, calibration, expected Top-5 hits; 95% block-bootstrap intervals of the Brier score and the
    hits over chance; a block sign test; the exact chance of as many hits under uniform draws; both families of p-values
    adjusted together by Holm. A model qualifies by probability if its interval is below 0, by ranking if its hits' interval is above 0,
    each with an adjusted p-value under 5%.
    """
    games = lift.table(spark, source, "draws").select("draw_date", "game").distinct()
    n = lift.table(spark, source, "draws").groupBy("draw_date", "game").agg(F.count(F.lit(1)).alias("n"))
    k = lift.table(spark, source, "draws").select("draw_date", "game", F.explode("numbers").alias("number")).groupBy("draw_date", "game", "number").agg(F.count(F.lit(1)).alias("k"))
    cells = stage(features(spark, source, games=games).join(n, ["draw_date", "game"]).join(k, ["draw_date", "game", "number"], "left").na.fill(0, ["k"]), "cells")
    data, chosen, _, end = choose(cells, models=models, min_train=min_train, outer=outer, trees=trees)
    tested = [c for c in chosen if c.fold <= outer]
    marks = sorted({day_of(f) for _, f, _, _ in plan(cells, min_train=min_train, outer=outer)}) + [end]
    spans = {fold: (marks[j], marks[j + 1]) for j, fold in enumerate(sorted({c.fold for c in tested}))}
    predicted = predictions(data, tested, spans)
    draws = by_draw(spark, source, predicted)
    means = {r["model"]: r for r in draws.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("delta"), F.avg("uplift").alias("uplift"), F.sum("uplift").alias("sum"), F.avg("loss").alias("loss")).collect()}
    both = together(draws, ["model"], ["delta", "uplift"], "i", replicates=replicates, block=block).collect()
    deltas, hits = ({r["model"]: r for r in both if r["value"] == c} for c in ("delta", "uplift"))
    shapes: dict[str, dict] = {}
    for r in predicted.groupBy("model", "above", "tied", "places").agg(F.sum("n").alias("n")).collect():  # at most 49 ties by five places
        shapes.setdefault(r["model"], {})[r["above"], r["tied"], r["places"]] = int(r["n"])
    errors = calibration(predicted)
    tails = {m: upper_tail(s, means[m]["sum"] + means[m]["n"] * DRAWN * EXPECTED) for m, s in shapes.items()}
    adjusted = holm([deltas[m]["p_lower"] for m in models] + [tails[m][0] for m in models])
    rows = []
    for i, m in enumerate(models):
        own = [c for c in tested if c.model == m]
        final = next(c for c in chosen if c.model == m and c.fold > outer)
        told, d, h = means[m], deltas[m], hits[m]
        by_p, by_rank = d["high"] < 0 and adjusted[i] < LEVEL, h["low"] > 0 and adjusted[len(models) + i] < LEVEL
        words = lambda c: c.text + ("" if c.model in RANKERS else f" blend={c.blend:g}")
        rows.append({
            "model": m, "folds": len(own), "test_draws": told["n"], "brier": told["delta"] + UNIFORM, "brier_delta": told["delta"], "delta_low": d["low"], "delta_high": d["high"], "p_value": d["p_lower"], "adjusted_p": adjusted[i],
            "log_loss": told["loss"], "calibration_error": errors[m], "top5_hits": told["uplift"] + DRAWN * EXPECTED, "top5_uplift": told["uplift"], "uplift_low": h["low"], "uplift_high": h["high"], "top5_p": tails[m][0], "adjusted_top5_p": adjusted[len(models) + i], "top5_p_exact": bool(tails[m][1]),
            "validation_brier": float(np.mean([c.brier for c in own])), "validation_hits": float(np.mean([c.hits for c in own])), "tied_draws": sum(v for (_, tied, left), v in shapes[m].items() if tied > left),
            "parameters": "; ".join(words(c) for c in own), "final_parameters": words(final), "qualification": {(True, True): "probability_and_ranking", (True, False): "probability", (False, True): "ranking", (False, False): "none"}[bool(by_p), bool(by_rank)], "qualified": bool(by_p or by_rank),
        })
    return Outcome(rows, {c.model: c for c in chosen if c.fold > outer})


def _told(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    names = [c.split()[0] for c in kind.split(", ")]
    out = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], kind)
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def nested_report(spark: SparkSession, sf_dir: str, *, game: str | None = None, as_of: date | None = None, **more) -> DataFrame:
    """A row per model. game, as_of: of the draws of one game, or up to a date, alone, features included."""
    source = lift.only(spark, sf_dir, game=game, as_of=as_of) if game or as_of else sf_dir
    return _told(spark, evaluate(spark, source, **more).rows, REPORT)


NEXT = (
    "status string, game string, target_date string, training_last_date string, model string, parameters string, numbers array<int>, certain array<int>, tied_candidates array<int>, tied_slots int, tied boolean, "
    "probabilities array<double>, probability_sum double, spread double, criterion string, validation_brier double, validation_hits double, qualification string"
)


def champion(rows: list[dict]) -> tuple[dict, str]:
    """The model that forecasts, and by what: of those that qualify by ranking (or of all, where none qualifies) the most hits in
    inner validation; else the least Brier score there. Tests don't choose, as they are told of the one chosen."""
    qualified = [r for r in rows if r["qualified"]]
    ranking = [r for r in qualified if "ranking" in r["qualification"]]
    if qualified and not ranking:
        return min(qualified, key=lambda r: r["validation_brier"]), "validation_brier"
    return max(ranking or rows, key=lambda r: r["validation_hits"]), "validation_hits"


def next_draw(spark: SparkSession, sf_dir: str, *, game: str = "loto", target: date | None = None, force: bool = False, **more) -> DataFrame:
    """One row: the forecast of a game's draw on a date after all its draws (the day after the last, if not given).

    Without a model that qualifies the status is abstention, with the target and no numbers, unless force asks for the
    best in inner validation (forced_experimental). A forecast of 49 equal probabilities is an abstention too. Ties at
    the fifth place go to smaller numbers, and are told.
    """
    plain = lift.only(spark, sf_dir, game=game)
    last = lift.table(spark, plain, "draws").agg(F.max("draw_date")).first()[0]
    if last is None:
        raise ValueError(f"no draws of {game}")
    target = target or last + timedelta(days=1)
    if target <= last:
        raise ValueError("the target must lie after the last draw")
    out = evaluate(spark, plain, **more)
    row = dict.fromkeys((c.split()[0] for c in NEXT.split(", ")))
    row |= {"game": game, "target_date": str(target), "training_last_date": str(last), "status": "abstention"}
    if any(r["qualified"] for r in out.rows) or force:
        best, by = champion(out.rows)
        c = out.finals[best["model"]]
        source = lift.only(spark, sf_dir, game=game, target=target)
        games = spark.createDataFrame([(target, game)], "draw_date date, game string")
        rows = features(spark, source, games=games).orderBy("number").collect()  # 49 rows
        x = np.array([[[r[name] for name in PLAIN] for r in rows]], dtype=float)
        p = blend(project(c.predictor.predict(np.array([day_of(target)]), x)), c.blend)
        credit, _, tied, left = structure(p)
        row |= {"model": c.model, "parameters": best["final_parameters"], "spread": float(np.ptp(p)), "criterion": by, "validation_brier": best["validation_brier"], "validation_hits": best["validation_hits"], "qualification": best["qualification"]}
        if np.ptp(p) >= TIE:
            top = sorted(int(j) + 1 for j in np.argsort(-p[0], kind="stable")[:DRAWN])
            share = left[0] / tied[0]
            full = p[0] > np.sort(p[0])[-DRAWN] + TIE
            row |= {
                "status": "qualified" if best["qualified"] else "forced_experimental", "numbers": top, "certain": [int(j) + 1 for j in np.flatnonzero(full)], "tied_candidates": [int(j) + 1 for j in np.flatnonzero(~full & (np.abs(credit[0] - share) < 1e-12))],
                "tied_slots": int(left[0]), "tied": bool(tied[0] > left[0]), "probabilities": [round(float(v), 9) for v in p[0]], "probability_sum": float(p.sum()),
            }
    return _told(spark, [row], NEXT)


#: The forecast is registered with the models that take few passes; next_draw(models=MODELS) has boosted trees too.
QUICK = tuple(m for m in MODELS if m != "gradient_boosting")
QUERIES = {"nested_report": nested_report, "next_draw": lambda spark, sf_dir: next_draw(spark, sf_dir, force=True, models=QUICK)}

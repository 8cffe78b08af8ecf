"""Walk-forward test of what a ticket is worth: every refit forecasts its next dates, against the value seen afterwards."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.probability import TOTAL, rank_probability
from urnspark.operators import participation
from urnspark.operators.calendar_cells import features
from urnspark.operators.learners import day_of
from urnspark.operators.resampling import bits32, together
from urnspark.operators.value import PRICES, TARGET, history, nearest, share, windows
from urnspark.plans import lift
from urnspark.plans.staging import stage

#: Least draws whose nine ranks pay that a refit needs.
LEAST = 5
ERRORS = (
    "observations bigint, mean_predicted double, mean_observed double, bias double, mae double, rmse double, naive_bias double, naive_mae double, naive_rmse double, improvement double, "
    "coverage double, width double, eligible bigint, positive bigint, false_positive bigint, false_negative bigint"
)
REPORT = (
    f"period int, fold int, training_last_date string, first_test_date string, last_test_date string, participation_model string, payout_window bigint, tail double, {ERRORS}, "
    "refits int, better_periods int, mae_delta double, delta_low double, delta_high double, p_value double, coverage_low double, coverage_high double, better_than_naive boolean, coverage_compatible boolean, qualified boolean"
)


def refits(spark: SparkSession, source: str, rows: DataFrame, observations: DataFrame, *, game: str, min_train: int, folds: int, interval: int) -> list[dict]:
    """Each refit: key, fold, first (date), end (the first date after its own), last (of its training), n, lower, code, known.

    The dates after min_train observations of any game, and after two dates with more than a hundred, which the forecaster
    needs, are cut into folds, and these into runs of interval dates. first:
    the game's first draw there; n, lower, code, known: the draws before, their mean of lower_ev, the mean of their pools above 0,
    and how many pools they have. Runs without a draw, or with too few draws before, are left out. A row a date on the driver.
    """
    counted = observations.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c")).orderBy("draw_date").collect()
    dates, run = [r["draw_date"] for r in counted], np.cumsum([r["c"] for r in counted])
    late = dates[max(2, int(np.searchsorted(run, min_train, side="right")), int(np.searchsorted(run, 100, side="right")) + 1) :]
    sums = (F.count(F.lit(1)), F.sum("lower_ev"), F.count("code"), F.sum("code"), F.count("pool"))
    own = rows.groupBy("draw_date").agg(*(s.cast("double").alias(f"s{i}") for i, s in enumerate(sums))).orderBy("draw_date").fillna(0.0).collect()
    days = [r["draw_date"] for r in own]
    totals = np.vstack([np.zeros(len(sums)), np.cumsum(np.array([r[1:] for r in own], dtype=float).reshape(-1, len(sums)), axis=0)])
    every = sorted(r[0] for r in lift.table(spark, source, "draws").where("draw_date IS NOT NULL").select("draw_date").distinct().collect())
    out = []
    for fold, part in enumerate(np.array_split(np.arange(len(late)), folds), 1):
        for at in range(0, len(part), interval):
            batch = [late[i] for i in part[at : at + interval]]
            i = bisect_left(days, batch[0])
            if i == len(days) or days[i] > batch[-1]:
                continue
            n, lower, codes, code, known = totals[i]
            if n < LEAST:
                continue
            out.append({"key": str(len(out)), "fold": fold, "first": days[i], "dates": batch, "last": every[bisect_left(every, days[i]) - 1], "n": int(n), "lower": lower / n, "code": code / codes if codes else 0.0, "known": int(known)})
    return out


def _samples(rows: DataFrame, found: list[dict], samples: int, seed: int) -> None:
    """Gives each refit the lower values and pools that its samples take: at places of its window, by hash; zeros if it has no pool.

    Only rows at these places leave their tasks: samples rows a refit.
    """
    spark, runs = rows.sparkSession, np.arange(samples)
    begins = spark.createDataFrame(sorted({r["n"] - r["window"] for r in found}), "bigint").withColumnRenamed("value", "b")
    known = {r["i"]: r["known"] for r in rows.join(F.broadcast(begins), F.col("i") == F.col("b")).select("i", "known").collect()}
    for k, r in enumerate(found):
        take = lambda begin, n, salt: begin + (bits32(np.array([seed]), runs + k * samples, salt)[0].astype(np.int64) * n >> 32)
        begin = known[r["n"] - r["window"]]
        r["at"] = take(r["n"] - r["window"], r["window"], 41)
        r["pool_at"] = take(begin, r["known"] - begin, 42) if r["known"] > begin else None
    held = {}
    for name, place, value, of in (("at", "i", "lower_ev", rows), ("pool_at", "known", "pool", rows.where("pool IS NOT NULL"))):
        places = sorted({int(a) for r in found if r[name] is not None for a in r[name]})
        table = spark.createDataFrame([(a,) for a in places], "a bigint")
        held[name] = {r[0]: r[1] for r in of.join(F.broadcast(table), F.col(place) == F.col("a")).select("a", value).collect()}
    for r in found:
        r["lowers"] = np.array([held["at"][int(a)] for a in r.pop("at")], dtype=float)
        at = r.pop("pool_at")
        r["pools"] = np.zeros(samples) if at is None else np.array([held["pool_at"][int(a)] for a in at], dtype=float)


EVALUATED = "key string, draw_id bigint, draw_date date, predicted double, naive double, observed double, low double, high double"


#: Draws whose samples a task holds at once.
AT_ONCE = 128


def evaluated(rows: DataFrame, observations: DataFrame, found: list[dict], forecasters: dict, *, samples: int, seed: int) -> DataFrame:
    """EVALUATED of each draw of the refits' dates with a jackpot and a count of tickets. A map over the draws.

    predicted: mean lower ranks, mean pool over the tickets forecast, and the jackpot's expected share. naive: lower ranks and
    the whole jackpot. low, high: the nearest quantiles, at the refit's tail, of as many samples, each a lower value and a
    pool of the window and a multiplier of the tickets. A refit's draws have its samples of the window in common; multipliers are the
    draw's own. observed: with the draw's own lower value, tickets and pool (the mean one, if unknown). The forecasts
    of all of a refit's dates and kinds (a game with a jackpot) are made before.
    """
    spark, first, runs = rows.sparkSession, rank_probability(1), np.arange(samples)
    dates = spark.createDataFrame([(r["key"], d, i) for r in found for i, d in enumerate(r["dates"])], "key string, d date, day int")  # the calendar
    kinds = observations.select("game", "jackpot", "jackpot_level").distinct().collect()  # few: the lifting's payouts
    table = spark.createDataFrame([(r["game"], r["jackpot"], i) for i, r in enumerate(kinds)], "g string, j double, kind int")
    told, medians, jackpots = {r["key"]: r for r in found}, {}, np.array([r["jackpot_level"] for r in kinds], dtype=float)
    for r in found:
        days = np.repeat([day_of(d) for d in r["dates"]], len(kinds))
        games, sizes = (np.tile([k[c] for k in kinds], len(r["dates"])) for c in ("game", "jackpot"))
        medians[r["key"]] = forecasters[r["first"]].log_medians(days, games, features(days, games, sizes)).reshape(-1, len(kinds))

    def values(batches):
        for x in batches:
            for key, part in x.groupby("key"):
                r, f = told[key], forecasters[told[key]["first"]]
                low, high = (nearest(samples, p) for p in (r["tail"], 1 - r["tail"]))
                for a in range(0, len(part), AT_ONCE):
                    own = part.iloc[a : a + AT_ONCE]
                    ids, kind, lower = own["draw_id"].to_numpy(), own["kind"].to_numpy(), own["lower_ev"].to_numpy(float)
                    n, tickets, jackpot = np.exp(medians[key][own["day"].to_numpy(), kind]) * f.smearing, np.exp(own["y"].to_numpy(float)), jackpots[kind]
                    sold = n[:, None] * f.draw((bits32(ids, runs, 43 + seed) + 0.5) / 2**32)
                    drawn = r["lowers"] + r["pools"] / sold + (first * jackpot)[:, None] * share(sold / TOTAL)
                    drawn.sort(axis=1)
                    pool = own["pool"].to_numpy(float)
                    pool = np.where(np.isnan(pool), r["code"], pool)
                    yield pd.DataFrame({
                        "key": key, "draw_id": ids, "draw_date": own["draw_date"].to_numpy(), "predicted": r["lower"] + r["code"] / n + first * jackpot * share(n / TOTAL), "naive": r["lower"] + first * jackpot,
                        "observed": lower + pool / tickets + first * jackpot * share(tickets / TOTAL), "low": drawn[:, low], "high": drawn[:, high],
                    })

    own = rows.join(F.broadcast(dates), F.col("draw_date") == F.col("d")).select("key", "day", F.col("draw_id").alias("_id"), "lower_ev", "pool")
    seen = observations.join(F.broadcast(table), (F.col("game") == F.col("g")) & (F.col("jackpot") == F.col("j"))).select("draw_id", "draw_date", "y", "kind")
    met = own.join(seen, F.col("_id") == F.col("draw_id"))
    return stage(met.select("key", "day", "draw_id", "draw_date", "y", "kind", "lower_ev", "pool").mapInPandas(values, EVALUATED), "evaluated")


def _errors(price: float) -> list:
    error, naive = F.col("predicted") - F.col("observed"), F.col("naive") - F.col("observed")
    bet, won = F.col("low") > price, F.col("observed") > price
    n = lambda c: F.sum(c.cast("long"))
    return [
        F.count(F.lit(1)).alias("observations"), F.avg("predicted").alias("mean_predicted"), F.avg("observed").alias("mean_observed"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(naive).alias("naive_bias"), F.avg(F.abs(naive)).alias("naive_mae"), F.sqrt(F.avg(naive * naive)).alias("naive_rmse"), (1 - F.avg(F.abs(error)) / F.avg(F.abs(naive))).alias("improvement"),
        F.avg(((F.col("low") <= F.col("observed")) & (F.col("observed") <= F.col("high"))).cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"),
        n(bet).alias("eligible"), n(won).alias("positive"), n(bet & ~won).alias("false_positive"), n(~bet & won).alias("false_negative"),
        F.min("draw_date").cast("string").alias("first_test_date"), F.max("draw_date").cast("string").alias("last_test_date"),
    ]


def value_backtest(spark: SparkSession, source: str, *, game: str = "loto", min_train: int = 500, folds: int = 3, samples: int = 500, seed: int = 0, block: int = 12, interval: int = 52, **more) -> DataFrame:
    """REPORT: a row for each refit (period from 1, by date) and one for all of them (period 0), of one game.

    A refit uses strictly earlier dates alone, and forecasts the draws of the next interval dates of its fold. The row of
    all has the mean difference of absolute errors against the naive value, its moving-block bootstrap interval and block
    sign test, and an interval of the coverage that holds the coverage itself. qualified: errors lie below the naive ones
    (interval and p under 5%) and the coverage's interval holds the target. No draw to evaluate is an error.
    more: of participation.walk, such as models.
    """
    if game not in PRICES:
        raise ValueError(f"unknown game: {game}")
    if min_train < 200 or folds < 2 or samples < 100 or block < 1 or interval < 1:
        raise ValueError("at least 200 observations, 2 folds, 100 samples, blocks and intervals of 1")
    seen = participation.participation(spark, source)
    seen = stage(seen.withColumn("jackpot_level", F.expm1(F.col("jackpot") * 20)), "observations")
    rows = history(spark, source).where(F.col("game") == game)
    found = refits(spark, source, rows, seen, game=game, min_train=min_train, folds=folds, interval=interval)
    if not found:
        raise ValueError(f"no draw of {game} to evaluate")
    forecasters = participation.walk(seen, [r["first"] for r in found], replicates=samples, **more)
    chosen = windows(rows, [(r["key"], game, r["n"]) for r in found])
    for r in found:
        r |= chosen[r["key"]]
    _samples(rows, found, samples, seed)
    draws = evaluated(rows, seen, found, forecasters, samples=samples, seed=seed)
    price = PRICES[game]
    periods = {r["key"]: r.asDict() for r in draws.groupBy("key").agg(*_errors(price)).collect()}
    if not periods:
        raise ValueError(f"no draw of {game} to evaluate")
    days = draws.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c")).select(F.col("draw_date").alias("d"), (F.sum("c").over(Window.orderBy("draw_date")) - F.col("c")).alias("h"))  # the calendar
    placed = draws.withColumn("r", F.row_number().over(Window.partitionBy("draw_date").orderBy("draw_id")) - 1).join(F.broadcast(days), F.col("draw_date") == F.col("d"))
    delta = F.abs(F.col("predicted") - F.col("observed")) - F.abs(F.col("naive") - F.col("observed"))
    inside = ((F.col("low") <= F.col("observed")) & (F.col("observed") <= F.col("high"))).cast("double")
    units = placed.select((F.col("h") + F.col("r")).alias("i"), delta.alias("delta"), inside.alias("coverage"))
    tests = {r["value"]: r for r in together(units, [], ["delta", "coverage"], "i", replicates=samples, block=block).collect()}
    names = [c.split()[0] for c in REPORT.split(", ")]
    out = []
    for r in found:
        if r["key"] in periods:
            champion = forecasters[r["first"]].champion
            model = champion["model"] if champion["qualified"] else "baseline"
            out.append({"period": len(out) + 1, "fold": r["fold"], "training_last_date": str(r["last"]), "participation_model": model, "payout_window": r["window"], "tail": r["tail"], **periods[r["key"]]})
    whole = draws.agg(*_errors(price)).first().asDict()
    d, c = tests["delta"], tests["coverage"]
    low, high = min(whole["coverage"], c["low"]), max(whole["coverage"], c["high"])
    better, fits = bool(d["high"] < 0 and d["p_lower"] < 0.05), bool(low <= TARGET <= high)
    whole |= {
        "period": 0, "refits": len(out), "better_periods": sum(p["mae"] < p["naive_mae"] for p in out), "mae_delta": d["observed"], "delta_low": d["low"], "delta_high": d["high"], "p_value": d["p_lower"],
        "coverage_low": low, "coverage_high": high, "better_than_naive": better, "coverage_compatible": fits, "qualified": better and fits,
    }
    table = spark.createDataFrame([tuple(r.get(c) for c in names) for r in [whole, *out]], REPORT)
    return table.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes))


QUERIES = {"value_backtest": value_backtest}

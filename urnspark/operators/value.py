"""What a ticket is worth: lower ranks, codes and a shared jackpot, with an interval and break-even jackpots, for all games at once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.probability import TOTAL, rank_probability
from urnspark.operators import participation
from urnspark.operators.draws import LOWER
from urnspark.operators.models import _base
from urnspark.operators.participation import Forecaster
from urnspark.operators.ranks import added, ranked
from urnspark.operators.resampling import bits32
from urnspark.plans import lift
from urnspark.plans.staging import stage

#: Ticket prices by game; the windows and tails that an interval is chosen from; its coverage.
PRICES = {"loto": 2.2, "super_loto": 3.0, "grand_loto": 5.0}
WINDOWS, TAILS, TARGET = (50, 100, 250), (0.01, 0.025, 0.05), 0.95
#: Jackpots that a break-even is looked for up to.
MOST = 1e9


def history(spark: SparkSession, source: str, before: date | None = None) -> DataFrame:
    """draw_id, game, i, draw_date, lower_ev, pool, code, known: the draws whose nine ranks all pay, by place in their game.

    lower_ev: ranks 2 to 9 at their odds. pool: what the draw's codes paid, null if unknown; code: that, if above 0; known:
    the game's pools, nulls aside, before this draw.
    """
    rows = lift.run(
        spark,
        source,
        _base(
            f"low AS (SELECT draw_id, sum(CASE WHEN rank > 1 THEN {LOWER} * payout END) AS lower_ev FROM prizes WHERE payout IS NOT NULL GROUP BY draw_id HAVING bit_or(1 << rank) = {sum(1 << r for r in range(1, 10))})",
        )
        + """ SELECT d.draw_id, draw_date, game, lower_ev, CASE WHEN d.draw_id % 6 = 0 THEN NULL ELSE (d.draw_id % 11) * (20000e0 + tp % 1000) END AS pool FROM draws d JOIN low ON d.draw_id = low.draw_id""",
    )
    if before is not None:
        rows = rows.where(F.col("draw_date") < F.lit(before))
    days = rows.groupBy("game", "draw_date").agg(F.count(F.lit(1)).alias("n"), F.count("pool").alias("c"))  # the calendar
    before_ = Window.partitionBy("game").orderBy("draw_date")
    days = days.select(F.col("game").alias("g"), F.col("draw_date").alias("d"), *((F.sum(c).over(before_) - F.col(c)).alias(f"h{c}") for c in "nc"))
    within = Window.partitionBy("game", "draw_date").orderBy("draw_id")
    own = F.col("pool").isNotNull().cast("long")
    rows = rows.withColumns({"r": F.row_number().over(within) - 1, "k": F.sum(own).over(within.rowsBetween(Window.unboundedPreceding, 0)) - own})
    rows = rows.join(days, (F.col("game") == F.col("g")) & (F.col("draw_date") == F.col("d")))
    code = F.when(F.col("pool") > 0, F.col("pool")).alias("code")
    return stage(rows.select("draw_id", "game", (F.col("hn") + F.col("r")).alias("i"), "draw_date", "lower_ev", "pool", code, (F.col("hc") + F.col("k")).alias("known")), "value-history")


def nearest(n: int, p: float) -> int:
    """The place of a quantile among n values in order, halves going to the even one."""
    return round(p * (n - 1))


def windows(rows: DataFrame, asked: list[tuple[str, str, int]]) -> dict[str, dict]:
    """Of each (key, game, n), from the game's first n draws: window, tail, coverage.

    With fewer than twenty draws all of them are the window, with the tail 0.025 and a coverage of 1. Else the first four
    fifths give, for each window of their last draws and each tail, an interval of lower_ev; the one whose share of the
    last fifth is nearest the target, then the narrowest, is chosen. The intervals' ends are exact; all keys share each pass.
    """
    out = {key: {"window": n, "tail": 0.025, "coverage": 1.0} for key, _, n in asked if n < 20}
    cuts = {key: max(10, int(n * 0.8)) for key, _, n in asked}
    tries = [(key, game, n, w, cuts[key]) for key, game, n in asked if n >= 20 for w in sorted({min(w, cuts[key]) for w in (*WINDOWS, cuts[key])})]
    if not tries:
        return out
    data = rows.select("game", "i", "lower_ev")
    games = sorted({g for _, g, _, _, _ in tries})
    ends, probs = {}, sorted({p for t in TAILS for p in (t, 1 - t)})
    # All draws before a cut: each cut's are those of the cut before and some more.
    parts = {g: np.unique([c for _, h, _, _, c in tries if h == g]) for g in games}
    spans = {r["game"]: ((r["a"], r["b"]), r["n"]) for r in data.where(F.col("game").isin(games)).groupBy("game").agg(F.min("lower_ev").alias("a"), F.max("lower_ev").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    places = {g: [(c, p) for c in parts[g] for p in probs] for g in games}
    wanted = {k: (spans[g][0], np.searchsorted(parts[g], [c for c, _ in places[g]]), np.array([nearest(int(c), p) for c, p in places[g]])) for k, g in enumerate(games)}

    def series(x: pd.DataFrame):
        for k, g in enumerate(games):
            own = x[x["game"] == g]
            yield k, np.searchsorted(parts[g], own["i"].to_numpy(), side="right"), own["lower_ev"].to_numpy(float)

    told = ranked(data, series, wanted, {k: spans[g][1] for k, g in enumerate(games)})
    whole = {(g, int(c), p): float(v) for k, g in enumerate(games) for (c, p), v in zip(places[g], told[k])}
    # The last draws before a cut, on the driver: as many as the longest window, of each that is asked.
    few = rows.sparkSession.createDataFrame([(g, int(c) - 1 - j) for g in games for c in parts[g] for j in range(min(c, max(WINDOWS)))], "g string, at long").distinct()
    recent = {(r["game"], r["i"]): r["lower_ev"] for r in data.join(F.broadcast(few), (F.col("game") == F.col("g")) & (F.col("i") == F.col("at"))).select("game", "i", "lower_ev").collect()}
    tried = []
    for key, game, n, w, cut in tries:
        last = np.sort([recent[game, j] for j in range(cut - w, cut)]) if w < cut else None
        for tail in TAILS:
            low, high = (whole[game, cut, p] if last is None else float(last[nearest(w, p)]) for p in (tail, 1 - tail))
            tried.append((key, game, n, cut, w, tail, low, high))

    def inside(x: pd.DataFrame):
        for g in games:
            own = x[x["game"] == g].sort_values("i")
            i, v = own["i"].to_numpy(), own["lower_ev"].to_numpy(float)
            near = 1e-12 * np.abs(v)
            up, down = v + near, v - near
            for j, (_, game, n, cut, _, _, low, high) in enumerate(tried):
                if game == g:
                    a, b = np.searchsorted(i, (cut, n))
                    if a < b:
                        yield 0, np.bincount([j], weights=[np.count_nonzero((up[a:b] >= low) & (down[a:b] <= high))], minlength=len(tried))

    counts = added(data, inside)[0]
    got = {(key, w, tail): c / (n - cut) for (key, _, n, cut, w, tail, _, _), c in zip(tried, counts)}
    best: dict[str, tuple] = {}
    for key, _, _, _, w, tail, low, high in tried:
        goal = (round(abs(got[key, w, tail] - TARGET), 12), high - low)
        if key not in best or goal < best[key][0]:
            best[key] = (goal, w, tail, got[key, w, tail])
    return out | {key: {"window": w, "tail": tail, "coverage": c} for key, (_, w, tail, c) in best.items()}


def references(rows: DataFrame) -> dict[str, dict]:
    """Of each game: n, lower (mean), code (mean pool), and its window, tail and coverage."""
    told = {r["game"]: r.asDict() for r in rows.groupBy("game").agg(F.count(F.lit(1)).alias("n"), F.avg("lower_ev").alias("lower"), F.coalesce(F.avg("code"), F.lit(0.0)).alias("code")).collect()}
    for game, found in windows(rows, [(g, g, t["n"]) for g, t in told.items()]).items():
        told[game] |= found
    return told


def share(rate: np.ndarray) -> np.ndarray:
    """The expected share of a jackpot with a Poisson number of other winners."""
    rate = np.asarray(rate, dtype=float)
    if not (rate == 0).any():
        return -np.expm1(-rate) / rate
    return np.where(rate == 0, 1.0, -np.expm1(-rate) / np.where(rate == 0, 1.0, rate))


def least(value: Callable[[float], float], price: float, start: float) -> float | None:
    """The least jackpot at which value reaches price, between 1 and MOST; None beyond.

    The upper end doubles until it reaches; then regula falsi steps, each kept inside the bracket and halved where they
    are slow, until the bracket is a billionth wide.
    """
    low, high = 1.0, max(start, 1e6)
    if value(low) >= price:
        return low
    while value(high) < price:
        if high >= MOST:
            return None
        low, high = high, 2 * high
    at_low, at_high = value(low) - price, value(high) - price
    while high - low > 1e-9 * high:
        step = low + (high - low) * min(0.9, max(0.1, at_low / (at_low - at_high)))
        at = value(step) - price
        if at >= 0:
            high, at_high = step, at
        else:
            low, at_low = step, at
    return high


REPORT = (
    "game string, target_date string, training_last_date string, reference_draws bigint, jackpot double, estimated_tickets double, expected_co_winners double, share_factor double, participation_model string, extrapolated boolean, "
    "lower_rank_ev double, code_ev double, estimated_ev double, naive_ev double, return_rate double, ev_low double, ev_high double, payout_window int, tail double, coverage double, ticket_price double, "
    "fair_jackpot double, fair_extrapolated boolean, conservative_jackpot double, conservative_extrapolated boolean, decision string"
)


def value_report(spark: SparkSession, source: str, *, jackpots: dict[str, float], target: date | None = None, co_winners: float | None = None, popularity: float = 1.0, samples: int = 2000, seed: int = 0, **more) -> DataFrame:
    """A row for each game of jackpots with at least five complete draws before target (or two days after its last draw).

    co_winners: None to forecast the tickets sold, with the participation model's residuals in the interval; else their
    number, which then neither depends on the jackpot nor adds codes. samples: draws of the chosen window and multipliers of tickets, by hash;
    the interval's ends are their quantiles at the chosen tail. fair and conservative: the least jackpots at which the
    mean, or the lower end, reaches the price; null beyond a billion. eligible: the lower end is above the price.
    """
    if any(j < 0 for j in jackpots.values()) or popularity < 0 or (co_winners is not None and co_winners < 0):
        raise ValueError("jackpots, co-winners and popularity aren't below 0")
    if unknown := set(jackpots) - set(PRICES):
        raise ValueError(f"unknown games: {sorted(unknown)}")
    rows = history(spark, source, target)
    told = {g: t for g, t in references(rows).items() if g in jackpots and t["n"] >= 5}
    last = lift.table(spark, source, "draws")
    last = (last if target is None else last.where(F.col("draw_date") < F.lit(target))).agg(F.max("draw_date")).first()[0]
    if last is None:
        return spark.createDataFrame([], REPORT)
    day = target or last + timedelta(days=2)
    forecaster = participation.evaluate(spark, source, before=target, **more)[1] if co_winners is None else None
    # The places that samples take in their game's window, each by hash.
    picks = []
    for k, (game, t) in enumerate(sorted(told.items())):
        at = t["n"] - t["window"] + (bits32(np.array([seed]), np.arange(samples), 11 + k)[0].astype(np.int64) * t["window"] >> 32)
        picks += [(game, int(j), int(a)) for j, a in enumerate(at)]
    table = spark.createDataFrame(picks, "g string, sample int, at long")
    drawn = rows.join(F.broadcast(table), (F.col("game") == F.col("g")) & (F.col("i") == F.col("at"))).select("game", "sample", "lower_ev", "pool")  # samples rows a game
    first = rank_probability(1)

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("sample")
        game = x["game"].iloc[0]
        t, price, jackpot = told[game], PRICES[game], float(jackpots[game])
        lower = x["lower_ev"].to_numpy(float)
        pool = x["pool"].fillna(t["code"]).to_numpy(float)
        if forecaster is not None:
            times = forecaster.draw((bits32(np.array([seed]), np.arange(samples), 31)[0] + 0.5) / 2**32)

        def point(j: float) -> float:
            if forecaster is None:
                return t["lower"] + first * j / (1 + co_winners)
            n = forecaster.tickets(j, day, game)
            return float(t["lower"] + t["code"] / n + first * j * share(n / TOTAL * popularity))

        def values(j: float) -> np.ndarray:
            if forecaster is None:
                return lower + first * j / (1 + co_winners)
            n = forecaster.tickets(j, day, game) * times
            return lower + pool / n + first * j * share(n / TOTAL * popularity)

        end = lambda j, p: float(np.sort(values(j))[nearest(samples, p)])
        n = forecaster.tickets(jackpot, day, game) if forecaster is not None else None
        rate = n / TOTAL * popularity if forecaster is not None else co_winners
        factor = float(share(rate)) if forecaster is not None else 1 / (1 + co_winners)
        code = t["code"] / n if forecaster is not None else 0.0
        mean, low = point(jackpot), end(jackpot, t["tail"])
        fair = least(point, price, jackpot)
        careful = least(lambda j: end(j, t["tail"]), price, fair or jackpot)
        top = _top(forecaster, game)
        beyond = lambda j: bool(top is not None and j is not None and j > top)
        row = (
            game, str(day), str(last), t["n"], jackpot, n, rate, factor, forecaster.champion["model"] if forecaster is not None and forecaster.predictor is not None else "segmented_median" if forecaster is not None else None, beyond(jackpot),
            t["lower"], code, mean, t["lower"] + first * jackpot, mean / price, low, end(jackpot, 1 - t["tail"]), t["window"], t["tail"], t["coverage"], price,
            fair, beyond(fair), careful, beyond(careful), "eligible" if low > price else "no_bet",
        )
        return pd.DataFrame([row], columns=[c.split()[0] for c in REPORT.split(", ")])

    out = drawn.groupBy("game").applyInPandas(solve, REPORT)
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def _top(f: Forecaster | None, game: str) -> float | None:
    """The greatest jackpot that the forecaster has seen of the game, or of all."""
    if f is None:
        return None
    return f.span[game][1] if game in f.span else max(b for _, b in f.span.values())


def report_of_last_jackpots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all games at the greatest jackpot of each."""
    rows = participation.participation(spark, sf_dir)
    top = {r["game"]: float(r["j"]) for r in rows.groupBy("game").agg(F.max(F.expm1(F.col("jackpot") * 20)).alias("j")).collect()}
    return value_report(spark, sf_dir, jackpots={g: j for g, j in top.items() if g in PRICES})


QUERIES = {"value_report": report_of_last_jackpots}

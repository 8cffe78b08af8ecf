"""Observations of many refits at once: sums by date and kind on the driver, and a few passes over rows that all refits share.

A kind is a game with a jackpot, and the lifting has few jackpots. What a model predicts depends on the date and the kind
alone, so errors, ridge sums and trees come from the sums of these cells, which the calendar bounds. Rows are needed
only for medians, quantiles and resampling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.operators.learners import EPOCH, day_of
from urnspark.operators.models import GAMES
from urnspark.operators.ranks import added, ranked
from urnspark.operators.resampling import AT_ONCE, _bits, _weights, poisson_ends
from urnspark.plans.staging import stage

#: The share of observations, by hash of the draw, that a boosted model with many of them doesn't learn from.
TENTH = 10


def features(days: np.ndarray, games: np.ndarray, jackpots: np.ndarray) -> np.ndarray:
    """FEATURES of days since EPOCH, games and jackpots as FEATURES has them, a row each."""
    dates = np.asarray(days).astype("datetime64[D]")
    turn = ((dates.astype("datetime64[M]").astype(int) % 12) + 1) * (2 * np.pi / 12)
    week, games = (np.asarray(days) + EPOCH.weekday()) % 7, np.asarray(games)
    return np.column_stack([
        jackpots, jackpots * jackpots, (np.asarray(days) - day_of(date(1990, 1, 1))) / 3652, np.sin(turn), np.cos(turn),
        *((week == i).astype(float) for i in range(7)), *((games == g).astype(float) for g in GAMES),
    ])


@dataclass
class Cells:
    """By date and kind: n, s, q, e (observations, sums of y less centre, of its square and of its exponential), low, high
    (of y less centre), tenth (n, s, q of the random tenth); x: FEATURES."""

    dates: list[date]
    kinds: list[tuple[str, float]]
    centre: float
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    e: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tenth: np.ndarray
    x: np.ndarray

    @property
    def days(self) -> np.ndarray:
        return np.array([day_of(d) for d in self.dates])

    def errors(self, predicted: np.ndarray, at: slice) -> tuple[float, float]:
        """The mean squared error on these dates, and the mean of exp(residual)."""
        n = self.n[at].sum()
        square = (self.q[at] - 2 * predicted * self.s[at] + predicted * predicted * self.n[at]).sum()
        return (float(square / n), float((self.e[at] * np.exp(-predicted)).sum() / n)) if n else (float("nan"), 1.0)


def gathered(rows: DataFrame, dates: list[date], centre: float) -> tuple[Cells, DataFrame]:
    """The cells, and the rows as staged t, k (places of date and kind), y less centre, draw_id.

    rows: participation. A row a date and kind on the driver.
    """
    y, picked = F.col("y") - F.lit(centre), F.pmod(F.xxhash64("draw_id"), F.lit(TENTH)) == 0
    sums = [F.count(F.lit(1)), F.sum(y), F.sum(y * y), F.sum(F.exp(y)), F.min(y), F.max(y)]
    sums += [F.sum(F.when(picked, v).otherwise(0.0)) for v in (F.lit(1.0), y, y * y)]
    got = rows.groupBy("draw_date", "game", "jackpot").agg(*(s.cast("double").alias(f"s{i}") for i, s in enumerate(sums))).toArrow().to_pandas()
    kinds = sorted(set(zip(got["game"], got["jackpot"])))
    place, kind = {d: i for i, d in enumerate(dates)}, {g: i for i, g in enumerate(kinds)}
    told = np.zeros((len(sums), len(dates), len(kinds)))
    told[4], told[5] = np.inf, -np.inf
    told[:, [place[d] for d in got["draw_date"]], [kind[g] for g in zip(got["game"], got["jackpot"])]] = got[[f"s{i}" for i in range(len(sums))]].to_numpy(float).T
    days = np.array([day_of(d) for d in dates])
    at = np.repeat(days, len(kinds)), np.tile(np.array([g for g, _ in kinds]), len(dates)), np.tile(np.array([j for _, j in kinds], dtype=float), len(dates))
    cells = Cells(dates, kinds, centre, *told[:6], told[6:], features(*at).reshape(len(dates), len(kinds), -1))
    spark = rows.sparkSession
    calendar = spark.createDataFrame(list(zip(dates, range(len(dates)))), "_d date, t int")
    table = spark.createDataFrame([(g, j, i) for i, (g, j) in enumerate(kinds)], "_g string, _j double, k int")
    met = rows.join(F.broadcast(calendar), F.col("draw_date") == F.col("_d")).join(F.broadcast(table), (F.col("game") == F.col("_g")) & (F.col("jackpot") == F.col("_j")))
    return cells, stage(met.select("t", "k", y.alias("y"), "draw_id"), "cells")


def ridges(cells: Cells, asked: list[tuple[int, float]]) -> list[np.ndarray]:
    """Intercept and coefficients, of y less centre, of each (dates to train on, penalty): sums of products are differences of running ones."""
    z = np.concatenate([np.ones((*cells.n.shape, 1)), cells.x], axis=2)
    told = np.cumsum((z * cells.n[:, :, None]).transpose(0, 2, 1) @ z, axis=0), np.cumsum((cells.s[:, None, :] @ z)[:, 0], axis=0)
    free = np.diag(np.r_[0.0, np.ones(z.shape[2] - 1)])
    return [np.linalg.solve(told[0][m - 1] + alpha * free, told[1][m - 1]) for m, alpha in asked]


def medians(cells: Cells, data: DataFrame, starts: list[int], own: int) -> list[dict[tuple[str, int], float]]:
    """Of each start (in order): the exact medians of y over the dates before, by game and weekday.

    Of the game's weekday where it has so many observations of its own, else of the game, else of all. Weekday -1 of a game
    has the game's, that of the game '' has that of all.
    """
    games = sorted({g for g, _ in cells.kinds})
    of, week = np.array([games.index(g) for g, _ in cells.kinds]), (cells.days + EPOCH.weekday()) % 7
    begins, m = np.array(starts), len(games)
    part = np.searchsorted(begins, np.arange(len(cells.dates)), side="right")
    masks = [(week == w)[:, None] & (of == g) for g in range(m) for w in range(7)] + [np.broadcast_to(of == g, cells.n.shape) for g in range(m)] + [np.ones(cells.n.shape, dtype=bool)]
    asked, sizes, counts = {}, {}, {}
    for i, mask in enumerate(masks):
        before = np.r_[0, np.cumsum(np.where(mask, cells.n, 0).sum(axis=1))][begins].astype(np.int64)
        use = np.flatnonzero(before >= (own if i < 7 * m else 1))
        if len(use):
            places = np.concatenate([(before[use] - 1) // 2, before[use] // 2])
            seen = mask & (cells.n > 0)
            asked[i] = ((cells.low[seen].min(), cells.high[seen].max()), np.tile(use, 2), places)
            sizes[i], counts[i] = int(before[-1]), use

    def series(x: pd.DataFrame) -> Iterator[tuple]:
        t, y, g = x["t"].to_numpy(), x["y"].to_numpy(), of[x["k"].to_numpy()]
        p = part[t]
        early = p < len(begins)
        t, y, g, p = t[early], y[early], g[early], p[early]
        yield 8 * m, p, y
        for i in range(m):
            use = g == i
            yield 7 * m + i, p[use], y[use]
            for w in range(7):
                day = use & (week[t] == w)
                yield 7 * i + w, p[day], y[day]

    got = ranked(data, series, asked, sizes)
    table = np.full((len(masks), len(starts)), np.nan)
    for i, v in got.items():
        low, high = v.reshape(2, -1)
        table[i, counts[i]] = low + 0.5 * (high - low) + cells.centre
    first = lambda *rows: float(next(v for v in rows if not np.isnan(v)))
    out = []
    for every, *rest in zip(table[8 * m], *table[: 8 * m]):
        one = {("", -1): float(every)}
        for i, g in enumerate(games):
            one[g, -1] = first(rest[7 * m + i], every)
            for w in range(7):
                one[g, w] = first(rest[7 * i + w], one[g, -1])
        out.append(one)
    return out


def baseline(cells: Cells, told: dict[tuple[str, int], float], at: slice) -> np.ndarray:
    """The medians, less centre, of these dates and all kinds."""
    week = (cells.days[at] + EPOCH.weekday()) % 7
    by = np.array([[told[g, w] - cells.centre for g, _ in cells.kinds] for w in range(7)])
    return by[week]


def tests(cells: Cells, data: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], replicates: int) -> list[list[dict]]:
    """Of each asked (first date, baseline, predictions of each model, by date and kind): of each model the mean difference of
    squared errors against the baseline, its 95% bootstrap interval and a sign test, as resampled has them.

    A draw's weight and sign in a replicate come from a hash of both; all that is asked has them in common, so they
    are made once.
    """
    runs, ends, words = np.arange(replicates), poisson_ends(1.0), np.arange(-(-replicates // 32))
    spans = [(z, z + len(b)) for z, b, _ in asked]
    start = min(z for z, _ in spans)
    m = len(asked[0][2])

    def sums(x: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        x = x[x["t"] >= start].sort_values("t")
        t, k, y, ids = (x[c].to_numpy() for c in ("t", "k", "y", "draw_id"))
        out: dict[int, np.ndarray] = {}
        for a in range(0, len(t), AT_ONCE):
            at = slice(a, a + AT_ONCE)
            held = [i for i, (z, e) in enumerate(spans) if z <= t[at][-1] and t[at][0] < e]
            if not held:
                continue
            # Of each asked: the differences of its models, then ones.
            told = np.zeros((len(t[at]), len(held), m + 1))
            for j, i in enumerate(held):
                z, base, predicted = asked[i]
                use = (t[at] >= z) & (t[at] < spans[i][1])
                c, v = (t[at][use] - z, k[at][use]), y[at][use]
                b = base[c] - v
                told[use, j, :m] = ((predicted[:, c[0], c[1]] - v) ** 2 - b * b).T
                told[use, j, m] = 1
            w = _weights(_bits(runs, ids[at], 1), ends).astype(float)
            bits = np.unpackbits(_bits(words, ids[at], 2).astype("<u4").view(np.uint8).reshape(len(words), -1, 4), axis=2, bitorder="little")
            signs = bits.transpose(0, 2, 1).reshape(-1, len(t[at]))[:replicates] * 2.0 - 1
            weighed = (w @ told.reshape(len(w[0]), -1)).reshape(replicates, len(held), m + 1)
            flipped = (signs @ told[:, :, :m].reshape(len(w[0]), -1)).reshape(replicates, len(held), m)
            for j, i in enumerate(held):
                both = np.concatenate([weighed[:, j], flipped[:, j]], axis=1)
                out[i] = out[i] + both if i in out else both
        for i, v in out.items():
            yield i, v.ravel()

    got = added(data, sums)
    out = []
    for i, (z, base, predicted) in enumerate(asked):
        at = slice(*spans[i])
        n, total = cells.n[at].sum(), got[i].reshape(replicates, 2 * m + 1)
        rows = []
        for j, p in enumerate(predicted):
            observed = float(((p * p - base * base) * cells.n[at] - 2 * (p - base) * cells.s[at]).sum() / n)
            means = np.where(total[:, m] > 0, total[:, j] / np.maximum(total[:, m], 1), observed)
            near = 1e-12 * max(1.0, abs(observed))
            low, high = np.quantile(means, (0.025, 0.975))
            rows.append({"observed": observed, "low": low, "high": high, "p_lower": (np.count_nonzero(total[:, m + 1 + j] / n <= observed + near) + 1) / (replicates + 1), "rmse": cells.errors(p, at)[0] ** 0.5})
        out.append(rows)
    return out


def multipliers(cells: Cells, data: DataFrame, asked: list[tuple[int, np.ndarray]], steps: int) -> list[np.ndarray]:
    """Of each asked (first date, prediction by date and kind): steps + 1 exact quantiles of exp(residual) over their mean."""
    spans = [(z, z + len(p)) for z, p in asked]
    places, wanted, sizes = [], {}, {}
    for i, (z, p) in enumerate(asked):
        at = slice(*spans[i])
        seen, n = cells.n[at] > 0, int(cells.n[at].sum())
        place = np.array([j / steps for j in range(steps + 1)]) * (n - 1)
        both = np.concatenate([np.floor(place), np.ceil(place)]).astype(np.int64)
        wanted[i] = (((cells.low[at] - p)[seen].min(), (cells.high[at] - p)[seen].max()), np.zeros(len(both), dtype=np.int64), both)
        places.append(place)
        sizes[i] = n

    def series(x: pd.DataFrame) -> Iterator[tuple]:
        x = x.sort_values("t")
        t, k, y = (x[c].to_numpy() for c in ("t", "k", "y"))
        for i, (z, p) in enumerate(asked):
            use = slice(*np.searchsorted(t, spans[i]))
            yield i, 0, y[use] - p[t[use] - z, k[use]]

    got, out = ranked(data, series, wanted, sizes), []
    for i, (_, p) in enumerate(asked):
        low, high = np.exp(got[i]).reshape(2, -1)
        mean = cells.errors(p, slice(*spans[i]))[1]
        out.append((low + (places[i] - np.floor(places[i])) * (high - low)) / mean)
    return out

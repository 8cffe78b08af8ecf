"""Linear and Poisson models fitted from sums: Spark adds up the products of features, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.operators.draws import OBS, P9, SHAPES, WIDE
from urnspark.plans import lift

GAMES = ("loto", "super_loto", "grand_loto")
FEATURES = ("jackpot", "jackpot2", "trend", "month_sin", "month_cos", *(f"day{i}" for i in range(7)), *GAMES)
SHAPE = ("high", "all_low", "adjacent", "lucky", "total", "off_centre")


def _base(*more: str) -> str:
    return "WITH " + ",\n".join((lift.NUMBERS, lift.PRIZES, *more))


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_id, draw_date, y (log of the tickets sold) and FEATURES of each draw with a jackpot and rank-9 winners."""
    obs = lift.run(spark, sf_dir, _base(WIDE, OBS) + " SELECT draw_id, draw_date, game, CAST(jackpot AS DOUBLE) AS prize, ln(tickets) AS y FROM obs")
    size, turn = F.log1p("prize") / 20, F.month("draw_date") * (2 * np.pi / 12)
    columns = [size, size * size, F.datediff("draw_date", F.lit("1990-01-01")) / 3652, F.sin(turn), F.cos(turn)]
    columns += [(F.weekday("draw_date") == i).cast("double") for i in range(7)] + [(F.col("game") == g).cast("double") for g in GAMES]
    return obs.select("draw_id", "draw_date", "game", "y", *(c.alias(n) for c, n in zip(columns, FEATURES, strict=True)))


def folds(df: DataFrame, *, min_train: int, n: int) -> DataFrame:
    """df with fold: 0 before the date of observation min_train, then n runs of whole dates, the first of them longer by one.

    The first date is never tested, as nothing lies before it, also where it has more than min_train observations.
    """
    days = df.groupBy("draw_date").agg(F.count(F.lit(1)).alias("c"))
    seen = days.withColumn("seen", F.sum("c").over(Window.orderBy("draw_date")))  # the calendar bounds it
    late = seen.where((F.col("seen") > min_train) & (F.col("seen") > F.col("c"))).select("draw_date", F.ntile(n).over(Window.orderBy("draw_date")).alias("fold"))
    return df.join(late, "draw_date", "left").withColumn("fold", F.coalesce("fold", F.lit(0)))


def moments(df: DataFrame, by: str, xs: tuple[str, ...], y, weight=None) -> dict[int, np.ndarray]:
    """For each value of by (few values): the sums of products of (1, xs, y)."""
    w = F.lit(1.0) if weight is None else weight
    v = [F.lit(1.0), *(F.col(x) for x in xs), y]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    out = {}
    for r in df.groupBy(by).agg(*(F.sum(w * v[i] * v[j]).alias(f"s{i}_{j}") for i, j in pairs)).collect():
        m = np.zeros((len(v), len(v)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r[by]] = m
    return out


def ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients, the intercept not penalised."""
    a, b = m[:-1, :-1].copy(), m[:-1, -1]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += alpha
    return np.linalg.solve(a, b)


def linear(beta: np.ndarray, xs: tuple[str, ...]):
    out = F.lit(float(beta[0]))
    for b, x in zip(beta[1:], xs, strict=True):
        out = out + F.lit(float(b)) * F.col(x)
    return out


def _inner(data: DataFrame, n: int) -> list[tuple]:
    """For each fold, its first date and the first of the last fifth of the dates before it; a row per fold on the driver."""
    order = Window.orderBy("draw_date")  # the calendar bounds it
    days = data.groupBy("draw_date").agg(F.max("fold").alias("fold")).withColumn("at", F.row_number().over(order) - 1)
    starts = days.where("fold > 0").groupBy("fold").agg(F.min("at").alias("start"), F.min("draw_date").alias("first"))
    cut = starts.withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("start") * 0.8)))
    rows = cut.join(days.select(F.col("at").alias("cut"), F.col("draw_date").alias("split")), "cut").select("fold", "first", "split").collect()
    return [(r["fold"], r["first"], r["split"]) for r in sorted(rows)]


def participation_backtest(spark: SparkSession, sf_dir: str, *, min_train: int = 500, n: int = 3, alpha: float = 1.0) -> DataFrame:
    """draw_id, game, fold, y, predicted, smearing of each tested draw; a fold's model has seen strictly earlier dates alone.

    smearing: the mean of exp(residual) over the last fifth of the training dates, of a model of the dates before these.
    One pass sums products between all dates of interest; models add up what lies before theirs. No tested draws: no rows.
    """
    data = folds(participation(spark, sf_dir), min_train=min_train, n=n)
    marks = _inner(data, n)
    dates = sorted({d for _, *ds in marks for d in ds})
    segment = sum((F.when(F.col("draw_date") >= F.lit(d), 1).otherwise(0) for d in dates), F.lit(0))
    sums = moments(data.withColumn("_segment", segment), "_segment", FEATURES, F.col("y")) if marks else {}
    upto = lambda d: sum((m for k, m in sums.items() if k <= dates.index(d)), 0.0)
    predicted, smear, checks = F.lit(None).cast("double"), F.lit(1.0), []
    for k, first, split in marks:
        predicted = F.when(F.col("fold") == k, linear(ridge(upto(first), alpha), FEATURES)).otherwise(predicted)
        if split < first:
            inside = (F.col("draw_date") >= F.lit(split)) & (F.col("draw_date") < F.lit(first))
            checks.append(F.avg(F.when(inside, F.exp(F.col("y") - linear(ridge(upto(split), alpha), FEATURES)))).alias(f"s{k}"))
    if checks:
        told = data.agg(*checks).first()
        for k, *_ in marks:
            smear = F.when(F.col("fold") == k, F.lit(float(told[f"s{k}"]))).otherwise(smear) if f"s{k}" in told.asDict() and told[f"s{k}"] is not None else smear
    return data.where("fold > 0").select("draw_id", "game", "fold", F.round("y", 9).alias("y"), F.round(predicted, 6).alias("predicted"), F.round(smear, 6).alias("smearing"))


def participation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each fold: log RMSE, the smearing factor, and the bias of the levels as predicted and as calibrated by it."""
    out = participation_backtest(spark, sf_dir)
    e, level, truth = F.col("predicted") - F.col("y"), F.exp("predicted"), F.exp("y")
    bias = lambda x: F.round(F.sum(x) / F.sum(truth) - 1, 6)
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("log_rmse"), F.max("smearing").alias("smearing"), bias(level).alias("bias"), bias(level * F.col("smearing")).alias("calibrated_bias"))


def popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_id, draw_date, winners, exposure and SHAPE of the draws whose winners of the five numbers are known."""
    return lift.run(
        spark,
        sf_dir,
        _base(WIDE) + f""", shape AS (SELECT draw_id, draw_date, {SHAPES} FROM (SELECT draw_id, draw_date, array_sort(numbers) AS m FROM draws) t)
SELECT s.draw_id, s.draw_date, CAST(w1 + w2 AS DOUBLE) AS winners, w9 / {P9} / 1906884e0 AS exposure, {", ".join(SHAPE)} FROM wide o JOIN shape s ON o.draw_id = s.draw_id WHERE w1 IS NOT NULL AND w2 IS NOT NULL AND w9 > 0""",
    )


def poisson_fits(obs: DataFrame, alphas: tuple[float, ...], *, steps: int = 12) -> list[np.ndarray]:
    """Intercept and coefficients of SHAPE for each penalty, exposure given; all penalties take their Newton step in one pass.

    A penalty is in units of the whole exposure and leaves the intercept free. No winners: zeros.
    """
    start = obs.agg(F.sum("winners").alias("w"), F.sum("exposure").alias("e")).first()
    betas = [np.zeros(len(SHAPE) + 1) for _ in alphas]
    if not start["e"] or not start["w"]:
        return betas
    for beta in betas:
        beta[0] = np.log(start["w"] / start["e"])
    v = [F.lit(1.0), *(F.col(x) for x in SHAPE)]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    for _ in range(steps):
        sums = []
        for k, beta in enumerate(betas):
            eta = linear(beta, SHAPE)
            mu = F.col("exposure") * F.exp(eta)
            z = eta * mu + F.col("winners") - mu  # the working response times its weight
            sums += [F.sum(mu * v[i] * v[j]).alias(f"h{k}_{i}_{j}") for i, j in pairs] + [F.sum(z * x).alias(f"g{k}_{i}") for i, x in enumerate(v)]
        r, moved = obs.agg(*sums).first(), 0.0
        for k, (beta, alpha) in enumerate(zip(betas, alphas)):
            h = np.zeros((len(v), len(v)))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{k}_{i}_{j}"]
            h[np.arange(1, len(v)), np.arange(1, len(v))] += alpha * start["e"]
            new = np.linalg.solve(h, np.array([r[f"g{k}_{i}"] for i in range(len(v))]))
            moved = max(moved, float(np.abs(new - beta).max()))
            betas[k] = new
        if moved < 1e-10:
            break
    return betas


def popularity_poisson(spark: SparkSession, sf_dir: str, *, alpha: float = 1e-6) -> DataFrame:
    """draw_id, winners, expected of the draws' main combinations: a Poisson model of all of them, exposure given."""
    obs = popularity(spark, sf_dir)
    beta = poisson_fits(obs, (alpha,))[0]
    return obs.select("draw_id", "winners", F.round(F.col("exposure") * F.exp(linear(beta, SHAPE)), 6).alias("expected"))


#: The penalties tried.
ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def _deviance(expected):
    safe = F.greatest(expected, F.lit(1e-12))
    return 2 * (F.when(F.col("winners") > 0, F.col("winners") * F.log(F.col("winners") / safe)).otherwise(0.0) - (F.col("winners") - safe))


def scaled(obs: DataFrame, told: DataFrame) -> DataFrame:
    """told with SHAPE centred and scaled by obs; a feature that doesn't vary is left as it is, less its mean."""
    m = obs.agg(*(F.avg(x).alias(f"m_{x}") for x in SHAPE), *(F.stddev_pop(x).alias(f"s_{x}") for x in SHAPE)).first()
    return told.withColumns({x: (F.col(x) - float(m[f"m_{x}"] or 0.0)) / float(m[f"s_{x}"] or 1.0) for x in SHAPE})


def popularity_backtest(spark: SparkSession, sf_dir: str, *, min_train: int = 500, n: int = 3) -> DataFrame:
    """fold, alpha, n, deviance, uniform, delta: mean Poisson deviance of each fold's draws, against the plain rate before it.

    A fold's penalty is the best over the last fifth of the dates before it; features are scaled by the training draws.
    """
    data = folds(popularity(spark, sf_dir), min_train=min_train, n=n)
    out = None
    for k, first, split in _inner(data, n):
        train, inner = data.where(F.col("draw_date") < F.lit(first)), data.where(F.col("draw_date") < F.lit(split))
        late = scaled(inner, train.where(F.col("draw_date") >= F.lit(split)))
        tried = poisson_fits(scaled(inner, inner), ALPHAS)
        mean = late.agg(*(F.avg(_deviance(F.col("exposure") * F.exp(linear(b, SHAPE)))).alias(f"d{i}") for i, b in enumerate(tried))).first()
        best = min(range(len(ALPHAS)), key=lambda i: (mean[f"d{i}"] if mean[f"d{i}"] is not None else 0.0, i))
        beta = poisson_fits(scaled(train, train), (ALPHAS[best],))[0]
        rate = train.agg((F.sum("winners") / F.sum("exposure")).alias("r")).first()["r"] or 0.0
        test = scaled(train, data.where(F.col("fold") == k))
        own, flat = _deviance(F.col("exposure") * F.exp(linear(beta, SHAPE))), _deviance(F.col("exposure") * F.lit(float(rate)))
        one = test.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(own), 9).alias("deviance"), F.round(F.avg(flat), 9).alias("uniform"), F.round(F.avg(own - flat), 9).alias("delta"))
        one = one.select(F.lit(k).alias("fold"), F.lit(ALPHAS[best]).alias("alpha"), "*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "fold int, alpha double, n bigint, deviance double, uniform double, delta double")


QUERIES = {"participation_backtest": participation_backtest, "participation_summary": participation_summary, "popularity_poisson": popularity_poisson, "popularity_backtest": popularity_backtest}

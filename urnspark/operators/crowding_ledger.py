"""A ledger of crowding models, frozen before each draw: scored once by Poisson deviance, verified by recomputation, judged by cohort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.predicates import recording_open, same_number
from urnspark.operators import crowding
from urnspark.operators.draws import P9, WIDE
from urnspark.operators.ledger import ALPHA, GENESIS, QUALIFYING, _heads, _there, chained
from urnspark.operators.resampling import resampled
from urnspark.plans import lift
from urnspark.plans.staging import folder, stage

FORECAST = "game string, target_date date, cohort int, cohort_index int, target string, feature_set string, beta array<double>, baseline double, training_last_date date, record string, previous_hash string, hash string, position bigint"
SCORE = (
    "game string, target_date date, cohort int, forecast_hash string, draw_id bigint, drawn array<bigint>, winners double, exposure double, expected double, baseline_expected double, deviance double, baseline_deviance double, record string, previous_hash string, hash string, position bigint"
)
KEY = ["game", "target_date", "cohort"]
#: Coefficients of each feature set, the intercept included.
SIZES = {"base": 7, "interactions": 12, "number_effects": 56}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, "crowding-forecasts", FORECAST)


def scores(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, "crowding-scores", SCORE)


def multiplier(numbers: Column, kind: Column, beta: Column) -> Column:
    """exp of a model's linear form for five ascending numbers: crowding.features as a column."""
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)
    size = lambda a: F.size(a).cast("double")
    high = size(F.filter(numbers, lambda x: x > 31))
    adjacent = size(F.filter(F.zip_with(F.slice(numbers, 2, 4), F.slice(numbers, 1, 4), lambda b, a: b - a), lambda d: d == 1))
    lucky = size(F.filter(numbers, lambda x: x.isin(7, 13)))
    shape = [high, (high == 0).cast("double"), adjacent, lucky, total / 150, F.abs(total - 125) / 100]
    products = [high * (total / 150), adjacent * (total / 150), high * high, adjacent * adjacent, (total / 150) * (total / 150)]
    dot = lambda xs, start: sum((F.get(beta, F.lit(start + i)) * x for i, x in enumerate(xs)), F.lit(0.0))
    each = F.aggregate(numbers, F.lit(0.0), lambda a, n: a + F.get(beta, (n + 6).cast("int")))
    return F.exp(F.get(beta, F.lit(0)) + dot(shape, 1) + F.when(kind == "interactions", dot(products, 7)).when(kind == "number_effects", each).otherwise(0.0))


def deviance(actual: Column, expected: Column) -> Column:
    safe = F.greatest(expected, F.lit(1e-12))
    return 2 * (F.when(actual > 0, actual * F.log(actual / safe)).otherwise(0.0) - (actual - safe))


def results(spark: SparkSession, source: str) -> DataFrame:
    """game, draw_date, draw_id, drawn, w1, w2, w9: every draw with what is known of its winners."""
    rows = lift.run(spark, source, f"WITH {lift.PRIZES}, {WIDE} SELECT d.game, draw_date, d.draw_id, numbers, w1, w2, w9 FROM draws d LEFT JOIN wide o ON d.draw_id = o.draw_id")
    return rows.select("game", "draw_date", "draw_id", F.array_sort("numbers").alias("drawn"), "w1", "w2", "w9")


def record(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Appends models and returns those appended: open still, trained before their date, whole, and the first of their game, date and cohort.

    new: game, target_date, cohort, target, feature_set, beta, baseline, training_last_date, recorded_at. A model is whole
    if it has its feature set's number of finite coefficients, a baseline above 0 and a known target. Of several new ones of
    a key, the least stays. A new cohort of a game takes its next index.
    """
    old = forecasts(spark, path)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    size = F.element_at(F.create_map(*(F.lit(v) for kv in SIZES.items() for v in kv)), F.col("feature_set"))
    whole = (F.size("beta") == size) & ~F.exists("beta", bad) & ~bad(F.col("baseline")) & (F.col("baseline") > 0) & F.col("target").isin(*crowding.TARGETS) & (F.col("training_last_date") < F.col("target_date"))
    fresh = new.where(recording_open(F.col("target_date"), F.col("recorded_at")) & F.coalesce(whole, F.lit(False))).join(old.select(*KEY), KEY, "left_anti")
    fresh = fresh.groupBy(*KEY).agg(F.min(F.struct("target", "feature_set", "beta", "baseline", "training_last_date")).alias("f")).select(*KEY, "f.*")
    known = old.groupBy("game", "cohort").agg(F.max("cohort_index").alias("cohort_index"))
    top = old.groupBy("game").agg(F.max("cohort_index").alias("top"))
    more = fresh.groupBy("game", "cohort").agg(F.min("target_date").alias("since")).join(known, ["game", "cohort"], "left_anti").join(top, "game", "left")
    more = more.select("game", "cohort", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("game").orderBy("since", "cohort"))).alias("cohort_index"))
    fresh = fresh.join(known.unionByName(more), ["game", "cohort"])
    text = F.to_json(F.struct("baseline", "beta", "cohort", "cohort_index", "feature_set", "game", "target", "target_date", "training_last_date"))
    out = chained(fresh.withColumn("record", text), ["target_date", "cohort"], _heads(old))
    out.select(*_names(FORECAST)).coalesce(1).write.mode("append").parquet(f"{path}/crowding-forecasts")
    return forecasts(spark, path).join(old.select("hash"), "hash", "left_anti")


def score_pending(spark: SparkSession, path: str, draws: DataFrame, now: Column) -> DataFrame:
    """Scores what can be scored, each model once, and returns game, target_date, cohort, reason of the rest: absent, open or incomplete.

    draws: as results gives them; of several of a game and date the last by id counts. Incomplete: no winners known of rank
    1, none of rank 9, or of rank 2 where its target needs them.
    """
    pending = forecasts(spark, path).join(scores(spark, path).select(*KEY), KEY, "left_anti")
    last = draws.groupBy("game", F.col("draw_date").alias("target_date")).agg(F.max(F.struct("draw_id", "drawn", "w1", "w2", "w9")).alias("d"))
    met = pending.join(last, ["game", "target_date"], "left")
    main = F.col("target") == "main_combination"
    short = F.col("d.w1").isNull() | ~F.coalesce(F.col("d.w9") > 0, F.lit(False)) | (main & F.col("d.w2").isNull())
    reason = F.when(F.col("d").isNull(), "absent").when(recording_open(F.col("target_date"), now), "open").when(short, "incomplete")
    met = stage(met.withColumn("reason", reason), "crowding-met")  # before the scores are there
    outcomes = F.when(main, float(crowding.OUTCOMES["main_combination"])).otherwise(float(crowding.OUTCOMES["jackpot"]))
    ready = met.where("reason IS NULL").select(
        *KEY,
        F.col("hash").alias("forecast_hash"),
        "d.draw_id",
        "d.drawn",
        (F.col("d.w1") + F.when(main, F.col("d.w2")).otherwise(0)).cast("double").alias("winners"),
        (F.col("d.w9") / F.expr(P9) / outcomes).alias("exposure"),
        multiplier(F.col("d.drawn"), F.col("feature_set"), F.col("beta")).alias("m"),
        "baseline",
    )
    ready = ready.withColumns({"expected": F.col("m") * F.col("exposure"), "baseline_expected": F.col("baseline") * F.col("exposure")}).drop("m", "baseline")
    ready = ready.withColumns({"deviance": deviance(F.col("winners"), F.col("expected")), "baseline_deviance": deviance(F.col("winners"), F.col("baseline_expected"))})
    text = F.to_json(F.struct("baseline_deviance", "baseline_expected", "cohort", "deviance", "draw_id", "drawn", "expected", "exposure", "forecast_hash", "winners"))
    out = chained(ready.withColumn("record", text), ["target_date", "cohort"], _heads(scores(spark, path)))
    out.select(*_names(SCORE)).coalesce(1).write.mode("append").parquet(f"{path}/crowding-scores")
    return met.where("reason IS NOT NULL").select(*KEY, "reason")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """kind, game, target_date, problem: records whose hash or link doesn't hold, whose columns aren't those hashed, or whose score isn't its model's; none in a sound ledger."""
    order = Window.partitionBy("game").orderBy("position")  # a few records a date
    told = {
        "forecast": (forecasts(spark, path), F.to_json(F.struct("baseline", "beta", "cohort", "cohort_index", "feature_set", "game", "target", "target_date", "training_last_date"))),
        "score": (scores(spark, path), F.to_json(F.struct("baseline_deviance", "baseline_expected", "cohort", "deviance", "draw_id", "drawn", "expected", "exposure", "forecast_hash", "winners"))),
    }
    out = None
    for kind, (table, text) in told.items():
        before = F.coalesce(F.lag("hash").over(order), F.lit(GENESIS))
        x = table.withColumn("gap", (F.row_number().over(order) - 1 != F.col("position")) | (before != F.col("previous_hash")))
        problem = F.when(F.col("gap"), "link").when(F.sha2(F.concat("previous_hash", "record"), 256) != F.col("hash"), "hash").when(text != F.col("record"), "columns")
        bad = x.select(F.lit(kind).alias("kind"), "game", "target_date", problem.alias("problem")).where("problem IS NOT NULL")
        out = bad if out is None else out.unionByName(bad)
    met = scores(spark, path).join(forecasts(spark, path).select(*KEY, "feature_set", "beta", "baseline", F.col("hash").alias("own")), KEY, "left")
    expected = multiplier(F.col("drawn"), F.col("feature_set"), F.col("beta")) * F.col("exposure")
    right = (F.col("own") == F.col("forecast_hash")) & same_number(expected, F.col("expected"), 1e-9) & same_number(F.col("baseline") * F.col("exposure"), F.col("baseline_expected"), 1e-9)
    for d, e in (("deviance", "expected"), ("baseline_deviance", "baseline_expected")):
        right = right & same_number(deviance(F.col("winners"), F.col(e)), F.col(d), 1e-9)
    return out.unionByName(met.where(~F.coalesce(right, F.lit(False))).select(F.lit("score").alias("kind"), "game", "target_date", F.lit("value").alias("problem")))


def cohorts(spark: SparkSession, path: str, *, replicates: int = 2000) -> DataFrame:
    """game, cohort, cohort_index, snapshots, scores, qualification_scores, alpha, deviance, baseline_deviance, delta, low, high, p_value, status.

    The verdict is of a cohort's first hundred scores by target date, and doesn't change when more come: a moving-block
    bootstrap's interval below 0, and a block sign test below the cohort's share of the level. With fewer scores:
    insufficient_data, without interval and test.
    """
    table = forecasts(spark, path).join(scores(spark, path).select(*KEY, "deviance", "baseline_deviance"), KEY, "left")
    place = F.row_number().over(Window.partitionBy("game", "cohort").orderBy(F.col("deviance").isNull(), "target_date")) - 1  # a model a date
    table = table.withColumn("i", place).withColumn("first", F.col("deviance").isNotNull() & (F.col("i") < QUALIFYING))
    own = lambda c: F.avg(F.when(F.col("first"), F.col(c))).alias(c)
    head = table.groupBy("game", "cohort", "cohort_index").agg(F.count(F.lit(1)).alias("snapshots"), F.count("deviance").alias("scores"), F.count_if("first").alias("qualification_scores"), own("deviance"), own("baseline_deviance"))
    told = resampled(table.where("first").select("game", "cohort", "i", (F.col("deviance") - F.col("baseline_deviance")).alias("delta")), ["game", "cohort"], "delta", "i", replicates=replicates, block=crowding.BLOCK)
    out = head.join(told.where(F.col("n") == QUALIFYING), ["game", "cohort"], "left")
    alpha = ALPHA / (F.col("cohort_index") * (F.col("cohort_index") + 1))
    status = F.when(F.col("low").isNull(), "insufficient_data").when((F.col("high") < 0) & (F.col("p_lower") < alpha), "qualified").otherwise("not_qualified")
    r = lambda c: F.round(c, 9).alias(c)
    return out.select(
        "game", "cohort", "cohort_index", "snapshots", "scores", "qualification_scores", F.round(alpha, 12).alias("alpha"), r("deviance"), r("baseline_deviance"), F.round(F.col("deviance") - F.col("baseline_deviance"), 9).alias("delta"),
        r("low"), r("high"), F.round("p_lower", 9).alias("p_value"), status.alias("status"),
    )


def proposals(spark: SparkSession, source: str, *, game: str = "loto", target: str = "main_combination", feature_set: str = "base", min_train: int = 500) -> DataFrame:
    """Models for each date a game is drawn on, frozen at the start of its year: trained on the years before it, whose first has min_train observations before it.

    The models of all years come from passes that they share.
    """
    obs = stage(crowding.observations(spark, source, game), "crowding-observations")
    days, n = crowding.calendar(obs, target)
    dates = lift.table(spark, source, "draws").where(F.col("game") == game).select("draw_date").distinct()
    years = sorted(r[0] for r in dates.select(F.year("draw_date")).distinct().collect())
    starts = {y: int((np.datetime64(f"{y}-01-01") - np.datetime64("1970-01-01")).astype(int)) for y in years}
    starts = {y: d for y, d in starts.items() if n[days < d].sum() >= min_train and (days < d).sum() > 1}
    data = crowding.blocks(obs)
    alphas = crowding.chosen(data, [(target, feature_set, crowding.split_of(days[days < d]), d) for d in starts.values()])
    made = crowding.fit(data, [((target, feature_set, d), a) for d, a in zip(starts.values(), alphas)])
    rows = [(y, m.beta.round(12).tolist(), round(m.baseline, 12), int(days[days < d].max())) for (y, d), m in zip(starts.items(), made) if m is not None]
    models = spark.createDataFrame(rows, "cohort int, beta array<double>, baseline double, last int")  # a row a year
    out = dates.withColumn("cohort", F.year("draw_date")).join(F.broadcast(models), "cohort")
    at = F.to_timestamp(F.concat(F.col("draw_date").cast("string"), F.lit(" 08:00:00")))
    return out.select(F.lit(game).alias("game"), F.col("draw_date").alias("target_date"), "cohort", F.lit(target).alias("target"), F.lit(feature_set).alias("feature_set"), "beta", "baseline", F.date_from_unix_date("last").alias("training_last_date"), at.alias("recorded_at"))


def popularity_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of a ledger of each year's models."""
    path = folder(spark, "ledger")
    record(spark, path, proposals(spark, sf_dir))
    score_pending(spark, path, results(spark, sf_dir), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return cohorts(spark, path)


QUERIES = {"popularity_ledger": popularity_ledger}

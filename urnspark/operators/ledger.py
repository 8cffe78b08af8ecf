"""A ledger of forecasts as append-only Parquet: record before the draw, score each once, verify the chains, judge cohorts once."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.functions.predicates import recording_open
from urnspark.operators.forecasts import DRAWN, EXPECTED, POOL, smoothed
from urnspark.operators.resampling import resampled
from urnspark.plans import lift
from urnspark.plans.staging import folder, stage

GENESIS = "0" * 64
#: Scores that a cohort is judged on; its first ones.
QUALIFYING = 100
#: The level that all cohorts share.
ALPHA = 0.05

FORECAST = "game string, target_date date, cohort int, cohort_index int, main array<bigint>, chance bigint, training_last_date date, record string, previous_hash string, hash string, position bigint"
SCORE = "game string, target_date date, forecast_hash string, drawn array<bigint>, drawn_chance bigint, main_hits int, chance_hit int, record string, previous_hash string, hash string, position bigint"


def exact_tail(n: int = QUALIFYING) -> list[float]:
    """The chance that n random draws hit a ticket's five numbers t times or more, for t from 0 to 5n."""
    single = np.array([comb(DRAWN, k) * comb(POOL - DRAWN, DRAWN - k) / comb(POOL, DRAWN) for k in range(DRAWN + 1)])
    law = np.ones(1)
    for _ in range(n):
        law = np.convolve(law, single)
    return law[::-1].cumsum()[::-1].tolist()


def chained(records: DataFrame, order: list[str], heads: DataFrame | None = None) -> DataFrame:
    """records with previous_hash, hash and position, by game: each hash is of the hash before it and the record.

    A game has a record a date at most, so a chain is as long as the calendar. heads: game, hash, position of what is
    already there.
    """
    rows = records.groupBy("game").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in records.columns if c not in (*order, "game"))))).alias("rows"))
    if heads is not None:
        rows = rows.join(heads.select("game", F.col("hash").alias("head"), F.col("position").alias("from")), "game", "left")
    else:
        rows = rows.withColumn("head", F.lit(None).cast("string")).withColumn("from", F.lit(None).cast("bigint"))
    rows = rows.withColumn("head", F.coalesce("head", F.lit(GENESIS))).withColumn("from", F.coalesce(F.col("from") + 1, F.lit(0)))
    step = lambda a, r: F.concat(a, F.array(F.sha2(F.concat(F.element_at(a, -1), r["record"]), 256)))
    rows = rows.withColumn("hashes", F.aggregate("rows", F.array("head"), step))
    out = rows.select("game", "hashes", "from", F.posexplode("rows").alias("i", "r"))
    return out.select("game", "r.*", F.get("hashes", F.col("i")).alias("previous_hash"), F.get("hashes", F.col("i") + 1).alias("hash"), (F.col("from") + F.col("i")).alias("position"))


def _there(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the ledger; empty before its first record."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, "forecasts", FORECAST)


def scores(spark: SparkSession, path: str) -> DataFrame:
    return _there(spark, path, "scores", SCORE)


def _heads(table: DataFrame) -> DataFrame:
    return table.groupBy("game").agg(F.max(F.struct("position", "hash")).alias("m")).select("game", "m.hash", "m.position")


def record(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Appends forecasts and returns those appended: the ones that were still open, are whole, and aren't there yet.

    new: game, target_date, cohort, main (five distinct numbers), chance, training_last_date, recorded_at. A forecast is
    open until the cutoff of its target date, and its training ends before that date. A new cohort of a game takes the
    next index.
    """
    old = forecasts(spark, path)
    whole = (F.size(F.array_distinct("main")) == DRAWN) & (F.array_min("main") >= 1) & (F.array_max("main") <= POOL) & F.col("chance").between(1, 10) & (F.col("training_last_date") < F.col("target_date"))
    fresh = new.where(recording_open(F.col("target_date"), F.col("recorded_at")) & whole).join(old.select("game", "target_date"), ["game", "target_date"], "left_anti")
    fresh = fresh.groupBy("game", "target_date").agg(F.min(F.struct("cohort", F.array_sort("main").alias("main"), "chance", "training_last_date")).alias("f")).select("game", "target_date", "f.*")
    known = old.groupBy("game", "cohort").agg(F.max("cohort_index").alias("cohort_index"))
    top = old.groupBy("game").agg(F.max("cohort_index").alias("top"))
    more = fresh.groupBy("game", "cohort").agg(F.min("target_date").alias("since")).join(known, ["game", "cohort"], "left_anti").join(top, "game", "left")
    more = more.select("game", "cohort", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("game").orderBy("since", "cohort"))).alias("cohort_index"))
    fresh = fresh.join(known.unionByName(more), ["game", "cohort"])
    text = F.to_json(F.struct("chance", "cohort", "cohort_index", "game", "main", "target_date", "training_last_date"))
    out = chained(fresh.withColumn("record", text), ["target_date"], _heads(old))
    out.select(*(c.split()[0] for c in FORECAST.split(", "))).coalesce(1).write.mode("append").parquet(f"{path}/forecasts")
    return forecasts(spark, path).join(old.select("hash"), "hash", "left_anti")


def score_pending(spark: SparkSession, path: str, draws: DataFrame, now: Column) -> DataFrame:
    """Scores what can be scored, each forecast once, and returns game, target_date, reason of what can't: open, then absent.

    draws: game, draw_date, draw_id, numbers, chance; of several draws of a game and date the last by id counts.
    """
    pending = forecasts(spark, path).join(scores(spark, path).select("game", "target_date"), ["game", "target_date"], "left_anti")
    last = draws.groupBy("game", F.col("draw_date").alias("target_date")).agg(F.max(F.struct("draw_id", F.array_sort("numbers").alias("drawn"), F.col("chance").alias("drawn_chance"))).alias("d"))
    met = pending.join(last, ["game", "target_date"], "left")
    reason = F.when(recording_open(F.col("target_date"), now), "open").when(F.col("d").isNull(), "absent")
    met = met.withColumn("reason", reason)
    ready = met.where("reason IS NULL").select("game", "target_date", F.col("hash").alias("forecast_hash"), "d.drawn", "d.drawn_chance", F.size(F.array_intersect("main", "d.drawn")).alias("main_hits"), (F.col("chance") == F.col("d.drawn_chance")).cast("int").alias("chance_hit"))
    text = F.to_json(F.struct("chance_hit", "drawn", "drawn_chance", "forecast_hash", "main_hits"))
    left = stage(met.where("reason IS NOT NULL").select("game", "target_date", "reason"), "ledger-left")  # before the scores are there
    out = chained(ready.withColumn("record", text), ["target_date"], _heads(scores(spark, path)))
    out.select(*(c.split()[0] for c in SCORE.split(", "))).coalesce(1).write.mode("append").parquet(f"{path}/scores")
    return left


def verify(spark: SparkSession, path: str) -> DataFrame:
    """kind, game, target_date, problem: every record whose hash, link or score doesn't hold; none in a sound ledger."""
    problems = None
    order = Window.partitionBy("game").orderBy("position")  # a record a date
    for kind, table in (("forecast", forecasts(spark, path)), ("score", scores(spark, path))):
        before = F.coalesce(F.lag("hash").over(order), F.lit(GENESIS))
        x = table.withColumn("gap", (F.row_number().over(order) - 1 != F.col("position")) | (before != F.col("previous_hash")))
        bad = x.select(F.lit(kind).alias("kind"), "game", "target_date", F.when(F.col("gap"), "link").when(F.sha2(F.concat("previous_hash", "record"), 256) != F.col("hash"), "hash").alias("problem")).where("problem IS NOT NULL")
        problems = bad if problems is None else problems.unionByName(bad)
    told = scores(spark, path).join(forecasts(spark, path).select("game", "target_date", "main", "chance", F.col("hash").alias("own")), ["game", "target_date"], "left")
    wrong = F.col("own").isNull() | (F.col("own") != F.col("forecast_hash")) | (F.size(F.array_intersect("main", "drawn")) != F.col("main_hits")) | ((F.col("chance") == F.col("drawn_chance")).cast("int") != F.col("chance_hit"))
    return problems.unionByName(told.where(wrong).select(F.lit("score").alias("kind"), "game", "target_date", F.lit("value").alias("problem")))


def cohorts(spark: SparkSession, path: str) -> DataFrame:
    """game, cohort_index, forecasts, scores, hits of its first hundred scores, mean, uplift, p_value, alpha, chance_hits and status.

    The verdict is of the first hundred scores by target date and stays as it is when more come: the exact tail of the
    hits against the cohort's share of the level. With fewer it is insufficient_data.
    """
    table = forecasts(spark, path).join(scores(spark, path).select("game", "target_date", "main_hits", "chance_hit"), ["game", "target_date"], "left")
    order = Window.partitionBy("game", "cohort_index").orderBy(F.col("main_hits").isNull(), "target_date")
    first = (F.row_number().over(order) <= QUALIFYING) & F.col("main_hits").isNotNull()
    x = table.withColumn("first", first).groupBy("game", "cohort_index").agg(F.count(F.lit(1)).alias("forecasts"), F.count("main_hits").alias("scores"), F.count_if("first").alias("n"), F.sum(F.when(F.col("first"), F.col("main_hits"))).alias("hits"), F.coalesce(F.sum("chance_hit"), F.lit(0)).alias("chance_hits"))
    tail = F.array(*(F.lit(float(v)) for v in exact_tail()))
    p = F.when(F.col("n") == QUALIFYING, F.get(tail, F.col("hits").cast("int")))
    alpha = ALPHA / (F.col("cohort_index") * (F.col("cohort_index") + 1))
    status = F.when(p.isNull(), "insufficient_data").when(p < alpha, "qualified").otherwise("not_qualified")
    mean = F.col("hits") / F.col("n")
    return x.select("game", "cohort_index", "forecasts", "scores", "hits", F.round(mean, 9).alias("mean"), F.round(mean - DRAWN * EXPECTED, 9).alias("uplift"), F.round(p, 9).alias("p_value"), F.round(alpha, 12).alias("alpha"), "chance_hits", status.alias("status"))


def intervals(spark: SparkSession, path: str, *, replicates: int = 2000) -> DataFrame:
    """game, cohort_index, scores, uplift, low, high, p_value, alpha, status of the first hundred scores of each cohort that has so many.

    The 95% interval of the mean uplift is an IID bootstrap's; a cohort qualifies if it lies above 0 and the exact tail is
    below the cohort's share of the level.
    """
    met = forecasts(spark, path).join(scores(spark, path).select("game", "target_date", "main_hits"), ["game", "target_date"])
    place = F.row_number().over(Window.partitionBy("game", "cohort_index").orderBy("target_date")) - 1  # a forecast a date
    first = met.withColumn("i", place).where(F.col("i") < QUALIFYING).select("game", "cohort_index", "i", (F.col("main_hits") - DRAWN * EXPECTED).alias("uplift"))
    told = resampled(first, ["game", "cohort_index"], "uplift", "i", replicates=replicates).where(F.col("n") == QUALIFYING)
    hits = F.round((F.col("observed") + DRAWN * EXPECTED) * QUALIFYING).cast("int")
    p = F.get(F.array(*(F.lit(float(v)) for v in exact_tail())), hits)
    alpha = ALPHA / (F.col("cohort_index") * (F.col("cohort_index") + 1))
    status = F.when((F.col("low") > 0) & (p < alpha), "qualified").otherwise("not_qualified")
    return told.select("game", "cohort_index", F.col("n").alias("scores"), F.round("observed", 9).alias("uplift"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), F.round(p, 9).alias("p_value"), F.round(alpha, 12).alias("alpha"), status.alias("status"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, target_date, cohort (the year), main, chance, training_last_date, recorded_at: forecasts of each game for each date it is drawn on.

    The five likeliest smoothed numbers and the commonest chance number of the game, ties to the smaller one, from dates before.
    """
    p = smoothed(lift.table(spark, sf_dir, "hist")).where("h >= 100")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.round("p", 12)).alias("p"), "number"))), 1, DRAWN)
    main = p.groupBy("draw_date").agg(F.transform(best, lambda x: x["number"]).alias("main"))
    draws = lift.table(spark, sf_dir, "draws")
    dates = draws.select("game", "draw_date").distinct()
    pool = spark.range(1, 11).select(F.col("id").alias("chance"))
    grid = dates.crossJoin(F.broadcast(pool)).join(draws.groupBy("game", "draw_date", "chance").agg(F.count(F.lit(1)).alias("k")), ["game", "draw_date", "chance"], "left")
    before = Window.partitionBy("game", "chance").orderBy("draw_date").rowsBetween(Window.unboundedPreceding, -1)
    seen = grid.select("game", "draw_date", "chance", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("c"))
    chance = seen.groupBy("game", "draw_date").agg(F.min(F.struct((-F.col("c")).alias("c"), "chance"))["chance"].alias("chance"))
    last = lift.table(spark, sf_dir, "days").select("draw_date", F.lag("draw_date").over(Window.orderBy("draw_date")).alias("training_last_date"))
    out = dates.join(main, "draw_date").join(chance, ["game", "draw_date"]).join(last, "draw_date")
    return out.select("game", F.col("draw_date").alias("target_date"), F.year("draw_date").alias("cohort"), "main", "chance", "training_last_date", F.to_timestamp(F.concat(F.col("draw_date").cast("string"), F.lit(" 08:00:00"))).alias("recorded_at"))


def _filled(spark: SparkSession, sf_dir: str) -> str:
    path = folder(spark, "ledger")
    record(spark, path, proposals(spark, sf_dir))
    score_pending(spark, path, lift.table(spark, sf_dir, "draws"), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return path


def cohort_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of a ledger of all dates' forecasts."""
    return intervals(spark, _filled(spark, sf_dir))


def number_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of a ledger of all dates' forecasts."""
    return cohorts(spark, _filled(spark, sf_dir))


def ledger_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """game, records, head, problems: the last hash of each game's chain of forecasts, and what verification finds."""
    path = _filled(spark, sf_dir)
    heads = _heads(forecasts(spark, path)).select("game", (F.col("position") + 1).alias("records"), F.col("hash").alias("head"))
    return heads.join(verify(spark, path).groupBy("game").agg(F.count(F.lit(1)).alias("problems")), "game", "left").na.fill(0, ["problems"])


QUERIES = {"cohort_intervals": cohort_intervals, "number_ledger": number_ledger, "ledger_heads": ledger_heads}

_FORECASTS = f"""WITH {lift.LIFT},
dd AS (SELECT draw_date, count(*) AS n FROM draws GROUP BY 1), cal AS (SELECT a.draw_date, (SELECT sum(b.n) FROM dd b WHERE b.draw_date < a.draw_date) AS h, (SELECT max(b.draw_date) FROM dd b WHERE b.draw_date < a.draw_date) AS pd FROM dd a),
num AS (SELECT unnest(generate_series(1, 49)) AS number), ev AS (SELECT d.draw_date, m.number, count(*) AS k FROM draws d JOIN draw_numbers m USING (draw_id) GROUP BY 1, 2),
sp AS (SELECT c.draw_date, u.number, 5 * (coalesce(sum(e.k), 0) + 20.0::DOUBLE) / (5 * any_value(c.h) + 980.0::DOUBLE) AS p FROM cal c CROSS JOIN num u LEFT JOIN ev e ON e.number = u.number AND e.draw_date < c.draw_date WHERE c.h >= 100 GROUP BY 1, 2),
mn AS (SELECT draw_date, list(number ORDER BY number) AS main FROM (SELECT *, row_number() OVER (PARTITION BY draw_date ORDER BY round(p, 12) DESC, number) AS r FROM sp) q WHERE r <= 5 GROUP BY 1),
gd AS (SELECT DISTINCT game, draw_date FROM draws), ck AS (SELECT game, draw_date, chance, count(*) AS k FROM draws GROUP BY 1, 2, 3),
cc AS (SELECT g.game, g.draw_date, c.c AS chance, coalesce(sum(k.k), 0) AS k FROM gd g CROSS JOIN (SELECT unnest(generate_series(1, 10)) AS c) c LEFT JOIN ck k ON k.game = g.game AND k.chance = c.c AND k.draw_date < g.draw_date GROUP BY 1, 2, 3),
ch AS (SELECT game, draw_date, chance FROM (SELECT *, row_number() OVER (PARTITION BY game, draw_date ORDER BY k DESC, chance) AS r FROM cc) q WHERE r = 1),
fc AS (SELECT g.game, g.draw_date, year(g.draw_date) AS cohort, dense_rank() OVER (PARTITION BY g.game ORDER BY year(g.draw_date)) AS ci, main, ch.chance, cal.pd FROM gd g JOIN mn USING (draw_date) JOIN ch ON ch.game = g.game AND ch.draw_date = g.draw_date JOIN cal ON cal.draw_date = g.draw_date)"""

ORACLE_SQL = {
    "number_ledger": _FORECASTS
    + f""", ld AS (SELECT game, draw_date, max(draw_id) AS draw_id FROM draws GROUP BY 1, 2),
hit AS (SELECT l.game, l.draw_date, count(m.number) AS hits FROM ld l JOIN fc f ON f.game = l.game AND f.draw_date = l.draw_date LEFT JOIN draw_numbers m ON m.draw_id = l.draw_id AND list_contains(f.main, m.number) GROUP BY 1, 2),
sc AS (SELECT f.*, hit.hits, CASE WHEN d.chance = f.chance THEN 1 ELSE 0 END AS c1, row_number() OVER (PARTITION BY f.game, ci ORDER BY f.draw_date) AS r FROM fc f JOIN hit ON hit.game = f.game AND hit.draw_date = f.draw_date JOIN ld ON ld.game = f.game AND ld.draw_date = f.draw_date JOIN draws d ON d.draw_id = ld.draw_id),
tl AS (SELECT [{", ".join(repr(float(v)) for v in exact_tail())}] AS t),
a AS (SELECT game, ci, count(*) AS forecasts, count(*) AS scores, count(*) FILTER (WHERE r <= 100) AS n, sum(hits) FILTER (WHERE r <= 100) AS hits, sum(c1) AS chance_hits FROM sc GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN n = 100 THEN t[hits::INT + 1] END AS p, 0.05::DOUBLE / (ci * (ci + 1)) AS alpha FROM a CROSS JOIN tl)
SELECT game, ci AS cohort_index, forecasts, scores, hits, round(hits / n, 9) AS mean, round(hits / n - 25.0::DOUBLE / 49, 9) AS uplift, round(p, 9) AS p_value, round(alpha, 12) AS alpha, chance_hits, CASE WHEN p IS NULL THEN 'insufficient_data' WHEN p < alpha THEN 'qualified' ELSE 'not_qualified' END AS status FROM b""",
    "ledger_heads": _FORECASTS
    + f""", rc AS (SELECT game, draw_date, '{{"chance":' || chance || ',"cohort":' || cohort || ',"cohort_index":' || ci || ',"game":"' || game || '","main":[' || array_to_string(main, ',') || '],"target_date":"' || draw_date || '","training_last_date":"' || pd || '"}}' AS rec FROM fc)
SELECT game, count(*) AS records, list_reduce(list_concat(['{GENESIS}'], list(rec ORDER BY draw_date)), lambda a, x: sha256(a || x)) AS head, 0 AS problems FROM rc GROUP BY 1""",
}

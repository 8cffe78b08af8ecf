"""Scores forecasts as results arrive: a stream of orders meets the pending forecasts, and each score is appended once."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnspark.plans.staging import folder


def score_results(results: DataFrame, forecasts: DataFrame, *, late: str = "7 days") -> DataFrame:
    """forecast_id, observed_at, forecast, outcome, brier of each result (a stream) that has a forecast.

    results: result_id, observed_at timestamp, outcome (1 or 0). A result that comes again within the time for late
    rows is scored once. Results without a forecast, and null ids, give no row.
    """
    once = results.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["result_id"])
    met = once.join(forecasts.select("forecast_id", "forecast"), F.col("result_id") == F.col("forecast_id"))
    return met.select("forecast_id", "observed_at", "forecast", "outcome", F.pow(F.col("forecast") - F.col("outcome"), 2).alias("brier"))


def drain(scores: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all that is there and returns the appended table; a restart goes on from its checkpoint."""
    spark = scores.sparkSession
    run = scores.writeStream.format("parquet").option("path", f"{folder}/scores").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{folder}/scores")


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from SINCE on as results (finished or not), scored against what the orders before SINCE foretell for their priority."""
    static = spark.read.parquet(f"{sf_dir}/orders.parquet")
    known = static.where(F.col("o_orderdate") < F.lit(SINCE).cast("timestamp"))
    rates = known.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("forecast"))
    forecasts = static.where(F.col("o_orderdate") >= F.lit(SINCE).cast("timestamp")).join(rates, F.col("o_orderpriority") == F.col("kind")).select(F.col("o_orderkey").alias("forecast_id"), "forecast")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/orders.parquet*")
    results = stream.select(F.col("o_orderkey").alias("result_id"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), (F.col("o_orderstatus") == "F").cast("int").alias("outcome"))
    out = drain(score_results(results, forecasts), folder(spark, "stream-scores"))
    return out.select("forecast_id", F.date_format("observed_at", "yyyy-MM-dd").alias("observed_on"), F.round("forecast", 9).alias("forecast"), "outcome", F.round("brier", 9).alias("brier"))


#: Forecasts are made of what lies before this date.
SINCE = "1998-01-01"

QUERIES = {"stream_scores": stream_scores}
ORACLE_SQL = {
    "stream_scores": f"""WITH r AS (SELECT o_orderpriority AS k, count(*) FILTER (WHERE o_orderstatus = 'F') * 1e0 / count(*) AS f FROM orders WHERE o_orderdate < DATE '{SINCE}' GROUP BY 1),
o AS (SELECT *, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders WHERE o_orderdate >= DATE '{SINCE}')
SELECT o_orderkey AS forecast_id, strftime(o_orderdate, '%Y-%m-%d') AS observed_on, round(f, 9) AS forecast, y AS outcome, round((f - y) * (f - y), 9) AS brier FROM o JOIN r ON r.k = o_orderpriority"""
}

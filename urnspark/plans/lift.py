"""Draws, their numbers and their prizes, lifted from the order tables once for all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urnspark.plans.staging import folder

#: The views in SQL, for the checking side. Five distinct numbers per order that has as many residues.
LIFT = """nums AS (SELECT DISTINCT l_orderkey AS k, CAST(l_partkey % 49 + 1 AS BIGINT) AS n FROM lineitem),
ranked AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY (n * 31 + k * 17) % 53) AS rn, count(*) OVER (PARTITION BY k) AS c FROM nums),
draw_numbers AS (SELECT k AS draw_id, n AS number FROM ranked WHERE c >= 5 AND rn <= 5),
ids AS (SELECT DISTINCT draw_id FROM draw_numbers),
draws AS (SELECT o_orderkey AS draw_id, CAST(o_orderdate AS DATE) AS draw_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'super_loto' WHEN '2-HIGH' THEN 'grand_loto' ELSE 'loto' END AS game,
  CAST(o_custkey % 10 + 1 AS BIGINT) AS chance, o_custkey AS ck, CAST(floor(o_totalprice) AS BIGINT) AS tp
  FROM orders JOIN ids ON o_orderkey = draw_id)"""

#: The same on Spark's side, of the lifted tables.
NUMBERS = "draw_numbers AS (SELECT draw_id, number FROM draws LATERAL VIEW explode(numbers) e AS number)"

#: Base winners and payouts of the nine ranks: fixed values of the published schedule.
SCHEDULE = ((1, 0, 2e6), (2, 0, 1e5), (3, 46, 1236.4), (4, 463, 443.0), (5, 2440, 50.2), (6, 23747, 18.5), (7, 35802, 9.5), (8, 335317, 4.0), (9, 300000, 2.2))

PRIZES = f"""base AS (SELECT * FROM (VALUES {", ".join(f"({r}, {w}, {p:e})" for r, w, p in SCHEDULE)}) AS t(rank, bw, bp)),
prizes AS (SELECT draw_id, CAST(rank AS INT) AS rank,
  CAST(CASE WHEN rank = 1 THEN CASE WHEN draw_id % 7 = 0 THEN 1 + ck % 2 ELSE 0 END
    WHEN rank = 2 THEN CASE WHEN draw_id % 40 = 0 THEN NULL ELSE draw_id % 5 END
    WHEN rank = 9 THEN 300000 + (draw_id % 997) * 200 + tp % 50000 ELSE bw + (draw_id * rank) % bw END AS BIGINT) AS winners,
  CASE WHEN rank = 1 THEN 2e6 + 1e6 * (draw_id % 13) WHEN rank = 2 THEN 1e5 + 1e3 * (draw_id % 101) WHEN rank = 9 THEN 2.2e0
    WHEN rank = 8 AND draw_id % 50 = 0 THEN NULL ELSE bp * (1 + (draw_id % 21 - 10) / 100e0) END AS payout
  FROM draws CROSS JOIN base)"""


def lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draw_id, draw_date, game, chance, ck, tp, numbers (five, in the lifting's order) of each order with five residues.

    One pass of the line items: residues are gathered by order (at most 49 of them) and the order's row joined once.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 49 + 1).cast("bigint").alias("n"))
    ranked = F.transform(F.collect_set("n"), lambda n: F.struct(((n * 31 + F.col("k") * 17) % 53).alias("r"), n.alias("n")))
    five = items.groupBy("k").agg(F.slice(F.sort_array(ranked), 1, 5).alias("five")).where(F.size("five") == 5)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("draw_id"),
        F.to_date("o_orderdate").alias("draw_date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "super_loto").when(F.col("o_orderpriority") == "2-HIGH", "grand_loto").otherwise("loto").alias("game"),
        (F.col("o_custkey") % 10 + 1).cast("bigint").alias("chance"),
        F.col("o_custkey").alias("ck"),
        F.floor("o_totalprice").cast("bigint").alias("tp"),
    )
    return orders.join(five, F.col("draw_id") == F.col("k")).select(*orders.columns, F.transform("five", lambda x: x["n"]).alias("numbers"))


def days(draws: DataFrame) -> DataFrame:
    """draw_date, n, h: draws of a date, and of all dates before. Windows over dates are as long as the calendar."""
    before = Window.orderBy("draw_date").rowsBetween(Window.unboundedPreceding, -1)
    return draws.groupBy("draw_date").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.coalesce(F.sum("n").over(before), F.lit(0)))


def placed(draws: DataFrame, days: DataFrame) -> DataFrame:
    """draw_id, draw_date, game, chance, numbers, place, idx: place of a draw in its date by (game, id), and in all draws; both from 0."""
    w = Window.partitionBy("draw_date").orderBy("game", "draw_id")
    return draws.join(days.select("draw_date", "h"), "draw_date").select("draw_id", "draw_date", "game", "chance", "numbers", (F.row_number().over(w) - 1).alias("place"), (F.col("h") + F.row_number().over(w) - 1).alias("idx"))


def hist(spark: SparkSession, placed: DataFrame, days: DataFrame) -> DataFrame:
    """draw_date, number, n, h, k, c, seen: a number's draws on a date and before it, and the index of its last draw before it."""
    hits = placed.select("draw_date", "idx", F.explode("numbers").alias("number")).groupBy("draw_date", "number").agg(F.count(F.lit(1)).alias("k"), F.max("idx").alias("at"))
    grid = days.crossJoin(F.broadcast(spark.range(1, 50).select(F.col("id").alias("number")))).join(hits, ["draw_date", "number"], "left")
    before = Window.partitionBy("number").orderBy("draw_date").rowsBetween(Window.unboundedPreceding, -1)
    return grid.select("draw_date", "number", "n", "h", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("c"), F.max("at").over(before).alias("seen"))


#: Where a session has put the lifted tables, by folder of the source.
_kept: dict[tuple[str, str], str] = {}


def tables(spark: SparkSession, sf_dir: str) -> str:
    """Lifts the draws once for a session and a source, as Parquet; all queries read these. Returns their folder.

    draws and placed grow with the input; days and hist with the calendar.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = _write(spark, lifted(spark, sf_dir))
    return _kept[key]


def only(spark: SparkSession, sf_dir: str, *, game: str | None = None, as_of=None, target=None) -> str:
    """A source with the draws of one game, or up to a date alone: its name, which every query takes for a folder.

    target: a date after all draws, which then stands in days and hist with all of them before it and none on it.
    """
    name = f"{sf_dir}?game={game}&as_of={as_of}&target={target}"
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        draws = table(spark, sf_dir, "draws")
        if game is not None:
            draws = draws.where(F.col("game") == game)
        if as_of is not None:
            draws = draws.where(F.col("draw_date") <= F.lit(as_of))
        _kept[key] = _write(spark, draws, target)
    return name


def _write(spark: SparkSession, draws: DataFrame, target=None) -> str:
    path = folder(spark, "lifted")
    write = lambda df, name: (df.write.parquet(f"{path}/{name}"), spark.read.parquet(f"{path}/{name}"))[1]
    draws = write(draws, "draws")
    by_day = days(draws)
    if target is not None:
        by_day = by_day.unionByName(draws.agg(F.lit(target).cast("date").alias("draw_date"), F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("h")))
    by_day = write(by_day.coalesce(1), "days")
    rows = write(placed(draws, by_day), "placed")
    write(hist(spark, rows, by_day), "hist")
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables(spark, sf_dir)}/{name}")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in ("draws", "days", "placed", "hist"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)

"""Exact quantiles of many groups at once, from counts of ever smaller ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnspark.plans.staging import stage


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], *, weight: str | None = None, nearest: bool = False, buckets: int = 256) -> DataFrame:
    """by, p, quantile: of each group the quantiles of a finite value, with linear interpolation between neighbours.

    weight: a column of whole numbers; a row counts so many times. Null and NaN values, and weights of 0, are left out; a
    group of none has no row. Nulls of by form groups of their own. nearest: the value at the nearest place instead, halves going
    to the even one.

    A rank's range begins as all of its group. Each round counts the rows of the open ranges in buckets, with the least
    and the greatest value of each, and a rank goes on in the bucket that holds it, until one value is left. Counts are
    combined before the shuffle, so a group of any size costs buckets, and no task holds a group's values.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, weight=weight, nearest=nearest, buckets=buckets).drop("_all")
    v, w = F.col(value).cast("double"), (F.lit(1) if weight is None else F.col(weight)).cast("long")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (w > 0)).select(*(F.col(c).alias(k) for c, k in zip(by, keys)), (v + 0.0).alias("_v"), w.alias("_w"))
    every = stage(rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantile-groups")
    ps = F.array(*(F.lit(float(p)) for p in probs))
    places = every.select(*keys, "_n", "_lo", "_hi", F.explode(ps).alias("p")).withColumn("_at", (lambda at: F.bround(at, 0) if nearest else at)(F.col("p") * (F.col("_n") - 1)))
    ends = F.array(F.floor("_at"), F.ceil("_at"))
    ranks = places.select(*keys, F.explode(ends).alias("_rank"), "_lo", "_hi").distinct().withColumn("_below", F.lit(0).cast("long"))
    now, found = stage(ranks, "ranks"), []
    same = lambda a, b: reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))
    while True:
        found.append(now.where("_lo = _hi"))
        now = now.where("_lo < _hi")
        if now.isEmpty():
            break
        ranges = now.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("_lo", "_hi"))).alias("_ranges"))
        inside = rows.alias("a").join(ranges.alias("b"), same("a", "b")).select("a.*", F.get(F.filter("_ranges", lambda r: (F.col("_v") >= r["_lo"]) & (F.col("_v") <= r["_hi"])), F.lit(0)).alias("_r")).where("_r IS NOT NULL")
        wide = F.col("_r._hi") / 2 - F.col("_r._lo") / 2  # halves, so that no range overflows
        share = F.when(wide > 0, ((F.col("_v") / 2 - F.col("_r._lo") / 2) / wide * buckets).cast("int")).otherwise(0)
        bucket = F.when(F.col("_v") == F.col("_r._hi"), buckets).otherwise(F.least(share, F.lit(buckets - 1)))
        counted = inside.groupBy(*keys, F.col("_r._lo").alias("_from"), F.col("_r._hi").alias("_to"), bucket.alias("_b")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(*keys, "_from", "_to").orderBy("_b")  # buckets
        counted = counted.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
        place = F.col("a._rank") - F.col("a._below")
        hit = same("a", "b") & (F.col("a._lo") == F.col("b._from")) & (F.col("a._hi") == F.col("b._to"))
        held = now.alias("a").join(counted.alias("b"), hit).where((place >= F.col("_before")) & (place < F.col("_before") + F.col("b._n")))
        now = stage(held.select(*(F.col(f"a.{k}") for k in keys), "_rank", F.col("b._lo"), F.col("b._hi"), (F.col("_below") + F.col("_before")).alias("_below")), "ranks")
    at = reduce(DataFrame.unionByName, found).select(*keys, "_rank", F.col("_lo").alias("_value"))
    side = lambda name, rank: at.select(*(F.col(k).alias(f"{name}{k}") for k in keys), F.col("_rank").alias(rank), F.col("_value").alias(f"{name}_value"))
    meets = lambda name: reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{name}{k}")) for k in keys), F.lit(True))
    out = places.join(side("l", "l_rank"), meets("l") & (F.floor("_at") == F.col("l_rank"))).join(side("h", "h_rank"), meets("h") & (F.ceil("_at") == F.col("h_rank")))
    between: Column = F.col("l_value") + (F.col("_at") - F.floor("_at")) * (F.col("h_value") - F.col("l_value"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "p", between.alias("quantile"))

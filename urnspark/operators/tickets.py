"""Tickets drawn by weight without replacement, few of them alike and off the crowd's paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urnspark.functions.probability import CHANCES, DRAWN, POOL
from urnspark.operators.forecasts import smoothed
from urnspark.operators.inference import crowd
from urnspark.plans import lift

#: Fixed value: what distance from the tickets chosen before counts, against the crowd's score.
DIVERSITY = 3.0


def uniform(*key: Column) -> Column:
    """A number between 0 and 1 from a hash of the key; never either."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", *(k.cast("string") for k in key))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def sampled(groups: DataFrame, count: int, *, seed: int = 0) -> DataFrame:
    """by, k, numbers: for each row (by, weights: 49 above 0) count samples of five numbers, by weight and without replacement.

    A number's key is the logarithm of a uniform over its weight; the five greatest keys are the sample, whose law is that
    of drawing one after another. Keys come from a hash of group, sample and number, so samples need no order and any
    task can draw them again. A weight that isn't above 0 fails the read.
    """
    fine = (F.size("weights") == POOL) & F.forall("weights", lambda w: F.coalesce(w > 0, F.lit(False)))
    checked = F.when(fine, F.col("weights")).otherwise(F.raise_error(F.lit(f"{POOL} weights above 0 are needed")).cast("array<double>"))
    rows = groups.select("by", checked.alias("weights")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    keys = F.transform(F.sequence(F.lit(1), F.lit(POOL)), lambda n: F.struct((F.log(uniform(F.lit(seed), F.col("by"), F.col("k"), n)) / F.get("weights", n - 1)).alias("key"), n.alias("n")))
    return rows.select("by", "k", F.array_sort(F.transform(F.slice(F.sort_array(keys, asc=False), 1, DRAWN), lambda x: x["n"])).alias("numbers"))


def generate(groups: DataFrame, count: int, *, candidates: int = 300, seed: int = 0, anti_crowd: bool = True) -> DataFrame:
    """by, ticket, numbers, chance, score: count different tickets for each row of groups (by, weights).

    Ticket by ticket the best of its own candidates is taken: the crowd's score plus three times the distance, one less the share
    of its numbers in the nearest ticket before (1 for the first). Ties go to the earlier candidate; tickets chosen before don't
    count. Chance numbers go round in an order by hash. A task holds the candidates of one group, whose number the caller sets.
    """
    if count < 1 or candidates < 1:
        raise ValueError("tickets and candidates are at least one")
    kind = groups.schema["by"].dataType.simpleString()
    rows = sampled(groups, count * candidates, seed=seed)
    at = {f"n{i}": F.col("numbers")[i] for i in range(DRAWN)}
    rows = rows.withColumns(at).withColumn("crowd", F.expr(crowd(list(at))) if anti_crowd else F.lit(0.0))
    order = [r["c"] for r in groups.sparkSession.range(1, CHANCES + 1).orderBy(uniform(F.lit(seed), F.lit("chance"), F.col("id"))).select(F.col("id").alias("c")).collect()]

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("k")
        out, chosen = [], []
        for t in range(count):
            best = None
            for numbers, score in zip(x["numbers"].iloc[t * candidates : (t + 1) * candidates], x["crowd"].iloc[t * candidates : (t + 1) * candidates]):
                own = frozenset(int(v) for v in numbers)
                if own not in chosen:
                    total = score + DIVERSITY * (1 - max((len(own & c) for c in chosen), default=0) / DRAWN)
                    if best is None or total > best[0]:
                        best = (total, own)
            if best is None:
                raise ValueError("too few different candidates")
            chosen.append(best[1])
            out.append((x["by"].iloc[0], t, sorted(best[1]), order[t % CHANCES], best[0]))
        return pd.DataFrame(out, columns=["by", "ticket", "numbers", "chance", "score"])

    return rows.select("by", "k", "numbers", "crowd").groupBy("by").applyInPandas(choose, f"by {kind}, ticket int, numbers array<int>, chance int, score double")


def diverse_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tickets for each year, weighted by the frequencies known before its first draw."""
    hist = smoothed(lift.table(spark, sf_dir, "hist"))
    first = hist.groupBy(F.year("draw_date").alias("by")).agg(F.min("draw_date").alias("d"))
    at = hist.join(F.broadcast(first), F.col("draw_date") == F.col("d"))  # a row a year
    groups = at.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "p"))), lambda x: x["p"]).alias("weights"))
    out = generate(groups, 10)
    return out.select(F.col("by").alias("year"), "ticket", "numbers", "chance", F.round("score", 9).alias("score"))


QUERIES = {"diverse_tickets": diverse_tickets}

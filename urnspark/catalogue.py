"""Every query of the draw analytics with its SQL."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urnspark.operators.dialect import CHECK, SPARK, Dialect
from urnspark.operators.draws import PARTS
from urnspark.operators.draws import SQL as DRAWS
from urnspark.operators.inference import SQL as INFERENCE
from urnspark.operators.inference import resampled_deltas
from urnspark.operators import backtests, chance, chance_crowding, crowding, crowding_ledger, forecasts, ledger, nested, participation, popularity, tickets, uniformity, value, value_backtest
from urnspark.operators.models import QUERIES as MODELS
from urnspark.plans import lift
from urnspark.streaming import scorer

SQL = DRAWS | INFERENCE
_DATES = ("draw_date", "first_date", "last_date", "closed_on")


def text(name: str, d: Dialect) -> str:
    ctes, body = SQL[name](d)
    for word, sides in PARTS.items():
        ctes = ctes.replace(word, sides[not d.spark])
    if not d.spark:
        shown = re.sub(r"\([^()]*\)", "", body[len("SELECT ") : body.index(" FROM ")])
        named = {item.split()[-1].rpartition(".")[2] for item in shown.split(",") if item.split()}
        if dates := [c for c in _DATES if c in named]:
            body = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({body}) dated"
    return "WITH " + ",\n".join(x for x in (lift.NUMBERS if d.spark else lift.LIFT, lift.PRIZES, ctes) if x) + "\n" + body


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lift.run(spark, sf_dir, text(name, SPARK))
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def _resampled(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block bootstrap's interval, or the block sign test, of the Brier scores' deltas."""
    out = resampled_deltas(lift.run(spark, sf_dir, text("brier_deltas", SPARK)))
    columns = ("observed", "low", "high") if kind == "interval" else ("observed", F.col("p_lower").alias("p_value"))
    return out.select("n", *(F.round(c, 9).alias(c) if isinstance(c, str) else F.round(c, 9).alias("p_value") for c in columns))


QUERIES = {name: partial(_run, name) for name in SQL} | forecasts.QUERIES | chance.QUERIES | ledger.QUERIES | backtests.QUERIES | nested.QUERIES | uniformity.QUERIES | participation.QUERIES | value.QUERIES | value_backtest.QUERIES | popularity.QUERIES | crowding.QUERIES | crowding_ledger.QUERIES | chance_crowding.QUERIES | tickets.QUERIES | MODELS | scorer.QUERIES
QUERIES |= {"block_bootstrap_ci": partial(_resampled, "interval"), "block_sign_permutation": partial(_resampled, "test")}
ORACLE_SQL = {name: text(name, CHECK) for name in SQL} | forecasts.ORACLE_SQL | chance.ORACLE_SQL | chance_crowding.ORACLE_SQL | ledger.ORACLE_SQL | scorer.ORACLE_SQL

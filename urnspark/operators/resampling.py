"""Bootstrap intervals and sign-flip tests: a unit is one row whatever the replicates.

A unit's weight in a replicate comes from a hash of both, so no replicate is dealt row by row, nothing is joined, and a
task that is run again draws the same.
"""

from __future__ import annotations

from functools import reduce
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units whose weights are drawn at once.
AT_ONCE = 512
MASK = np.uint64(0xFFFFFFFF)


def _bits(replicate: np.ndarray, unit: np.ndarray, salt: int) -> np.ndarray:
    """bits32 in 32-bit numbers, whose products wrap as the masks of its SQL do."""
    r, u = np.asarray(replicate).astype(np.uint64), np.asarray(unit).astype(np.uint64)
    u = ((u & MASK) * np.uint64(2654435761) + (u >> np.uint64(32)) * np.uint64(40503) & MASK).astype(np.uint32)
    r = ((r & MASK) * np.uint64(2246822519) + np.uint64(salt) & MASK).astype(np.uint32)
    x = r[:, None] + u[None, :]
    shifted = np.empty_like(x)
    for shift, by in ((16, 2146121005), (15, 2221713035)):
        x ^= np.right_shift(x, np.uint32(shift), out=shifted)
        x *= np.uint32(by)
    x ^= np.right_shift(x, np.uint32(16), out=shifted)
    return x


def bits32(replicate: np.ndarray, unit: np.ndarray, salt: int) -> np.ndarray:
    """32 bits of each replicate and unit: a row a replicate. Fixed constants; whole numbers only, so that SQL can say it."""
    return _bits(replicate, unit, salt).astype(np.uint64)


def bits32_sql(replicate: str, unit: str, salt: int) -> str:
    """The same in the checking SQL: numbers of 128 bits keep each product whole, and a step is a look at the one before."""
    m = "4294967295::HUGEINT"
    steps = [f"((({unit})::HUGEINT & {m}) * 2654435761 + (({unit})::HUGEINT >> 32) * 40503 + ({replicate})::HUGEINT * 2246822519 + {salt}) & {m}"]
    steps += [f"(xor(h, h >> {shift}) * {by}) & {m}" for shift, by in ((16, 2146121005), (15, 2221713035))] + ["xor(h, h >> 16)"]
    # (SELECT f(h) FROM (SELECT x AS h)), innermost first.
    out = f"SELECT {steps[0]} AS h"
    for s in steps[1:]:
        out = f"SELECT {s} AS h FROM ({out}) t"
    return f"({out})"


def poisson_ends(rate: float) -> list[int]:
    """Of 2**32, the bits below which a Poisson weight is at most 0, 1, 2, ...; its last value takes the rest."""
    out, term, total, k = [], exp(-rate), 0.0, 0
    while total + term < 1 - 2**-33 and k < 64:
        total += term
        out.append(int(total * 2**32))
        k += 1
        term *= rate / k
    return out


def _weights(bits: np.ndarray, ends: list[int]) -> np.ndarray:
    """Poisson weights: how many of the ends don't exceed the bits."""
    w = np.zeros(bits.shape, dtype=np.uint8)
    for e in ends:
        w += bits >= np.uint32(e)
    return w


def _ranges(x: pd.DataFrame, columns: list[str], n: int, block: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the moving blocks of a chunk and the sums of each column; x has the rows up to the end of the last block."""
    first = int(x["_chunk"].iloc[0]) * chunk
    run = np.vstack([np.zeros(len(columns)), np.cumsum(x[columns].to_numpy(float), axis=0)])
    starts = np.arange(first, min(first + chunk, n - block + 1))
    at = starts - first
    return starts, run[at + block] - run[at]


def resampled(df: DataFrame, by: list[str], value: str, place: str, *, replicates: int = 2000, block: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """by, n, observed, low, high, p_lower: of each group the mean of value, its 95% bootstrap interval, and a sign test.

    place: the row's place in its group, from 0 without gaps. low, high: over replicates in which every moving block of so
    many rows (block 1: every row) has a Poisson weight, on average as many blocks as rows need; a replicate that has none
    takes the observed mean. p_lower: the share of replicates, this one included, whose mean with the signs of whole
    blocks flipped at random is at most the observed one. Blocks are no longer than the group. Null values count as 0;
    an empty table gives no row.

    A group is dealt into chunks of places, each with the rows that its last blocks need, so a task holds a chunk whatever
    the group's size. A chunk gives one sum a replicate, and these are added up in two steps.
    """
    return together(df, by, [value], place, replicates=replicates, block=block, chunk=chunk).drop("value")


def together(df: DataFrame, by: list[str], values: list[str], place: str, *, replicates: int = 2000, block: int = 1, chunk: int = 1 << 16) -> DataFrame:
    """by, value (a column's name), n, observed, low, high, p_lower: resampled of several columns, whose replicates share their weights and signs."""
    if not by:
        return together(df.withColumn("_all", F.lit(0)), ["_all"], values, place, replicates=replicates, block=block, chunk=chunk).drop("_all")
    keys, columns = [f"_k{i}" for i in range(len(by))], [f"_v{i}" for i in range(len(values))]
    own = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(c) for v, c in zip(values, columns)]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), *own, F.col(place).cast("long").alias("_i"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*(F.sum(c) for c in columns)).alias("_sum"))
    chunk = max(1, chunk // block) * block
    own = F.floor(F.col("_i") / chunk).cast("long")
    # The rows after a chunk that its last blocks reach into go to it as well.
    also = F.when((F.col("_i") % chunk < block - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_chunk", F.explode(also))
    meets = reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys))
    dealt = dealt.alias("a").join(totals.alias("t"), meets).select(*(F.col(f"a.{k}") for k in keys), "_chunk", "_i", *columns, "_n")
    head = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for c, k in zip(by, keys))
    runs, m = np.arange(replicates), len(columns)

    def sums(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("_i", kind="stable")
        n = int(x["_n"].iloc[0])
        size = min(block, n)
        starts, sums_ = _ranges(x, columns, n, size, chunk)
        ends = poisson_ends(-(-n // size) / (n - size + 1))
        # Rows of out: the weighted sum of each column, the weight, and the flipped sum of each column.
        told = np.column_stack([sums_, np.full(len(starts), float(size))])
        out = np.zeros((2 * m + 1, replicates))
        for a in range(0, len(starts), AT_ONCE):
            w = _weights(_bits(runs, starts[a : a + AT_ONCE], 1), ends).astype(float)
            out[: m + 1] += (w @ told[a : a + AT_ONCE]).T
        mine = x[x["_i"] // chunk == x["_chunk"]]
        group = (mine["_i"] // size).to_numpy()
        units, which = np.unique(group, return_inverse=True)
        parts = np.column_stack([np.bincount(which, weights=mine[c].to_numpy(float), minlength=len(units)) for c in columns])
        for a in range(0, len(units), AT_ONCE):
            sign = 2.0 * (_bits(runs, units[a : a + AT_ONCE], 2) & np.uint32(1)).astype(float) - 1
            out[m + 1 :] += (sign @ parts[a : a + AT_ONCE]).T
        return pd.DataFrame({**{k: x[k].iloc[:1] for k in keys}, "_part": [int(x["_chunk"].iloc[0]) // 256], "_sums": [out.tobytes()]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in x["_sums"])
        return pd.DataFrame({**{k: x[k].iloc[:1] for k in keys}, "_part": x["_part"].iloc[:1], "_sums": [total.tobytes()]})

    def told(x: pd.DataFrame) -> pd.DataFrame:
        total, n, out = sum(np.frombuffer(v) for v in x["_sums"]).reshape(2 * m + 1, replicates), int(x["_n"].iloc[0]), []
        for j, value in enumerate(values):
            observed = x["_sum"].iloc[0][j] / n
            means = np.where(total[m] > 0, total[j] / np.maximum(total[m], 1), observed)
            near = 1e-12 * max(1.0, abs(observed))
            p = (np.count_nonzero(total[m + 1 + j] / n <= observed + near) + 1) / (replicates + 1)
            out.append((value, n, observed, *np.quantile(means, (0.025, 0.975)), p))
        keyed = pd.DataFrame({k: np.repeat(x[k].iloc[:1], m).reset_index(drop=True) for k in keys})
        return pd.concat([keyed, pd.DataFrame(out, columns=["value", "n", "observed", "low", "high", "p_lower"])], axis=1)

    parts = dealt.groupBy(*keys, "_chunk").applyInPandas(sums, f"{head}_part bigint, _sums binary")
    parts = parts.groupBy(*keys, "_part").applyInPandas(add, f"{head}_part bigint, _sums binary")
    both = parts.alias("a").join(totals.alias("t"), meets).select(*(F.col(f"a.{k}") for k in keys), "_sums", "_n", "_sum")
    out = both.groupBy(*keys).applyInPandas(told, f"{head}value string, n bigint, observed double, low double, high double, p_lower double")
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), "value", "n", "observed", "low", "high", "p_lower")

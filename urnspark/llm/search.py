"""Exact top-k search by inner product, pruned by multi-resolution segment statistics (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnspark.llm.shared import drop, read, ship, stage


@dataclass(frozen=True)
class Segments:
    """scale: of a component before it is floored. counts: of segments, coarse to fine. cell: components that one side of a task holds. block: queries of a row."""

    scale: int = 256
    counts: tuple[int, ...] = (1, 4, 16)
    cell: int = 1 << 22
    block: int = 512
    chunk: int = 2048


FOUND = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
NONE = np.iinfo(np.int64).min


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Of each row: its segments' means times the root of their lengths, then the roots of their squared deviations.

    The distance of two rows is at least that of their summaries; so their inner product is at most that of the
    summaries, which have the same squared length as the rows.
    """
    ends = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))
    starts, size = ends[:-1], np.diff(ends)
    mean = np.add.reduceat(x, starts, axis=1) / size
    return np.hstack([mean * np.sqrt(size), np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, starts, axis=1))])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of whole vectors, exact; beyond 64 bits the ends of their range."""
    top = lambda m: max(int(m.max(initial=0)), -int(m.min(initial=0)))
    if top(q) * top(x) * max(1, q.shape[1]) < 1 << 53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    wide = q.astype(object) @ x.T.astype(object) if q.shape[1] else np.zeros((len(q), len(x)), dtype=object)
    return np.clip(wide, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """Each query's k best so far: score, vec_id, row; least: what a score must reach."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows, k
        self.least = np.full(len(rows), NONE)
        self.found = [np.zeros(0, dtype=np.int64)] * 4  # query, score, vec_id, row

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        other = self.rows[query] != rows
        query, score, ids, rows = (np.r_[a, b[other]] for a, b in zip(self.found, (query, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query = order[place < self.k], query[place < self.k]
        self.found = [query, score[order], ids[order], rows[order]]
        full = place[place < self.k] == self.k - 1
        self.least[query[full]] = self.found[1][full]


def search_chunk(q: np.ndarray, which: np.ndarray, x: np.ndarray, members: list[np.ndarray], best: Best, c: Segments) -> None:
    """Adds to best what the different vectors x hold for the queries which (rows q), coarse bounds first.

    members: of each vector the first k + 1 rows that have it: their vectors' places, ids and rows.
    """
    rows, cols = np.arange(len(q)), np.arange(len(x))
    norm_q, norm_x = (np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (q, x))
    for segments in (s for s in c.counts if s < q.shape[1]):
        least = best.least[which[rows]].astype(np.float64)
        upper = summary(q[rows].astype(np.float64), segments) @ summary(x[cols].astype(np.float64), segments).T
        alive = upper + 1e-9 * norm_q[rows][:, None] * norm_x[cols] + 1 >= least[:, None]
        rows, cols = rows[alive.any(axis=1)], cols[alive.any(axis=0)]
        if not len(rows):
            return
    score = products(q[rows], x[cols])
    least = best.least[which[rows]]
    if len(cols) > best.k + 1:
        # The query itself may be among them, so one more than k.
        least = np.maximum(least, np.partition(score, -(best.k + 1), axis=1)[:, -(best.k + 1)])
    i, j = np.nonzero(score >= least[:, None])
    place, ids, own = members
    first, last = np.searchsorted(place, cols[j]), np.searchsorted(place, cols[j], side="right")
    size = last - first
    at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    best.add(np.repeat(which[rows[i]], size), np.repeat(score[i, j], size), ids[at], own[at])


def _matrices(vectors, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    length = np.fromiter((len(v) for v in vectors), dtype=np.int64, count=n)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        yield at, np.array([vectors[i] for i in at.tolist()], dtype=np.int64).reshape(len(at), d)


def _distinct(at: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The different rows of x, longest first, and members: of each the k + 1 least (id, row)."""
    order = np.lexsort((rows[at], ids[at], *x.T[::-1]))
    x, at = x[order], at[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(axis=1)] if x.shape[1] else np.arange(len(x)) == 0
    group = np.cumsum(new) - 1
    keep = np.arange(len(x)) - np.flatnonzero(new)[group] <= k
    norm = (x[new].astype(np.float64) ** 2).sum(axis=1)
    rank = np.empty(len(norm), dtype=np.int64)
    rank[np.argsort(-norm, kind="stable")] = np.arange(len(norm))
    place, at = rank[group[keep]], at[keep]
    order = np.argsort(place, kind="stable")
    return x[new][np.argsort(rank)], (place[order], ids[at[order]], rows[at[order]])


def _cell(k: int, c: Segments):
    def run(_key, known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(asked):
            return pd.DataFrame({n.split()[0]: pd.Series(dtype="int64") for n in FOUND.split(", ")})
        ids, rows = known["vec_id"].to_numpy(), known["row"].to_numpy()
        parts = [_distinct(at, x, ids, rows, k) for at, x in _matrices(known["v"].tolist(), len(known))]
        out = []
        for q_ids, q_rows, vectors in zip(asked["ids"], asked["rows"], asked["vs"], strict=True):
            q_ids, q_rows = np.asarray(q_ids), np.asarray(q_rows)
            best = Best(q_rows, k)
            for which, q in _matrices(list(vectors), len(q_rows)):
                for x, (place, m_ids, m_rows) in parts:
                    d = min(q.shape[1], x.shape[1])
                    for a in range(0, len(x), c.chunk):
                        lo, hi = np.searchsorted(place, [a, a + c.chunk])
                        search_chunk(q[:, :d], which, x[a : a + c.chunk, :d], (place[lo:hi] - a, m_ids[lo:hi], m_rows[lo:hi]), best, c)
            query, score, found, row = best.found
            out.append(pd.DataFrame({"query_row": q_rows[query], "query_id": q_ids[query], "vec_id": found, "row": row, "score": score}))
        return pd.concat(out, ignore_index=True)

    return run


def _asked(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for a in range(0, len(x), size):
                y = x.iloc[a : a + size]
                yield pd.DataFrame({"block": [int(y["row"].iloc[0])], "ids": [y["vec_id"].tolist()], "rows": [y["row"].tolist()], "vs": [y["v"].tolist()]})

    return run


def whole(vector: Column, scale: int) -> Column:
    """Components as whole numbers: the floor of each times scale, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def top_k(vectors: DataFrame, queries: str, k: int, *, id_col: str, vector_col: str, c: Segments = Segments()) -> DataFrame:
    """query_row, query_id, rank, vec_id, row, score: each query's k highest inner products with other rows.

    queries: a condition on vec_id. Ties go to the smaller vec_id, then to the earlier row. Rows that repeat an id are
    queries and candidates each; only a query's own row isn't its candidate. Null vectors, vectors with a null or
    non-finite component, and rows without an id take no part. A shorter vector counts as padded with zeros; scores
    and components beyond 64 bits are the ends of that range. An empty table gives no row.

    Rows are dealt by a hash of their number into groups, and query blocks into others, so that a cell of both fits a
    task; each cell returns its k best per query. In a cell equal vectors are one. Chunks of vectors, longest first,
    meet a block of queries: bounds from segment means and deviations, coarse to fine, drop queries and vectors that
    can't reach a query's k-th best so far, and what is left is computed exactly. Nothing is dropped otherwise.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), whole(v, c.scale).alias("v"))
    base = stage(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    is_query = F.expr(queries)
    held = base.agg(F.sum(F.size("v")).alias("all"), F.sum(F.when(is_query, F.size("v"))).alias("asked")).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(held["all"] or 0) // c.cell))
    sides = max(1, -(-(held["asked"] or 0) // c.cell))
    asked = stage(base.where(is_query).mapInPandas(_asked(c.block), "block bigint, ids array<bigint>, rows array<bigint>, vs array<array<bigint>>"), "query-blocks")
    known = base.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    spread = asked.withColumn("b", F.pmod(F.xxhash64("block"), F.lit(sides)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    cells = known.groupBy("g", "b").cogroup(spread.groupBy("g", "b")).applyInPandas(_cell(k, c), FOUND)
    by = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return cells.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "row", "score")


def op11_segment_search(spark, sf_dir: str) -> DataFrame:
    out = top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5, id_col="vec_id", vector_col="embedding")
    return out.select("query_id", "rank", "vec_id", "score")


#: Every query against every other row; ids are unique in the given tables.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

QUERIES = {"op11_segment_search": op11_segment_search}
ORACLE_SQL = {"op11_segment_search": ORACLE}

"""Logistic regressions and boosted trees fitted from sums that Spark adds up, many models in one pass.

Data are blocks: rows of whole groups as matrices, each group weighed by its draws, so a pass costs NumPy's time and the
driver sees a row per model, never a row of data. A group is a date, a game and its 49 numbers with the hits of each; or
one observation with its value. A model trains on the dates before its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.operators.forecasts import POOL
from urnspark.operators.quantiles import exact_quantiles
from urnspark.plans.staging import stage

BLOCK = "days binary, games array<string>, x binary, n binary, k binary"
EPOCH = date(1970, 1, 1)
#: Up to so many tasks, their sums are added up on the driver without a shuffle.
FEW = 16


def day_of(d: date) -> int:
    return (d - EPOCH).days


def in_groups(function):
    """function over batches that end with a whole group; what a batch has of the next group waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x])
            whole = len(x) // POOL * POOL
            held = x.iloc[whole:]
            if whole:
                yield from function(iter([x.iloc[:whole]]))

    return run


def blocks(cells: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """cells (draw_date, game, number, columns, n, k) as staged blocks: a block's groups in order, 49 rows of columns each."""
    parts = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cells.select("draw_date", "game", "number", *columns, "n", "k").repartition(parts, "draw_date", "game").sortWithinPartitions("draw_date", "game", "number")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            one = x.iloc[::POOL]
            days = np.array([day_of(d) for d in one["draw_date"]], dtype=np.int32)
            n, k = x["n"].to_numpy(float)[::POOL], x["k"].to_numpy(float)
            yield pd.DataFrame({"days": [days.tobytes()], "games": [one["game"].tolist()], "x": [x[list(columns)].to_numpy(float).tobytes()], "n": [n.tobytes()], "k": [k.tobytes()]})

    return stage(rows.mapInPandas(in_groups(pack), BLOCK), "blocks")


def observed(rows: DataFrame, columns: tuple[str, ...], value: str) -> DataFrame:
    """rows (draw_date, game, columns, value) as staged blocks of groups of one observation each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            days = np.array([day_of(d) for d in x["draw_date"]], dtype=np.int32)
            yield pd.DataFrame({"days": [days.tobytes()], "games": [x["game"].tolist()], "x": [x[list(columns)].to_numpy(float).tobytes()], "n": [np.ones(len(x)).tobytes()], "k": [x[value].to_numpy(float).tobytes()]})

    return stage(rows.select("draw_date", "game", *columns, value).mapInPandas(pack, BLOCK), "blocks")


def unpacked(r) -> tuple[np.ndarray, ...]:
    """days (groups), x (groups, their rows, columns), n (groups), k (groups, their rows) of a block."""
    days, n = np.frombuffer(r.days, dtype=np.int32), np.frombuffer(r.n)
    k = np.frombuffer(r.k).reshape(len(days), -1)
    return days, np.frombuffer(r.x).reshape(*k.shape, -1), n, k


def summed(data: DataFrame, function: Callable) -> dict[int, np.ndarray]:
    """What function(block) tells of each model, added up in Spark: model -> vector, a row per model, or of each of FEW tasks, on the driver."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for r in x.itertuples(index=False):
                for m, v in function(r):
                    total[m] = total[m] + v if m in total else v
        if total:
            yield pd.DataFrame({"model": list(total), "v": [v.tobytes() for v in total.values()]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": x["model"].iloc[:1], "v": [sum(np.frombuffer(v) for v in x["v"]).tobytes()]})

    rows, out = data.mapInPandas(each, "model int, v binary"), {}
    if not hasattr(data, "_tasks"):
        data._tasks = data.rdd.getNumPartitions()
    if data._tasks > FEW:
        rows = rows.groupBy("model").applyInPandas(add, "model int, v binary")
    for r in rows.collect():  # a row per model, or per model and one of few tasks
        v = np.frombuffer(r["v"])
        out[r["model"]] = out[r["model"]] + v if r["model"] in out else v
    return out


def with_numbers(x: np.ndarray) -> np.ndarray:
    """Columns with one more for each of the 49 numbers."""
    return np.concatenate([x, np.broadcast_to(np.eye(POOL), (len(x), POOL, POOL))], axis=2)


@dataclass
class Logistic:
    """Trains on dates before first; c: the inverse of the penalty. mean, scale, beta (intercept first): after the fit."""

    first: int
    c: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = (with_numbers(x) - self.mean) / self.scale
        return 1 / (1 + np.exp(-(self.beta[0] + z @ self.beta[1:])))


def fit_logistic(data: DataFrame, models: list[Logistic], *, rounds: int = 50, tolerance: float = 1e-10) -> list[Logistic]:
    """Penalised logistic regressions on standardised columns and numbers, the intercept free, by Newton's method.

    A round adds up gradient and curvature of all models in one pass; it ends when no step moves a coefficient by more
    than tolerance. A column that doesn't vary is only centred.
    """
    firsts = sorted({m.first for m in models})

    def scales(r):
        days, x, n, _ = unpacked(r)
        x = with_numbers(x)
        for i, first in enumerate(firsts):
            w = n * (days < first)
            yield i, np.r_[POOL * w.sum(), np.einsum("gpi,g->i", x, w), np.einsum("gpi,gpi,g->i", x, x, w, optimize=True)]

    told = summed(data, scales)
    for m in models:
        total, *rest = told[firsts.index(m.first)]
        s1, s2 = np.split(np.array(rest), 2)
        m.mean = s1 / total
        spread = np.sqrt(np.maximum(s2 / total - m.mean**2, 0))
        m.scale = np.where(spread > 1e-12 * np.maximum(1, np.abs(m.mean)), spread, 1.0)
        m.beta = np.zeros(len(s1) + 1)
    active = list(range(len(models)))
    for _ in range(rounds):
        now = [(i, models[i].first, models[i].mean, models[i].scale, models[i].beta) for i in active]

        def sums(r, now=now):
            days, x, n, k = unpacked(r)
            x = with_numbers(x)
            for i, first, mean, scale, beta in now:
                use = days < first
                if use.any():
                    z = ((x[use] - mean) / scale).reshape(-1, len(mean))
                    z = np.c_[np.ones(len(z)), z]
                    p = 1 / (1 + np.exp(-z @ beta))
                    w = np.repeat(n[use], POOL)
                    yield i, np.r_[z.T @ (w * p - k[use].ravel()), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()]

        moved = []
        for i, v in summed(data, sums).items():
            m, size = models[i], len(models[i].beta)
            g, h = m.c * v[:size], m.c * v[size:].reshape(size, size)
            keep = np.r_[0.0, np.ones(size - 1)]
            step = np.linalg.solve(h + np.diag(keep), g + keep * m.beta)
            m.beta = m.beta - step
            if np.abs(step).max() > tolerance:
                moved.append(i)
        active = moved
        if not active:
            break
    return models


@dataclass
class Tree:
    """Nodes by number: column (or -1 at a leaf), bin (rows up to it go left), children, value."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for a, v in ((self.column, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            a.append(v)
        return len(self.column) - 1

    def split(self, node: int, column: int, at: int, left: int, right: int) -> None:
        self.column[node], self.bin[node], self.left[node], self.right[node] = column, at, left, right


def leaf_of(tree: Tree, b: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to; b: a row of bins for each column, and of the numbers' places.

    Splits go over all rows one after another, parents first: comparing whole columns is cheaper than walking each row.
    """
    plain = len(b) - 1
    node = np.zeros(b.shape[1], dtype=np.uint8)
    for i, c in enumerate(tree.column):
        if c >= 0:
            # A column beyond the plain ones is one number's: its rows go right, all others left.
            right = b[c] > tree.bin[i] if c < plain else b[plain] == c - plain
            node = np.where(node == i, np.where(right, np.uint8(tree.right[i]), np.uint8(tree.left[i])), node)
    return node


@dataclass
class Boosted:
    """Trains on dates before first. base: log odds of the hits, or the mean; trees: with the learning rate in their values; edges: of the bins.

    value: predicts a value by least squares, instead of the chance of a hit.
    """

    first: int
    rate: float
    leaves: int
    l2: float
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    edges: list[np.ndarray] = field(default_factory=list)
    value: bool = False

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.edges)
        score = np.full(b.shape[1], self.base)
        for t in self.trees:
            score += np.array(t.value)[leaf_of(t, b)]
        return (score if self.value else 1 / (1 + np.exp(-score))).reshape(x.shape[:2])


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each column the bins of all groups' rows, then the numbers' places from 0."""
    flat = x.reshape(-1, x.shape[-1])
    b = [np.searchsorted(e, flat[:, i], side="left") for i, e in enumerate(edges)]
    return np.array([*b, np.tile(np.arange(x.shape[1]), len(x))], dtype=np.uint8)


def bin_edges(cells: DataFrame, columns: tuple[str, ...], before: date, bins: int) -> list[np.ndarray]:
    """Upper edges of each column's bins, at most 255: exact quantiles, by draws, of the dates before; equal ones once."""
    long = cells.where(F.col("draw_date") < F.lit(before)).select("n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("e")).select("e.i", "e.v", "n")
    counted = long.groupBy("i", "v").agg(F.sum("n").alias("n"))
    rows = exact_quantiles(counted, ["i"], "v", [j / bins for j in range(1, bins)], weight="n").collect()  # bins of each column
    return [np.unique([r["quantile"] for r in rows if r["i"] == i]) for i in range(len(columns))]


@dataclass
class Node:
    """A node while its tree grows: g, h, c (gradient, curvature, draws); best: (gain, column, bin, left g h c), once counted; kids: once split."""

    g: float
    h: float
    c: float
    best: tuple | None = None
    kids: tuple | None = None


def best_split(hist: np.ndarray, sizes: list[int], l2: float, least: int) -> tuple | None:
    """gain, column, bin and the left side's sums of the best split; hist: (3, bins of all columns, then rows of a group by place)."""
    group = hist.shape[1] - sum(sizes)
    total = hist[:, -group:].sum(axis=1, keepdims=True)
    whole = float(total[0, 0] ** 2 / (total[1, 0] + l2))
    # Left sides of all splits: of a column's bins but its last, and of all rows but one number's.
    ends = np.cumsum([0, *sizes])
    lefts = [np.cumsum(hist[:, a:b], axis=1)[:, :-1] for a, b in zip(ends, ends[1:])] + [total - hist[:, -group:]]
    column = np.repeat([*range(len(sizes)), *range(len(sizes), len(sizes) + group)], [*(size - 1 for size in sizes), *[1] * group])
    bin_ = np.concatenate([*(np.arange(size - 1) for size in sizes), np.zeros(group, dtype=np.int64)])
    left = np.concatenate(lefts, axis=1)
    right = total - left
    ok = (left[2] >= least) & (right[2] >= least) & (left[1] >= 1e-3) & (right[1] >= 1e-3)
    if not ok.any():
        return None
    gain = np.where(ok, left[0] ** 2 / (np.maximum(left[1], 0) + l2) + right[0] ** 2 / (np.maximum(right[1], 0) + l2) - whole, -np.inf)
    most = gain.max()
    # Sums come in any order: the first of those that are as good.
    j = int(np.argmax(gain >= most - 1e-9 * abs(most)))
    return (float(gain[j]), int(column[j]), int(bin_[j]), *left[:, j]) if most > 1e-12 else None


class Growth:
    """One tree of a model, grown level by level; `wanted` are the nodes whose histograms the next pass is to bring."""

    def __init__(self, m: Boosted, sizes: list[int], least: int):
        self.m, self.sizes, self.least = m, sizes, least
        self.root = Node(0.0, 0.0, 0.0)
        self.wanted, self.leaves, self.done = [self.root], 1, False

    def probe(self) -> tuple[Tree, dict[int, int]]:
        """The tree so far, and the places of the wanted nodes by leaf."""
        tree, where = Tree(), {}
        place = {id(n): i for i, n in enumerate(self.wanted)}

        def put(n: Node) -> int:
            at = tree.add(-self.m.rate * n.g / (n.h + self.m.l2))
            if id(n) in place:
                where[at] = place[id(n)]
            if n.kids:
                column, cut = n.best[1:3]
                tree.split(at, column, cut if column < len(self.sizes) else 0, put(n.kids[0]), put(n.kids[1]))
            return at

        put(self.root)
        return tree, where

    def take(self, hists: np.ndarray) -> None:
        """Histograms of a level's nodes: those that gain most are split, as long as leaves are left; their children are the next level."""
        for n, hist in zip(self.wanted, hists):
            if n is self.root:
                n.g, n.h, n.c = hist[:, sum(self.sizes) :].sum(axis=1)
            n.best = best_split(hist, self.sizes, self.m.l2, self.least)
        ranked = sorted((n for n in self.wanted if n.best), key=lambda n: -n.best[0])
        self.wanted = []
        for n in ranked[: self.m.leaves - self.leaves]:
            left = n.best[3:6]
            n.kids = (Node(*left), Node(n.g - left[0], n.h - left[1], n.c - left[2]))
            self.leaves += 1
            self.wanted += n.kids
        if not self.wanted or self.leaves == self.m.leaves:
            self.m.trees.append(self.probe()[0])
            self.done = True


def _merged(data: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of observations as blocks of bins, in x: those of a day and the same bins as one, with their number and the sum of their values.

    Least squares needs no more of them, so passes grow with the calendar and the bins, however many observations there are.
    """
    width = len(edges) + 1

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                days, v, n, k = unpacked(r)
                rows = np.concatenate([np.ascontiguousarray(days.astype("<i4")).view(np.uint8).reshape(-1, 4), binned(v, edges).T], axis=1)
                keys, of = np.unique(np.ascontiguousarray(rows).view(f"V{4 + width}")[:, 0], return_inverse=True)
                yield pd.DataFrame({"cell": [key.tobytes() for key in keys], "n": np.bincount(of, weights=n), "k": np.bincount(of, weights=k[:, 0])})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = np.frombuffer(b"".join(x["cell"]), dtype=np.uint8).reshape(len(x), -1)
            days, b = np.ascontiguousarray(rows[:, :4]).view("<i4")[:, 0], np.ascontiguousarray(rows[:, 4:].T)
            yield pd.DataFrame({"days": [days.tobytes()], "x": [b.tobytes()], "n": [x["n"].to_numpy(float).tobytes()], "k": [x["k"].to_numpy(float).tobytes()]})

    cells = data.mapInPandas(bins, "cell binary, n double, k double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    return cells.repartition(data.sparkSession.sparkContext.defaultParallelism, "cell").mapInPandas(pack, "days binary, x binary, n binary, k binary")


def fit_boosted(cells: DataFrame, columns: tuple[str, ...], models: list[Boosted], *, trees: int = 100, bins: int = 64, least: int = 20, refresh: int = 10, data: DataFrame | None = None) -> list[Boosted]:
    """Boosted classification trees of hits, grown level by level from histograms of gradients by (leaf, column, bin).

    Of a level the nodes that gain most are split first, until a tree has its leaves; so a tree takes a pass a level.
    A pass serves all models, each at its own tree and node. The histograms of a block are counted in its task, added up
    in Spark, and only the sums of the open nodes reach the driver, which chooses the splits. Bins are quantiles of the
    dates before the earliest model's first, so no model sees later ones; scores are kept beside the blocks and renewed
    every so many trees. A leaf has at least `least` draws of a number, or observations. No early stop: all trees are grown. data: blocks of cells, if made.
    """
    if not models:
        return models
    edges = bin_edges(cells, columns, date.fromordinal(EPOCH.toordinal() + min(m.first for m in models)), bins)
    sizes = [len(e) + 1 for e in edges]
    group = 1 if models[0].value else POOL
    width = sum(sizes) + group
    offset = np.r_[0, np.cumsum(sizes)]
    data = blocks(cells, columns) if data is None else data

    def odds(r):
        days, _, n, k = unpacked(r)
        for i, m in enumerate(models):
            use = days < m.first
            yield i, np.array([k[use].sum(), group * n[use].sum()])

    for i, (k, n) in summed(data, odds).items():
        if models[i].value:
            models[i].base = float(k / max(n, 1))
        else:
            models[i].base = float(np.log(k / (n - k))) if 0 < k < n else 0.0
        models[i].edges = edges
    firsts, bases = [m.first for m in models], [m.base for m in models]

    def first_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                b = np.frombuffer(r.x, dtype=np.uint8).reshape(len(edges) + 1, -1) if group == 1 else binned(unpacked(r)[1], edges)
                yield pd.DataFrame({"days": [r.days], "n": [r.n], "k": [r.k], "b": [b.tobytes()], "score": [np.repeat(bases, b.shape[1]).tobytes()]})

    held = "days binary, n binary, k binary, b binary, score binary"
    if group == 1:
        data = _merged(data, edges)
    data = stage(data.mapInPandas(first_scores, held), "binned")
    kept = [0] * len(models)
    growing = {i: Growth(m, sizes, least) for i, m in enumerate(models)}
    while growing:
        asked = {i: (*g.probe(), len(g.wanted), models[i].trees[kept[i] :]) for i, g in growing.items()}

        def count(r, asked=asked):
            days, n, k = np.frombuffer(r.days, dtype=np.int32), np.frombuffer(r.n), np.frombuffer(r.k)
            b = np.frombuffer(r.b, dtype=np.uint8).reshape(-1, len(k))
            scores = np.frombuffer(r.score).reshape(len(firsts), -1)
            for i, (tree, where, wanted, new) in asked.items():
                use = np.repeat(days < firsts[i], group)
                if use.any():
                    own, w, hits = b[:, use], np.repeat(n, group)[use], k[use]
                    s = scores[i][use]
                    for t in new:
                        s = s + np.array(t.value)[leaf_of(t, own)]
                    p = s if group == 1 else 1 / (1 + np.exp(-s))
                    at = np.full(len(tree.column), -1)
                    at[list(where)] = list(where.values())
                    node = at[leaf_of(tree, own)]
                    inside = node >= 0
                    node, own = node[inside] * width, own[:, inside]
                    parts = [(w * p - hits)[inside], (w if group == 1 else w * p * (1 - p))[inside], w[inside]]
                    out = np.zeros((3, wanted * width))
                    for c in range(len(own)):
                        place = node + own[c] + offset[c]
                        for j, v in enumerate(parts):
                            out[j] += np.bincount(place, weights=v, minlength=wanted * width)
                    yield i, out.ravel()

        told = summed(data, count)
        for i in list(growing):
            g = growing[i]
            wanted = len(g.wanted)
            g.take(told[i].reshape(3, wanted, width).transpose(1, 0, 2) if i in told else np.zeros((wanted, 3, width)))
            if g.done:
                if len(models[i].trees) < trees:
                    growing[i] = Growth(models[i], sizes, least)
                else:
                    del growing[i]
        if growing and max(len(models[i].trees) - kept[i] for i in growing) >= refresh:
            fresh = [m.trees[k:] for m, k in zip(models, kept)]

            def renew(batches: Iterator[pd.DataFrame], fresh=fresh) -> Iterator[pd.DataFrame]:
                for x in batches:
                    out = []
                    for r in x.itertuples(index=False):
                        b = np.frombuffer(r.b, dtype=np.uint8).reshape(-1, len(r.k) // 8)
                        scores = np.frombuffer(r.score).reshape(len(fresh), -1).copy()
                        for i, new in enumerate(fresh):
                            for t in new:
                                scores[i] += np.array(t.value)[leaf_of(t, b)]
                        out.append(scores.tobytes())
                    yield x.assign(score=out)

            data = stage(data.mapInPandas(renew, held), "binned")
            kept = [len(m.trees) for m in models]
    return models

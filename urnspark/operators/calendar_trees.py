"""Boosted trees of a value over dates and kinds (a game with a jackpot): one task grows a whole model from the sums of cells.

Every column belongs to the date or to the kind, so a node is a set of dates by a set of kinds. Its splits need no more
than its sums by date and by kind; a model costs the calendar by the kinds, however many observations there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

import numpy as np

from urnspark.operators.learners import EPOCH

#: Fixed values of the definition: bins, observations of a leaf, and when a random tenth stops the growth.
BINS = 255
LEAST = 20
STOPS_OVER, PATIENCE, TOLERANCE = 10_000, 10, 1e-7


def thresholds(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Between distinct values where these are few; else the midpoints around BINS - 1 percentiles of the observations, equal ones once."""
    seen = n > 0
    order = np.argsort(values[seen], kind="stable")
    v, run = values[seen][order], np.cumsum(n[seen][order])
    distinct = np.unique(v)
    if len(distinct) <= BINS:
        return (distinct[:-1] + distinct[1:]) * 0.5
    at = np.arange(1, BINS) / BINS * (run[-1] - 1)
    low, high = (v[np.searchsorted(run, f(at), side="right")] for f in (np.floor, np.ceil))
    return np.unique((low + high) * 0.5)


def date_columns(days: np.ndarray) -> np.ndarray:
    """trend, month_sin, month_cos, day0 to day6 of days since EPOCH."""
    dates = [EPOCH + timedelta(days=int(d)) for d in days]
    turn = 2 * np.pi * np.array([d.month for d in dates], dtype=float) / 12
    week = np.array([d.weekday() for d in dates])
    return np.column_stack([np.asarray(days, dtype=float), np.sin(turn), np.cos(turn), *((week == i).astype(float) for i in range(7))]).reshape(len(dates), 10)


@dataclass
class Grown:
    """base; trees: of each (nodes: on dates?, column, threshold, left, right, value), the last with the learning rate. on dates -1: a leaf."""

    base: float
    trees: list[np.ndarray] = field(default_factory=list)

    def predict(self, days: np.ndarray, x: np.ndarray) -> np.ndarray:
        """x: FEATURES of each (or of each in a row of its own); the date's columns come from its day."""
        rows = x.reshape(-1, x.shape[-1])
        unique, of = np.unique(np.asarray(days), return_inverse=True)
        columns = [date_columns(unique)[of], rows[:, [0, 12, 13, 14]]]
        out = np.full(len(rows), self.base)
        for tree in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for i, (side, column, cut, left, right, _) in enumerate(tree):
                if side >= 0:
                    here = node == i
                    node[here] = np.where(columns[int(side)][here, int(column)] <= cut, int(left), int(right))
            out += tree[node, 5]
        return out.reshape(x.shape[:-1])


class _Side:
    """Dates, or kinds: their columns' splits, and what goes left at each. rising: the first column's values are in order."""

    def __init__(self, columns: np.ndarray, n: np.ndarray, rising: bool):
        cuts = [thresholds(columns[:, c], n) for c in range(columns.shape[1])]
        self.column = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        self.cut = np.concatenate(cuts)
        self.left = np.ascontiguousarray((columns[:, self.column] <= self.cut).T)
        self.upto = np.searchsorted(columns[:, 0], cuts[0], side="right") if rising else np.zeros(0, dtype=np.int64)
        self.ones = self.left[len(self.upto) :].astype(float)

    def lefts(self, by: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The left sums of all splits, from the sums by the places of a node."""
        run = np.concatenate([np.zeros((len(by), 1)), np.cumsum(by, axis=1)], axis=1)
        return np.concatenate([run[:, np.searchsorted(own, self.upto)], by @ self.ones[:, own].T], axis=1)


@dataclass
class _Node:
    """dates, kinds: places; by: sums (gradients, observations) by date and by kind; at: its number in the tree."""

    dates: np.ndarray
    kinds: np.ndarray
    by: tuple[np.ndarray, np.ndarray]
    at: int
    best: tuple | None = None


def _best(node: _Node, sides: tuple[_Side, _Side], order: np.ndarray, l2: float) -> tuple | None:
    """gain, side and split of the best; of those that are as good the first in the order of the columns."""
    total = node.by[0].sum(axis=1)
    if total[1] < 2 * LEAST:
        return None
    left = np.concatenate([sides[0].lefts(node.by[0], node.dates), sides[1].lefts(node.by[1], node.kinds)], axis=1)[:, order]
    g, n = left
    rest = total[:, None] - left
    ok = (n >= LEAST) & (rest[1] >= LEAST)
    if not ok.any():
        return None
    gain = np.where(ok, g * g / (n + l2) + rest[0] ** 2 / (np.maximum(rest[1], 0) + l2) - total[0] ** 2 / (total[1] + l2), -np.inf)
    most = gain.max()
    if most <= 1e-12:
        return None
    j = int(order[int(np.argmax(gain >= most - 1e-9 * abs(most)))])
    split = len(sides[0].cut)
    return (float(most), 0, j) if j < split else (float(most), 1, j - split)


def grow(days: np.ndarray, kinds: np.ndarray, cells: np.ndarray, tenth: np.ndarray, *, rate: float, leaves: int, l2: float, trees: int = 150) -> tuple[Grown, np.ndarray]:
    """A model, and what it predicts for each date and kind; least squares, best gains first, as many trees or until it stops.

    kinds: jackpot and the games' columns of each. cells, tenth: observations, sums and sums of squares of the value by
    date and kind, of all and of a random tenth; a cell without observations is only predicted. With more than
    STOPS_OVER observations that tenth isn't learnt from: growth ends once the mean squared error there hasn't fallen for
    PATIENCE trees. Jackpot's square splits as jackpot does, which comes first, so it needs no column.
    """
    n, s = cells[0], cells[1]
    held = n.sum() > STOPS_OVER and tenth[0].sum() > 0
    if held:
        n, s = n - tenth[0], s - tenth[1]
    base = float(s.sum() / max(n.sum(), 1))
    sides = (_Side(date_columns(days), n.sum(axis=1), True), _Side(kinds, n.sum(axis=0), False))
    # Jackpot, then the date's columns, then the games: the order of FEATURES.
    d, k = sides
    order = np.concatenate([len(d.cut) + np.flatnonzero(k.column == 0), np.arange(len(d.cut)), len(d.cut) + np.flatnonzero(k.column > 0)])
    model, score = Grown(base), np.full(n.shape, base)
    losses, squares, count = [], tenth[2].sum(), max(tenth[0].sum(), 1)

    def loss() -> None:
        losses.append(float((squares - 2 * np.vdot(score, tenth[1]) + np.vdot(score * score, tenth[0])) / count / 2))

    if held:
        loss()
    both = np.stack([n * score - s, n])
    every = np.arange(n.shape[0]), np.arange(n.shape[1])
    for _ in range(trees):
        both[0] = n * score - s
        root = _Node(*every, (both.sum(axis=2), both.sum(axis=1)), 0)
        root.best = _best(root, sides, order, l2)
        table = [[-1.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
        ends = [root]
        while len(ends) < leaves and any(e.best for e in ends):
            node = max((e for e in ends if e.best), key=lambda e: e.best[0])  # the first of equal ones
            _, side, j = node.best
            own = (node.dates, node.kinds)
            goes = sides[side].left[j, own[side]]
            # Sums along the side that is split are parts of the node's; the others are added up for the smaller half.
            small = goes if 2 * np.count_nonzero(goes) <= len(goes) else ~goes
            part = (own[0][small], own[1]) if side == 0 else (own[0], own[1][small])
            sums = both[:, part[0][:, None], part[1]].sum(axis=1 + side)
            rest = node.by[1 - side] - sums
            children = []
            for mask in (goes, ~goes):
                across = sums if mask[0] == small[0] else rest
                along = node.by[side][:, mask]
                children.append(_Node(*((own[0][mask], own[1]) if side == 0 else (own[0], own[1][mask])), (along, across) if side == 0 else (across, along), len(table)))
                table.append([-1.0, 0.0, 0.0, 0.0, 0.0, 0.0])
            table[node.at][:5] = [side, sides[side].column[j], sides[side].cut[j], children[0].at, children[1].at]
            ends = [e for e in ends if e is not node]
            for c in children:
                c.best = _best(c, sides, order, l2) if len(ends) + 2 < leaves else None
            ends += children
        for e in ends:
            g, size = e.by[0].sum(axis=1)
            table[e.at][5] = float(-rate * g / (size + l2))
            score[e.dates[:, None], e.kinds] += table[e.at][5]
        model.trees.append(np.array(table))
        if held:
            loss()
            if len(losses) > PATIENCE and not any(v < losses[-PATIENCE - 1] - TOLERANCE for v in losses[-PATIENCE:]):
                break
    return model, score

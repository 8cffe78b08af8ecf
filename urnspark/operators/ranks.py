"""Values at exact places of many overlapping series, from a few passes over the rows that the series share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Steps that a series' span is cut into, in bits; what a pass counts of all series, about; rows that go to the driver at once.
BITS = 44
CELLS = 1 << 21
ROWS = 1 << 19


def added(data: DataFrame, function: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """What function(batch) tells of each key, added up in the tasks, then in Spark: a row a key on the driver."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for k, v in function(x):
                if k in total:
                    total[k] += v
                else:
                    total[k] = np.array(v, dtype=float)
        for k, v in total.items():
            yield pd.DataFrame({"key": [k], "v": [v.tobytes()]})

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": x["key"].iloc[:1], "v": [sum(np.frombuffer(v) for v in x["v"]).tobytes()]})

    rows = data.mapInPandas(each, "key int, v binary").groupBy("key").applyInPandas(add, "key int, v binary")
    return {r["key"]: np.frombuffer(r["v"]) for r in rows.toLocalIterator()}


class _Series:
    """span: the least and greatest value; asked: (part, place); windows: open prefixes of keys, in order; at: each asked one's; below: rows before it there."""

    def __init__(self, span: tuple[float, float], parts: np.ndarray, places: np.ndarray):
        low, high = span
        self.low = low
        self.scale = (2.0**BITS - 1) / (high - low) if high > low else 0.0
        self.parts, self.places = np.asarray(parts, dtype=np.int64), np.asarray(places, dtype=np.int64)
        self.windows = np.zeros(1, dtype=np.int64)
        self.at, self.below = np.zeros(len(self.places), dtype=np.int64), np.zeros(len(self.places), dtype=np.int64)
        self.bits, self.size = 0, 1

    def step(self, cells: int) -> None:
        """How many bits the next pass adds, to count about so many cells."""
        most = max(1, cells // (len(self.windows) * self.size))
        self.more = min(BITS - self.bits, max(4, int(most).bit_length() - 1))

    def found(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The window of each value that lies in one, and its key of so many bits; -1 for others."""
        keys = np.clip((v - self.low) * self.scale, 0, 2.0**BITS - 1).astype(np.int64)
        own = keys >> (BITS - self.bits)
        w = np.searchsorted(self.windows, own)
        w[w == len(self.windows)] = 0
        return np.where(self.windows[w] == own, w, -1), keys >> (BITS - bits)

    def take(self, counts: np.ndarray) -> None:
        """counts: parts, windows, and the keys that the pass adds in each. An asked one goes on in the key that holds it."""
        pairs, of = np.unique(self.parts * counts.shape[1] + self.at, return_inverse=True)
        run = counts.cumsum(axis=0)[pairs // counts.shape[1], pairs % counts.shape[1]].cumsum(axis=1).astype(np.int64)
        # All rows in one rising line, so that one search serves every place.
        start = np.r_[0, np.cumsum(run[:, -1])[:-1]]
        key = np.searchsorted((run + start[:, None]).ravel(), self.places - self.below + start[of], side="right") - of * run.shape[1]
        self.below += np.where(key > 0, run[of, key - 1], 0)
        own = (self.windows[self.at] << self.more) + key
        rows = counts.sum(axis=0).reshape(-1)
        spots = self.at * counts.shape[2] + key
        self.windows, self.at = np.unique(own, return_inverse=True)
        self.bits += self.more
        self.rows = int(rows[np.unique(spots)].sum())


def ranked(data: DataFrame, series: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray | int, np.ndarray]]], asked: dict[int, tuple], sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The values at places of series: of each, an array in the order asked.

    series(batch): (series, the part of each value or of all, values). asked: of each series its span, and parts and
    places, from 0, among the values of parts up to that one; sizes: the rows of each series. A pass counts the values
    of the open windows in narrower ones, and a place goes on in the window that holds it. Once few rows are left
    in open windows, or windows are the narrowest, the driver sees those, equal ones once with their number.
    """
    told = {s: _Series(*a) for s, a in asked.items()}
    for s, t in told.items():
        t.size, t.rows = int(t.parts.max(initial=0)) + 1, sizes[s]
    while sum(t.rows for t in told.values()) > ROWS and any(t.bits < BITS for t in told.values()):
        for t in told.values():
            t.step(CELLS // len(told))

        def count(x: pd.DataFrame, told=told) -> Iterator[tuple[int, np.ndarray]]:
            for s, part, v in series(x):
                if s in told and len(v):
                    t = told[s]
                    w, key = t.found(v, t.bits + t.more)
                    part = np.broadcast_to(part, v.shape)
                    use = (w >= 0) & (part < t.size)
                    spot = (part[use] * len(t.windows) + w[use] << t.more) + (key[use] & (1 << t.more) - 1)
                    yield s, np.bincount(spot, minlength=t.size * len(t.windows) << t.more)

        got = added(data, count)
        for s, t in told.items():
            t.take(got[s].reshape(t.size, len(t.windows), -1))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for x in batches:
            for s, part, v in series(x):
                if s in told and len(v):
                    t = told[s]
                    w, _ = t.found(v, t.bits)
                    part = np.broadcast_to(part, v.shape)
                    use = (w >= 0) & (part < t.size)
                    if use.any():
                        held.setdefault(s, []).append(_equal([(part[use], v[use], np.ones(int(use.sum()), dtype=np.int64))]))
                        if len(held[s]) > 64:
                            held[s] = [_equal(held[s])]
        for s, parts in held.items():
            part, v, n = _equal(parts)
            yield pd.DataFrame({"s": [s], "part": [part.astype(np.int64).tobytes()], "v": [v.tobytes()], "n": [n.tobytes()]})

    rows: dict[int, list] = {}
    for r in data.mapInPandas(emit, "s int, part binary, v binary, n binary").toLocalIterator():
        rows.setdefault(r["s"], []).append((np.frombuffer(r["part"], dtype=np.int64), np.frombuffer(r["v"]), np.frombuffer(r["n"], dtype=np.int64)))
    out = {}
    for s, t in told.items():
        part, v, n = _equal(rows[s])
        w, _ = t.found(v, t.bits)
        values = np.empty(len(t.places))
        for p in np.unique(t.parts):
            own = np.flatnonzero(t.parts == p)
            use = part <= p
            order = np.lexsort((v[use], w[use]))
            sv, sw, run = v[use][order], w[use][order], np.cumsum(n[use][order])
            start = np.searchsorted(sw, t.at[own])
            before = np.where(start > 0, run[start - 1], 0)
            values[own] = sv[np.searchsorted(run, before + t.places[own] - t.below[own], side="right")]
        out[s] = values
    return out


def _equal(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, value, number of rows with the same part and value as one, by value."""
    part, v, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((part, v))
    part, v, n = part[order], v[order], n[order]
    new = np.r_[True, (v[1:] != v[:-1]) | (part[1:] != part[:-1])] if len(v) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    return part[starts], v[starts], np.add.reduceat(n, starts) if len(starts) else n

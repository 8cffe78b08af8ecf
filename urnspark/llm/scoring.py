"""Brown class-based bigrams by exchange clustering, and scores of all texts (operator 2)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import drop, read, ship, stage

#: The token at the end of each text. No word equals it, since words hold no blank.
END = b" "


@dataclass(frozen=True)
class Brown:
    """classes: of words. rounds: of exchange; in each, half of the words may move.

    A word is common if it makes up 2**-common of the training tokens or more; so there are at most 2**common, and with
    longest its bytes at most that table has a bound at any size of input. Only common words go to every task;
    all other words are joined. weight: of the class model against the word frequency. prior: of the class frequencies
    in a row of transitions, in tokens.
    """

    classes: int = 32
    rounds: int = 8
    common: int = 19
    longest: int = 64
    weight: float = 0.95
    prior: float = 20.0
    seed: int = 11


def words(text: str) -> list[bytes]:
    """The text's words with A-Z in lower case, in UTF-8; bytes are split at the six ASCII blanks alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _counted(seen: Counter[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "c": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[bytes] = Counter()
    for x in batches:
        for t in x["text"]:
            seen.update(words(t))
            seen[END] += 1
            if len(seen) > 400_000:
                yield _counted(seen)
                seen = Counter()
    yield _counted(seen).astype({"c": "int64"})


def _numbered(common) -> object:
    """row, id, held, ids (int32 of common words, -1 of others) and the other words in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {w: i for i, w in enumerate(common.value)}
        for x in batches:
            ids, rest = [], []
            for t in x["text"]:
                w = [*words(t), END]
                n = np.fromiter(map(at.get, w, repeat(-1)), dtype=np.int32, count=len(w))
                ids.append(n.tobytes())
                rest.append([w[i] for i in np.flatnonzero(n < 0).tolist()])
            yield pd.DataFrame({"id": x["id"], "row": x["row"], "held": x["held"], "ids": ids, "rest": rest})

    return run


BLOCK = 1024


def _joined(raws) -> Iterator[np.ndarray]:
    """The ids of many texts one after another, some two million at a time."""
    held, n = [], 0
    for raw in raws:
        held.append(raw)
        n += len(raw)
        if n >= 1 << 23:
            yield np.frombuffer(b"".join(held), dtype=np.int32)
            held, n = [], 0
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.int32)


def _contexts(classes, first: int) -> object:
    """block, cells: of the words before first, how often each class stands before and after, as dense int64 blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, k = classes.value
        cells = np.zeros(first * 2 * k, dtype=np.int64)
        end = int(cls[-1])  # the class of END stands before each text
        for x in batches:
            for ids in _joined(x["ids"]):
                c = np.where(ids >= 0, cls[ids], -1)
                # Each text ends with END, so the place before a text's first word has END's class, and nothing is after END.
                before = np.r_[end, c[:-1]]
                after = np.r_[c[1:], -1]
                after[ids == len(cls) - 1] = -1
                ok = (ids >= 0) & (ids < first)
                for side, near in ((0, before), (1, after)):
                    m = ok & (near >= 0)
                    np.add.at(cells, ids[m].astype(np.int64) * (2 * k) + side * k + near[m], 1)
        rows = cells.reshape(first, 2 * k)
        part = [(b, rows[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-first // BLOCK))]
        yield pd.DataFrame({"block": [b for b, r in part if r.any()], "cells": [r.astype("<i8").tobytes() for _, r in part if r.any()]})

    return run


def _sum_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for x in batches:
        for b, raw in zip(x["block"], x["cells"], strict=True):
            r = np.frombuffer(raw, dtype="<i8")
            total[b] = total[b] + r if b in total else r
    yield pd.DataFrame({"block": list(total), "cells": [r.tobytes() for r in total.values()]})


def _gather(spark, docs: DataFrame, cls: np.ndarray, k: int, first: int) -> np.ndarray:
    """The context counts of the first words by class; a table of bounded size, summed by Spark block by block."""
    sent = spark.sparkContext.broadcast((cls, k))
    parts = docs.select("ids").mapInPandas(_contexts(sent, first), "block int, cells binary")
    out = np.zeros((first, 2 * k), dtype=np.int64)
    # Staged, since Spark keeps the shuffle files of a plain collect for as long as the driver holds its plan.
    summed = stage(parts.repartition("block").mapInPandas(_sum_blocks, "block int, cells binary"), "contexts")
    for r in summed.collect():
        rows = np.frombuffer(r["cells"], dtype="<i8").reshape(-1, 2 * k)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(rows)] = rows
    drop(summed)
    sent.unpersist()
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(ctx: np.ndarray, cls: np.ndarray, k: int, may: np.ndarray) -> np.ndarray:
    """New classes: each word that may move goes to the class that gains the most log likelihood, all others staying.

    ctx: a word's counts by class before and after. With class bigrams N(c, d) and class counts N(c), the class model's
    likelihood is sum N(c,d) log N(c,d) - sum over left and right of N(c) log N(c), up to what the classes don't touch.
    """
    before, after = ctx[:, :k].astype(float), ctx[:, k:].astype(float)
    into = np.zeros((k, k))  # [d, c]: class d before a word of class c
    out = np.zeros((k, k))  # [c, d]: class d after a word of class c
    np.add.at(into.T, cls, before)
    np.add.at(out, cls, after)
    new = cls.copy()
    left, right = into.sum(axis=0), out.sum(axis=1)
    for w in np.flatnonzero(may):
        c, b, a = cls[w], before[w], after[w]
        # Columns and rows without the word, and then with it, for every class at once.
        i0, o0, l0, r0 = into.T.copy(), out.copy(), left.copy(), right.copy()
        i0[c] -= b
        o0[c] -= a
        l0[c] -= b.sum()
        r0[c] -= a.sum()
        d = np.flatnonzero(b), np.flatnonzero(a)
        gain = (_xlogx(i0[:, d[0]] + b[d[0]]) - _xlogx(i0[:, d[0]])).sum(axis=1) + (_xlogx(o0[:, d[1]] + a[d[1]]) - _xlogx(o0[:, d[1]])).sum(axis=1)
        gain -= _xlogx(l0 + b.sum()) - _xlogx(l0) + _xlogx(r0 + a.sum()) - _xlogx(r0)
        best = int(np.argmax(gain))
        if gain[best] > gain[c] + 1e-9:
            new[w] = best
            into[:, c] -= b
            into[:, best] += b
            out[c] -= a
            out[best] += a
            left[c] -= b.sum()
            left[best] += b.sum()
            right[c] -= a.sum()
            right[best] += a.sum()
            cls = new
    return new


def _neared(seen: Counter[tuple[bytes, int]]) -> pd.DataFrame:
    n = len(seen)
    return pd.DataFrame({"word": pd.Series([w for w, _ in seen], dtype=object), "near": np.fromiter((c for _, c in seen), dtype=np.int32, count=n), "n": np.fromiter(seen.values(), dtype=np.int64, count=n)})


def _rest_contexts(classes) -> object:
    """word, near, n: of other words in training texts, how often each class stands before them (-1: another word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, k = classes.value
        end = int(cls[-1])
        seen: Counter[tuple[bytes, int]] = Counter()
        for x in batches:
            for raw, rest in zip(x["ids"], x["rest"], strict=True):
                ids = np.frombuffer(raw, dtype=np.int32)
                c = np.where(ids >= 0, cls[ids], -1)
                near = np.r_[end, c[:-1]][ids < 0]
                seen.update(zip(rest, near.tolist()))
            if len(seen) > 400_000:
                yield _neared(seen)
                seen = Counter()
        yield _neared(seen)

    return run


def _assign(log_next: np.ndarray) -> object:
    """Gives each other word the class that is likeliest after the classes seen before it."""
    k = len(log_next)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            m = np.zeros((len(x), k + 1))
            if len(x):
                at = np.repeat(np.arange(len(x)), [len(s) for s in x["near"]])
                np.add.at(m, (at, np.concatenate(x["near"].to_numpy()).astype(np.int64)), np.concatenate(x["n"].to_numpy()).astype(float))  # -1 falls in the last column
            yield pd.DataFrame({"word": x["word"], "c": x["c"], "cls": np.argmax(m[:, :k] @ log_next, axis=1).astype("int32")})

    return run


def _read(raw: bytes, slot, c, kind, cls: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and count of each token of a text; -1 and 0 where training didn't have it."""
    ids = np.frombuffer(raw, dtype=np.int32)
    k, n = np.where(ids >= 0, cls[ids], -1).astype(np.int64), np.where(ids >= 0, count[ids], 0).astype(float)
    if slot is not None and len(slot):
        at = np.flatnonzero(ids < 0)[np.asarray(slot, dtype=np.int64)]
        k[at], n[at] = kind, c
    return k, n


def _bigrams(sent) -> object:
    """cells: how often a class follows another, over all tokens of the texts; one dense table for a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, count, k = sent.value
        cells = np.zeros(k * k, dtype=np.int64)
        for x in batches:
            for raw, slot, c, kind in zip(x["ids"], x["slot"], x["c"], x["kind"], strict=True):
                now, _ = _read(raw, slot, c, kind, cls, count)
                before = np.r_[int(cls[-1]), now[:-1]]
                ok = (now >= 0) & (before >= 0)
                cells += np.bincount(before[ok] * k + now[ok], minlength=k * k)
        yield pd.DataFrame({"at": np.arange(k * k), "n": cells})

    return run


def _score(model) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cls, count, total, kinds, logs, size, unseen, weight = model.value
        for x in batches:
            out = []
            for raw, slot, c, kind in zip(x["ids"], x["slot"], x["c"], x["kind"], strict=True):
                now, n = _read(raw, slot, c, kind, cls, count)
                before = np.r_[int(cls[-1]), now[:-1]]
                known = n > 0
                # A class of -1 before: the class frequencies, the last row.
                move = logs[before[known], now[known]]
                p = (1 - unseen) * (weight * move * n[known] / size[now[known]] + (1 - weight) * n[known] / total)
                base, own = np.log10((n + 1) / (total + kinds + 1)), float(np.log10(p).sum())
                out.append((len(n), int(known.sum()), total, float(base.sum()), own + float((~known).sum() * np.log10(unseen)), own, float(base[known].sum())))
            y = pd.DataFrame(out, columns=["n_tokens", "n_known", "train_tokens", "base_score", "score", "known_score", "known_base"])
            yield pd.concat([pd.DataFrame({"doc_id": x["id"].values, "held_out": x["held"].values}), y], axis=1)

    return run


@dataclass
class Fitted:
    """A fitted model and the texts it was fitted beside.

    texts: id, held, ids, and of the words that aren't common slot, c, kind. common, count, cls: the common words, END last.
    rare: word, c, cls. table: rows of transitions, and the class frequencies last. size: tokens of a class. unseen: the
    probability of all other words together.
    """

    texts: DataFrame
    common: list[bytes]
    count: np.ndarray
    cls: np.ndarray
    rare: DataFrame
    table: np.ndarray
    size: np.ndarray
    total: int
    kinds: int
    unseen: float
    weight: float


def fit(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", p: Brown = Brown()) -> Fitted:
    """Classes from exchange over the common words' contexts in all training texts; other words by the classes before them.

    Transitions are then counted over all training tokens, rare words included.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("held", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)
    kind = rows.schema["id"].dataType.simpleString()
    counts = rows.where("not held").select("text").mapInPandas(_counts, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = stage(counts, "word-counts")
    t = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("one")).first()
    total, kinds = int(t["n"]), int(t["v"])
    unseen = max(int(t["one"]), 1) / (total + 1)
    freq = counts.where((F.col("c") * (1 << p.common) >= total) & (F.length("word") <= p.longest) & (F.col("word") != F.lit(END))).orderBy(F.desc("c"), "word").collect()
    ends = counts.where(F.col("word") == F.lit(END)).collect()
    drop(counts)
    common = [bytes(r["word"]) for r in freq] + [END]
    count = np.array([r["c"] for r in freq] + [ends[0]["c"] if ends else 0], dtype=np.int64)
    sent = sc.broadcast(common)
    made = stage(rows.mapInPandas(_numbered(sent), f"id {kind}, row bigint, held boolean, ids binary, rest array<binary>"), "numbered")
    train = made.where("not held")
    k, f = p.classes, len(common)
    rng = np.random.default_rng(p.seed)
    # The most frequent words begin one to a class; END keeps the last class to itself.
    cls = np.where(np.arange(f) < k - 1, np.arange(f), rng.integers(0, k - 1, f)).astype(np.int64)
    cls[-1] = k - 1
    core = max(1, min(f, int((count * (1 << (p.common - 3)) >= total)[:-1].sum())))
    for r in range(p.rounds):
        first = core if r < p.rounds - 1 else f
        ctx = _gather(spark, train, cls, k, first)
        may = rng.random(first) < 0.5 if r < p.rounds - 1 else np.arange(first) >= core
        may[f - 1 :] = False
        cls[:first] = exchange(ctx, cls[:first], k, may)
    ctx = _gather(spark, train, cls, k, f)
    moves = np.zeros((k, k))
    np.add.at(moves.T, cls, ctx[:, :k])  # [d, c]: c after d, between common words
    share = moves.sum(axis=0) + 1.0
    smooth = lambda m, q: (m + p.prior * q) / (m.sum(axis=1, keepdims=True) + p.prior)
    log_next = np.log(smooth(moves, share / share.sum()))
    sent2 = sc.broadcast((cls, k))
    near = train.where(F.size("rest") > 0).select("ids", "rest").mapInPandas(_rest_contexts(sent2), "word binary, near int, n bigint")
    near = near.groupBy("word", "near").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum("n").alias("c"), F.collect_list("near").alias("near"), F.collect_list("n").alias("n"))
    rare = stage(near.mapInPandas(_assign(log_next), "word binary, c bigint, cls int"), "rare-words")
    size = np.bincount(cls, weights=count, minlength=k).astype(float)
    for r in rare.groupBy("cls").agg(F.sum("c").alias("c")).collect():  # a row per class
        size[r["cls"]] += r["c"]
    p_class = size / max(size.sum(), 1.0)
    asked = made.where(F.size("rest") > 0).select("row", F.posexplode("rest").alias("slot", "word"))
    got = asked.join(rare, "word").groupBy(F.col("row").alias("_row")).agg(F.collect_list("slot").alias("slot"), F.collect_list("c").alias("c"), F.collect_list("cls").alias("kind"))
    # Staged, so that the words' shuffles are gone before the ids travel.
    got = stage(got, "rare-slots")
    texts = stage(made.join(got, F.col("row") == F.col("_row"), "left").select("id", "held", "ids", "slot", "c", "kind"), "classed")
    drop(made, got)
    cells = texts.where("not held").select("ids", "slot", "c", "kind").mapInPandas(_bigrams(sc.broadcast((cls, count, k))), "at bigint, n bigint")
    moves = np.zeros(k * k)
    for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row per pair of classes
        moves[r["at"]] = r["n"]
    table = np.vstack([smooth(moves.reshape(k, k), p_class), p_class])
    return Fitted(texts, common, count, cls, rare, table, np.maximum(size, 1.0), total, kinds, min(unseen, 1.0), p.weight)


def scored(m: Fitted) -> DataFrame:
    """A row for each text: its scores by the model and by the base, with and without the words that training didn't have."""
    model = m.texts.sparkSession.sparkContext.broadcast((m.cls, m.count, m.total, m.kinds, m.table, m.size, m.unseen, m.weight))
    kind = m.texts.schema["id"].dataType.simpleString()
    out = m.texts.mapInPandas(_score(model), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, known_score double, known_base double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), F.least(F.lit(300.0), -F.col("score") / F.col("n_tokens"))))


def score(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", p: Brown = Brown()) -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score, known_base, perplexity.

    Rows whose crc32 of the id as text leaves 2 by 7 are held out; the others train. Exchange clustering gives the
    common words their classes from counts over all training texts; END is one of them. Other words get the class that
    is likeliest after the classes before them. A known word's probability mixes transition times emission with its
    frequency; all unseen words share, as one, the share of training tokens that are the only one of their word
    (Good-Turing). So the probabilities of known words and the unseen one sum to 1 after any word, and a text with unseen
    words isn't told which they were; known_score and known_base leave these words out. Null and empty texts have END
    alone. With no training text every token is unseen and scores are 0. Ties between words go by their bytes.
    """
    return scored(fit(docs, id_col=id_col, text=text, p=p))


def op2_class_ngrams(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))


QUERIES = {"op2_class_ngrams": op2_class_ngrams}
ORACLE_SQL = {}

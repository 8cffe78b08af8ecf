"""Near-duplicates by Order MinHash, verified by banded alignment (operator 6)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.graph import components
from urnspark.llm.shared import append, drop, folder, read, ship, stage


#: Texts of a bucket in a block, on average, and pairs that are compared at once.
BLOCK, AT_ONCE = 2048, 1 << 15


@dataclass(frozen=True)
class OrderMinHash:
    """k: words of a k-mer. picks: k-mers a sketch holds, in text order. sketches: drawn for each text.

    num/den: the least similarity. Two long texts of similarity s share a sketch with about s ** picks, and any of 20 with
    0.9997 at 0.8; 0.006 at 0.2. Short ones share fewer (0.998 for 9 of 10 k-mers each), so pairs in which a text has
    fewer than short k-mers have exact keys as well. stars: the most rounds in which a bucket's texts meet one of them,
    before all pairs that are still apart; they end when one finds few links. marks: bits of a text's k-mer parities.
    """

    k: int = 5
    picks: int = 5
    sketches: int = 20
    num: int = 4
    den: int = 5
    stars: int = 12
    short: int = 10
    marks: int = 2048
    seed: int = 12345


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def kmers(text: str, k: int) -> np.ndarray:
    """Hashes of the text's k-word runs in order, each labelled by how often it came before; so none repeats.

    A text of fewer words has one run, of all its words; one without a word has none.
    """
    words = np.array([crc32(w) for w in text.encode("utf-8", "surrogatepass").split()], dtype=np.uint64)
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = _mix(h ^ words[i : i + len(h)])
    order = np.argsort(h, kind="stable")
    runs = h[order]
    first = np.r_[True, runs[1:] != runs[:-1]]
    if not first.all():
        at = np.arange(len(h))
        seen = np.empty(len(h), dtype=np.uint64)
        seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        h = np.where(seen > 0, _mix(h + seen * np.uint64(0xD1B54A32D192ED03)), h)
    return h


def sketch(h: np.ndarray, p: OrderMinHash) -> np.ndarray:
    """A hash for each sketch: of the k-mers least under the sketch's own order, taken in text order."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng(p.seed)
    odd = rng.integers(1, 1 << 62, p.sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, m = np.arange(1, p.sketches + 1, dtype=np.uint64), min(p.picks, len(h))
    step = max(1, 4_000_000 // len(h))
    for a in range(0, p.sketches, step):
        rank = h[None, :] * odd[a : a + step, None]
        least = np.argpartition(rank, m - 1, axis=1)[:, :m] if m < len(h) else np.tile(np.arange(m), (len(rank), 1))
        least.sort(axis=1)
        for c in range(m):
            out[a : a + step] = _mix(out[a : a + step] ^ h[least[:, c]])
    return out.view(np.int64)


def exact_keys(h: np.ndarray, p: OrderMinHash) -> np.ndarray:
    """Keys of a short text, or of one similar in size to a short one; similar texts share one for certain.

    Similar texts have num/den of the longer one's k-mers in common. So of n k-mers by value, the first n - need + 1
    hold one that both have among their first: the prefix filter.
    """
    n = len(h)
    if not n or p.num * n > p.den * (p.short - 1):
        return np.zeros(0, dtype=np.int64)
    need = -(-p.num * n // p.den)
    return _mix(np.sort(h)[: n - need + 1] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def parities(h: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each value of the hash's last bits: whether an odd number of k-mers has it; in bytes."""
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(marks: np.ndarray) -> np.ndarray:
    """Parities by fewer bits, 256 in four integers: the exclusive or of a text's parities in blocks."""
    return np.bitwise_xor.reduce(marks.reshape(-1, 32), axis=0).view("<i8")


def aligned(a: np.ndarray, b: np.ndarray, p: OrderMinHash) -> bool:
    """Whether k-mers matched in order, over all k-mers of both, reach the similarity.

    Occurrence-labelled k-mers are unique in a text, so the alignment is the longest rising run of their places in
    the other. Matches off the diagonal by more than the two lengths allow can't be part of it: that is the band.
    """
    n, m = len(a), len(b)
    need = -(-p.num * (n + m) // (p.num + p.den))
    if min(n, m) < need:
        return False
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), m - 1)
    j = order[at]
    hit = b[j] == a
    i, j = np.flatnonzero(hit), j[hit]
    band = (j - i <= m - need) & (i - j <= n - need)
    j = j[band]
    if len(j) < need or (np.diff(j) > 0).all():
        return len(j) >= need
    tails: list[int] = []
    for x in j.tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    return len(tails) >= need


def _sketches(p: OrderMinHash):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            h = [kmers(t, p.k) for t in x["text"]]
            marks = [parities(y, p.marks) for y in h]
            yield pd.DataFrame({"id": x["id"], "ck": x["ck"], "keys": [np.r_[sketch(y, p), exact_keys(y, p)] for y in h], "size": [len(y) for y in h], "bits": [folded(m) for m in marks], "marks": [m.tobytes() for m in marks]})

    return run


def _may(p: OrderMinHash):
    """Leaves out pairs whose parities by all bits rule the similarity out: a bit that differs is a k-mer that one text lacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                a, b = (np.frombuffer(b"".join(x[c]), dtype=np.uint64).reshape(len(x), -1) for c in ("mu", "mv"))
                both = x["nu"].to_numpy() + x["nv"].to_numpy()
                need = -(-p.num * both // (p.num + p.den))
                x = x[both - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) >= 2 * need]
            yield x[["u", "v"]]

    return run


def _apart(p: OrderMinHash):
    """u, v: pairs of a bucket whose labels differ and whose parities by all bits leave room for the similarity.

    Rows come in order of key, i, j, block; those of blocks i and j meet, or of i alone where it is j. Pairs are counted out
    a few thousand at once and never leave the task unless they pass, so memory is bounded whatever the bucket holds.
    """

    def met(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n, label, ck = x["size"].to_numpy(), pd.factorize(x["label"])[0], x["ck"].to_numpy()
        marks = np.frombuffer(b"".join(x["marks"]), dtype=np.uint64).reshape(len(x), -1)
        at, own = np.arange(len(x)), (x["i"] == x["block"]).to_numpy()
        new = np.r_[True, (x[["key", "i", "j"]].to_numpy()[1:] != x[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)]
        begin = np.flatnonzero(new)
        end = np.repeat(np.r_[begin[1:], len(x)], np.diff(np.r_[begin, len(x)]))
        # The rows of block i come first.
        other = np.repeat(begin + np.add.reduceat(own.astype(np.int64), begin), np.diff(np.r_[begin, len(x)]))
        start = np.where((x["i"] == x["j"]).to_numpy(), at + 1, np.where(own, other, end))
        sums = np.r_[0, (end - start).cumsum()]
        for lo in range(0, int(sums[-1]), AT_ONCE):
            k = np.arange(lo, min(lo + AT_ONCE, int(sums[-1])))
            a = np.searchsorted(sums, k, side="right") - 1
            b = start[a] + k - sums[a]
            both = n[a] + n[b]
            most = both - 2 * -(-p.num * both // (p.num + p.den))
            ok = (label[a] != label[b]) & (np.abs(n[a] - n[b]) <= most)
            a, b, most = a[ok], b[ok], most[ok]
            # A part of the bits that differs too much settles most pairs.
            for bits in (marks[:, :4], marks):
                ok = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most
                a, b, most = a[ok], b[ok], most[ok]
            if len(a):
                yield pd.DataFrame({"u": np.minimum(ck[a], ck[b]), "v": np.maximum(ck[a], ck[b])}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for x in batches:
            if len(x):
                held.append(x)
                whole = pd.concat(held, ignore_index=True) if len(held) > 1 else x
                last = (whole[["key", "i", "j"]] == whole[["key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
                cut = len(whole) - int(last.sum())
                if cut:
                    yield from met(whole.iloc[:cut])
                held = [whole.iloc[cut:]]
        if held:
            yield from met(held[0])

    return run


def _verify(p: OrderMinHash):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            known: dict[str, np.ndarray] = {}
            ok = []
            for u, v, tu, tv in zip(x["u"], x["v"], x["tu"], x["tv"], strict=True):
                for c, t in ((u, tu), (v, tv)):
                    if c not in known:
                        known[c] = kmers(t, p.k)
                ok.append(aligned(known[u], known[v], p))
            yield x.loc[ok, ["u", "v"]]

    return run


def _sieve(inside: DataFrame):
    """Leaves out most rows whose ck isn't inside, before they are shuffled to be joined with it.

    A table of 16 bits for each text inside goes to every task; a row stays if the bit of its ck's hash is set.
    """
    slots = F.lit(max(64, 16 * inside.count()))
    slot = F.pmod(F.xxhash64("ck"), slots)
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("bigint"), s.bitwiseAND(F.lit(63)).cast("int"))
    words = inside.groupBy(F.shiftright(slot, 6).alias("_word")).agg(F.bit_or(bit(slot)).alias("_bits"))

    def sifted(df: DataFrame) -> DataFrame:
        met = df.withColumn("_slot", slot).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"))
        return met.where(F.col("_bits").bitwiseAND(bit(F.col("_slot"))) != 0).drop("_slot", "_word", "_bits")

    return sifted


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """id, ck, class_id, n_texts for each distinct (id, text): the class is the least id that the text is linked to, over any chain.

    Equal texts are one node (null is the empty text). Texts that share a sketch, or an exact key of short texts, are candidates, linked if their
    alignment reaches the similarity; pairs whose sizes or k-mer parities rule that out aren't aligned. Within a bucket, stars come first: each text meets one chosen text, another in
    each round. Then all pairs of a bucket that are still in different classes meet. Pairs within a class are not tried, as they
    can't change it. So a bucket of a hundred thousand near copies costs a few rounds of its size, and no link between
    classes is lost. Texts without a word match only equal ones. ck: a hash of the text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", F.md5(F.col("text").cast("binary")).alias("ck"), "text")
    id_type = rows.schema["id"].dataType.simpleString()
    made = stage(rows.mapInPandas(_sketches(p), f"id {id_type}, ck string, keys array<bigint>, size bigint, bits array<bigint>, marks binary"), "sketches")
    node = made.groupBy("ck").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first(F.struct("size", *(F.col("bits")[i].alias(f"b{i}") for i in range(4)))).alias("own"), F.first("marks").alias("marks"))
    node = stage(node, "texts")
    flat = node.select("ck", F.explode("keys").alias("key"))
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = stage(flat.join(shared, "key", "left_semi"), "buckets")
    inside = stage(buckets.select("ck").distinct(), "bucket-texts")
    sifted = _sieve(inside)
    # Inner joins: Spark would push a semi join below the sieve.
    words = sifted(rows).join(inside, "ck").dropDuplicates(["ck"]).select("ck", "text")
    words = stage(words, "candidate-texts")
    own = stage(sifted(node).join(inside, "ck").select("ck", "own"), "bucket-sizes")
    marked = stage(sifted(node).join(inside, "ck").select("ck", "own.size", "marks"), "bucket-marks")
    labels = inside.select(F.col("ck").alias("node"), F.col("ck").alias("label"))

    def may(u: str, v: str):
        """Whether sizes and parities leave room for the similarity: a bit that differs is a k-mer that one text lacks."""
        both = F.col(f"{u}.size") + F.col(f"{v}.size")
        need = F.ceil(both * p.num / F.lit(float(p.num + p.den)) - 1e-9)
        differ = sum((F.bit_count(F.col(f"{u}.b{i}").bitwiseXOR(F.col(f"{v}.b{i}"))) for i in range(1, 4)), F.bit_count(F.col(f"{u}.b0").bitwiseXOR(F.col(f"{v}.b0"))))
        return (F.least(F.col(f"{u}.size"), F.col(f"{v}.size")) >= need) & (both - differ >= 2 * need)

    def close_of(pairs: DataFrame) -> DataFrame:
        mu, mv = (marked.select(F.col("ck").alias(c), F.col("size").alias(f"n{c}"), F.col("marks").alias(f"m{c}")) for c in "uv")
        return stage(pairs.join(mu, "u").join(mv, "v").mapInPandas(_may(p), "u string, v string"), "close-pairs")

    def linked(close: DataFrame) -> DataFrame:
        texts = close.join(words.select(F.col("ck").alias("u"), F.col("text").alias("tu")), "u").join(words.select(F.col("ck").alias("v"), F.col("text").alias("tv")), "v")
        out = stage(texts.mapInPandas(_verify(p), "u string, v string"), "near-links")
        drop(close)
        return out

    path = folder(spark, "near-pairs")

    def unmet(pairs: DataFrame, k: int) -> DataFrame:
        """Pairs that haven't met in an earlier round."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        if k:
            pairs = pairs.join(spark.read.schema(pairs.schema).parquet(f"{path}/*"), ["u", "v"], "left_anti")
        return pairs

    def met(pairs: DataFrame, k: int) -> DataFrame:
        return linked(close_of(append(unmet(pairs, k), path, k)))

    at = lambda: buckets.join(labels.select(F.col("node").alias("ck"), "label").join(own, "ck"), "ck")
    most = 0
    for k in range(p.stars):
        # One text of each bucket whose texts have different labels.
        now = at()
        one = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("ck", F.lit(k)).alias("h"), "ck", "label", "own")).alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
        one = one.select("key", F.col("m.ck").alias("v"), F.col("m.label").alias("lv"), F.col("m.own").alias("ov"))
        links = met(now.join(one, "key").where((F.col("label") != F.col("lv")) & may("own", "ov")).select(F.col("ck").alias("u"), "v"), k)
        n = links.count()
        if n:
            labels = components(labels, links)
        most = max(most, n)
        if n * 20 <= most:
            break
    now = buckets.join(labels.select(F.col("node").alias("ck"), "label"), "ck")
    open_ = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    # Blocks of a bucket meet two by two, each pair of blocks in a group of its own.
    now = now.join(open_.select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("ck"), F.col("blocks")))
    now = now.join(marked, "ck").withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    now = now.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "ck", "label", "size", "marks")
    now = now.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block").mapInPandas(_apart(p), "u string, v string")
    close = stage(unmet(now, p.stars), "open-pairs")
    labels = components(labels, linked(close))
    all_ = node.join(labels.select(F.col("node").alias("ck"), "label"), "ck", "left").select("ck", "first", F.coalesce("label", "ck").alias("label"))
    groups = all_.groupBy("label").agg(F.min("first").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    classes = stage(all_.join(groups, "label").select("ck", "class_id", "n_texts"), "classes")
    return made.select("id", "ck").join(classes, "ck").select(F.col("id").alias(id_col), "ck", "class_id", "n_texts")


def neardup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class, the document with the least id; of equal rows, one."""
    keep = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "ck")
    # Rows that share the least id but not the text: one text stays.
    keep = stage(keep.groupBy(F.col("doc_id").alias("id")).agg(F.min("ck").alias("ck")), "kept")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("to"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("own"))
    out = rows.join(keep, F.col("to").eqNullSafe(F.col("id")) & (F.col("own") == F.col("ck")), "left_semi")
    return out.dropDuplicates(["to", "own"]).select("doc.*")


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "n_texts", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLE_SQL = {}

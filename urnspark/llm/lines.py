"""Line dedup by an exact set-similarity join (operator 8). DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import drop, read, stage, words_of


#: Words of a line whose parity 64 bits can't tell from another's.
LONG = 64


@dataclass(frozen=True)
class LineJoin:
    """num/den: the least Jaccard similarity of two lines' word sets, as a fraction.

    bits: of a word's hash name its bucket in the table of frequencies. It has this size whatever the
    input, so it goes to every task; words that share a bucket share a frequency, which changes the order of rarity and
    never the result.
    """

    num: int = 4
    den: int = 5
    bits: int = 16


def _ceil(a, b: int):
    """Whole a/b, rounded up."""
    return F.floor((a + (b - 1)) / F.lit(b)).cast("int")


def _place(no, line):
    """A line's number, which any array leaves room for, and 32 bits of its hash, for rows that repeat an id with another text."""
    return F.shiftleft(no.cast("bigint"), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(line), 32))


def _wordy(s):
    return s.rlike(r"[^\x20\x09-\x0D]")


def _rarity(rows: DataFrame, p: LineJoin):
    """Column: for each bucket of words, half octaves of how often its words occur in all texts; and those of the mean."""
    # Words don't cross lines, and one explode is faster than one of lines and one of words.
    flat = rows.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    seen = flat.select(F.explode_outer(words_of(F.col("t"))).alias("w")).groupBy(_bucket(F.xxhash64("w"), p).alias("b")).agg(F.count("w").alias("n"))
    table, total, half = [0] * (1 << p.bits), 0, lambda n: int(2 * log2(n + 1))
    for r in seen.collect():  # a row per bucket at most
        table[r["b"]] = half(r["n"])
        total += r["n"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>"), half(total >> p.bits)  # folded into one literal, of which plans and events hold copies


def _bucket(h, p: LineJoin):
    return F.shiftrightunsigned(h, 64 - p.bits)


def _every_line(rows: DataFrame, p: LineJoin) -> DataFrame:
    """lid, id, at, a, b, c, line, n, bits, more, prefix, leads: each line with a word, staged as the rows are read.

    id, at: where it stands, by (id, line number). a, b, c: what equal lines have in common. n: its distinct words. prefix: the keys of its rarest words,
    which lines at the similarity share one of. bits: the parity of the keys by their last six bits. more: in
    long lines, that of the keys whose seventh bit is set; with bits it gives the parity by seven bits. leads: of
    its three rarest usual words, which words that one copy alone has don't shift; of the next three; and of its three
    rarest common ones. A key has the rarity on top of the word's hash; equal words have equal keys.
    """
    table, mean = _rarity(rows, p)
    # The outer forms don't make Spark evaluate an array once more to see whether it is empty.
    lines = rows.select("id", F.posexplode_outer(F.split("text", "\n")).alias("no", "line")).where(_wordy(F.col("line")))
    # A key that can't be null lets Spark sort plain longs.
    key = lambda h: F.coalesce(F.shiftleft(F.get(table, _bucket(h, p).cast("int")), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0).cast("bigint"))
    one = F.lit(1).cast("bigint")
    parity = lambda keys: F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    out = lines.withColumn("h", F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))))
    out = out.select("id", "no", "line", F.sort_array(F.transform("h", key)).alias("keys"))
    # Four and sixteen times the mean of a bucket.
    out = out.withColumn("usual", F.filter("keys", lambda x: x >= F.lit(mean + 4 << 56)))
    out = out.withColumn("common", F.filter("usual", lambda x: x >= F.lit(mean + 8 << 56)))
    lead = lambda c, at: F.when(F.size(c) > at, F.xxhash64(F.slice(c, at, 3)))
    out = out.select(
        F.monotonically_increasing_id().alias("lid"),
        "id",
        _place(F.col("no"), F.col("line")).alias("at"),
        F.xxhash64("line").alias("a"),
        F.hash("line").alias("b"),
        F.length("line").alias("c"),
        "line",
        F.size("keys").alias("n"),
        parity(F.col("keys")).alias("bits"),
        F.when(F.size("keys") > LONG, parity(F.filter("keys", lambda x: x.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("bigint")).alias("more"),
        F.slice("keys", F.lit(1), F.size("keys") - _ceil(F.size("keys") * p.num, p.den) + 1).alias("prefix"),
        F.array_distinct(F.array_compact(F.array(lead("usual", 1), lead("usual", 4), lead("common", 1)))).alias("leads"),
    )
    return stage(out, "lines")


def _ordered(lines: DataFrame, parts: int) -> DataFrame:
    """lid, pos of the first of each set of equal lines, staged. pos rises with (id, line number). No text is shuffled for it."""
    at = lines.select("lid", "id", "at", "a", "b", "c").repartitionByRange(parts, "id", "at", "lid").sortWithinPartitions("id", "at", "lid")
    at = at.select("lid", "a", "b", "c", F.monotonically_increasing_id().alias("pos"))
    return stage(at.groupBy("a", "b", "c").agg(F.min_by("lid", "pos").alias("lid"), F.min("pos").alias("pos")).select("lid", "pos"), "line-order")


#: Lets Spark sift the scan of all lines by a Bloom filter of those asked for, before their texts are shuffled.
_SIFT = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def _texts(ends: DataFrame, lines: DataFrame) -> DataFrame:
    """pos, h: the word hashes of the lines asked for (pos, lid), staged."""
    spark = ends.sparkSession
    words = F.array_distinct(F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)))
    before = spark.conf.get(_SIFT)
    spark.conf.set(_SIFT, "0")
    try:
        # Spark sifts by a side that has a condition; all lids are 0 or more.
        return stage(lines.select("lid", "line").join(ends.where("lid >= 0"), "lid").select("pos", words.alias("h")), "line-ends")
    finally:
        spark.conf.set(_SIFT, before)


def _verified(pairs: DataFrame, lines: DataFrame, order: DataFrame, p: LineJoin) -> DataFrame:
    """x, y of the pairs whose word sets reach the similarity; each line of them is split into words once."""
    asked = stage(pairs.select(F.explode(F.array("x", "y")).alias("pos")).distinct().join(order, "pos"), "asked-lines")
    ends = _texts(asked, lines)
    drop(asked)
    hx, hy = (ends.select(F.col("pos").alias(s), F.col("h").alias(f"h{s}")) for s in "xy")
    met = pairs.join(hx, "x").join(hy, "y")
    shared = F.size(F.array_intersect("hx", "hy"))
    out = stage(met.where(shared * (p.num + p.den) >= (F.size("hx") + F.size("hy")) * p.num).select("x", "y"), "line-links")
    drop(ends)
    return out


def _may(n: dict, p: LineJoin):
    """Whether two lines' sizes and parities leave room for the similarity: a bit that differs is a word that one line lacks.

    n: sizes of x and y. bx, by, mx, my: their parities, and those of the seventh bit.
    """
    both = n["x"] + n["y"]
    part, rest = F.col("bx").bitwiseXOR(F.col("by")), F.col("mx").bitwiseXOR(F.col("my"))
    differ = F.when((n["x"] > LONG) & (n["y"] > LONG), F.bit_count(part.bitwiseXOR(rest)) + F.bit_count(rest)).otherwise(F.bit_count(part))
    # The least overlap is (nx + ny) * num / (num + den), rounded up; whole numbers alone.
    return (F.least(n["x"], n["y"]) * (p.num + p.den) >= both * p.num) & ((both - differ) * (p.num + p.den) >= 2 * p.num * both)


def _starred(lines: DataFrame, order: DataFrame, p: LineJoin) -> DataFrame:
    """x, y: lines that share a lead with others, against the first line before them in each of four parts of these.

    Copies of a line that differ little are settled here by a few pairs for each copy, instead of all their pairs.
    """
    known = order.join(lines.select("lid", "n", "bits", "more", "leads"), "lid")
    leads = known.select(F.col("pos").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"), F.col("more").alias("mx"), F.explode_outer("leads").alias("lead")).where("lead IS NOT NULL")
    part = F.pmod(F.xxhash64("x"), F.lit(4))
    first = leads.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), *(F.min(F.when(part == i, F.col("x"))).alias(f"y{i}") for i in range(4))).where("n > 1")
    first = first.select("lead", F.explode_outer(F.array(*(f"y{i}" for i in range(4)))).alias("y")).where("y IS NOT NULL")
    first = first.join(known.select(F.col("pos").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"), F.col("more").alias("my")), "y")
    pairs = leads.join(first, "lead").where((F.col("x") > F.col("y")) & _may({s: F.col(f"n{s}").cast("bigint") for s in "xy"}, p)).select("x", "y")
    pairs = stage(pairs.distinct(), "line-stars")
    out = _verified(pairs, lines, order, p)
    drop(pairs)
    return out


def _prefixed(lines: DataFrame, order: DataFrame, settled: DataFrame, p: LineJoin) -> DataFrame:
    """x, y: each line that isn't settled, and the lines before it that reach the similarity.

    Two such lines share a word among the first n - ceil(t*n) + 1 of each, in any common order of words: the prefix
    filter. What a shared word at its places leaves for the rest bounds the overlap: the positional filter. Bits that
    differ in parity bound it too, since each stands for a word that only one line has. Pairs that pass are verified.
    """
    known = order.join(lines.select("lid", "n", "bits", "more", "prefix"), "lid").join(settled.select("lid", F.lit(1).alias("s")), "lid", "left")
    post = known.select("pos", "bits", "more", F.col("n").cast("bigint").alias("n"), F.coalesce("s", F.lit(0)).cast("bigint").alias("s"), F.posexplode_outer("prefix").alias("i", "key"))
    # One plan for both sides, so that the postings are shuffled once. at: words of the line, place of the word, settled.
    post = post.select("key", "pos", (F.shiftleft("n", 33) + F.shiftleft(F.col("i").cast("bigint"), 1) + F.col("s")).alias("at"), "bits", "more")
    x, y = (post.select("key", F.col("pos").alias(s), F.col("at").alias(f"a{s}"), F.col("bits").alias(f"b{s}"), F.col("more").alias(f"m{s}")) for s in "xy")
    n = {s: F.shiftright(f"a{s}", 33) for s in "xy"}
    left = {s: n[s] - F.shiftright(F.col(f"a{s}").bitwiseAND(F.lit(0x1FFFFFFFF)), 1) for s in "xy"}
    earlier = F.col("y") < F.when(F.col("ax").bitwiseAND(F.lit(1)) == 1, F.lit(-1)).otherwise(F.col("x"))
    fits = lambda v: v * (p.num + p.den) >= (n["x"] + n["y"]) * p.num
    # The same about nulls on both sides, for the one plan.
    pairs = stage(x.join(y, "key").where(F.col("x").isNotNull() & F.col("y").isNotNull() & earlier & fits(left["x"]) & fits(left["y"]) & _may(n, p)).select("x", "y").distinct(), "line-pairs")
    out = _verified(pairs, lines, order, p)
    drop(pairs)
    return out


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", p: LineJoin = LineJoin()) -> DataFrame:
    """docs' columns with the text's later matches removed, and struct _lines (n_lines, n_kept, n_links).

    A line goes if any line before it, by (id, line number), has a word set at the similarity or above; equal lines are
    such. It doesn't matter whether the earlier line itself stays. Lines without a word stay. Words are split at ASCII
    blanks and compared by 64-bit hashes. n_lines: lines with a word; n_links: lines of the document whose first
    occurrence in the corpus is here, but which are linked to a different line before. Null and empty texts stay as they
    are. Rows that repeat an id are read as one document in order of their lines; each such row keeps the lines that are
    first. A column named _lines is replaced; any other name may occur in docs.
    """
    others = [c for c in docs.columns if c not in (text, "_lines")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    lines = _every_line(rows, p)
    order = _ordered(lines, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    stars = _starred(lines, order, p)
    settled = stage(order.join(stars.select(F.col("x").alias("pos")).distinct(), "pos"), "settled-lines")
    more = _prefixed(lines, order, settled, p)
    gone = settled.select("pos").union(more.select(F.col("x").alias("pos"))).distinct().withColumn("gone", F.lit(True))
    held = lines.select("lid", "id", "at").join(order.join(gone, "pos", "left"), "lid").groupBy("id")
    held = held.agg(F.collect_list(F.when(F.col("gone").isNull(), F.col("at"))).alias("at"), F.count("gone").alias("n_links")).select(F.col("id").alias("hid"), "at", "n_links")
    held = stage(held, "kept-lines")
    drop(lines, order, stars, settled, more)
    out = rows.join(held.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("hid")), "left")
    out = out.withColumn("old", F.split("text", "\n"))
    old = F.col("old")
    blank = F.array_compact(F.transform(old, lambda s, i: F.when(~_wordy(s), _place(i, s))))
    stays = F.array_intersect(F.transform(old, lambda s, i: _place(i, s)), F.concat(F.coalesce("at", F.array().cast("array<bigint>")), blank))
    n = lambda a: F.coalesce(F.size(F.filter(a, _wordy)).cast("bigint"), F.lit(0))
    out = out.select("doc", "n_links", n("old").alias("n_lines"), F.transform(stays, lambda k: F.get(old, F.shiftright(k, 32).cast("int"))).alias("new"))
    counts = F.struct("n_lines", n("new").alias("n_kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    kept = [F.array_join("new", "\n").alias(c) if c == text else F.col("doc").getField(c).alias(c) for c in docs.columns if c != "_lines"]
    return out.select(*kept, counts.alias("_lines"))


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without the lines that match an earlier one."""
    others = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    out = dedup_lines(docs.select(others.alias("doc"), "doc_id", "text"))
    return out.select(*(F.col(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "_lines.*", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE_SQL = {}

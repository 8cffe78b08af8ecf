"""Quality rules whose cutoffs carry an exact binomial guarantee (operator 5). DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import BLANK_RUN, read, stage, words_of


@dataclass(frozen=True)
class RiskControl:
    """Rules reject a document whose feature exceeds the cutoff of its stratum.

    risk: the share of good documents of a stratum that all rules together may reject.
    confidence: that every stratum keeps this risk, over all rules, strata and cutoffs tried.
    grids: the cutoffs tried, by feature.
    """

    risk: float = 0.02
    confidence: float = 0.95
    grids: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_ratio", (0.01, 0.02, 0.05, 0.1, 0.2)),
        ("repeat_ratio", (0.05, 0.1, 0.2, 0.3, 0.4)),
        ("dup_line_ratio", (0.1, 0.2, 0.3, 0.5, 0.7)),
    )


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and a struct column _q of word features of the whole text.

    n_words; word_chars (code points in words); n_symbols; n_lines (with a word); n_dup_lines (equal to an earlier
    line); n_repeat_words (words in 3-word windows that the text holds twice or more); the ratios of the rules.
    Null, empty and blank texts have zeros. Windows are compared by a 64-bit hash.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_w", words_of(F.col(text)))
    df = df.withColumn(
        "_h",
        F.when(
            F.size("_w") >= 3,
            F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    # Windows in hash order; a window whose hash stands beside its own kind is found twice or more.
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked))
    n = F.size("_s")
    starts = F.sort_array(
        F.transform(
            F.filter(
                F.sequence(F.lit(1), n),
                lambda k: ((k > 1) & (F.element_at("_s", F.greatest(k - 1, F.lit(1)))["h"] == F.element_at("_s", k)["h"]))
                | ((k < n) & (F.element_at("_s", F.least(k + 1, n))["h"] == F.element_at("_s", k)["h"])),
            ),
            lambda k: F.element_at("_s", k)["i"],
        )
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("sum")),
        lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    counts = F.struct(
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("bigint").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_s").isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias("n_repeat_words"),
    )
    df = df.withColumn("_c", counts).drop("_w", "_h", "_l", "_s")
    ratio = lambda a, b: F.col(f"_c.{a}") / F.greatest(F.col(f"_c.{b}"), F.lit(1))
    return df.withColumn(
        "_q",
        F.struct(
            "_c.*",
            ratio("n_symbols", "word_chars").alias("symbol_ratio"),
            ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
            ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            ((F.col("_c.n_words") < 50) | (100 * F.col("_c.n_repeat_words") > 50 * F.col("_c.n_words"))).alias("base_failed"),
        ),
    ).drop("_c")


def binomial_tail(k, n, p: float):
    """Column: P(X <= k) for X of the binomial law of n trials at p; 1 where k >= n*p, whose tail certifies nothing.

    Terms are summed from their logarithms, each from the one before.
    """
    first = n * F.log(F.lit(1.0 - p))
    tail = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), k),
        F.struct(first.alias("lp"), F.exp(first).alias("sum")),
        lambda a, i: F.struct(
            (a["lp"] + F.log((n - i + 1) / i * F.lit(p / (1.0 - p)))).alias("lp"),
            (a["sum"] + F.exp(a["lp"] + F.log((n - i + 1) / i * F.lit(p / (1.0 - p))))).alias("sum"),
        ),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(tail)


def cutoffs(labelled: DataFrame, rc: RiskControl) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is certified.

    labelled: stratum, good (boolean), _q. A cutoff is certified if the exact binomial test rejects "it rejects more
    than risk/rules of the good documents" at (1 - confidence)/(strata x cutoffs tried) (Bonferroni). Of the certified
    ones, the one that rejects most bad documents is taken, then the highest; none if no bad document goes.
    """
    grid = [(f, c) for f, cs in rc.grids for c in cs]
    over = lambda f, c: F.col(f"_q.{f}") > F.lit(c)
    # What the base rule rejects is not for the rules to answer for.
    tested = labelled.where(~F.col("_q.base_failed"))
    sums = tested.groupBy("stratum").agg(
        F.count_if("good").alias("n"),
        *(F.count_if(F.col("good") & over(f, c)).alias(f"g{i}") for i, (f, c) in enumerate(grid)),
        *(F.count_if(~F.col("good") & over(f, c)).alias(f"b{i}") for i, (f, c) in enumerate(grid)),
    )
    sums = stage(sums, "cutoff-counts")
    tried = max(1, sums.count()) * len(grid)
    allowed, level = rc.risk / len(rc.grids), (1.0 - rc.confidence) / tried
    best = []
    for f, _ in rc.grids:
        certified = F.array(
            *(
                F.when((F.col(f"b{i}") > 0) & (binomial_tail(F.col(f"g{i}"), F.col("n"), allowed) <= level), F.struct(F.col(f"b{i}").alias("bad"), F.lit(float(c)).alias("cut")))
                for i, (g, c) in enumerate(grid)
                if g == f
            )
        )
        best.append(F.array_max(F.array_compact(certified))["cut"].alias(f))
    return sums.select("stratum", *best)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", carry: tuple[str, ...] = (), rc: RiskControl = RiskControl()) -> DataFrame:
    """docs' id, the columns in carry, the features _q and boolean _kept.

    labels: doc_id, quality (1: good). A document that repeats in labels is good if every row says so; null quality
    counts for nothing. Strata are the values of a column, null as the empty string. Without labels, with an empty
    table, or where no cutoff is certified, only the base rule rejects. Rows that repeat are judged alike, each kept.
    Columns _q and _kept are replaced; any other name may be carried. Columns _q and _kept
    are replaced; any other name may be carried.
    """
    own = [c for c in dict.fromkeys((id_col, *carry)) if c not in ("_q", "_kept")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    rows = stage(with_features(rows, "text").select("doc", "id", "stratum", "_q"), "features")
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") == 1).alias("good"))
    cut = stage(cutoffs(rows.select("id", "stratum", "_q").join(good, "id"), rc), "cutoffs")
    # A staged table has a known size: Spark sends it to all executors only if it is small.
    cut = cut.select("stratum", F.struct(*(f for f, _ in rc.grids)).alias("cut"))
    passed = ~F.col("_q.base_failed")
    for f, _ in rc.grids:
        passed = passed & ~F.coalesce(F.col(f"_q.{f}") > F.col(f"cut.{f}"), F.lit(False))
    return rows.join(cut, "stratum", "left").select("doc.*", "_q", passed.alias("_kept"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass; a null text fails the base rule."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "lang")
    return judge(rows, read(spark, sf_dir, "labels"), carry=("doc",)).where("_kept").select("doc.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    q = lambda c: F.col(f"_q.{c}")
    return out.select("doc_id", q("n_words").alias("n_words"), *(q(c).alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("_kept").alias("kept"))


def _sql() -> str:
    rc = RiskControl()
    grid = [(f, c) for f, cs in rc.grids for c in cs]
    tries = " UNION ALL ".join(f"SELECT '{f}' AS feature, {c!r}::DOUBLE AS cut" for f, c in grid)
    allowed = rc.risk / len(rc.grids)
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, stratum, x, list_filter(regexp_split_to_array(x, '{BLANK_RUN}'), lambda s: s <> '') AS w,
    list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
gg AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM gg WHERE n > 1) GROUP BY doc_id),
f AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN r USING (doc_id)),
q AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
lab AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
long AS (SELECT stratum, good, feature, v FROM (SELECT stratum, good, symbol_ratio, repeat_ratio, dup_line_ratio FROM q JOIN lab USING (doc_id) WHERE NOT base_failed)
    UNPIVOT (v FOR feature IN (symbol_ratio, repeat_ratio, dup_line_ratio))),
k AS (SELECT stratum, feature, cut, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND v > cut) AS g,
    count(*) FILTER (WHERE NOT good AND v > cut) AS b FROM long JOIN ({tries}) USING (feature) GROUP BY ALL),
m AS (SELECT greatest(1, count(DISTINCT stratum)) * {len(grid)} AS tried FROM k),
p AS (SELECT k.*, CASE WHEN g >= n * {allowed!r}::DOUBLE THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, g + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({allowed!r}::DOUBLE) + (n - i) * ln(1.0::DOUBLE - {allowed!r}::DOUBLE)))) END AS tail FROM k),
c AS (SELECT stratum, feature, arg_max(cut, b * 1000 + cut) AS cut FROM p, m WHERE b > 0 AND tail <= {1.0 - rc.confidence!r}::DOUBLE / tried GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = q.stratum AND (CASE feature WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'repeat_ratio' THEN repeat_ratio ELSE dup_line_ratio END) > cut) AS kept
FROM q"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLE_SQL = {"op5_quality_rules": _sql()}

"""Mixing to target weights by iterative proportional fitting (operator 9). DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urnspark.llm.shared import BLANK_RUN, drop, read, stage, words_of

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """Targets of the three margins and of the fit.

    targets: by margin, a table (value, share); a margin without one aims at shares in proportion to tokens ** power,
    which flattens the corpus. rounds: of raking, each over the three margins. seed: of the sample. keep: the share of
    all tokens that the sample is to have; without one, the greatest probability is 1 and rare cells set the share.
    """

    power: float = 0.8
    rounds: int = 10
    seed: str = "mix-1"
    keep: float | None = None


#: The pipeline's mix: four fifths of the tokens.
PIPELINE = Mix(keep=0.8)


def topics(words):
    """Column: a stand-in topic where the table has none, by the length class of the text."""
    return F.when(words < 50, "note").when(words < 400, "page").when(words < 2000, "article").otherwise("book")


def rake(cells: DataFrame, p: Mix, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells and weight: the token weights whose sums over each margin meet the targets, as near as the cells allow.

    cells: source, lang, topic, tokens (> 0); a row per combination that occurs, so their number is that of the
    combinations and not of the rows. Each round scales the weights to one margin after another, by windows over the
    cells of a value, and is staged.
    With p.keep the weights add up to that share of all tokens and none is above its cell's tokens: each round cuts what is
    above, and the next one rakes the excess onto the other cells.
    """
    budget = p.keep * float(cells.agg(F.sum("tokens")).first()[0] or 0) if p.keep is not None else 1.0
    w = cells
    for m in MARGINS:
        if targets and m in targets:
            given = targets[m].select(F.col("value").alias(m), F.col("share").cast("double").alias(f"goal_{m}"))
        else:
            given = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(p.power)).alias(f"goal_{m}"))
        total = given.agg(F.sum(f"goal_{m}").alias("goals"))
        share = given.crossJoin(F.broadcast(total)).select(m, (F.col(f"goal_{m}") / F.col("goals")).alias(f"goal_{m}"))
        w = w.join(share, m, "left")
    w = w.select("source", "lang", "topic", "tokens", *(F.coalesce(f"goal_{m}", F.lit(0.0)).alias(f"goal_{m}") for m in MARGINS), F.col("tokens").cast("double").alias("weight"))
    for k in range(p.rounds):
        for m in MARGINS:
            held_ = F.sum("weight").over(Window.partitionBy(m))
            w = w.withColumn("_sum", held_).withColumn("weight", F.when(F.col("_sum") > 0, F.col("weight") * F.col(f"goal_{m}") / F.col("_sum")).otherwise(0.0)).drop("_sum")
        if p.keep is not None:
            w = w.withColumn("weight", F.least(F.col("weight") * F.lit(budget), F.col("tokens").cast("double")))
        w = stage(w, "raked")
        if k:
            drop(held)
        held = w
    w = w.drop(*(f"goal_{m}" for m in MARGINS))
    return w if p.keep is None else filled(w, budget)


def filled(w: DataFrame, budget: float) -> DataFrame:
    """weight scaled, and cut at the cell's tokens, so that the sum is the budget, or all that cells with weight have.

    Each step finds the scale at which the cells that aren't full yet take what the full ones leave; scales only rise, so
    a full cell stays full, and the steps end when no further cell is full.
    """
    scale, full = 1.0, -1
    while True:
        held = F.col("weight") * F.lit(scale) >= F.col("tokens")
        n, taken, rest = w.where("weight > 0").agg(F.count_if(held), F.sum(F.when(held, F.col("tokens").cast("double"))), F.sum(F.when(~held, F.col("weight")))).first()
        if n == full or not rest or budget <= (taken or 0.0):
            break
        full, scale = n, (budget - (taken or 0.0)) / rest
    return w.withColumn("weight", F.least(F.col("weight") * F.lit(scale), F.col("tokens").cast("double")))


def sample(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: str | None = None, targets: dict[str, DataFrame] | None = None, p: Mix = Mix()) -> DataFrame:
    """docs and struct _mix: source, lang, topic, n_tokens, probability, kept.

    Tokens are words between ASCII blanks. A document's probability is that of its cell: raked weight over tokens,
    scaled so that the greatest is 1, or with p.keep so that the kept tokens come to that share. It is kept if the hash of its id and the seed falls below; rows that repeat an id
    share their fate within a cell. Null values of a margin are the value ''. Texts without a word carry no weight: they
    take their cell's probability, or 1 where the cell has no token. An empty table gives an empty one. A column _mix is
    replaced; any other name may occur in docs.
    """
    own = [c for c in docs.columns if c != "_mix"]
    margin = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("doc"), F.col(id_col).alias("id"), F.size(words_of(F.col(text))).cast("bigint").alias("n"), margin(source).alias("source"), margin(lang).alias("lang"), (margin(topic) if topic else F.lit("")).alias("topic"))
    if not topic:
        rows = rows.withColumn("topic", topics(F.col("n")))
    cells = rows.groupBy(*MARGINS).agg(F.sum("n").alias("tokens")).where("tokens > 0")
    raked = rake(stage(cells, "cells"), p, targets)
    top = stage(raked.withColumn("r", F.col("weight") / F.col("tokens")), "ratios")
    top = stage(top.crossJoin(F.broadcast(top.agg(F.max("r").alias("top")))).select(*(F.col(m).alias(f"to_{m}") for m in MARGINS), (F.col("r") / F.col("top") if p.keep is None else F.col("r")).alias("p")), "shares")
    # A staged table has a known size: Spark sends it to all executors only if it is small.
    rows = rows.join(top, [F.col(m) == F.col(f"to_{m}") for m in MARGINS], "left")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(p.seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    prob = F.coalesce("p", F.lit(1.0))
    mix = F.struct(*MARGINS, F.col("n").alias("n_tokens"), prob.alias("probability"), (u < prob).alias("kept"))
    return rows.select("doc.*", mix.alias("_mix"))


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the sample, of PIPELINE.keep of the tokens."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source", "lang")
    return sample(rows, p=PIPELINE).where("_mix.kept").select("doc.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = sample(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "_mix.source", "_mix.lang", "_mix.topic", "_mix.n_tokens", F.round("_mix.probability", 9).alias("probability"), "_mix.kept")


def _sql() -> str:
    p = Mix()
    parts = [
        f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK_RUN}'), lambda s: s <> '')) AS BIGINT) AS n_tokens FROM documents),
t AS MATERIALIZED (SELECT *, CASE WHEN n_tokens < 50 THEN 'note' WHEN n_tokens < 400 THEN 'page' WHEN n_tokens < 2000 THEN 'article' ELSE 'book' END AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS MATERIALIZED (SELECT {m}, goal / sum(goal) OVER () AS goal FROM (SELECT {m}, pow(sum(tokens), {p.power!r}::DOUBLE) AS goal FROM c GROUP BY 1))")
    last = "(SELECT *, tokens AS w FROM c)"
    for k in range(p.rounds):
        for m in MARGINS:
            parts.append(f"w{k}_{m} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, tokens, w * goal / sum(w) OVER (PARTITION BY x.{m}) AS w FROM {last} x JOIN g_{m} USING ({m}))")
            last = f"w{k}_{m}"
    return (
        ",\n".join(parts)
        + f""", s AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 1.0::DOUBLE), 9) AS probability,
    (('0x' || substr(md5('{p.seed}:' || doc_id), 1, 12))::BIGINT / {float(1 << 48)!r}::DOUBLE) < coalesce(p, 1.0::DOUBLE) AS kept
FROM t LEFT JOIN s USING (source, lang, topic)"""
    )


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL = {"op9_mixing": _sql()}

"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, packing; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urnspark.llm.lines import line_stage
from urnspark.llm.mixing import mix_stage
from urnspark.llm.neardup import neardup_stage
from urnspark.llm.packing import pack_stage
from urnspark.llm.quality import quality_stage
from urnspark.llm.shared import stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", neardup_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: Near dedup and tokenisation have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs

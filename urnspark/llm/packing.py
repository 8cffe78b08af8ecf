"""Sequences of neighbouring documents along a Hilbert curve (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm import tokens
from urnspark.llm.shared import drop, read, ship, stage


@dataclass(frozen=True)
class Curve:
    """dims and bits: of the curve's grid. features: of the hashed vector. span: of a projected unit vector, cut off."""

    dims: int = 3
    bits: int = 16
    features: int = 1024
    span: float = 3.0
    seed: int = 7


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates in [0, 2**bits): one int64 for each row.

    The coordinates are undone from the highest bit down by exchanging or inverting the lower bits, then Gray coded and
    interleaved. dims * bits may be 63 at most.
    """
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projector(c: Curve, vocab: int) -> np.ndarray:
    """A row for each token id: the projection of the hashed feature that the id falls in, with the id's sign."""
    rng = np.random.default_rng(c.seed)
    plane = rng.standard_normal((c.features, c.dims))
    h = (np.arange(vocab, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return plane[(h >> np.uint64(40)) % np.uint64(c.features)] * np.where(h >> np.uint64(63), 1.0, -1.0)[:, None]


def grid_point(ids: np.ndarray, table: np.ndarray, c: Curve) -> np.ndarray:
    """The grid cell of a document: its token counts, damped by the square root, hashed, projected and normed."""
    kinds, n = np.unique(ids, return_counts=True)
    w = np.sqrt(n)
    v = (table[kinds] * w[:, None]).sum(axis=0) / max(np.sqrt((w * w).sum()), 1.0)
    top = (1 << c.bits) - 1
    return np.clip((v + c.span) / (2 * c.span) * top, 0, top).astype(np.int64)


def _tokenise(path: str, end_id: int, c: Curve):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(path)
        table = projector(c, max(enc.tok.get_vocab_size(), end_id + 1))
        small = enc.tok.get_vocab_size() <= 1 << 16
        for x in batches:
            ids = [np.append(enc(t), np.uint32(end_id)) for t in x["text"]]
            keys = hilbert_keys(np.array([grid_point(i, table, c) for i in ids]), c.bits) if ids else []
            yield pd.DataFrame({"id": x["id"], "curve": keys, "n": [len(i) for i in ids], "ids": [i.astype("<u2" if small else "<u4").tobytes() for i in ids]})

    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for d, n, raw, g in zip(x["id"], x["n"], x["ids"], x["before"], strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    seq, off = divmod(g + at, length)
                    size = min(length - off, n - at)
                    out.append((d, at, size, crc32(ids[at : at + size].tobytes()), n, seq, off, ids[at : at + size].tobytes()))
                    at += size
            yield pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return run


def running_offsets(keyed: DataFrame, order: list[str], size: str) -> DataFrame:
    """keyed and long column before: the sum of size over all rows before in the total order; no task sees all rows.

    The rows are range-sorted and staged; only the sums of the parts, a row each, are summed in one place.
    """
    spark = keyed.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = stage(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    from pyspark.sql import Window

    sums = ranged.groupBy("part").agg(F.sum(size).alias("sum"))
    start = stage(sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("base")), "part-starts")
    within = F.sum(size).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(size)
    return ranged.withColumn("within", within).join(F.broadcast(start), "part").withColumn("before", F.col("base") + F.col("within")).drop("part", "within", "base")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, length: int = 2048, end_id: int = tokens.END_ID, c: Curve = Curve()) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids as little-endian uint32.

    The documents, each with end_id, stand one after another along the curve (ties by id, then by arrival), and every
    length tokens begin a sequence. So all sequences are full but the last, whatever the number of tasks. Null and
    empty texts have the end id alone; no row is lost, and rows that repeat an id are packed each.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInPandas(_tokenise(path or tokens.vocabulary(tokens.BYTE_BPE), end_id, c), f"id {kind}, curve bigint, n bigint, ids binary")
    made = stage(made.withColumn("row", F.monotonically_increasing_id()), "token-ids")
    at = running_offsets(made.select("row", "id", "curve", "n"), ["curve", "id", "row"], "n").select(F.col("row").alias("_row"), "before")
    both = made.join(at, F.col("row") == F.col("_row")).select("id", "n", "ids", "before")
    out = both.mapInPandas(_cut(length), f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return out.withColumnRenamed("id", id_col)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents."""
    return pack(docs).drop("ids")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents")).drop("ids")


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL = {}

"""A content-addressed store of token ids (operator 7): chunks, recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm import tokens
from urnspark.llm.shared import drop, read, ship, stage

#: Bytes of a chunk's hash in a recipe.
HASH = 16
#: Ids that are cut into chunks at once.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Chunking:
    """window: ids under the rolling hash. mean: of a chunk, a power of two. least, most: ids of a chunk, but for a last shorter one."""

    window: int = 16
    mean: int = 256
    least: int = 64
    most: int = 1024


def marks(ids: np.ndarray, starts: np.ndarray, c: Chunking) -> np.ndarray:
    """Places after which the rolling hash of the last window ids has its low bits zero; ids of several documents at once.

    The hash is a sum of powers taken as a difference of two running sums, none reaching back beyond its document's
    start, so a mark depends on the ids of its window alone and equal passages soon share their marks.
    """
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        run = np.r_[np.uint64(0), np.cumsum(h * np.uint64(0xBF58476D1CE4E5B9))]
        first = np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        now = run[1:] - run[np.maximum(np.arange(len(ids)) + 1 - c.window, first)]
        now ^= now >> np.uint64(32)
    return np.flatnonzero((now & np.uint64(c.mean - 1)) == 0) + 1


def cuts(at: list[int], n: int, c: Chunking) -> list[int]:
    """Ends of a document's chunks: its marks, but for those that make a chunk too short, and more where it grows too long."""
    ends, last = [], 0
    for e in [*at, n]:
        while e - last > c.most:
            last += c.most
            ends.append(last)
        if e - last >= c.least or (e == n and e > last):
            last = e
            ends.append(e)
    return ends


def boundaries(ids: np.ndarray, c: Chunking) -> list[int]:
    """Ends of the chunks of one document."""
    return cuts(marks(ids, np.zeros(1, dtype=np.int64), c).tolist(), len(ids), c)


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root over chunk hashes: pairs are hashed together level by level; an odd one moves up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _parts(hashes: bytes) -> list[bytes]:
    return [hashes[i : i + HASH] for i in range(0, len(hashes), HASH)]


def _chunked(path: str, end_id: int, c: Chunking):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(path)
        kind = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        wide, end = int(kind[-1]), np.array([end_id], dtype=np.uint32)

        def cut(x: pd.DataFrame, ids: list[np.ndarray]) -> pd.DataFrame:
            size = np.array([len(i) for i in ids])
            starts = size.cumsum() - size
            flat = np.concatenate(ids)
            at = marks(flat, starts, c)
            lo, hi = np.searchsorted(at, starts, side="right"), np.searchsorted(at, starts + size, side="right")
            all_raw, out = flat.astype(kind).tobytes(), []
            for k, (s, n) in enumerate(zip(starts.tolist(), size.tolist())):
                raw = all_raw[s * wide : (s + n) * wide]
                ends = cuts((at[lo[k] : hi[k]] - s).tolist(), n, c)
                hashes = [hashlib.sha256(raw[a * wide : b * wide]).digest()[:HASH] for a, b in zip([0, *ends], ends)]
                out.append((n, wide, raw, np.array(ends, dtype="<i4").tobytes(), b"".join(hashes), merkle_root(hashes)))
            made = pd.DataFrame(out, columns=["n_tokens", "wide", "ids", "ends", "hashes", "root"])
            return pd.concat([x[["id", "row"]].reset_index(drop=True), made], axis=1)

        for x in batches:
            a, held, n = 0, [], 0
            for b, t in enumerate(x["text"]):
                held.append(np.append(enc(t), end))
                n += len(held[-1])
                if n >= AT_ONCE or b + 1 == len(x):
                    yield cut(x.iloc[a : b + 1], held)
                    a, held, n = b + 1, [], 0

    return run


def _refs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """row, hash of each different chunk of a document."""
    for x in batches:
        own = [list(dict.fromkeys(_parts(h))) for h in x["hashes"]]
        yield pd.DataFrame({"row": np.repeat(x["row"].to_numpy(), [len(h) for h in own]), "hash": [h for hs in own for h in hs]})


def _stored(base: dict[int, int]):
    """Documents with the chunks that they are to hold, and where their ids begin.

    In order of rows, what is said of a document's chunks comes before the document: those that another one holds, and
    those of its own that others name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[int, bytes] = {}
        now, before, part = None, 0, None
        for x in batches:
            out = []
            for d, r, kind, n, wide, raw, ends, hashes, root in zip(*(x[c].to_pylist() for c in ("id", "row", "kind", "n_tokens", "wide", "ids", "ends", "hashes", "root"))):
                if r != now:
                    now, said = r, {}
                if kind < 2:
                    said[kind] = b"".join(hashes)
                    continue
                if r >> 33 != part:
                    part = r >> 33
                    before = base[part]
                absent, lent, seen, body = set(_parts(said.get(0, b""))), said.get(1, b""), set(), []
                at = [0, *np.frombuffer(ends, dtype="<i4").tolist()]
                for i, h in enumerate(_parts(hashes[0])):
                    if h not in absent and h not in seen:
                        seen.add(h)
                        body.append(raw[at[i] * wide : at[i + 1] * wide])
                out.append((d, r, before, n, wide, ends, hashes[0], root, said.get(0, b""), lent, b"".join(body)))
                before += n
            kinds = [x.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "row", "start", "n_tokens", "wide", "ends", "hashes", "root", "absent", "lent", "payload"])

    return run


def _held(ends: bytes, hashes: bytes, absent: bytes, payload: bytes, wide: int) -> dict[bytes, bytes]:
    """hash -> chunk of what a payload holds."""
    at, pos, away, out = [0, *np.frombuffer(ends, dtype="<i4").tolist()], 0, set(_parts(absent)), {}
    for i, h in enumerate(_parts(hashes)):
        if h not in away and h not in out:
            size = (at[i + 1] - at[i]) * wide
            out[h] = payload[pos : pos + size]
            pos += size
    return out


def _lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """hash, chunk of the chunks that other documents name."""
    for x in batches:
        out = []
        for wide, ends, hashes, absent, lent, body in zip(x["wide"], x["ends"], x["hashes"], x["absent"], x["lent"], x["payload"], strict=True):
            held = _held(ends, hashes, absent, body, wide)
            out += [(h, held[h]) for h in _parts(lent)]
        yield pd.DataFrame(out, columns=["hash", "chunk"])


def _absent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """row, hash of the chunks that a document doesn't hold."""
    for x in batches:
        away = [_parts(h) for h in x["absent"]]
        yield pd.DataFrame({"row": np.repeat(x["row"].to_numpy(), [len(h) for h in away]), "hash": [h for hs in away for h in hs]})


def _rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Puts each document together from its own payload and the chunks lent to it, and verifies hashes and root."""
    for x in batches:
        out = []
        for d, r, start, n, wide, ends, hashes, root, absent, body, got in zip(x["id"], x["row"], x["start"], x["n_tokens"], x["wide"], x["ends"], x["hashes"], x["root"], x["absent"], x["payload"], x["got"], strict=True):
            chunks, names = _held(ends, hashes, absent, body, wide), _parts(hashes)
            chunks.update({e["hash"]: e["chunk"] for e in got} if got is not None else {})
            ok = sum(map(len, chunks.values())) >= len(body) and all(h in chunks for h in names) and all(hashlib.sha256(c).digest()[:HASH] == h for h, c in chunks.items()) and merkle_root(names) == root
            raw = b"".join(chunks[h] for h in names) if ok else b""
            if len(raw) != n * wide:
                raise ValueError(f"document {d}: the store doesn't match its manifest")
            ids = np.frombuffer(raw, dtype=f"<u{wide}").astype("<u4").tobytes()
            out.append((d, start, n, crc32(ids), ids))
        yield pd.DataFrame(out, columns=["id", "start", "n_tokens", "ids_crc32", "ids"])


def manifest(store: DataFrame) -> str:
    """The Merkle root over the documents in order, as hex: rows in blocks of 1,024, and these again, to one.

    A document counts by its recipe's root, row, start, n_tokens, width, coding and id, each value after its length.
    """
    told = [F.col(c).cast("string") for c in ("row", "start", "n_tokens", "wide", "coding", "id")]
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told]
    at = store.select(F.col("row").alias("k"), F.unhex(F.sha2(F.concat("root", *(c.cast("binary") for c in told)), 256)).alias("h"))
    for _ in range(7):  # 63 bits
        at = at.groupBy(F.shiftright("k", 10).alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("x"))
        at = at.select("k", F.unhex(F.sha2(F.aggregate(F.transform("x", lambda e: e["h"]), F.lit(b""), lambda a, h: F.concat(a, h)), 256)).alias("h"))
    top = at.select(F.lower(F.hex("h")).alias("h")).first()
    return top["h"] if top else hashlib.sha256(b"").hexdigest()


def write_store(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = tokens.END_ID, c: Chunking = Chunking()) -> DataFrame:
    """The store, staged as Parquet files in ascending order of id: id, row, start, n_tokens, recipe (ends, hashes), root, absent, lent, payload, coding.

    A document's ids with end_id are cut at content-defined places. The first document that holds a chunk keeps it in its
    payload, so each chunk is stored once; others name it by hash (absent), and the holder knows which of its chunks are
    named by others (lent). root: the Merkle root over the recipe. start: ids of all documents before. coding: a digest of
    the vocabulary's file, and the end id. Null and empty texts have the end id alone. Rows that repeat an id are stored each, in order of a hash of their texts.
    """
    spark, path = docs.sparkSession, path or tokens.vocabulary(tokens.WORD_BPE)
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # The order is made while the texts are small and no id is counted yet.
    rows = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    schema = f"id {kind}, row bigint, n_tokens bigint, wide int, ids binary, ends binary, hashes binary, root binary"
    made = stage(rows.mapInPandas(_chunked(path, end_id, c), schema), "chunked")
    refs = made.select("row", "hashes").mapInPandas(_refs, "row bigint, hash binary")
    owners = refs.groupBy("hash").agg(F.min("row").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "owner")
    away = stage(refs.join(owners, "hash").where("row <> owner"), "foreign-chunks")
    away_of = away.groupBy("row").agg(F.collect_list("hash").alias("hashes"))
    lent_of = away.select("owner", "hash").distinct().groupBy(F.col("owner").alias("row")).agg(F.collect_list("hash").alias("hashes"))
    total, base = 0, {}
    for r in sorted(made.groupBy(F.shiftright("row", 33).alias("part")).agg(F.sum("n_tokens").alias("n")).collect()):  # a row per partition
        base[r["part"]] = total
        total += r["n"]
    every = made.withColumn("kind", F.lit(2)).withColumn("hashes", F.array("hashes"))
    for k, notes in enumerate((away_of, lent_of)):
        every = every.unionByName(notes.withColumn("kind", F.lit(k)), allowMissingColumns=True)
    # One shuffle of the bodies: partition k takes what was partition k, so the files are in ascending order.
    every = every.repartitionById(max(base, default=0) + 1, F.shiftright("row", 33).cast("int")).sortWithinPartitions("row", "kind")
    out = every.mapInArrow(_stored(base), f"id {kind}, row bigint, start bigint, n_tokens bigint, wide int, ends binary, hashes binary, root binary, absent binary, lent binary, payload binary")
    out = stage(out.withColumn("coding", F.lit(f"{hashlib.sha256(Path(path).read_bytes()).hexdigest()}:{end_id}")), "store")
    drop(made, away)
    return out


def read_store(store: DataFrame, root: str | None = None) -> DataFrame:
    """id, start, n_tokens, ids_crc32, ids (little-endian uint32), rebuilt from chunks and verified against the manifests.

    root: of manifest() when the store was written; a store that lacks a document, has another, or another id, place or
    coding, doesn't match it.
    Only chunks held elsewhere travel, and the documents that name them. A chunk that very many documents name is one row
    of a join on its hash, whose other side Spark splits when it is skewed.
    """
    if root is not None and manifest(store) != root:
        raise ValueError("the documents of the store don't match its manifest")
    kind = store.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    columns = ["id", "row", "start", "n_tokens", "wide", "ends", "hashes", "root", "absent", "payload"]
    got = "array<struct<hash: binary, chunk: binary>>"
    away = F.length("absent") > 0
    whole = store.where(~away).select(*columns, F.lit(None).cast(got).alias("got")).mapInPandas(_rebuild, schema)
    lent = store.where(F.length("lent") > 0).select("wide", "ends", "hashes", "absent", "lent", "payload").mapInPandas(_lend, "hash binary, chunk binary")
    refs = store.where(away).select("row", "absent").mapInPandas(_absent, "row bigint, hash binary")
    given = refs.join(lent, "hash").groupBy(F.col("row").alias("to")).agg(F.collect_list(F.struct("hash", "chunk")).alias("got"))
    mended = store.where(away).select(*columns).join(given, F.col("row") == F.col("to"), "left").select(*columns, "got").mapInPandas(_rebuild, schema)
    return whole.unionByName(mended)


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    kept = write_store(read(spark, sf_dir, "documents"))
    out = read_store(kept, manifest(kept))
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op7_token_store": op7_token_store}
ORACLE_SQL = {}

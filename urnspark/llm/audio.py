"""Chroma fingerprints of recordings and their alignment (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm.shared import read, ship, stage


@dataclass(frozen=True)
class Chroma:
    """rate, frame, hop: of the spectra, in samples. error: the greatest share of differing bits of a match. overlap: its least codes."""

    rate: int = 11025
    frame: int = 4096
    hop: int = 1365
    error: float = 0.15
    overlap: int = 16


PITCHES = 12
#: (shape, first pitch class, pitch classes, frames) of the filters; each gives two bits of a code.
FILTERS = tuple((i % 4, (5 * i) % 9, 4, 4 * (1 + i % 4)) for i in range(16))
WIDTH = max(f[3] for f in FILTERS)
#: Codes of a block of recordings that are compared at once.
CODES = 1 << 14


def chroma_of_pcm(samples: np.ndarray, c: Chroma) -> np.ndarray:
    """Frames by pitch class: the energy of the spectrum's bins between 28 Hz and 3520 Hz, folded into an octave."""
    if len(samples) < c.frame:
        samples = np.pad(samples, (0, c.frame - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples, c.frame)[:: c.hop]
    power = np.abs(np.fft.rfft(frames * np.hamming(c.frame), axis=1)) ** 2
    hz = np.fft.rfftfreq(c.frame, 1 / c.rate)
    use = (hz >= 28) & (hz <= 3520)
    pitch = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % PITCHES
    out = np.zeros((len(frames), PITCHES))
    np.add.at(out.T, pitch, power[:, use].T)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def chroma_of_vector(v: np.ndarray) -> np.ndarray:
    """Frames of a recording that is given as one vector: the magnitudes under a window of 12, moved by one."""
    v = np.abs(np.nan_to_num(np.asarray(v, dtype=float)))
    if len(v) < PITCHES:
        v = np.pad(v, (0, PITCHES - len(v)))
    out = np.lib.stride_tricks.sliding_window_view(v, PITCHES)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def fingerprint(chroma: np.ndarray) -> np.ndarray:
    """A 32-bit code per place of a window of WIDTH frames: 16 filters over the integral image, two Gray-coded bits each.

    A filter compares two areas of its rectangle: halves in pitch, halves in time, quarters crosswise, or the middle
    third in time with the rest; the log ratio is cut at -0.15, 0 and 0.15. Shorter recordings repeat their frames.
    """
    if len(chroma) < WIDTH:
        chroma = np.tile(chroma, (-(-WIDTH // max(1, len(chroma))), 1))[:WIDTH] if len(chroma) else np.zeros((WIDTH, PITCHES))
    image = np.zeros((len(chroma) + 1, PITCHES + 1))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)
    n = len(chroma) - WIDTH + 1
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[at + t1, y1] - image[at + t0, y1] - image[at + t1, y0] + image[at + t0, y0]

    code = np.zeros(n, dtype=np.uint64)
    for shape, y, h, w in FILTERS:
        whole = area(0, w, y, y + h)
        if shape == 0:
            a = area(0, w, y, y + h // 2)
        elif shape == 1:
            a = area(0, w // 2, y, y + h)
        elif shape == 2:
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        else:
            a = area(w // 4, w - w // 4, y, y + h)
        ratio = np.log((a + 1e-3) / (whole - a + 1e-3))
        level = np.digitize(ratio, (-0.15, 0.0, 0.15)).astype(np.uint64)
        code = (code << np.uint64(2)) | (level ^ (level >> np.uint64(1)))
    return code


def _codes(kind: str, c: Chroma):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for r, v in zip(x["id"], x["media"], strict=True):
                if kind == "pcm":
                    frames = chroma_of_pcm(np.frombuffer(v or b"", dtype="<i2").astype(float), c)
                else:
                    frames = chroma_of_vector(np.zeros(0) if v is None else v)
                codes = fingerprint(frames)
                out.append((r, hashlib.md5(codes.tobytes()).hexdigest(), codes.astype("int64")))
            yield pd.DataFrame(out, columns=["id", "fp", "codes"])

    return run


def fingerprints(media: DataFrame, *, id_col: str, media_col: str, c: Chroma = Chroma()) -> DataFrame:
    """id, fp, codes (32-bit integers): media is PCM (binary, 16 bits, little-endian) or an array of numbers; null is silence."""
    ship(media.sparkSession)
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = "pcm" if rows.schema["media"].dataType.typeName() == "binary" else "vector"
    if kind == "vector":
        rows = rows.withColumn("media", F.col("media").cast("array<double>"))
    t = rows.schema["id"].dataType.simpleString()
    return stage(rows.mapInPandas(_codes(kind, c), f"id {t}, fp string, codes array<bigint>"), "fingerprints")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recordings packed into rows of at most CODES codes, or of one recording: fps, sizes, codes (32 bits, little-endian)."""
    for x in batches:
        out, fps, own = [], [], []
        for fp, codes in zip(x["fp"], x["codes"], strict=True):
            if fps and sum(map(len, own)) + len(codes) > CODES:
                out.append((fps, [len(y) for y in own], np.concatenate(own).astype("<u4").tobytes()))
                fps, own = [], []
            fps.append(fp)
            own.append(np.asarray(codes, dtype=np.int64))
        if fps:
            out.append((fps, [len(y) for y in own], np.concatenate(own).astype("<u4").tobytes()))
        yield pd.DataFrame(out, columns=["fps", "sizes", "codes"])


def _by_size(fps, sizes, codes: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each number of codes, the fingerprints of a block and a matrix of their codes."""
    sizes, flat = np.asarray(sizes), np.frombuffer(codes, dtype="<u4")
    start, fps = np.r_[0, sizes.cumsum()[:-1]], np.asarray(fps, dtype=object)
    return [(fps[at], flat[start[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def aligned(a: np.ndarray, b: np.ndarray, c: Chroma) -> tuple[np.ndarray, ...]:
    """row of a, row of b, offset, votes, bits, codes: every alignment of rows within c.error, at every offset that overlaps enough.

    Bits are summed over a third of the overlap; only pairs that are already beyond c.error of all its bits are left out.
    """
    out = []
    la, lb = a.shape[1], b.shape[1]
    least = max(1, min(c.overlap, la, lb))
    two = lambda m: m[:, :-1].astype(np.uint64) | (m[:, 1:].astype(np.uint64) << np.uint64(32))
    wide = len(a) * len(b) >= 4096
    a2, b2 = (np.ascontiguousarray(two(a).T), np.ascontiguousarray(two(b).T)) if wide else (None, None)
    for d in range(least - la, lb - least + 1):
        s, t = max(0, -d), max(0, d)
        n = min(la - s, lb - t)
        limit = int(c.error * 32 * n + 1e-6)
        if wide:
            bits = np.zeros((len(a), len(b)), dtype=np.uint16 if n < 2000 else np.uint32)
            for k in range(0, n - 1 if n < 6 else -(-n // 3), 2):
                bits += np.bitwise_count(a2[s + k][:, None] ^ b2[t + k][None, :])
            i, j = np.nonzero(bits <= limit)
        else:
            i, j = (x.ravel() for x in np.indices((len(a), len(b))))
        step = max(1, (1 << 22) // n)
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            differ = a[x, s : s + n] ^ b[y, t : t + n]
            bits_xy = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            ok = bits_xy / (32.0 * n) <= c.error
            if ok.any():
                differ = differ[ok]
                votes = sum(((differ & np.uint32(m)) == 0).sum(axis=1) for m in (0x00FFFFFF, 0xFF00FFFF, 0xFFFF00FF, 0xFFFFFF00))
                out.append((x[ok], y[ok], np.full(len(differ), d), votes, bits_xy[ok], np.full(len(differ), n)))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(6))


def _compare(c: Chroma):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                for qs, a in _by_size(r.fps, r.sizes, r.codes):
                    for rs, b in _by_size(r.fps_r, r.sizes_r, r.codes_r):
                        i, j, d, votes, bits, n = aligned(a, b, c)
                        found = pd.DataFrame({"fp": qs[i], "other": rs[j], "offset": d, "votes": votes, "bit_error": bits / (32.0 * n)})
                        found = found[found["fp"] != found["other"]].sort_values(["votes", "offset"], ascending=[False, True])
                        yield found.drop_duplicates(["fp", "other"]).astype({"offset": "int32", "votes": "int64"})

    return run


def matches(asked: DataFrame, known: DataFrame, c: Chroma = Chroma()) -> DataFrame:
    """fp, other, offset, votes, bit_error: pairs of different fingerprints that align within c.error; all of them.

    asked, known: fp (distinct), codes. Every offset of every pair with an overlap of c.overlap codes (or of all codes of
    the shorter) is compared, by the share of differing bits over the overlap, so recall is 1: at 0.15 of 32 bits, keys
    that lose no match select too little to be worth a join. Codes that agree in any three of their four bytes vote; of
    a pair's alignments within c.error, the one with most votes (ties: the least offset) is told. Blocks of both tables
    meet in tasks of their own, so the work is the product of the tables and any number of machines shares it.
    """
    spark = asked.sparkSession
    kind = "fps array<string>, sizes array<int>, codes binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    block = lambda df, name: stage(df.select("fp", "codes").mapInPandas(_blocks, kind), name)
    # Asked blocks are few: they are dealt out against one known block after another.
    left, right = block(asked, "asked-blocks"), block(known, "known-blocks").toDF("fps_r", "sizes_r", "codes_r")
    pairs = right.repartition(parts).crossJoin(left)
    return pairs.mapInPandas(_compare(c), "fp string, other string, offset int, votes bigint, bit_error double")


def search(media: DataFrame, queries: str, *, id_col: str, media_col: str, c: Chroma = Chroma()) -> DataFrame:
    """A row per query and matching class: query_id, class_id, n_members, offset, votes, bit_error.

    queries: a condition on id. Recordings with equal fingerprints form a class, named by its least id; a query's own
    class comes with offset 0 and no error. Rows that repeat an id are one recording each. An empty table gives none.
    """
    made = fingerprints(media, id_col=id_col, media_col=media_col, c=c)
    classes = stage(made.groupBy("fp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_members"), F.first("codes").alias("codes")), "recordings")
    who = made.where(queries).select("id", "fp").distinct()
    asked = classes.join(who.select("fp").distinct(), "fp", "left_semi")
    pairs = matches(asked, classes, c)
    own = asked.select("fp", F.col("fp").alias("other"), F.lit(0).alias("offset"), F.size("codes").cast("bigint").alias("votes"), F.lit(0.0).alias("bit_error"))
    out = stage(pairs.unionByName(own), "alignments").join(classes.select(F.col("fp").alias("other"), "class_id", "n_members"), "other")
    return who.join(out, "fp").select(F.col("id").alias("query_id"), "class_id", "n_members", "offset", "votes", F.round("bit_error", 9).alias("bit_error"))


def op10_chroma_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), "id % 50 = 0", id_col="vec_id", media_col="embedding")


QUERIES = {"op10_chroma_search": op10_chroma_search}
ORACLE_SQL = {}

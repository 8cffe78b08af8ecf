"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids (operator 13)."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnspark.llm import tokens
from urnspark.llm.shared import read, ship, stage

PIECES = "piece_bpe_32k.model"
#: Where a blank may be cut off with the word after it: both vocabularies begin a token there, whatever stands further off.
_cut = re.compile("(?<=[!-~À-ÖØ-öø-ÿ]) (?=[!-~À-ÖØ-öø-ÿ])")
RECORDS = "batch string, radix int, pairs binary, docs binary, stats binary, sha array<string>, counts binary"


@dataclass(frozen=True)
class Spill:
    """batch_bytes: text that a task aligns at once. radix: parts by B id, at least; more as shuffle partitions grow. frame: pairs of a zstd frame."""

    batch_bytes: int = 8 << 20
    radix: int = 64
    frame: int = 4096


class Sides:
    """Both tokenizers, and their tokens' bytes: A is byte-level BPE (tokenizers), B sentencepiece, which adds the blank."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        ranks = a_path.removesuffix(".json") + ".tiktoken"
        self.ranked = tokens._ranked(ranks) if os.path.basename(a_path) == tokens.BYTE_BPE and os.path.exists(ranks) else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {chr(s): bytes([x]) for x, s in [*((x, x) for x in tokens._same), *tokens._stand_in.items()]}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [b"".join(byte_of.get(c, c.encode()) for c in t) for t in names]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        """Ids of a blank and the text; plain Latin from the file of ranks, which gives the same ids faster."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.ranked and tokens._plain.fullmatch(t):
                out[i] = self.ranked.encode_ordinary(" " + t)
            else:
                rest.append(i)
        for k in range(0, len(rest), 1000):
            some = rest[k : k + 1000]
            for i, e in zip(some, self.a.encode_batch([" " + texts[i] for i in some], add_special_tokens=False)):
                out[i] = e.ids
        return out


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of the given sizes, which may be 0."""
    run = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, dtype=np.int64)


@dataclass
class Pieces:
    """Of each of some texts: ok, n_a, n_b, n_groups, links (their number), text (groups as bytes, each with `;`); key: B id and A id of all links in one."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray
    text: list[bytes]
    key: np.ndarray


def _rendered(ids: np.ndarray, marks: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """Each owner's ids as decimals, each with its mark behind it."""
    digits = np.frombuffer(b"".join(b"%-8d" % i for i in range(int(ids.max(initial=0)) + 1)), dtype=np.uint8).reshape(-1, 8).copy()
    width = (digits != 32).sum(axis=1)
    out, size = digits[ids], width[ids]
    out[np.arange(len(ids)), size] = marks
    blob = out[np.arange(8) <= size[:, None]].tobytes()
    at = np.r_[0, np.cumsum(np.bincount(owner, weights=size + 1, minlength=n).astype(np.int64))].tolist()
    return [blob[a:b] for a, b in zip(at, at[1:])]


def pieces(texts: list[str], s: Sides) -> Pieces:
    """The alignment of each text by itself, all at once.

    Byte ends of all texts stand on one line. Every end of either side closes a segment that one A and one B token
    share, so the segments are the links; an end of both sides closes a group.
    """
    n = len(texts)
    a_ids, b_ids = s.encode_a(texts), s.b.encode(texts, num_threads=1) if texts else []
    raw = [b" " + t.encode() for t in texts]
    n_a, n_b = (np.array([len(i) for i in ids], dtype=np.int64) for ids in (a_ids, b_ids))
    flat_a, flat_b = (np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(k.sum())) for ids, k in ((a_ids, n_a), (b_ids, n_b)))
    size = np.array([len(x) for x in raw], dtype=np.int64)
    whole, ok = b"".join(raw), np.ones(n, dtype=bool)
    for flat, count, length, table in ((flat_a, n_a, s.a_len, s.a_bytes), (flat_b, n_b, s.b_len, s.b_bytes)):
        same = _sums(length[flat], count) == size
        if not same.all() or b"".join(map(table.__getitem__, flat.tolist())) != whole:
            ids = a_ids if table is s.a_bytes else b_ids
            same = np.array([b"".join(map(table.__getitem__, i)) == r for i, r in zip(ids, raw)], dtype=bool)
        ok &= same
    flat_a, flat_b = flat_a[np.repeat(ok, n_a)], flat_b[np.repeat(ok, n_b)]
    n_a, n_b = n_a * ok, n_b * ok
    end_a, end_b = np.cumsum(s.a_len[flat_a]), np.cumsum(s.b_len[flat_b])
    ends = np.union1d(end_a, end_b)
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    of_a, of_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    key = flat_b[at_b] * len(s.a_bytes) + flat_a[at_a]
    links = np.bincount(of_a[at_a], minlength=n)
    both_a = end_b[np.searchsorted(end_b, end_a)] == end_a
    both_b = end_a[np.searchsorted(end_a, end_b)] == end_b
    groups = np.r_[2 * (np.cumsum(both_a) - both_a), 2 * (np.cumsum(both_b) - both_b) + 1]
    order = np.argsort(groups, kind="stable")
    marks = np.r_[np.where(both_a, ord("|"), ord(",")), np.where(both_b, ord(";"), ord(","))].astype(np.uint8)
    text = _rendered(np.r_[flat_a, flat_b][order], marks[order], np.r_[of_a, of_b][order], n)
    return Pieces(ok, n_a, n_b, np.bincount(of_a[both_a], minlength=n), links, text, key)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as one zstd frame; whole numbers in as few bytes as the largest needs."""
    kinds = [np.min_scalar_type(int(c.max(initial=0))).str for c in columns]
    head = " ".join([str(len(columns[0])), *kinds]).encode() + b"\n"
    return zstandard.compress(head + b"".join(c.astype(k).tobytes() for c, k in zip(columns, kinds)), 3)


def _unpacked(frame: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(frame)
    head, _, body = raw.partition(b"\n")
    n, *kinds = head.decode().split()
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(body, dtype=k, count=int(n), offset=at).astype(np.int64))
        at += int(n) * np.dtype(k).itemsize
    return out


def _framed(frames: list[bytes]) -> bytes:
    return b"".join(len(f).to_bytes(4, "little") + f for f in frames)


def _frames(run: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(run):
        n = int.from_bytes(run[at : at + 4], "little")
        yield run[at + 4 : at + 4 + n]
        at += 4 + n


def _coded(parts: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """Each part's place in the list of different parts, and that list."""
    known: dict[str, int] = {}
    codes = [known.setdefault(w, len(known)) for p in parts for w in p]
    return np.array(codes, dtype=np.int64), list(known)


def aligned(ids: list, texts: list, s: Sides, radix: int, frame: int) -> tuple[dict, list[tuple[int, bytes, bytes]]]:
    """A batch's documents, and its runs of pair-document records: radix, pairs and counts in B-major order, documents of each pair.

    Words with the blank before them are aligned once a batch. A text with a word whose bytes don't come back is
    aligned as a whole, and has no tokens if its bytes don't come back either.
    """
    parts = [_cut.split(t) if t else [] for t in texts]
    n_parts = np.array([len(p) for p in parts], dtype=np.int64)
    codes, words = _coded(parts)
    made = pieces(words, s)
    if not made.ok.all():
        bad = np.flatnonzero(_sums((~made.ok[codes]).astype(np.int64), n_parts))
        for d in bad:
            parts[d] = [texts[d]]
        n_parts = np.array([len(p) for p in parts], dtype=np.int64)
        codes, words = _coded(parts)
        made = pieces(words, s)
    stats = {k: _sums(getattr(made, k)[codes], n_parts) for k in ("n_a", "n_b", "n_groups", "links")}
    sha, at = [], 0
    for n in n_parts.tolist():
        line = b"".join(map(made.text.__getitem__, codes[at : at + n].tolist()))
        sha.append(hashlib.sha256(line[:-1]).hexdigest() if line else "")
        at += n
    # Records: (pair, document, times), a pair's documents together, pairs by radix, B id and A id.
    pair, which = np.unique(made.key, return_inverse=True)
    part = radix_of(pair // len(s.a_bytes), radix)
    order = np.argsort(part, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    which, pair, part = rank[which], pair[order], part[order]
    held, times = np.unique(np.repeat(np.arange(len(ids)), n_parts) * max(1, len(words)) + codes, return_counts=True)
    doc, word = held // max(1, len(words)), held % max(1, len(words))
    first = np.cumsum(made.links) - made.links
    n_links = made.links[word]
    record = which[_ranges(first[word], n_links)] * len(ids) + np.repeat(doc, n_links)
    weight = np.repeat(times, n_links)
    order = np.argsort(record, kind="stable")
    record, weight = record[order], weight[order]
    new = np.flatnonzero(np.r_[True, record[1:] != record[:-1]]) if len(record) else np.zeros(0, dtype=np.int64)
    weight, record = (np.add.reduceat(weight, new) if len(new) else weight), record[new]
    of, doc = record // len(ids), record % len(ids)
    docs_of = np.bincount(of, minlength=len(pair))
    total = _sums(weight, docs_of)
    runs, begin = [], np.cumsum(docs_of) - docs_of
    for r in np.unique(part):
        a, b = np.searchsorted(part, [r, r + 1])
        lo, hi = begin[a], begin[b] if b < len(pair) else len(doc)
        frames = [_packed(pair[i : min(b, i + frame)], total[i : min(b, i + frame)]) for i in range(a, b, frame)]
        runs.append((int(r), _framed(frames), _framed([_packed(docs_of[a:b]), _packed(doc[lo:hi], weight[lo:hi])])))
    return {"stats": _framed([_packed(*stats.values())]), "sha": sha}, runs


def radix_of(b: np.ndarray, radix: int) -> np.ndarray:
    return ((b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % radix


def _spilled(a_path: str, b_path: str, radix: int, c: Spill):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, task = sides(a_path, b_path), TaskContext.get().partitionId()
        ids, texts, size, k = [], [], 0, 0

        def flush() -> pd.DataFrame:
            head, runs = aligned(ids, texts, s, radix, c.frame)
            rows = [(f"{task}-{k}", -1, None, None, head["stats"], head["sha"], None, list(ids))]
            rows += [(f"{task}-{k}", r, pairs, docs, None, None, None, None) for r, pairs, docs in runs]
            return pd.DataFrame(rows, columns=["batch", "radix", "pairs", "docs", "stats", "sha", "counts", "ids"])

        for x in batches:
            for d, t in zip(x["id"].tolist(), x["text"], strict=True):
                t = t or ""
                if ids and size + len(t) > c.batch_bytes:
                    yield flush()
                    ids, texts, size, k = [], [], 0, k + 1
                ids.append(None if d is pd.NA or d != d else d)
                texts.append(t)
                size += len(t)
        if ids:
            yield flush()

    return run


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their summed counts in ascending order, each key once, from runs in ascending order.

    Two heaps hold the runs, by the first and by the last key of the frame that is unpacked of each: up to the least
    last key nothing smaller can follow, so what lies below it is taken from all runs that have some, summed and told.
    """
    frames = [_frames(r) for r in runs]
    heads: dict[int, list[np.ndarray]] = {}
    firsts, lasts = [], []

    def advance(i: int) -> None:
        if (f := next(frames[i], None)) is not None:
            heads[i] = _unpacked(f)
            heapq.heappush(firsts, (int(heads[i][0][0]), i))
            heapq.heappush(lasts, (int(heads[i][0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while lasts:
        bound, keys, counts, ended = lasts[0][0], [], [], []
        while firsts and firsts[0][0] <= bound:
            i = heapq.heappop(firsts)[1]
            k, n = heads[i]
            cut = int(np.searchsorted(k, bound, side="right"))
            keys.append(k[:cut])
            counts.append(n[:cut])
            heads[i] = [k[cut:], n[cut:]]
            if cut < len(k):
                heapq.heappush(firsts, (int(k[cut]), i))
        while lasts and lasts[0][0] == bound:
            ended.append(heapq.heappop(lasts)[1])
        for i in ended:
            advance(i)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        yield key[new], np.add.reduceat(np.concatenate(counts)[order], new)


def with_maxima(blocks: Iterator[tuple[np.ndarray, np.ndarray]], n_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with a mark on the highest counts of each B id; a B id that a block may not end is held back for the next."""
    key, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for block in itertools.chain(blocks, [None]):
        if block is None:
            ready = len(key)
        else:
            key, count = np.r_[key, block[0]], np.r_[count, block[1]]
            ready = int(np.searchsorted(key, key[-1] // n_a * n_a))
        if ready:
            b = key[:ready] // n_a
            start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            most = np.repeat(np.maximum.reduceat(count[:ready], start), np.diff(np.r_[start, ready]))
            yield key[:ready], count[:ready], count[:ready] == most
            key, count = key[ready:], count[ready:]


def _counted(n_a: int):
    """A radix part: its runs are merged, and each gets the counts of its pairs, and which are their B id's highest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for x in batches:
            for batch, r, pairs in zip(x["batch"], x["radix"], x["pairs"], strict=True):
                held.setdefault(r, []).append((batch, pairs))
        for r, runs in held.items():
            key, count, best = (np.concatenate(z) for z in zip(*with_maxima(merged([p for _, p in runs]), n_a)))
            for batch, pairs in runs:
                own = np.concatenate([_unpacked(f)[0] for f in _frames(pairs)])
                at = np.searchsorted(key, own)
                yield pd.DataFrame({"batch": [batch], "radix": [r], "counts": [_packed(count[at], best[at].astype(np.int64))]})

    return run


def _told(n_a: int):
    """A radix part's pairs: a_id, b_id, n, best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[bytes]] = {}
        for x in batches:
            for r, pairs in zip(x["radix"], x["pairs"], strict=True):
                held.setdefault(r, []).append(pairs)
        for runs in held.values():
            for key, count, best in with_maxima(merged(runs), n_a):
                yield pd.DataFrame({"a_id": (key % n_a).astype("int32"), "b_id": (key // n_a).astype("int32"), "n": count, "best": best})

    return run


def _finish(x: pd.DataFrame) -> pd.DataFrame:
    """A batch: its documents with the contributions of all radix parts."""
    head = x[x["radix"] < 0].iloc[0]
    n_a, n_b, n_groups, n_links = _unpacked(next(_frames(head["stats"])))
    n_best, count_sum = np.zeros(len(n_a), dtype=np.int64), np.zeros(len(n_a), dtype=np.int64)
    counts = {r: c for r, c in zip(x["radix"], x["counts"]) if c is not None}
    for r, docs in zip(x["radix"], x["docs"]):
        if docs is not None:
            count, best = _unpacked(counts[r])
            (docs_of,), (doc, times) = map(_unpacked, _frames(docs))
            np.add.at(count_sum, doc, np.repeat(count, docs_of) * times)
            np.add.at(n_best, doc, np.repeat(best, docs_of) * times)
    return pd.DataFrame({"id": pd.Series(list(head["ids"]), dtype=object), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_best": n_best, "count_sum": count_sum, "groups_sha256": list(head["sha"])})


@dataclass(frozen=True)
class Alignment:
    """What align() has staged: runs of pair-document records by batch and radix part, and each batch's documents."""

    records: DataFrame
    radix: int
    n_a: int

    def _dealt(self, *columns: str) -> DataFrame:
        return self.records.where("radix >= 0").select(*columns).repartitionById(self.radix, F.col("radix"))

    def pairs(self) -> DataFrame:
        """a_id, b_id, n (links corpus-wide), best (none of the B id's pairs has more): a row per linked pair of ids."""
        return self._dealt("radix", "pairs").mapInPandas(_told(self.n_a), "a_id int, b_id int, n bigint, best boolean")

    def documents(self) -> DataFrame:
        """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document."""
        counts = self._dealt("batch", "radix", "pairs").mapInPandas(_counted(self.n_a), "batch string, radix int, counts binary")
        kind = self.records.schema["ids"].dataType.elementType.simpleString()
        both = self.records.drop("pairs", "counts").unionByName(counts, allowMissingColumns=True)
        return both.groupBy("batch").applyInPandas(_finish, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def align(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, c: Spill = Spill()) -> Alignment:
    """Aligns every whole text's tokens of two tokenizers, counts linked pairs of ids and gives the counts back to the documents.

    A task aligns a batch of texts and writes its pair-document records as zstd runs in B-major order, radix-partitioned
    by B id. Only a run's pairs with their sums travel to the radix part, where a k-way heap merge counts each pair and,
    as a B id's pairs come together, finds its highest; the counts of a run's pairs stream back to its batch, where its
    records add them to their documents. So a pair that all documents share is one record a batch, and a task holds the
    runs of one radix part, or of one batch. Records are staged, so a lost executor costs the tasks it ran.

    Null and empty texts, and texts whose bytes either tokenizer doesn't give back, have no tokens: zeros and ''. Rows
    that repeat an id are documents each; a null id is kept. An empty table gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    a_path, b_path = a_path or tokens.vocabulary(tokens.BYTE_BPE), b_path or tokens.vocabulary(PIECES)
    radix = max(c.radix, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    records = stage(rows.mapInPandas(_spilled(a_path, b_path, radix, c), f"{RECORDS}, ids array<{kind}>"), "pair-runs", codec="none")
    from tokenizers import Tokenizer

    return Alignment(records, radix, Tokenizer.from_file(a_path).get_vocab_size())


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    out = align(read(spark, sf_dir, "documents")).documents()
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL = {}

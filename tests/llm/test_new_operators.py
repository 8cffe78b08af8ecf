"""Search, manifest and alignment against plain programs, on whole tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from urnspark.llm import align, manifest, neardup, search

SF = "/root/testdata/sf0.01"
KEY = lambda row: tuple(map(str, row))


def _nearest(rows, k=5):
    """Every query's k best by trying every row; whole numbers, ends of 64 bits."""
    low, high = -(2**63), 2**63 - 1
    usable = [(i, [max(low, min(high, math.floor(x * 256))) for x in v], r) for r, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, r in usable:
        if i % 50 == 0:
            scores = sorted((-max(low + 1, min(high, sum(a * b for a, b in zip(v, w)))), j) for j, w, q in usable if q != r)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def _found(df, c=search.Segments()):
    out = search.top_k(df, "vec_id % 50 = 0", 5, id_col="vec_id", vector_col="embedding", c=c)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


def test_search_of_all_embeddings(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    got = sorted(tuple(r) for r in search.op11_segment_search(spark, SF).collect())
    assert got == _nearest(list(zip(t["vec_id"], t["embedding"])))


def test_search_of_odd_rows(spark):
    """A third of all rows equal, ties, repeated ids, nulls, values that aren't finite, other lengths, values beyond 64 bits; small cells, blocks and chunks."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(700):
        u = rng.random()
        v = [0.5] * 6 if u < 0.3 else rng.integers(-2, 3, 6).astype(float).tolist() if u < 0.6 else rng.standard_normal(rng.integers(0, 9)).tolist() if u < 0.9 else None if u < 0.92 else [1.0, None] if u < 0.94 else [float("nan")] if u < 0.95 else [float("inf"), 1.0] if u < 0.96 else [1e17, -3e18, 1e300] if u < 0.97 else [0.0] * 6
        rows.append((None if i % 97 == 5 else int(rng.integers(0, 500)) if i % 3 else i, v, "x"))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    want = _nearest([r[:2] for r in rows])
    assert _found(df) == want
    assert _found(df, search.Segments(cell=500, block=3, chunk=7, counts=(1, 2, 3))) == want
    assert _found(df.limit(0)) == []
    one = spark.createDataFrame([(50, [1.0, 2.0]), (51, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert _found(one) == [(50, 1, 51, 256 * 256 * 11)]


def test_bounds_hold():
    """Summaries' inner products are never less than the rows' own, and come nearer with more segments."""
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(30, 17)), rng.normal(size=(40, 17)) + 1
    true, last = q @ x.T, None
    for s in (1, 2, 4, 16):
        upper = search.summary(q, s) @ search.summary(x, s).T
        assert (upper >= true - 1e-9).all()
        assert last is None or upper.mean() <= last + 1e-9
        last = upper.mean()


def _tree(rows):
    """The definition, level by level, in plain Python."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by: dict = {}
    for d, s, lang, n, t in rows:
        leaf = lambda t: h(field(d) + field(s) + field(lang) + field(n) + field(t))  # noqa: B023, E731
        bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by.setdefault(s, []).append((d, leaf(t), leaf(low(t)) if bad else leaf(t)))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                b = i // 16 * 16
                paths[k].append(("".join(nodes[b:i]), "".join(nodes[i + 1 : b + 16])))
                at[k] = i // 16
            nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in sources:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[s] = climb([x[1] for x in by[s]])
    root, tops = climb([made[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (d, leaf, bad), path in zip(by[s], made[s][1]):
            node = bad
            for left, right in path + top:
                node = h(left + node + right)
            out.append((d, leaf, made[s][0], root, h("".join(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=KEY)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest_of_all_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    got = sorted((tuple(r) for r in manifest.op12_nested_manifest(spark, SF).collect()), key=KEY)
    assert got == _tree(list(zip(*(t[c] for c in COLUMNS))))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("case", ["odd", "one", "sixteen", "seventeen", "groups", "none"])
def test_manifest_of_odd_tables(spark, tmp_path, case):
    """Null ids and sources, repeated rows, one hot group, lone leaves, whole and broken runs, as many groups as rows, no row."""
    rng = random.Random(1)
    odd = [(rng.choice([None, *range(200)]), "hot" if rng.random() < 0.5 else rng.choice([None, "", "é", *(f"s{i}" for i in range(20))]), None, rng.choice([None, 3]), rng.choice([None, "", "Ab", "é" * 9])) for _ in range(400)]
    rows = {"odd": odd + odd[:9], "one": odd[:1], "sixteen": [(i, "x", None, 1, "a") for i in range(16)], "seventeen": [(i, "x", None, 1, "a") for i in range(17)], "groups": [(i, str(i), None, 1, "A") for i in range(40)], "none": []}[case]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in manifest.op12_nested_manifest(spark, str(tmp_path)).collect()), key=KEY)
    assert got == (_tree(rows) if rows else [])


def _aligned(rows):
    """Tokens, groups and links of each text by walking its bytes, then counts over all texts."""
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
    counts, docs = Counter(), []
    for d, t in rows:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        a_raw = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(a_raw) == b"".join(b_raw) == (" " + t).encode():
            docs.append((d, None))
            continue
        spans = lambda raw: [(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))] if len(raw) < 300 else _running(raw)
        sa, sb = spans(a_raw), spans(b_raw)
        links, j = [], 0
        for i, (s, e) in enumerate(sa):
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((b[k], a[i]))
                k += 1
        groups, i, j = [], 0, 0
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        for end in ends:
            i0, j0 = i, j
            while i < len(sa) and sa[i][1] <= end:
                i += 1
            while j < len(sb) and sb[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j])))
        counts.update(links)
        docs.append((d, (len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most: dict[int, int] = {}
    for (b, _), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = [(d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, *x[:3], len(x[3]), sum(counts[p] == most[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for d, x in docs]
    return sorted(out, key=KEY), counts, most


def _running(raw):
    ends = np.cumsum([len(r) for r in raw]).tolist()
    return list(zip([0, *ends], ends))


def test_alignment_of_all_documents(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted((tuple(r) for r in align.op13_token_alignment(spark, SF).collect()), key=KEY)
    assert got == _aligned(list(zip(t["doc_id"], t["text"])))[0]


def test_alignment_of_odd_texts(spark):
    """Blanks of all kinds, special tokens' strings, bytes without a piece, NUL, composed signs, a long word, null ids and
    texts, repeated rows; many small batches, frames of seven pairs; the pairs themselves; an empty table."""
    rng = random.Random(5)
    signs = ["a", "Z", "é", "ß", " ", "  ", "\n", "\t", " \n", "▁", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "日本", "語", "😀", " ", "　", "ﬁ", "①", "é", "\x00", "\x1c", "\x7f", "​", "12", "'s", "!!", "ő", "Ω", "the", "and of", "▁▁", "\r\n", "﻿", "­", "½"]
    rows = [(i if i % 7 else None, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) if i % 11 else None, "x") for i in range(1500)]
    rows += [(5, "x" * 50_000, "x"), (6, " ", "x"), (7, "  ", "x"), (8, "a  b ", "x"), (9, " a", "x"), (9, " a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, radix string").repartition(3)
    made = align.align(df, c=align.Spill(batch_bytes=3000, frame=7))
    want, counts, most = _aligned([r[:2] for r in rows])
    assert sorted((tuple(r) for r in made.documents().collect()), key=KEY) == want
    assert {(r["b_id"], r["a_id"]): (r["n"], r["best"]) for r in made.pairs().collect()} == {p: (n, n == most[p[0]]) for p, n in counts.items()}
    empty = align.align(df.limit(0))
    assert empty.documents().count() == empty.pairs().count() == 0


def test_merge_of_runs():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(9):
        key = np.unique(rng.integers(0, 60, 40))
        n = rng.integers(1, 5, len(key))
        want.update(dict(zip(key.tolist(), n.tolist())))
        runs.append(align._framed([align._packed(key[i : i + 4], n[i : i + 4]) for i in range(0, len(key), 4)]))
    got = [(k, n, best) for keys, counts, marks in align.with_maxima(align.merged([*runs, b""]), 10) for k, n, best in zip(keys.tolist(), counts.tolist(), marks.tolist())]
    assert [k for k, _, _ in got] == sorted(want) and dict((k, n) for k, n, _ in got) == want
    assert all(best == (n == max(v for j, v in want.items() if j // 10 == k // 10)) for k, n, best in got)


def test_near_duplicates_of_a_bucket_that_stays_apart(spark, monkeypatch):
    """Long texts that share sketches but aren't similar make no rows of pairs; links between the blocks of a bucket are found."""
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(600)]
    texts = []
    for i in range(90):
        own = list(base)
        for k in rng.choice(600, 14, replace=False):
            own[k] = f"own{i}x{k}"
        texts.append(" ".join(own))
    texts += [t + " more" for t in texts[:20]]
    p, made = neardup.OrderMinHash(), []
    stage, append = neardup.stage, neardup.append
    monkeypatch.setattr(neardup, "stage", lambda df, name: (out := stage(df, name), name == "open-pairs" and made.append(out.count()))[0])
    monkeypatch.setattr(neardup, "append", lambda df, path, k: (out := append(df, path, k), made.append(out.count()))[0])
    monkeypatch.setattr(neardup, "BLOCK", 8, raising=False)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(rows, p=p).collect()}
    h = [neardup.kmers(t, p.k) for t in texts]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if neardup.aligned(h[i], h[j], p):
                want = {k: min(want[i], want[j]) if v in (want[i], want[j]) else v for k, v in want.items()}
    assert got == want and len(set(want.values())) == 90
    assert made[-1] < 2 * len(texts)

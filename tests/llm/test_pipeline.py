"""The pipeline on a small table, stage by stage, against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from urnspark.llm import mixing, neardup, packing, tokens

NAMES = ("doc", "id", "row", "n", "h", "own", "to", "at", "key", "label", "stratum", "cut", "_q", "_kept", "_lines", "_mix", "_key", "_at", "_new", "_n", "_p", "_source", "_ck", "_id", "topic", "tokens", "weight", "part", "before", "curve", "ids", "kind", "line", "pos", "x", "y", "text_", "class_id", "hid", "old", "new")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" if i % 7 else f"é{i}" for i in range(900)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    shared = text(60)
    out = []
    for d in range(60):
        lines = [text(int(rng.integers(20, 90))) for _ in range(int(rng.integers(1, 4)))]
        if d % 4 == 0:
            lines.insert(0, shared)
        out.append((d, "\n".join(lines), "fr" if d % 3 else "en", f"s{d % 5}"))
    base = out[10][1].split(" ")
    base[5] = "edited"
    out += [(100, " ".join(base), "en", "s0"), (101, out[11][1], "en", "s0"), (102, None, "en", None), (103, "", None, "s1"), (104, "few words", "en", "s1"), (105, "again and again " * 40, "en", "s2"), (106, text(3000), "fr", "s3")]
    return out


def quality(docs):
    kept = []
    for r in docs:
        w = words(r[1])
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(w) >= 50 and 100 * len(at) <= 50 * len(w):
            kept.append(r)
    return kept


def line_dedup(docs):
    seen, out = [], []
    for d, t, *rest in sorted(docs):
        keep = []
        for line in t.split("\n"):
            w = set(words(line))
            if not w or not any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen):
                keep.append(line)
            seen += [w] if w else []
        out.append((d, "\n".join(keep), *rest))
    return out


def near_dedup(docs):
    p = neardup.OrderMinHash()
    docs = sorted(docs)
    h = [neardup.kmers(r[1], p.k) for r in docs]
    label = list(range(len(docs)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] == docs[j][1] or (len(h[i]) and len(h[j]) and neardup.aligned(h[i], h[j], p)):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(docs) if find(i) == i]


def mix(docs, p=mixing.PIPELINE):
    topic = lambda n: "note" if n < 50 else "page" if n < 400 else "article" if n < 2000 else "book"
    cell = {r[0]: (r[3] or "", r[2] or "", topic(len(words(r[1])))) for r in docs}
    size = Counter()
    for r in docs:
        size[cell[r[0]]] += len(words(r[1]))
    size = {c: float(n) for c, n in size.items() if n}
    goals = []
    for m in range(3):
        by = defaultdict(float)
        for c, n in size.items():
            by[c[m]] += n
        total = sum(v**p.power for v in by.values())
        goals.append({v: n**p.power / total for v, n in by.items()})
    budget, w = p.keep * sum(size.values()), dict(size)
    for _ in range(p.rounds):
        for m in range(3):
            by = defaultdict(float)
            for c, v in w.items():
                by[c[m]] += v
            w = {c: v * goals[m][c[m]] / by[c[m]] for c, v in w.items()}
        w = {c: min(v * budget, size[c]) for c, v in w.items()}
    scale, full = 1.0, -1
    while True:
        held = {c for c in w if w[c] * scale >= size[c]}
        taken, rest = sum(size[c] for c in held), sum(w[c] for c in w if c not in held)
        if len(held) == full or not rest or budget <= taken:
            break
        full, scale = len(held), (budget - taken) / rest
    prob = {c: min(w[c] * scale, size[c]) / size[c] for c in w}
    u = lambda d: int(hashlib.md5(f"{p.seed}:{d}".encode()).hexdigest()[:12], 16) / float(1 << 48)
    return [r for r in docs if u(r[0]) < prob.get(cell[r[0]], 1.0)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    extra = ", ".join(f"`{n}` int" for n in NAMES)
    spark.createDataFrame([(*r, *([7] * len(NAMES))) for r in rows()], f"doc_id bigint, text string, lang string, source string, {extra}").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_each_stage_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs, want = spark.read.parquet(f"{sf}/documents.parquet"), rows()
    for k, ((name, stage), plain) in enumerate(zip(corpus_pipeline.STAGES[:4], (quality, line_dedup, near_dedup, mix))):
        want = plain(want)
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        got = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r[0], r[1]) for r in want), name
        assert all(r[n] == 7 for r in got for n in NAMES), name
    assert 0 < len(want) < len(rows()) - 5
    enc = tokens.encoder(tokens.vocabulary(tokens.BYTE_BPE))
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf).toPandas()
    assert pieces.groupby("doc_id")["length"].sum().to_dict() == {r[0]: len(enc(r[1])) + 1 for r in want}


def test_the_whole_run(spark, sf):
    want = mix(near_dedup(line_dedup(quality(rows()))))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {r[0] for r in want}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if "length" in out.columns else spark.createDataFrame([], out.schema)
    assert packing.pack(docs).count() == 0

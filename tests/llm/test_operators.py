"""The training-data operators on small tables: brute force, round trips, and nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from urnspark.llm import audio, chat, lines, mixing, neardup, packing, quality, scoring, secrets, store, tokens

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, h bigint, row int, n double"


def words(text):
    return re.findall(WORDS, text or "")


def some_docs():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    base = text(120)
    edited = base.split(" ")
    edited[60] = "changed"
    long = "\n".join(text(50) for _ in range(200))
    rows = [(1, base), (2, " ".join(edited)), (3, base), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"), (9, long), (10, text(80) + "\n" + text(5) + "\n" + base), (11, text(300)), (12, "a b c a b c a b c"), (13, "x it's  ok <|endoftext|> 12 Ωμέγα ́"), (11, "again " + text(60))]
    return [(d, t, None if d == 4 else "en", "s" if d % 2 else None, 0, "x", 1, 2, 0.5) for d, t in rows] + [(1, base, "en", "s", 0, "x", 1, 2, 0.5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = quality.judge(docs, labels, carry=("text",)).collect()
    assert len(out) == len(some_docs())
    for r in out:
        w, q = words(r["text"]), r["_q"]
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        at = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert (q["n_words"], q["word_chars"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(at))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(at) > 50 * len(w))
    assert quality.judge(none, labels.limit(0)).count() == 0


def test_cutoffs_need_the_bound(spark):
    """A cutoff is certified with enough good documents and none rejected, and not with few."""
    q = lambda s: f"named_struct('symbol_ratio', {s}D, 'repeat_ratio', 0D, 'dup_line_ratio', 0D, 'base_failed', false)"
    for n, want in ((5000, 0.2), (200, None)):
        good = spark.range(n).select(F.lit("en").alias("stratum"), F.lit(True).alias("good"), F.expr(q("0.0")).alias("_q"))
        bad = spark.range(20).select(F.lit("en").alias("stratum"), F.lit(False).alias("good"), F.expr(q("0.5")).alias("_q"))
        assert quality.cutoffs(good.union(bad), quality.RiskControl()).first()["symbol_ratio"] == want
    tail = spark.range(1).select(quality.binomial_tail(F.lit(3).cast("bigint"), F.lit(500).cast("bigint"), 0.02)).first()[0]
    from math import comb

    assert tail == pytest.approx(sum(comb(500, i) * 0.02**i * 0.98 ** (500 - i) for i in range(4)))


def test_lines(docs, none):
    rows = some_docs()
    seen, keep = [], {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda x: x[0]):
        for no, line in enumerate(t.split("\n")):
            if w := set(words(line)):
                seen.append((d, no, line, w))
    seen.sort(key=lambda x: (x[0], x[1]))
    for r in lines.dedup_lines(docs).collect():
        if r["text"] is None:
            assert r["doc_id"] == 4
            continue
        original = [t for d, t, *_ in rows if d == r["doc_id"] and t is not None]
        if r["doc_id"] == 11:
            continue  # an id with two texts: the docstring's case, below
        want = []
        for no, line in enumerate(original[0].split("\n")):
            w = set(words(line))
            earlier = [v for a, b, _, v in seen if (a, b) < (r["doc_id"], no)]
            if not w or not any(5 * len(w & v) >= 4 * len(w | v) for v in earlier):
                want.append(line)
        assert r["text"] == "\n".join(want)
        assert r["_lines"]["n_kept"] == sum(bool(words(x)) for x in want)
    assert lines.dedup_lines(none).count() == 0
    del keep


def test_near_duplicates(docs, none):
    got = {(r["doc_id"], r["ck"]): r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    by = {d: c for (d, _), c in got.items()}
    assert by[1] == by[2] == by[3] == 1
    assert by[4] == by[5] == 4 and by[6] == 6 and by[7] == by[8] == 7
    assert by[9] == 9 and by[12] == 12
    out = neardup.neardup_stage(None, docs, "").collect()
    assert sorted(r["doc_id"] for r in out) == [1, 4, 6, 7, 9, 10, 11, 12, 13]
    assert neardup.near_duplicates(none).count() == 0


def test_alignment_is_banded_and_exact():
    p = neardup.OrderMinHash()
    rng = np.random.default_rng(0)
    for _ in range(60):
        a = list(rng.integers(0, 30, rng.integers(5, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 4)):
            b[rng.integers(len(b))] = int(rng.integers(0, 30))
        x, y = (neardup.kmers(" ".join(map(str, s)), 5) for s in (a, b))
        dp = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                dp[i + 1, j + 1] = dp[i, j] + 1 if x[i] == y[j] else max(dp[i, j + 1], dp[i + 1, j])
        lcs = dp[-1, -1]
        assert neardup.aligned(x, y, p) == (5 * lcs >= 4 * (len(x) + len(y) - lcs))


@pytest.mark.parametrize("name", [tokens.BYTE_BPE, tokens.WORD_BPE])
def test_encoder_equals_library(name):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(name)
    mine, tok = tokens.encoder(path), Tokenizer.from_file(path)
    odd = ["", "a", "  a  b", "a \n b", "x\n\ny z ", "it's  ok <|endoftext|> hm", " lead", "tail ", "tab\t t", "'s 's", "áb é", "ΣΑΣ", "1234 56 7,8", "foo\x1cbar\xa0baz", "Ünïcode ß Straße"]
    for t in [*odd, *(r[1] or "" for r in some_docs())]:
        assert list(mine(t)) == tok.encode(t, add_special_tokens=False).ids


def test_hilbert_curve_steps_by_one():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1).max() == 1


def test_packing(docs, none):
    out = packing.pack(docs, length=64).toPandas()
    enc = tokens.encoder(tokens.vocabulary(tokens.BYTE_BPE))
    total = sum(len(enc(r[1] or "")) + 1 for r in some_docs())
    assert out["length"].sum() == total
    full = out.groupby("sequence_id")["length"].sum()
    assert (full.iloc[:-1] == 64).all() and len(full) == -(-total // 64)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
    ids = np.append(enc(some_docs()[8][1]), 1).astype("<u4")
    nine = out[out["doc_id"] == 9].sort_values("start")
    assert b"".join(nine["ids"]) == ids.tobytes() and nine["ids_crc32"].iloc[0] == zlib.crc32(nine["ids"].iloc[0])
    assert packing.pack(none).count() == 0


def test_store_round_trip(docs, none):
    kept = store.write_store(docs)
    enc = tokens.encoder(tokens.vocabulary(tokens.WORD_BPE))
    out = sorted(store.read_store(kept).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in out] == sorted(r[0] for r in some_docs())
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter(zlib.crc32(np.append(enc(r[1] or ""), 1).astype("<u4").tobytes()) for r in some_docs())
    assert Counter(r["ids_crc32"] for r in out) == want
    # Copies add no chunk of their own.
    body = kept.select(F.sum(F.length("payload"))).first()[0]
    assert body < 2 * sum(r["n_tokens"] for r in out)
    assert store.read_store(store.write_store(none)).count() == 0


def test_tampering_is_found(docs):
    kept = store.write_store(docs).withColumn("payload", F.when(F.col("id") == 9, F.concat(F.lit(b"\x00\x01"), F.expr("substring(payload, 3)"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="manifest"):
        store.read_store(kept).collect()


def test_class_ngrams(docs, none):
    rows = some_docs()
    low = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in words(t)] + [None]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for r in rows if not held(r[0]) for w in low(r[1]))
    n, v = sum(c.values()), len(c)
    out = scoring.score(docs).collect()
    want = Counter((r[0], len(low(r[1])), sum(c[w] > 0 for w in low(r[1])), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in low(r[1])), 6)) for r in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == want
    assert all(r["train_tokens"] == n and r["held_out"] == held(r["doc_id"]) and np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert scoring.score(none).count() == 0


def test_exchange_separates_two_languages():
    """Words that follow their own kind end in classes of their own kind."""
    rng = np.random.default_rng(1)
    seq = np.concatenate([rng.integers(0, 10, 4000) + 10 * (k % 2) for k in range(6)])
    k, cls = 4, np.arange(20) % 4
    for _ in range(6):
        ctx = np.zeros((20, 2 * k), dtype=np.int64)
        np.add.at(ctx, (seq[1:], cls[seq[:-1]]), 1)
        np.add.at(ctx, (seq[:-1], k + cls[seq[1:]]), 1)
        cls = scoring.exchange(ctx, cls, k, rng.random(20) < 0.5)
    assert not set(cls[:10]) & set(cls[10:])


def test_secrets(docs, none):
    import base64
    import gzip

    key = "AKIA" + "B" * 16
    once = base64.b64encode(b'password = "abcdef12"').decode()
    twice = base64.b64encode(gzip.compress(once.encode())).decode()
    for text, kind, at in (
        (f"x {key} y", "access", (2, 22)),
        ("see password%3Dabcdef1234 ok", "assign", (4, 25)),
        (f"x {once} y", "assign", (2, 2 + len(once))),
        (f"x {twice} y", "assign", (2, 2 + len(twice))),
        ("é tok\\u0065n = \\u0061bcdefgh", "assign", (2, 28)),
        ("0123456789abcdef01234567", "hex", (0, 24)),
    ):
        assert any(secrets.KINDS[k] == kind and (s, e) == at for s, k, e in secrets.scan(text)[1]), text
    assert secrets.scan("token: abc secret=12345 AKIA12 abcdef0")[1] == []
    assert secrets.scan("PASSWORD: 'hunter22'")[0] == [(0, 0, 19)]
    assert secrets.scan("paſſword=abcdefgh")[0] == []
    assert secrets.scan("%2525252541")[2] == 5
    assert secrets.scan_secrets(docs).count() == len(some_docs()) and secrets.scan_secrets(none).count() == 0


def test_mixing(spark, docs, none):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 300), ("b", "x", "t", 50), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens bigint")
    half = lambda u, v: spark.createDataFrame([(u, 1.0), (v, 1.0)], "value string, share double")
    out = mixing.rake(cells, mixing.Mix(rounds=12), {"source": half("a", "b"), "lang": half("x", "y")}).toPandas()
    assert out.groupby("source")["weight"].sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-6)
    assert out.groupby("lang")["weight"].sum().tolist() == pytest.approx([0.5, 0.5], abs=1e-3)
    got = mixing.sample(docs, p=mixing.Mix(rounds=2)).collect()
    assert len(got) == len(some_docs())
    assert all(r["_mix"]["n_tokens"] == len(words(r["text"])) and 0 <= r["_mix"]["probability"] <= 1 for r in got)
    assert max(r["_mix"]["probability"] for r in got if r["_mix"]["n_tokens"]) == pytest.approx(1.0)
    assert mixing.sample(none, p=mixing.Mix(rounds=1)).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "t", {"n": "12", "s": 'q"\n'}, ["b"]), (1, "b", 2, "t", {"n": "x", "z": "1"}, []), (1, "c", 3, "t", None, ["d"]), (1, "d", 4, "t", {"n": "1"}, ["c"]), (1, "a", 9, "t", {"n": "7"}, None), (2, "a", 0, "no", {}, ["gone"])],
        "conv_id bigint, call_id string, at bigint, name string, arguments map<string,string>, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, "a", 5, "ok"), (1, "b", 1, None), (3, "q", 1, "lost")], "conv_id bigint, call_id string, at bigint, content string")
    schemas = spark.createDataFrame([("t", [("n", "integer", True), ("s", "string", False)])], "name string, params array<struct<param:string,type:string,required:boolean>>")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(calls, results, schemas).collect()}
    a = got[1, "a"]
    assert a["json"] == '{"arguments":{"n":12,"s":"q\\"\\n"},"id":"a","name":"t","result":"ok"}' and (a["status"], a["level"], a["problems"]) == ("linked", 1, [])
    assert (got[1, "b"]["status"], got[1, "b"]["level"], got[1, "b"]["problems"]) == ("early", 0, ["type:n", "unexpected:z"])
    assert got[1, "c"]["level"] is None and got[1, "d"]["level"] is None and got[1, "c"]["problems"] == ["missing:n"]
    assert (got[2, "a"]["status"], got[2, "a"]["problems"], got[2, "a"]["level"]) == ("no_result", ["unknown_tool"], 0)
    assert got[3, "q"]["status"] == "no_call"
    assert chat.link_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_chroma(spark):
    rng = np.random.default_rng(5)
    t = np.arange(11025 * 12) / 11025
    notes = np.repeat(rng.choice([220, 262, 330, 392, 440, 523], 60), len(t) // 60)[: len(t)]
    tune = np.sin(2 * np.pi * np.cumsum(np.pad(notes, (0, len(t) - len(notes)), "edge")) / 11025)
    pcm = lambda x: (x * 20000).astype("<i2").tobytes()
    noisy = tune + 0.05 * rng.standard_normal(len(t))
    rows = [(0, pcm(tune)), (1, pcm(noisy)), (2, pcm(tune[1365 * 5 :])), (3, pcm(rng.standard_normal(len(t)) * 0.3)), (4, None), (5, pcm(tune)), (6, b"")]
    got = {(r["query_id"], r["class_id"]): r for r in audio.search(spark.createDataFrame(rows, "rec bigint, media binary"), "id = 0", id_col="rec", media_col="media").collect()}
    assert got[0, 0]["n_members"] == 2 and got[0, 0]["bit_error"] == 0
    assert got[0, 1]["offset"] == 0 and got[0, 2]["offset"] == -5
    assert (0, 3) not in got and (0, 4) not in got
    v = spark.createDataFrame([(0, None), (50, [0.1] * 64), (3, [0.1] * 64)], "vec_id bigint, embedding array<float>")
    assert audio.search(v, "id % 50 = 0", id_col="vec_id", media_col="embedding").count() >= 2


def test_chroma_finds_all_alignments(spark):
    """op10 on whole embeddings against all offsets of all pairs."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    code = {i: audio.fingerprint(audio.chroma_of_vector(v)).astype("<u4") for i, v in zip(table["vec_id"], table["embedding"], strict=True)}
    name = {}
    for i in sorted(code):
        name.setdefault(code[i].tobytes(), i)
    classes = {i: code[i] for i in name.values()}
    ids = np.array(list(classes))
    bits = np.unpackbits(np.stack(list(classes.values())).view(np.uint8), axis=1).reshape(len(ids), -1, 32)
    want, n = set(), bits.shape[1]
    for q in (i for i in code if i % 50 == 0):
        mine = np.unpackbits(code[q].view(np.uint8)).reshape(n, 32)
        for d in range(16 - n, n - 15):
            m = n - abs(d)
            s, t = max(0, -d), max(0, d)
            error = (mine[s : s + m] != bits[:, t : t + m]).mean(axis=(1, 2))
            want |= {(q, int(r)) for r in ids[error <= 0.15] if r != name[code[q].tobytes()]}
    got = {(r["query_id"], r["class_id"]) for r in audio.op10_chroma_search(spark, "/root/testdata/sf0.1").collect()}
    own = {(i, name[code[i].tobytes()]) for i in code if i % 50 == 0}
    assert len(want) > 20 and got == want | own


def test_chroma_alignment_without_a_shared_code(spark):
    """Four errors in every code, one in each byte: no three bytes agree anywhere."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 32, 40, dtype=np.int64)
    b = [int(x) ^ sum(1 << int(8 * k + rng.integers(8)) for k in range(4)) for x in a[10:]]
    rows = [("a", a.tolist()), ("b", b), ("c", rng.integers(0, 1 << 32, 40, dtype=np.int64).tolist())]
    t = spark.createDataFrame(rows, "fp string, codes array<bigint>")
    assert [(r["fp"], r["other"], r["offset"], r["votes"], r["bit_error"]) for r in audio.matches(t.where("fp = 'a'"), t).collect()] == [("a", "b", -10, 0, 0.125)]
    many = spark.createDataFrame([*rows, *((f"r{i}", rng.integers(0, 1 << 32, 40, dtype=np.int64).tolist()) for i in range(5000))], "fp string, codes array<bigint>")
    assert [(r["fp"], r["other"], r["offset"]) for r in audio.matches(many.where("fp = 'b'"), many).collect()] == [("b", "a", 10)]


def test_mixing_keeps_its_budget_beside_a_tiny_source(spark):
    """One document that is its own source doesn't set how much of the corpus is kept; full cells leave the excess to others."""
    rows = [(i, " ".join(["w"] * (60 + i % 7)), "fr" if i % 3 else "en", f"s{i % 4}") for i in range(2000)] + [(2000, " ".join(["w"] * 70), "en", "rare")]
    t = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    total = sum(len(r[1].split()) for r in rows)
    out = mixing.sample(t, p=mixing.PIPELINE).select("doc_id", "_mix.*").toPandas()
    assert out["probability"].between(0, 1).all()
    assert (out["probability"] * out["n_tokens"]).sum() == pytest.approx(mixing.PIPELINE.keep * total, rel=1e-6)
    kept = mixing.mix_stage(spark, t, "").select("text").collect()
    assert sum(len(r["text"].split()) for r in kept) == pytest.approx(mixing.PIPELINE.keep * total, rel=0.05)
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "x", "t", 300), ("c", "x", "t", 600)], "source string, lang string, topic string, tokens bigint")
    want = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "value string, share double")
    got = {r["source"]: r["weight"] for r in mixing.rake(cells, mixing.Mix(keep=0.6), {"source": want}).collect()}
    assert got == pytest.approx({"a": 100, "b": 250, "c": 250}, rel=1e-3)
    assert {r["weight"] for r in mixing.rake(cells, mixing.Mix(keep=1.0)).collect()} == {100.0, 300.0, 600.0}


def test_secrets_in_layers_that_are_not_plain():
    import base64
    import bz2
    import gzip
    from urllib.parse import quote, quote_plus

    find = b'password = "abcdef12"'
    rng = np.random.default_rng(2)
    noise = "".join(map(chr, rng.integers(97, 123, 600))).encode()
    b64 = lambda x: base64.b64encode(x).decode()
    wrapped = base64.encodebytes(gzip.compress(noise + find)).decode()
    deep = find
    for _ in range(20):
        deep = gzip.compress(deep)
    packed = gzip.compress(b" " + find)
    for name, text in {
        "no-break space": b64("prix\u00a0: ".encode() + find), "joiner": b64("\u200d".encode() + find), "byte order mark": b64("\ufeff".encode() + find),
        "NUL": b64(b"\0" + find), "Latin-1": b64(b"caf\xe9 " + find), "wrapped": wrapped, "wrapped with CRLF": wrapped.replace("\n", "\r\n"),
        **{f"prefix of {n}": "p" * (n - 1) + "/" + b64(find) for n in range(1, 6)}, **{f"packed, prefix of {n}": "p" * (n - 1) + "_" + b64(packed) for n in range(1, 6)},
        "members of gzip": b64(gzip.compress(b"first") + packed), "members of bzip2": b64(bz2.compress(b"first") + bz2.compress(find)), "twenty deep": b64(deep),
        "URL bytes": quote(packed), "form bytes": quote_plus(packed), "literal": repr(packed), "all escaped": "".join(f"\\x{c:02x}" for c in packed), "zlib": quote(zlib.compress(find)),
    }.items():
        text = "see: " + text + " . end"
        base, spans, _, full = secrets.scan(text)
        mine = [(s, e) for s, k, e in spans if k == 0]
        assert not base and mine and not full and all(4 <= s < e <= len(text) - 5 for s, e in mine), name
    most, secrets.MOST = secrets.MOST, 1000
    try:
        assert secrets.scan(b64(gzip.compress(b"x" * 5000)))[3]
    finally:
        secrets.MOST = most


def test_near_duplicates_of_few_words(spark):
    """8 against 9 words, and all pairs of short texts against brute force."""
    rng = np.random.default_rng(6)
    texts = []
    for g in range(60):
        a = [f"g{g}w{i}" for i in range(5 + g % 12)]
        texts += [" ".join(a), " ".join([*a, "more"]), " ".join(["before", *a]), " ".join([*a[:-1], "other"]), " ".join(rng.permutation(a))]
    p = neardup.OrderMinHash()
    h = [neardup.kmers(t, p.k) for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(h)) for j in range(i) if neardup.aligned(h[i], h[j], p)]
    for _ in range(5):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(t).collect()}
    assert {(len(h[i]), len(h[j])) for i, j in links} >= {(5, 4), (10, 9), (12, 11)}
    assert got == dict(enumerate(label)) and got[15] == got[16]
    for i, j in links:
        if min(len(h[i]), len(h[j])) < p.short:
            assert set(neardup.exact_keys(h[i], p)) & set(neardup.exact_keys(h[j], p))


def test_store_root_binds_ids_places_and_coding(docs):
    kept = store.write_store(docs)
    root = store.manifest(kept)
    assert store.read_store(kept, root).count() == kept.count()
    other = {9: 12, 12: 9}
    swapped = F.coalesce(*(F.when(F.col("id") == a, F.lit(b).cast(kept.schema["id"].dataType)) for a, b in other.items()), F.col("id"))
    for name, value in (("id", swapped), ("start", F.col("start") + 100), ("n_tokens", F.col("n_tokens") + 1), ("coding", F.lit("x:2"))):
        with pytest.raises(ValueError, match="manifest"):
            store.read_store(kept.withColumn(name, value), root)
    assert store.manifest(store.write_store(docs, end_id=2)) != root


def test_lines_beyond_two_to_the_23(spark):
    """Places keep their order, and give the line back, as far as an array goes."""
    ns = [0, 1, (1 << 23) - 1, 1 << 23, (1 << 31) - 2]
    df = spark.createDataFrame([(n,) for n in ns], "n int").select("n", lines._place(F.col("n"), F.lit("a line")).alias("at"))
    got = [tuple(r) for r in df.select("n", F.shiftright("at", 32).cast("int"), "at").collect()]
    assert all(a == b and at >= 0 for a, b, at in got) and [a for a, _, _ in sorted(got, key=lambda r: r[2])] == ns


def test_secrets_in_form_bodies_and_long_escapes():
    for text, at in (("x password+%3D+abcdef12 y", (2, 23)), (r"\U00000070assword=abcdef12", (0, 26)), (r"\u{70}assword=abcdef12", (0, 22)), (r"\u{000070}assword=abcdef12", (0, 26))):
        base, spans, _, _ = secrets.scan(text)
        assert not base and spans == [(at[0], 0, at[1])], text
    assert secrets.scan("password+=+abcdef12 50%41")[1] == []  # no escape in the run
    assert secrets.scan(r"\U00110000 \u{ffffffff} \u{d800}")[1] == []


def test_secrets_in_random_nestings_of_every_document(spark):
    """A secret under one to four random layers, planted at a random blank of every document: all are found, where they are."""
    import base64
    import bz2
    import gzip
    import lzma
    import zlib
    from urllib.parse import quote, quote_plus

    b64 = lambda x: base64.b64encode(x).decode()
    layers = [
        quote, quote_plus, lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: "".join(f"\\x{ord(c):02x}" for c in t), lambda t: "".join(f"\\U{ord(c):08x}" for c in t),
        lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t), lambda t: b64(t.encode()), lambda t: base64.urlsafe_b64encode(t.encode()).decode(), lambda t: base64.encodebytes(t.encode()).decode().strip(),
        *(lambda t, pack=pack: b64(pack(t.encode())) for pack in (gzip.compress, zlib.compress, bz2.compress, lzma.compress)), lambda t: quote(gzip.compress(t.encode())), lambda t: b64(gzip.compress(b"first") + gzip.compress(t.encode())),
    ]
    rng, missed, n = np.random.default_rng(7), [], 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect():
        find, plan = f"password = Zq{int(rng.integers(10**9)):09d}xk", [int(i) for i in rng.integers(len(layers), size=int(rng.integers(1, 5)))]
        for i in plan:
            find = layers[i](find)
        if len(find) > 200_000:
            continue
        text = r["text"] or ""
        places = [0, *(i for i, c in enumerate(text) if c == " ")]
        at = places[int(rng.integers(len(places)))]
        text = text[:at] + " " + find + " " + text[at:]
        n += 1
        if not any(k == 0 and at <= s < e <= at + 2 + len(find) for s, k, e in secrets.scan(text)[1]):
            missed.append((r["doc_id"], plan))
    assert n > 150 and not missed


def test_many_small_members():
    """A run of members costs what it holds, not its square."""
    import gzip
    from time import process_time

    one, began = gzip.compress(b"x"), process_time()
    data, used, cut = secrets._unpack(one * 100_000 + gzip.compress(b"token=abcdef12"), 1 << 26)
    assert data.endswith(b"token=abcdef12") and len(data) == 100_014 and not cut and used == len(one) * 100_000 + len(gzip.compress(b"token=abcdef12"))
    assert process_time() - began < 20
    assert secrets._unpack(gzip.compress(b"x" * 5000), 1000) == (b"x" * 1000, len(gzip.compress(b"x" * 5000)), True)


def test_memory_of_runs():
    """A new run of letters is made once and kept once; the older generation is still known, and no run is lost when it goes."""
    made = []
    m = tokens.Memory(lambda k: made.append(k) or k.encode(), 3)
    assert m.all(["a", "b", "a", "c", "d", "a", "e", "d"]) == [k.encode() for k in "abacdaed"]
    assert made == ["a", "b", "c", "d", "e"] and len(m) <= 3
    assert m.all(list("fghijab")) == [k.encode() for k in "fghijab"] and len(m) + len(m.old) <= 6
    enc = tokens.Encoder(tokens.vocabulary(tokens.WORD_BPE))
    text = "Some plain words, don't élan plain 42x words"
    assert enc(text).tolist() == enc(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert "plain" in enc.runs and not {"plain", "some", "élan"} & set(enc.words)
    assert {"words", "don", "'t", "4", "2", "x"} <= set(enc.words)


def test_line_table_is_made_without_a_shuffle_of_texts(spark, monkeypatch):
    """Only hashes and places travel to find the first of equal lines; the second reads of texts are sifted."""
    plans, real = {}, lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, name, **k: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), real(df, name, **k))[1])
    rows = [(d, f"common line of some words here\nown line {d} {' '.join(f'w{d}x{i}' for i in range(30))}") for d in (5, 2, 9)] + [(7, "tab\tand  blanks\r\n\x0b"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["_lines"]["n_kept"] for r in lines.dedup_lines(df).collect()}
    assert got == {2: 2, 5: 1, 9: 1, 7: 1, 1: 0}
    # What stands below the staging is the exchange that dealt out the rows here.
    assert plans["lines"].count("Exchange") == df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert "line#" not in plans["line-order"]

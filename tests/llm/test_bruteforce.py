"""Queries of whole tables against plain programs, and cases that their docstrings define."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from urnspark.llm import chat, lines, neardup, scoring, secrets

SF = "/root/testdata/sf0.01"


def test_secret_scan_of_all_documents(spark):
    """Counts and hash of the base spans of every document, from patterns written again."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    kinds = (
        ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII), lambda m: len(m[1]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    want = {}
    for d, t in zip(table["doc_id"], table["text"]):
        spans = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}", k) for i, (k, rx, ok) in enumerate(kinds) for m in rx.finditer(t or "") if ok(m))
        n = [sum(s[3] == k for s in spans) for k, *_ in kinds]
        want[d] = (*n, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.op3_secret_scan(spark, SF).collect()}
    assert got == want


def test_near_duplicates_of_all_documents(spark):
    """Classes by all pairs; and how many pairs of a given Jaccard similarity of their runs are in one class."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    p = neardup.OrderMinHash()
    first = {}
    for d, t in sorted(zip(table["doc_id"], table["text"])):
        first.setdefault(t or "", d)
    texts = sorted(first.items(), key=lambda x: x[1])
    h = [neardup.kmers(t, p.k) for t, _ in texts]
    sets = [set(x.tolist()) for x in h]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    found, total = 0, 0
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for at in where.values() if len(at) > 1 for k, a in enumerate(at) for b in at[k + 1 :]}
    links = []
    for a, b in pairs:
        if neardup.aligned(h[a], h[b], p):
            links.append((a, b))
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in neardup.op6_near_dedup(spark, SF).collect()}
    for a, b in pairs:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            total += 1
            found += got[texts[a][1]] == got[texts[b][1]]
    assert total == 0 or found / total >= 0.9
    assert {d: got[d] for _, d in texts} == {d: texts[find(i)][1] for i, (_, d) in enumerate(texts)}


def test_class_model_beats_word_frequencies_on_known_words(spark):
    """Held out texts: the model's score, with and without what it gives to unseen words, against the base."""
    out = scoring.op2_class_ngrams(spark, SF).toPandas()
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()
    assert held["known_score"].sum() > held["known_base"].sum()


def test_scores_are_those_of_the_classes(spark):
    """Every text's score from the transitions and emissions that the fit returns, in plain Python."""
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(rng.choice(vocab, int(rng.integers(1, 80)))) + (" new" + str(d) if d % 5 == 0 else "")) for d in range(120)] + [(500, None), (501, "  ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fit = scoring.fit(docs)
    rare = {bytes(r["word"]): (r["c"], r["cls"]) for r in fit.rare.collect()}
    word = {w: (int(c), int(k)) for w, c, k in zip(fit.common, fit.count, fit.cls)} | rare
    logs, size = fit.table, fit.size
    assert logs.sum(axis=1) == pytest.approx(np.ones(len(logs)))
    got = {r["doc_id"]: r["score"] for r in scoring.scored(fit).collect()}
    for d, t in rows:
        last, total = int(fit.cls[-1]), 0.0
        for w in [*(t or "").encode().lower().split(), scoring.END]:
            c, k = word.get(w, (0, -1))
            if c == 0:
                total += np.log10(fit.unseen)
            else:
                total += np.log10((1 - fit.unseen) * (fit.weight * logs[last, k] * c / size[k] + (1 - fit.weight) * c / fit.total))
            last = k if c else -1
        assert got[d] == pytest.approx(total, abs=1e-9), d


def test_hot_group_of_near_copies_of_a_line(spark):
    """Each copy has words of its own; all but the first go, and so do equal lines, whatever the order of rows."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(300):
        line = list(base)
        for k in range(3):
            line[int(rng.integers(60))] = f"own{d}x{k}"
        rows.append((d, " ".join(line) + "\n" + " ".join(rng.choice([f"v{i}" for i in range(3000)], 40))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = [(d, no, set(t.split())) for d, text in rows for no, t in enumerate(text.split("\n"))]
    want = {(d, no) for i, (d, no, w) in enumerate(sets) if not any(9 * len(w & v) >= 4 * (len(w) + len(v)) for _, _, v in sets[:i])}
    got = lines.dedup_lines(docs).collect()
    assert {r["doc_id"]: r["_lines"]["n_kept"] for r in got} == {d: sum((d, n) in want for n in (0, 1)) for d, _ in rows}
    assert sum(r["_lines"]["n_links"] for r in got) == len(sets) - len(want)


def test_calls_with_null_ids_stay_apart_and_places_are_topological(spark):
    calls = spark.createDataFrame(
        [(1, None, 0, "t", {"n": "1.0"}, None), (1, None, 1, "t", {"n": "1e0"}, None), (None, "a", 2, "t", {"n": "-0"}, None), (7, "a", 0, "t", {"n": "1e999"}, ["c"]), (7, "b", 1, "t", {}, ["a", "c"]), (7, "c", 2, "t", {}, []), (7, "d", 3, "t", {}, ["b", "x"]), (7, "e", 4, "t", {}, ["f", "a"]), (7, "f", 5, "t", {}, ["e"])]
        + [(8, f"k{i}", i, "t", {}, [f"k{i - 1}"]) for i in range(300)],
        "conv_id bigint, call_id string, at bigint, name string, arguments map<string,string>, depends_on array<string>",
    )
    results = spark.createDataFrame([(1, None, 5, "x"), (1, None, 6, "y")], "conv_id bigint, call_id string, at bigint, content string")
    kinds = "name string, params array<struct<param:string,type:string,required:boolean>>"
    schemas = spark.createDataFrame([("t", [("n", "number", False)]), ("t", [("z", "string", True)])], kinds)
    out = chat.link_calls(calls, results, schemas).collect()
    assert len(out) == calls.count() + results.count()
    seven = {r["call_id"]: (r["level"], r["place"]) for r in out if r["conv_id"] == 7}
    assert seven == {"c": (0, 0), "a": (1, 1), "b": (2, 2), "d": (3, 3), "e": (None, None), "f": (None, None)}
    assert {r["call_id"]: (r["level"], r["place"]) for r in out if r["conv_id"] == 8} == {f"k{i}": (i, i) for i in range(300)}
    numbers = {r["at"]: r["json"].split('"arguments":')[1].split(',"id"')[0] for r in out if r["call_id"] is None and r["at"] is not None}
    assert numbers == {0: '{"n":1}', 1: '{"n":1}'}
    assert next(r["json"] for r in out if r["conv_id"] is None).startswith('{"arguments":{"n":0}')
    assert next(r for r in out if r["conv_id"] == 7 and r["call_id"] == "a")["problems"] == ["type:n"]

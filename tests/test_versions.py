"""Merges by part, digests and provenance."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from urnspark.sources import versions

SCHEMA = "game string, draw_date date, main array<int>, payout double"
PART = "concat_ws('-', game, coalesce(string(year(draw_date)), 'undated'))"
KEY = ("game", "draw_date")


def draws(spark, rows):
    return spark.createDataFrame(rows, "game string, d string, main array<int>, payout double").select("game", F.to_date("d").alias("draw_date"), "main", "payout")


def test_merge_writes_only_touched_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    first = versions.merge(draws(spark, [("loto", "2020-01-01", [1, 2], 1.0), ("loto", "2021-01-01", [3], None), ("grand", None, [4], 2.0), ("loto", "2020-01-01", [1, 2], 1.0)]), path, KEY, PART)
    assert first.number == 1 and sorted(r["part"] for r in first.manifest) == ["grand-undated", "loto-2020", "loto-2021"]
    assert first.rows.count() == 3
    files = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    second = versions.merge(draws(spark, [("loto", "2021-01-01", [9], 5.0), ("loto", "2021-05-05", [7], 1.0), ("grand", None, [4], 2.0)]), path, KEY, PART)
    assert second.number == 2
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in files.items())
    folder = lambda v: {r["part"]: (r["folder"], r["digest"]) for r in v.manifest}
    a, b = folder(first), folder(second)
    assert a["loto-2020"] == b["loto-2020"]
    assert a["loto-2021"][0] != b["loto-2021"][0] and a["loto-2021"][1] != b["loto-2021"][1]
    # Rewritten with equal rows: other files, the same digest.
    assert a["grand-undated"][1] == b["grand-undated"][1]
    got = {(r["game"], str(r["draw_date"])): (r["main"], r["payout"]) for r in second.rows.collect()}
    assert got == {("loto", "2020-01-01"): ([1, 2], 1.0), ("loto", "2021-01-01"): ([9], 5.0), ("loto", "2021-05-05"): ([7], 1.0), ("grand", "None"): ([4], 2.0)}
    # The older version is still there, and an empty merge changes nothing but the number.
    assert versions.current(spark, path, 1).rows.count() == 3 and versions.current(spark, path, 1).digest == first.digest
    third = versions.merge(draws(spark, []), path, KEY, PART)
    assert (third.number, third.digest) == (3, second.digest) and second.digest != first.digest
    # A manifest without its mark isn't a version.
    (Path(path) / "manifest/v3/_SUCCESS").unlink()
    assert versions.current(spark, path).number == 2


def test_no_table(spark, tmp_path):
    v = versions.current(spark, str(tmp_path / "none"))
    assert (v.number, v.rows, v.digest) == (0, None, None)


def test_fingerprint(spark):
    """Order and partitions don't matter; values, nulls, repeats and counts do."""
    rows = [("loto", "2020-01-01", [1, 2], 1.0), ("loto", "2021-01-01", [3], None), ("loto", None, [], 2.0)]
    told = lambda r: versions.fingerprint(draws(spark, r).repartition(3)).first()
    one = told(rows)
    assert told(rows[::-1]) == one and one["n"] == 3
    others = [rows + rows[:1], rows[:2], [rows[0], ("loto", "2021-01-01", [3], 0.0), rows[2]], [("loto", "2020-01-01", [2, 1], 1.0), *rows[1:]]]
    assert len({told(r)["digest"] for r in others} | {one["digest"]}) == 5
    assert versions.fingerprint(draws(spark, [])).count() == 0
    s = versions.snapshot(draws(spark, rows)).first()
    assert (s["n"], s["first_date"], s["last_date"], s["digest"]) == (3, "2020-01-01", "2021-01-01", one["digest"])
    assert versions.snapshot(draws(spark, [])).first()["n"] == 0


def test_provenance(spark, tmp_path):
    for name, body in (("a.csv", b"x;y\n1;2\n"), ("b.csv", b"z"), ("empty.csv", b"")):
        (tmp_path / name).write_bytes(body)
    got = {Path(r["path"]).name: (r["size"], r["sha256"]) for r in versions.provenance(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (8, hashlib.sha256(b"x;y\n1;2\n").hexdigest()), "b.csv": (1, hashlib.sha256(b"z").hexdigest())}

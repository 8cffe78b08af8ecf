"""What operators leave on disk while they run."""

from __future__ import annotations

from pathlib import Path

import numpy as np

from urnspark.llm import scoring


def _shuffled(spark) -> set[str]:
    return {str(p) for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*") if p.is_file()}


def test_context_counts_leave_no_shuffle_files(spark):
    """op2 counts contexts once a round of exchange; a round's shuffle files don't outlive it."""
    ids = [np.array([0, 1, 0, 2], dtype=np.int32).tobytes(), np.array([1, 2], dtype=np.int32).tobytes()] * 3
    docs = spark.createDataFrame([(i,) for i in ids], "ids binary").repartition(3).localCheckpoint()
    before = _shuffled(spark)
    ctx = scoring._gather(spark, docs, np.array([0, 1, 2]), 3, 3)
    assert not _shuffled(spark) - before
    # Columns: classes before (0, 1, END), classes after; END stands before a text and has none after it.
    assert ctx.tolist() == [[0, 3, 3, 0, 3, 3], [3, 0, 3, 3, 0, 3], [3, 3, 0, 0, 0, 0]]

"""Tables in the folder that driver and executors share, deleted when the session's process ends."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where unset, a local one, for a local master only."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="urnspark-draws-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path, which is deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new path and read again: cuts the lineage, survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes what this process has staged, once the results that read it are written."""
    while _made:
        spark, path = _made.pop()
        sc = spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

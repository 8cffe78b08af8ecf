"""Tables in the folder that driver and executors share, and helpers of all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset, a local one, for a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="urnspark-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


#: Staged folders that are still there.
_staged: set[str] = set()


def stage(df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors.

    Spark deletes the shuffle files of the write when it ends.
    """
    spark = df.sparkSession
    path, schema, before = folder(spark, name), df.schema, spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A new path for tables that are appended to it and read together."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_leave, spark)
    _staged.add(path)
    return path


def append(df: DataFrame, path: str, k: int) -> DataFrame:
    """df written as part k of a folder, and that part read again."""
    df.write.option("compression", "zstd").parquet(f"{path}/k{k}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/k{k}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, paths) -> None:
    sc = spark.sparkContext
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        _staged.discard(path)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, [df._staged])


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this process has staged; call it once the results that read them are written."""
    _delete(spark, list(_staged))


def _leave(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        clear(spark)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed or on their path."""
    root = Path(__file__).resolve().parents[2]
    known = {os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(":")] if p}
    if str(root) in known or "site-packages" in str(root):
        return
    sc = spark.sparkContext
    if getattr(sc, "_urnspark_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="urnspark-zip-"), "urnspark")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "urnspark"))
    sc._urnspark_shipped = True
    sys.modules.setdefault("urnspark", sys.modules[__name__.split(".")[0]])


def words_of(text):
    """Column: the words of a text, between runs of blanks; none for null or blank text.

    Most texts have no blank but spaces and line feeds, and a plain split is twice as fast as one by a pattern.
    """
    t = F.coalesce(text, F.lit(""))
    odd = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\r")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\x0c"))
    return F.array_remove(F.when(odd, F.split(t, BLANK_RUN)).otherwise(F.split(t, " ")), "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

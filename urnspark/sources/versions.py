"""Tables in parts: a merge rewrites only the parts that new keys fall in, and an order-free digest tells any change."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "part string, folder string, n bigint, digest string"


def row_digest(columns: list[str]) -> Column:
    """A whole number of 60 bits from a row's canonical JSON: names in order, nulls written out."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, by: Column | None = None) -> DataFrame:
    """part, n, digest: of each part (all rows, without by) the rows and the sum of their digests, in whatever order they stand.

    Equal rows count as often as they come; a change of any value, a row more or a row less, changes it. Sums are combined
    before the shuffle. An empty table has no part.
    """
    part = F.lit("") if by is None else by
    out = df.select(part.alias("part"), row_digest(df.columns).alias("h")).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    return out.select("part", "n", F.sha2(F.concat_ws(":", "part", "n", F.col("h").cast("string")), 256).alias("digest"))


@dataclass(frozen=True)
class Version:
    """number: 0 where there is no table. rows: None then. manifest: part, folder, n, digest; a row per part."""

    number: int
    rows: DataFrame | None
    manifest: list

    @property
    def digest(self) -> str | None:
        """Of the whole table: over its parts' digests in order."""
        import hashlib

        return hashlib.sha256("\n".join(sorted(f"{r['part']}:{r['digest']}" for r in self.manifest)).encode()).hexdigest() if self.manifest else None


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The last whole version of the table at path, or the one of that number."""
    root, fs = _hadoop(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(int(x[1:]) for x in names if x[1:].isdigit() and fs.exists(_hadoop(spark, f"{path}/manifest/{x}/_SUCCESS")[0]))
    if number is not None:
        done = [d for d in done if d == number]
    if not done:
        return Version(0, None, [])
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{done[-1]}").collect()  # a row per part
    folders = [f"{path}/data/{r['folder']}" for r in manifest]
    rows = spark.read.parquet(*folders) if folders else None
    return Version(done[-1], rows, manifest)


def merge(new: DataFrame, path: str, key: tuple[str, ...], part: str) -> Version:
    """The table at path with new upserted by key, as a further version; returns it.

    part: SQL for a text of letters, digits and dashes that follows from the key, so that equal keys fall in one part. Only parts
    with new rows are read and written; the files of all others stay as they are, and so do older versions. Rows of new
    that repeat a key leave one of them. A version is whole once its manifest is marked; a lost job leaves files that no
    manifest names. An empty new makes a version with the same parts.
    """
    spark = new.sparkSession
    old = current(spark, path)
    new = new.select(*old.rows.columns) if old.rows is not None else new
    dealt = new.withColumn("_part", F.expr(part))
    touched = {r["_part"] for r in dealt.select("_part").distinct().collect()}  # parts
    read = [f"{path}/data/{r['folder']}" for r in old.manifest if r["part"] in touched]
    rows = dealt.withColumn("_seq", F.lit(1))
    if read:
        rows = spark.read.schema(old.rows.schema).parquet(*read).withColumn("_part", F.expr(part)).withColumn("_seq", F.lit(0)).unionByName(rows)
    best = Window.partitionBy(*key).orderBy(F.col("_seq").desc())
    rows = rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_seq")
    name = uuid.uuid4().hex
    if touched:
        rows.write.partitionBy("_part").parquet(f"{path}/data/{name}")
        made = spark.read.option("basePath", f"{path}/data/{name}").schema(f"{_ddl(new)}, _part string").parquet(f"{path}/data/{name}")
        told = fingerprint(made.drop("_part"), F.expr(part)).select("part", F.concat(F.lit(f"{name}/_part="), "part").alias("folder"), "n", "digest")
    else:
        told = spark.createDataFrame([], MANIFEST)
    kept = spark.createDataFrame([tuple(r) for r in old.manifest if r["part"] not in touched], MANIFEST)
    kept.unionByName(told).coalesce(1).write.parquet(f"{path}/manifest/v{old.number + 1}")
    return current(spark, path)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def provenance(spark: SparkSession, *paths: str) -> DataFrame:
    """path, size, sha256 of each file at the paths (files, folders or patterns); a file is hashed by one task, where it lies.

    Spark leaves empty files out.
    """
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def snapshot(draws: DataFrame) -> DataFrame:
    """n, first_date, last_date, digest of draws with a draw_date, in whatever order; one row, of an empty table too."""
    told = draws.agg(F.count(F.lit(1)).alias("n"), F.min("draw_date").cast("string").alias("first_date"), F.max("draw_date").cast("string").alias("last_date"))
    return told.join(F.broadcast(fingerprint(draws).select("digest")), F.lit(True), "left")  # one row each

"""Tables of parts (one for each key, such as a video) that are replaced whole, all of a commit or none of it.

A commit writes its rows under data/version=name and then a manifest,
manifests/n: for every key the version that holds its rows. Readers follow the highest manifest that
was written to its end, so until its last file is there a commit can't be
seen, and a stopped one leaves the table as it was. A key that a commit covers
but has no row for drops out of the manifest; those that it doesn't cover keep
their version. Of two that publish at once, and so under one number, the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.sources.sinks import is_written


def _numbers(spark: SparkSession, path: str) -> list[int]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(jvm_path)) if fs.exists(jvm_path) else []


def version(spark: SparkSession, path: str) -> int | None:
    """The last commit's number, None before the first."""
    return next((k for k in reversed(_numbers(spark, path)) if is_written(spark, f"{path}/manifests/{k}")), None)


def _manifest(spark: SparkSession, path: str, k: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifests/{k}")


def stage(df: DataFrame, path: str, key: str) -> str:
    """Writes a commit's rows and returns their version's name; nothing can be seen of it before ``publish``."""
    name = f"v{uuid.uuid4().hex}"
    df.filter(F.col(key).isNotNull()).write.parquet(f"{path}/data/version={name}")
    return name


def publish(spark: SparkSession, path: str, key: str, name: str, covered: DataFrame | None = None) -> int:
    """Makes staged rows part of the table's state and returns the commit's number. covered: the keys (column ``key``) that it replaces besides those it has rows of."""
    own = spark.read.parquet(f"{path}/data/version={name}").select(key).distinct()
    last = version(spark, path)
    k = max([-1, *_numbers(spark, path)]) + 1
    entries = own.withColumn("version", F.lit(name))
    if last is not None:
        gone = own if covered is None else own.union(covered.select(key)).distinct()
        entries = entries.union(_manifest(spark, path, last).select(key, "version").join(gone, key, "left_anti"))
    entries.write.mode("error").parquet(f"{path}/manifests/{k}")
    return k


def replace(df: DataFrame, path: str, key: str, covered: DataFrame | None = None) -> int:
    """Replaces the rows of df's keys, and clears those of covered that df has no row for, in one commit; rows without key are left out."""
    return publish(df.sparkSession, path, key, stage(df, path, key), covered)


def read(spark: SparkSession, path: str, key: str, at: int | None = None) -> DataFrame:
    """The table's rows, as of the last commit or of commit ``at``."""
    k = version(spark, path) if at is None else at
    if k is None:
        raise FileNotFoundError(f"{path} has no commit")
    manifest = _manifest(spark, path, k)
    live = [r[0] for r in manifest.select("version").distinct().collect()]  # a row for each commit still in use
    if not live:  # all keys are cleared: the columns are those of any version
        return spark.read.parquet(f"{path}/data").limit(0).drop("version")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}" for v in live])
    return rows.join(manifest.withColumnRenamed("version", "_version").withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (F.col("version") == F.col("_version")), "left_semi").drop("version")


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the data that the last manifest doesn't use, those of stopped commits among them, and older manifests; the versions' names.

    Not while another commit is being written. Where no key is left the last version stays, for its columns.
    """
    last = version(spark, path)
    used = {r[0] for r in _manifest(spark, path, last).select("version").distinct().collect()} if last is not None else set()
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = sorted(s.getPath().getName().split("=")[1] for s in fs.listStatus(root)) if fs.exists(root) else []
    gone = [name for name in there if name not in (used or there[-1:])]
    for name in [f"data/version={name}" for name in gone] + [f"manifests/{k}" for k in _numbers(spark, path) if k != last]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone

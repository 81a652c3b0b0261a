"""Folders that all executors share, and small files written by tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, or under a temporary folder where that is unset on one machine, as in tests; a cluster must set it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = _fallback.setdefault("dir", "") or _fallback.update(dir=tempfile.mkdtemp(prefix="kithline-")) or _fallback["dir"]
    return f"{known.rstrip('/')}/kithline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under a new shared path and read from there, which cuts its lineage; the files stay."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without means the cluster's default file system, as it does to Spark's readers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_files(files: DataFrame, path: str, suffix: str = "") -> int:
    """Writes each row's ``content`` to path/``file_name``suffix and returns their number.

    file_name may hold folders. Tasks write under a name of their own and
    rename, so a repeated task replaces a file by an equal one. Rows without a
    name are left out; null content is an empty file; of rows of one name that
    with the least content (null: none of it) counts.
    """
    spark = files.sparkSession
    root = qualified(spark, path)
    fs, inner = pfs.FileSystem.from_uri(root)
    fs.create_dir(inner, recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = pfs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                target = f"{inner}/{name}{suffix}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                own = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(own) as f:
                    f.write((content or "").encode())
                fs.move(own, target)
            yield pd.DataFrame({"n": [len(batch)]})

    named = files.filter("file_name is not null").groupBy("file_name").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    rows = named.mapInPandas(put, "n long")
    return rows.groupBy().sum("n").first()[0] or 0

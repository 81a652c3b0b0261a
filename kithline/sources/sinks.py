"""Writers: upserts, partitioned results, run records and metrics."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.params import Params
from kithline.sources.shared import write_files


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """existing with rows of incoming in place of those of equal key; of incoming rows of one key the last by ``order`` counts, of equally late ones that whose columns have the greatest hash.

    Incoming rows without a key are left out; existing ones stay.
    """
    keyless = existing.filter(F.col(key).isNull())
    ranked = existing.select("*", F.lit(0).alias("_new")).unionByName(incoming.select("*", F.lit(1).alias("_new")), allowMissingColumns=True).filter(F.col(key).isNotNull())
    last = [F.desc("_new"), *([F.desc(order)] if order else []), F.xxhash64(*[F.col(f"`{c}`") for c in incoming.columns]).desc()]
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*last))).filter("_n = 1").drop("_n", "_new").unionByName(keyless, allowMissingColumns=True)


def insert_missing(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """existing and those rows of seed whose key it lacks, one for each key."""
    return existing.unionByName(seed.join(existing.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def write_videos(df: DataFrame, path: str, partition: str = "video_id") -> None:
    """Replaces the partitions that df holds and leaves the others, so that a repeated run changes nothing."""
    df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written path to its end."""
    return _exists(spark, f"{path}/_SUCCESS")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet rows under path, none if nothing was written there."""
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label contents (file_name, content) as one text file each, path/file_name.txt."""
    write_files(lines, path, ".txt")


def write_sorted(df: DataFrame, path: str, keys: list[str]) -> None:
    """df in order of keys: the files follow one another by name, and rows within each; no task orders the whole."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def order_report(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """n_rows, inversions (neighbouring rows of a file out of order) and overlaps (files that begin before the one before ends) of sorted files."""
    key = F.struct(*keys)
    rows = spark.read.parquet(path).select(key.alias("k"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    before = F.lag("k").over(Window.partitionBy("file").orderBy("place"))
    by_file = rows.withColumn("wrong", F.coalesce((F.col("k") < before).cast("long"), F.lit(0))).groupBy("file").agg(F.count("*").alias("n"), F.sum("wrong").alias("wrong"), F.min("k").alias("least"), F.max("k").alias("most"))
    ahead = F.lag("most").over(Window.orderBy("file"))  # a row for each file
    marked = by_file.withColumn("overlap", F.coalesce((F.col("least") < ahead).cast("long"), F.lit(0)))
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("inversions"), F.coalesce(F.sum("overlap"), F.lit(0)).alias("overlaps"))


def save_trials(trials: DataFrame, path: str) -> None:
    """Results of trials (trial, macro_f1, micro_f1, ...): all and the best as JSON, and a summary as CSV, in folders of path.

    The best has the greatest macro_f1, of equals the greatest micro_f1, then
    the smallest trial.
    """
    trials.write.mode("overwrite").json(f"{path}/all")
    trials.orderBy(F.desc("macro_f1"), F.desc("micro_f1"), "trial").limit(1).write.mode("overwrite").json(f"{path}/best")
    write_csv(trials, f"{path}/summary")


def run_record(spark: SparkSession, run_id: str, p: Params) -> DataFrame:
    """One row: run_id and all parameters as JSON."""
    return spark.createDataFrame([(run_id, json.dumps(asdict(p), sort_keys=True))], "run_id string, params string")


def metric_rows(df: DataFrame, scope: str, metrics: list[str]) -> DataFrame:
    """scope, metric, value: one row for each metric of each row."""
    return df.select(F.col(scope).cast("string").alias("scope"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("scope", "m.*")


def mark_processed(done: DataFrame, path: str) -> None:
    """Adds names to the list of processed videos."""
    done.select("name").distinct().write.mode("append").text(path)

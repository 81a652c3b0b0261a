"""Where models plug in: batches of rows in, detections out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.sources import sinks


def detect(frames: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, step: int = 10) -> DataFrame:
    """Every step-th frame through a model that load() makes once for each task; the model maps batches of rows to rows of schema."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return frames.filter(F.col("frame") % step == 0).mapInPandas(run, schema)


def insert_detections(batch: DataFrame, batch_id: int, path: str, ids: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, step: int = 10) -> None:
    """The first half of a detector's step over a micro-batch of frames (video_name, frame, ...): what the model finds, under path/detections/batch=batch_id.

    Names are looked up in ids (video_name, video_id, of a repeated name the
    least id counts); frames of names that aren't there, or null, go to
    path/unknown. Videos that an earlier batch has logged are left out. A
    batch that runs again replaces what it wrote.
    """
    spark = batch.sparkSession
    known = ids.filter("video_name is not null").groupBy("video_name").agg(F.min("video_id").alias("video_id"))
    done = sinks.read_or_empty(spark, f"{path}/log", "video_name string, batch long").filter(F.col("batch") < batch_id)
    todo = batch.join(done.select("video_name"), "video_name", "left_anti").join(known, "video_name", "left")
    todo.filter("video_id is null").drop("video_id").write.mode("overwrite").parquet(f"{path}/unknown/batch={batch_id}")
    detect(todo.filter("video_id is not null"), load, schema, step).write.mode("overwrite").parquet(f"{path}/detections/batch={batch_id}")


def log_videos(batch: DataFrame, batch_id: int, path: str) -> None:
    """The second half: names of the batch's videos in path/log, which makes its detections count."""
    batch.filter("video_name is not null").select("video_name").distinct().write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")


def detect_stream(stream: DataFrame, path: str, ids: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, step: int = 10) -> None:
    """Runs a detector over all that a stream of frames holds, from where path/state stands; a video's frames must come in one batch, such as one file.

    Each detection counts once, wherever a run was stopped: both halves write
    under the batch's number, and only logged batches are read.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        insert_detections(batch, batch_id, path, ids, load, schema, step)
        log_videos(batch, batch_id, path)

    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def detections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What logged batches have found."""
    rows = sinks.read_or_empty(spark, f"{path}/detections", f"{schema}, batch long")
    logged = sinks.read_or_empty(spark, f"{path}/log", "video_name string, batch long").select("batch").distinct()
    return rows.join(logged, "batch", "left_semi").drop("batch")


def padded_sequences(frames: DataFrame, feature: str, label: str, length: int, pad: int = -100) -> DataFrame:
    """video_id, sequence, features and labels: runs of ``length`` frames in order, the last one padded (zeros, pad) with its true size."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame")) - 1
    rows = frames.withColumn("sequence", F.floor(place / length))
    own = rows.groupBy("video_id", "sequence").agg(F.array_sort(F.collect_list(F.struct("frame", F.col(feature).alias("f"), F.col(label).alias("y")))).alias("s"))
    size = F.size("s")
    features = F.concat(F.transform("s", lambda x: x["f"]), F.array_repeat(F.transform(F.get(F.col("s"), F.lit(0))["f"], lambda v: v * 0), F.lit(length) - size))
    labels = F.concat(F.transform("s", lambda x: x["y"].cast("int")), F.array_repeat(F.lit(pad), F.lit(length) - size))
    return own.select("video_id", "sequence", size.alias("size"), features.alias("features"), labels.alias("labels"))

"""The domain's tables, built from the star schema's tables by fixed rules.

A user is a video, an event an observation. Time is cut into cells of three
hours, one analysed frame each, so one second of the domain is three cells.
click, view and error are speech of the child, to the child and overheard;
purchase is a face, signup a person; every third of both also carries a book
that encloses the box, the next third one that is shifted off it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video_id, event_type, value, frame; one row for each event."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    return read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), "event_type", "value", (F.floor(seconds / 10800) * 10).cast("long").alias("frame"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, video_name, child_id, age_at_recording, max_frame."""
    child = F.col("video_id") % 40
    return (
        events(spark, sf_dir)
        .groupBy("video_id")
        .agg(F.max("frame").alias("max_frame"))
        .select("video_id", F.concat(F.lit("cam_id"), F.lpad(child.cast("string"), 6, "0"), F.lit("_v"), F.col("video_id").cast("string")).alias("video_name"), F.lpad(child.cast("string"), 6, "0").alias("child_id"), ((child * 3 + 36) / 12).alias("age_at_recording"), "max_frame")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind (face, person), detection_id, video_id, frame, conf, x1..y2, age_class."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup"))
    x, y = (F.col("event_id") * 37 % 1800).cast("double"), (F.col("event_id") * 53 % 900).cast("double")
    w, h = 10 + F.col("event_id") * 7 % 400, 10 + F.col("event_id") * 11 % 380
    return e.select(F.when(F.col("event_type") == "purchase", "face").otherwise("person").alias("kind"), F.col("event_id").alias("detection_id"), "video_id", "frame", F.least(F.col("value") / 100, F.lit(1.0)).alias("conf"), x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), (F.col("event_id") % 2).cast("int").alias("age_class"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, x1..y2 of books."""
    d, k = detections(spark, sf_dir), F.col("detection_id") % 3
    by = F.when(k == 0, 0.0).otherwise(30.0)
    return d.filter(k < 2).select("video_id", "frame", (F.col("x1") + by).alias("x1"), (F.col("y1") + by).alias("y1"), (F.col("x2") + by).alias("x2"), (F.col("y2") + by).alias("y2"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, has_kchi, has_cds, has_ohs; one row for each snippet and frame."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view", "error"))
    return e.select("video_id", "frame", *[(F.col("event_type") == t).cast("int").alias(n) for t, n in (("click", "has_kchi"), ("view", "has_cds"), ("error", "has_ohs"))])


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id (conversation), start, end (seconds), speaker KCHI, KCDS or OHS; from conversations."""
    speaker = F.when(F.col("role") == "user", "KCHI").when(F.col("role") == "assistant", "KCDS").otherwise("OHS")
    start = (F.col("turn") * 5).cast("double")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", start.alias("start"), (start + F.length("text") % 12 + 1).alias("end"), speaker.alias("speaker"))


def chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, interaction_type, start, end (seconds): three stretches of each conversation."""
    last = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg((F.max("turn") * 5 + 9).cast("double").alias("last"))
    cut = [("Interacting", 0.0, 8.0), ("Available", 8.0, 17.0), ("Interacting", 17.0, None)]
    parts = F.array(*[F.struct(F.lit(n).alias("interaction_type"), F.lit(a).alias("start"), (F.lit(b) if b else F.col("last")).alias("end")) for n, a, b in cut])
    return last.select("video_id", F.explode(parts).alias("s")).select("video_id", "s.*").filter("`end` > start")


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, second, a, b: two raters' labels from documents' labels, ten documents a video."""
    def named(c: str):
        return F.when(F.col(c) == 1, "interacting").otherwise("alone")

    return read(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 100).alias("video_id"), (F.col("doc_id") % 100).alias("second"), named("quality").alias("a"), F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(named("toxic")).alias("b"))

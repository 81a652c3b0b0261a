"""Observations aggregated for each video and frame and joined onto the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.scalars import proximity
from kithline.params import Params

KEY = ["video_id", "frame"]


def sampled(df: DataFrame, p: Params) -> DataFrame:
    return df.filter(F.col("frame") % p.step == 0)


def contains(outer: str, inner: str) -> Column:
    """Whether one aliased table's box holds the other's, borders included."""
    o, i = (lambda c: F.col(f"{outer}.{c}")), (lambda c: F.col(f"{inner}.{c}"))
    return (i("x1") >= o("x1")) & (i("y1") >= o("y1")) & (i("x2") <= o("x2")) & (i("y2") <= o("y2"))


def inside_books(detections: DataFrame, books: DataFrame) -> DataFrame:
    """Detections that lie within a book of their frame, with the book's box."""
    d, b = detections.alias("d"), books.alias("b")
    return d.join(b, (F.col("d.video_id") == F.col("b.video_id")) & (F.col("d.frame") == F.col("b.frame")) & contains("b", "d")).select("d.*", *[F.col(f"b.{c}").alias(f"book_{c}") for c in ("x1", "y1", "x2", "y2")])


def outside_books(detections: DataFrame, books: DataFrame) -> DataFrame:
    """Detections that lie within no book of their frame: pictures of people aren't people. One anti join with the containment as residual."""
    d, b = detections.alias("d"), books.alias("b")
    return d.join(b, (F.col("d.video_id") == F.col("b.video_id")) & (F.col("d.frame") == F.col("b.frame")) & contains("b", "d"), "left_anti")


def faces(detections: DataFrame) -> DataFrame:
    """Face detections with their proximity; those of unknown age class are dropped."""
    near = proximity(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("age_class"))
    return detections.filter("kind = 'face'").withColumn("proximity", near).filter("proximity is not null")


def hull(detections: DataFrame) -> DataFrame:
    """The box around all detections of a frame, books and sampling disregarded."""
    return detections.groupBy(*KEY).agg(F.min("x1").alias("last_x1"), F.min("y1").alias("last_y1"), F.max("x2").alias("last_x2"), F.max("y2").alias("last_y2"))


def speech(audio: DataFrame) -> DataFrame:
    """One row for each frame: overlapping snippets don't multiply it."""
    return audio.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("has_kchi", "has_cds", "has_ohs")])


def integrate(grid: DataFrame, detections: DataFrame, books: DataFrame, audio: DataFrame, p: Params) -> DataFrame:
    """The grid with every observation: absent ones are 0 (boxes -1), a missing proximity stays null.

    Faces and persons that no book encloses are aggregated together, and all
    joins share one key, so each side is exchanged once.
    """
    is_face = (F.col("kind") == "face") & F.col("proximity").isNotNull()
    near = proximity(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("age_class"))
    kept = sampled(outside_books(detections, sampled(books, p)), p).withColumn("proximity", near)
    seen = kept.groupBy(*KEY).agg(F.max(F.when(is_face, F.col("proximity"))).alias("proximity"), F.max(F.when(is_face, F.col("conf"))).alias("face_conf"), F.max(F.when(F.col("kind") == "person", F.col("conf"))).alias("person_conf"))
    book = sampled(books, p).select(*KEY).distinct().withColumn("has_book", F.lit(1))
    joined = grid
    for side in (seen, book, hull(detections), speech(audio)):
        joined = joined.join(side, KEY, "left")
    filled = {**{c: 0 for c in ("has_kchi", "has_cds", "has_ohs", "has_book")}, **{c: 0.0 for c in ("person_conf", "face_conf")}, **{c: -1.0 for c in ("last_x1", "last_y1", "last_x2", "last_y2")}}
    return joined.fillna(filled).withColumn("presence_conf", F.greatest("person_conf", "face_conf"))

"""The dense time grid and speech snippets laid onto it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.params import Params


def dense_grid(videos: DataFrame, p: Params) -> DataFrame:
    """video_id and every analysed frame 0, step, ... up to max_frame; frame 0 exists even if that is null or negative."""
    last = F.greatest(F.coalesce("max_frame", F.lit(0)).cast("long"), F.lit(0).cast("long"))
    return videos.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(p.step).cast("long"))).alias("frame"))


def snippet_frames(start: Column, end: Column, p: Params) -> Column:
    """The analysed frames of a snippet in seconds, its end exclusive; none if it hits no analysed frame."""
    first = F.ceil(F.floor(start * p.fps) / p.step) * p.step
    last = F.ceil(end * p.fps) - 1
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(p.step).cast("long"))).otherwise(F.array().cast("array<long>"))


def snippets_to_frames(snippets: DataFrame, p: Params) -> DataFrame:
    """video_id, frame and has_kchi, has_cds, has_ohs for each snippet (start, end, speaker) and analysed frame."""
    flags = [(F.col("speaker") == s).cast("int").alias(n) for s, n in (("KCHI", "has_kchi"), ("KCDS", "has_cds"), ("OHS", "has_ohs"))]
    return snippets.select("video_id", F.explode(snippet_frames(F.col("start"), F.col("end"), p)).alias("frame"), *flags)

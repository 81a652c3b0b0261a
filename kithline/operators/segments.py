"""Frames into segments: runs, shortest lengths, merging and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.scalars import lookup, state_name
from kithline.params import STATE_NAMES, Params

COLUMNS = ["video_id", "interaction_type", "segment_start", "segment_end", "start_sec", "end_sec"]


def _by_start() -> Window:
    return Window.partitionBy("video_id").orderBy("segment_start", "segment_end")


def _numbered(df: DataFrame, changed: Column, w: Window) -> DataFrame:
    return df.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))


def runs(frames: DataFrame, p: Params, state: str = "state") -> DataFrame:
    """Maximal runs of one state over a video's frames that are long enough for their state."""
    w = Window.partitionBy("video_id").orderBy("frame")
    changed = F.when(F.col(state) == F.lag(state).over(w), 0).otherwise(1)
    found = _numbered(frames.select("video_id", "frame", state), changed, w).groupBy("video_id", "run").agg(F.first(state).alias("s"), F.min("frame").alias("segment_start"), F.max("frame").alias("segment_end"))
    named = found.withColumn("interaction_type", state_name("s"))
    least = F.coalesce(lookup(F.col("interaction_type"), {n: float(p.least_frames(n)) for n in STATE_NAMES.values()}), F.lit(float(p.least_frames("Alone"))))
    return named.filter(F.col("segment_end") - F.col("segment_start") >= least).withColumns({"start_sec": F.col("segment_start") / p.fps, "end_sec": F.col("segment_end") / p.fps}).select(*COLUMNS)


def coalesce_runs(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of one type as one, whatever lies between; the end is the last one's."""
    w = _by_start()
    changed = F.when(F.col("interaction_type") == F.lag("interaction_type").over(w), 0).otherwise(1)
    last = F.struct("segment_start", "segment_end")
    merged = _numbered(segments, changed, w).groupBy("video_id", "run").agg(F.first("interaction_type").alias("interaction_type"), F.min("segment_start").alias("segment_start"), F.max_by("segment_end", last).alias("segment_end"), F.min("start_sec").alias("start_sec"), F.max_by("end_sec", last).alias("end_sec"))
    return merged.select(*COLUMNS)


def fill_gaps(segments: DataFrame, p: Params, default: str = "Alone") -> DataFrame:
    """Gaps of up to gap_stretch_sec lengthen the segment before; longer ones become segments of the default type."""
    w = _by_start()
    following = segments.withColumns({"next_frame": F.lead("segment_start").over(w), "next_sec": F.lead("start_sec").over(w)})
    gap = F.col("next_sec") - F.col("end_sec")
    small, large = (gap > 0) & (gap <= p.gap_stretch_sec), gap > p.gap_stretch_sec

    def part(kind: Column, a: Column, b: Column, s: Column, e: Column) -> Column:
        return F.struct(kind.alias("interaction_type"), a.alias("segment_start"), b.alias("segment_end"), s.alias("start_sec"), e.alias("end_sec"))

    before_next = F.col("next_frame") - 1
    own = part(F.col("interaction_type"), F.col("segment_start"), F.when(small, before_next).otherwise(F.col("segment_end")), F.col("start_sec"), F.when(small, F.col("next_sec")).otherwise(F.col("end_sec")))
    filler = part(F.lit(default), F.col("segment_end") + 1, before_next, F.col("end_sec"), F.col("next_sec"))
    parts = F.when(F.coalesce(large, F.lit(False)), F.array(own, filler)).otherwise(F.array(own))
    return following.select("video_id", F.explode(parts).alias("s")).select("video_id", "s.*").select(*COLUMNS)


def segment(frames: DataFrame, p: Params, state: str = "state") -> DataFrame:
    """Clean segments of classified frames, with duration_sec. All steps share the exchange by video."""
    found = coalesce_runs(fill_gaps(coalesce_runs(runs(frames, p, state)), p))
    return found.withColumn("duration_sec", F.col("end_sec") - F.col("start_sec"))


def segment_summary(segments: DataFrame) -> DataFrame:
    """For each type: number, minutes and share of all minutes."""
    found = segments.groupBy("interaction_type").agg(F.count("*").alias("n_segments"), (F.sum("duration_sec") / 60).alias("minutes"))
    return found.withColumn("percent", F.col("minutes") * 100 / F.sum("minutes").over(Window.partitionBy()))  # a row for each type


def state_shares(frames: DataFrame) -> DataFrame:
    """Frames of each state in each video and their share."""
    found = frames.groupBy("video_id", "state").agg(F.count("*").alias("n_frames"))
    return found.select("video_id", state_name("state").alias("state"), "n_frames", (F.col("n_frames") / F.sum("n_frames").over(Window.partitionBy("video_id"))).alias("share"))


def with_subjects(segments: DataFrame, subjects: DataFrame) -> DataFrame:
    """Segments with child_id, age_at_recording and video_name; one row of subjects for each video counts."""
    once = subjects.groupBy("video_id").agg(*[F.min(c).alias(c) for c in ("video_name", "child_id", "age_at_recording")])
    return segments.join(once, "video_id", "left")

"""Interval joins, union lengths and speech exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.params import Params


def _level(span: tuple[str, str], unit: float) -> Column:
    """The level of a span: cells of unit * 2 ** level are no shorter than it."""
    length = (F.col(f"`{span[1]}`") - F.col(f"`{span[0]}`")) / unit
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1.0)))), F.lit(0)).cast("int")


def _cells(levels: Column, span: tuple[str, str], unit: float) -> Column:
    """(level, cell) of the cells that a span touches on each of levels, two or so on each that is no lower than its own."""
    lo, hi = F.col(f"`{span[0]}`"), F.col(f"`{span[1]}`")

    def of(level: Column) -> Column:
        width = F.pow(F.lit(2.0), level) * unit
        return F.transform(F.sequence(F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long")), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    return F.flatten(F.transform(levels, of))


def filed(df: DataFrame, span: tuple[str, str], other_levels: DataFrame, unit: float) -> DataFrame:
    """df with ``_own`` (its level), ``_level`` and ``_cell``: a row for each cell of its own level and of those of other_levels (one row: ``levels``) above it that it touches.

    However long a span is, that is two or so for each level, of which there
    are as many as doublings from the shortest to the longest span. Spans that
    end before they start, or have a null end, are left out.
    """
    own = df.filter(F.col(f"`{span[1]}`") >= F.col(f"`{span[0]}`")).withColumn("_own", _level(span, unit))
    above = own.crossJoin(F.broadcast(other_levels)).withColumn("levels", F.concat(F.array("_own"), F.filter("levels", lambda x: x > F.col("_own"))))  # one row
    return above.withColumn("_at", F.explode(_cells(F.col("levels"), span, unit))).select(*df.columns, "_own", F.col("_at.level").alias("_level"), F.col("_at.cell").alias("_cell"))


def _levels(df: DataFrame, span: tuple[str, str], unit: float) -> DataFrame:
    """One row: the levels that occur, a few dozen at most."""
    return df.filter(F.col(f"`{span[1]}`") >= F.col(f"`{span[0]}`")).agg(F.collect_set(_level(span, unit)).alias("levels"))


def overlap_join(a: DataFrame, b: DataFrame, key: str, bin_width: float, *, a_span: tuple[str, str] = ("start", "end"), b_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of rows of a and b (suffix _b) of one key whose spans overlap by more than a point.

    A span is filed under the cells it touches on a level whose cells are at
    least as long as it, which double from bin_width on, and under those of
    the other side's higher levels. A pair meets on the longer one's level by
    equality of (key, level, cell), so neither a long video nor a long span
    becomes one task or very many rows; a pair that shares two cells is kept
    where the later of the two starts lies.
    """
    renamed = b.select(*[F.col(f"`{c}`").alias(c if c == key else f"{c}_b") for c in b.columns])
    span_b = (f"{b_span[0]}_b", f"{b_span[1]}_b")
    left = filed(a, a_span, _levels(renamed, span_b, bin_width), bin_width)
    right = filed(renamed, span_b, _levels(a, a_span, bin_width), bin_width).withColumnRenamed("_own", "_own_b")
    sa, ea, sb, eb = F.col(f"`{a_span[0]}`"), F.col(f"`{a_span[1]}`"), F.col(span_b[0]), F.col(span_b[1])
    found = left.join(right, [key, "_level", "_cell"]).filter((sa < eb) & (ea > sb) & (F.col("_level") == F.greatest("_own", "_own_b")))
    width = F.pow(F.lit(2.0), F.col("_level")) * bin_width
    return found.filter(F.col("_cell") == F.floor(F.greatest(sa, sb) / width)).drop("_level", "_cell", "_own", "_own_b")


def merge_overlaps(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", keep: list[str] | None = None) -> DataFrame:
    """keys, start, end of unions of spans that overlap or touch, and the columns keep of the first span of each."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col(start) <= reach, 0).otherwise(1)
    numbered = df.withColumn("begins", begins).withColumn("island", F.sum("begins").over(w))
    first = [F.min_by(c, F.struct(start, end, *keep)).alias(c) for c in keep or []]
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *first).drop("island")


def union_length(df: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", name: str = "seconds") -> DataFrame:
    """keys and the length of the union of their spans."""
    return merge_overlaps(df, keys, start=start, end=end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(name))


EXPOSURES = {"TOTAL": ("KCDS", "OHS"), "KCDS_ONLY": ("KCDS",), "OHS_ONLY": ("OHS",)}


def speech_exposure(segments: DataFrame, speech: DataFrame, bin_width: float = 30.0) -> DataFrame:
    """Seconds of speech in each segment by exposure type, overlaps counted once; segments without speech count 0.

    segments: video_id, interaction_type, start, end; speech: video_id, start,
    end, speaker. A segment without length has exposure 0.
    """
    kinds = EXPOSURES
    heard = overlap_join(segments.select("video_id", "interaction_type", "start", "end"), speech.select("video_id", "start", "end", "speaker"), "video_id", bin_width)
    keys = ["video_id", "interaction_type", "start", "end"]
    clipped = heard.withColumns({"from": F.greatest("start", "start_b"), "to": F.least("end", "end_b")})
    spread = clipped.withColumn("exposure_type", F.explode(F.filter(F.array(*[F.when(F.col("speaker_b").isin(*s), F.lit(k)) for k, s in kinds.items()]), lambda x: x.isNotNull())))
    seconds = union_length(spread, [*keys, "exposure_type"], start="from", end="to", name="speech_sec")
    every = segments.select(*keys).distinct().withColumn("exposure_type", F.explode(F.array(*[F.lit(k) for k in kinds])))
    out = every.join(seconds, [*keys, "exposure_type"], "left").fillna({"speech_sec": 0.0}).withColumn("duration_sec", F.col("end") - F.col("start"))
    return out.withColumn("exposure_share", F.coalesce(F.try_divide("speech_sec", "duration_sec"), F.lit(0.0)))


def exposure_by_child(exposure: DataFrame, subjects: DataFrame) -> DataFrame:
    """Speech and recording minutes of each child by exposure type; segments of unknown children are left out."""
    named = exposure.join(subjects.select("video_id", "child_id", "age_at_recording").dropDuplicates(["video_id"]), "video_id").filter("child_id is not null")
    sums = named.groupBy("child_id", "exposure_type").agg(F.sum("speech_sec").alias("s"), F.sum("duration_sec").alias("d"), F.min("age_at_recording").alias("age_at_recording"))
    return sums.select("child_id", "exposure_type", "age_at_recording", (F.col("s") / 60).alias("speech_minutes"), (F.col("d") / 60).alias("recording_minutes"), F.coalesce(F.try_divide("s", "d"), F.lit(0.0)).alias("exposure_share"))


def child_speech(segments: DataFrame, spoken: DataFrame, subjects: DataFrame, bin_width: float = 30.0) -> DataFrame:
    """Seconds of the child's own speech and of recording, for each child with a known age; silent segments count as recording."""
    keys = ["video_id", "start", "end"]
    own = segments.select(*keys).distinct()
    clipped = overlap_join(own, spoken.select("video_id", "start", "end"), "video_id", bin_width).withColumns({"from": F.greatest("start", "start_b"), "to": F.least("end", "end_b")})
    seconds = union_length(clipped, keys, start="from", end="to", name="speech_sec")
    named = own.join(seconds, keys, "left").fillna({"speech_sec": 0.0}).join(subjects.select("video_id", "child_id", "age_at_recording").dropDuplicates(["video_id"]), "video_id")
    sums = named.filter("age_at_recording is not null").groupBy("child_id").agg(F.sum("speech_sec").alias("speech_sec"), F.sum(F.col("end") - F.col("start")).alias("recording_sec"), F.min("age_at_recording").alias("age_at_recording"))
    return sums.withColumn("speech_share", F.coalesce(F.try_divide("speech_sec", "recording_sec"), F.lit(0.0)))


def frames_in_segments(frames: DataFrame, segments: DataFrame, step: int) -> DataFrame:
    """frames with is_interaction, is_alone, is_available: whether they lie in such a segment, borders included.

    Segments are spread over the grid's frames and joined by equality; unknown
    types mark nothing.
    """
    flags = {"is_interaction": "Interacting", "is_alone": "Alone", "is_available": "Available"}
    first = F.ceil(F.col("segment_start") / step) * step
    covered = segments.filter(first <= F.col("segment_end")).select("video_id", "interaction_type", F.explode(F.sequence(first.cast("long"), F.col("segment_end").cast("long"), F.lit(step).cast("long"))).alias("frame"))
    marks = covered.groupBy("video_id", "frame").agg(*[F.bool_or(F.col("interaction_type") == t).alias(c) for c, t in flags.items()])
    return frames.join(marks, ["video_id", "frame"], "left").fillna({c: False for c in flags})


def overlay(shown: DataFrame, analysed: DataFrame, segments: DataFrame, p: Params) -> DataFrame:
    """shown (video_id, frame) with the state of the analysed frame that stands for it and the type of the segment there; nulls without one.

    Frame f is stood for by rint(f / fps) * step, halves to even. Segments are
    spread over the analysed frames and joined by equality.
    """
    at = (F.rint(F.col("frame") / p.fps) * p.step).cast("long")
    first = F.ceil(F.col("segment_start") / p.step) * p.step
    types = segments.filter(first <= F.col("segment_end")).select("video_id", "interaction_type", F.explode(F.sequence(first.cast("long"), F.col("segment_end").cast("long"), F.lit(p.step).cast("long"))).alias("at"))
    states = analysed.select("video_id", F.col("frame").alias("at"), "state")
    return shown.withColumn("at", at).join(states, ["video_id", "at"], "left").join(types, ["video_id", "at"], "left")

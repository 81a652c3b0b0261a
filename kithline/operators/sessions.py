"""Speech islands, turn-taking bouts and directional turn blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.operators.intervals import overlap_join
from kithline.params import Params


def islands(frames: DataFrame, flags: dict[str, str], p: Params) -> DataFrame:
    """video_id, type, start, end of maximal runs of flagged frames at most one step apart; flags: the type of each 0/1 column.

    All flags go through one exchange.
    """
    w = Window.partitionBy("video_id", "type").orderBy("frame")
    types = F.array(*[F.when(F.col(c) == 1, F.lit(t)) for c, t in flags.items()])
    flagged = frames.select("video_id", "frame", F.explode(F.filter(types, lambda x: x.isNotNull())).alias("type")).distinct()
    begins = F.coalesce((F.col("frame") - F.lag("frame").over(w) > p.step).cast("int"), F.lit(1))
    numbered = flagged.withColumn("begins", begins).withColumn("island", F.sum("begins").over(w))
    return numbered.groupBy("video_id", "type", "island").agg(F.min("frame").alias("start"), F.max("frame").alias("end")).select("video_id", "type", "start", "end")


def bouts(speech_islands: DataFrame, p: Params) -> DataFrame:
    """video_id, start, end of bouts that hold speech both of the child and to it."""
    return bouts_by(speech_islands, ["video_id"], F.lit(p.turn_gap_sec * p.fps), F.lit(p.same_gap_sec * p.fps))


def bouts_by(speech_islands: DataFrame, keys: list[str], turn_gap: Column, same_gap: Column) -> DataFrame:
    """keys, start, end of the bouts within each of keys; the gaps, in frames, may depend on keys.

    A segment joins the running bout if its gap is at most same_gap where the
    bout has its type already, else turn_gap. It then sets the bout's end, even
    to an earlier one. Those of the child come first among equal starts.

    Segments with gaps up to the smaller limit always stand together (a run),
    and gaps over the larger one always part. Whether a run joins the one
    before depends on the types its bout holds, which follows from the runs'
    own types and places, so windows state it and no video is collected:

    - same_gap <= turn_gap: a gap between the limits parts unless the run
      before has one type and this one begins with the other. Of such links in
      a row each second one parts, as the first has filled the bout.
    - same_gap > turn_gap: such a gap parts only where the type changes and no
      run of both types came since the last gap over the larger limit.
    """
    shorter, longer = F.least(turn_gap, same_gap), F.greatest(turn_gap, same_gap)
    is_kchi = F.col("type") == "kchi"
    w = Window.partitionBy(*keys).orderBy("start", F.when(is_kchi, 0).otherwise(1), "type", "end")
    placed = speech_islands.withColumns({"n": F.row_number().over(w), "gap": F.col("start") - F.lag("end").over(w)})
    apart = placed.withColumn("begins", F.coalesce(F.col("gap") > shorter, F.lit(True)))
    numbered = apart.withColumn("run", F.sum(F.col("begins").cast("int")).over(w))
    runs = numbered.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max_by("end", "n").alias("end"), F.min_by("gap", "n").alias("gap"), F.min_by(is_kchi, "n").alias("by_child"), F.bool_or(is_kchi).alias("kchi"), F.bool_or(F.col("type") == "cds").alias("cds"))
    v = Window.partitionBy(*keys).orderBy("run")
    so_far, before = v.rowsBetween(Window.unboundedPreceding, 0), v.rowsBetween(Window.unboundedPreceding, -1)
    far = F.coalesce(F.col("gap") > longer, F.lit(True))
    had_child, had_cds = F.lag("kchi").over(v), F.lag("cds").over(v)
    changes = (had_child != had_cds) & (F.col("by_child") != had_child)
    linked = runs.withColumns({"far": far, "changes": F.coalesce(changes, F.lit(False))})
    parts = F.col("far") | ~F.col("changes")
    every_second = (F.col("run") - F.max(F.when(parts, F.col("run"))).over(so_far)) % 2 == 0
    mixed = F.max(F.when(F.col("kchi") & F.col("cds"), F.col("run"))).over(before)
    filled = F.coalesce(mixed >= F.max(F.when(F.col("far"), F.col("run"))).over(so_far), F.lit(False))
    begins = F.when(same_gap <= turn_gap, every_second).otherwise(F.col("far") | (F.col("changes") & ~filled))
    found = linked.withColumn("begins", begins).withColumn("bout", F.sum(F.col("begins").cast("int")).over(v))
    whole = found.groupBy(*keys, "bout").agg(F.min("start").alias("start"), F.max_by("end", "run").alias("end"), F.bool_or("kchi").alias("kchi"), F.bool_or("cds").alias("cds"))
    return whole.filter("kchi and cds").select(*keys, "start", "end")


def speech_islands(frames: DataFrame, p: Params) -> DataFrame:
    return islands(frames, {"has_kchi": "kchi", "has_cds": "cds"}, p)


def mark_bouts(frames: DataFrame, p: Params) -> DataFrame:
    """frames with in_bout: the frame holds such speech and lies in a bout, borders included.

    A bout covers grid frames only, so it is spread over them and joined by
    equality; bouts of a video may overlap, hence the distinct.
    """
    found = bouts(speech_islands(frames, p), p)
    covered = found.filter("`end` >= start").select("video_id", F.explode(F.sequence("start", "end", F.lit(p.step).cast("long"))).alias("frame")).distinct().withColumn("covered", F.lit(True))
    speaks = (F.col("has_kchi") == 1) | (F.col("has_cds") == 1)
    return frames.join(covered, ["video_id", "frame"], "left").withColumn("in_bout", F.coalesce("covered", F.lit(False)) & speaks).drop("covered")


def turn_blocks(turns: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """keys, block and its turns, first speaker and category, from turns (start, end, speaker).

    A turn begins a block if its gap to the turn before is over same_gap (same
    speaker) or turn_gap. Ties are ordered by end and speaker.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end", "speaker")
    before, gap = F.lag("speaker").over(w), F.col("start") - F.lag("end").over(w)
    marked = turns.withColumns({"before": before, "gap": gap})
    same = F.col("speaker") == F.col("before")
    begins = F.coalesce((F.col("gap") > F.when(same, p.same_gap_sec).otherwise(p.turn_gap_sec)).cast("int"), F.lit(1))
    numbered = marked.withColumn("begins", begins).withColumn("block", F.sum("begins").over(w))
    switches = F.sum(F.when((F.col("begins") == 0) & ~same, 1).otherwise(0)).cast("long")
    found = numbered.groupBy(*keys, "block").agg(switches.alias("turns"), F.min_by("speaker", F.struct("start", "end", "speaker")).alias("first_speaker"))
    child, answered = F.col("first_speaker") == "KCHI", F.col("turns") > 0
    kind = F.when(answered & child, "successful_initiation").when(answered, "successful_response").when(child, "unanswered_bid").otherwise("unanswered_prompt")
    return found.withColumn("category", kind)


def turns_within(turns: DataFrame, segments: DataFrame, bin_width: float = 30.0) -> DataFrame:
    """Turns (video_id, start, end, speaker) with each segment (video_id, segment_start, segment_end) of their video that they overlap; turns that end before they start are left out."""
    found = overlap_join(segments, turns.select("video_id", "start", "end", "speaker"), "video_id", bin_width, a_span=("segment_start", "segment_end"))
    return found.withColumnsRenamed({"start_b": "start", "end_b": "end", "speaker_b": "speaker"})


def turn_summary(segments: DataFrame, turns: DataFrame, p: Params) -> DataFrame:
    """For each interacting segment: total_turns, blocks of each category and turns a minute; segments without speech count 0.

    segments: video_id, interaction_type, start, end; turns: video_id, start, end, speaker.
    """
    own = segments.filter("interaction_type = 'Interacting'").select("video_id", F.col("start").alias("segment_start"), F.col("end").alias("segment_end"))
    within = turns_within(turns.filter(F.col("speaker").isin("KCHI", "KCDS")), own)
    keys = ["video_id", "segment_start", "segment_end"]
    kinds = {"successful_initiations": "successful_initiation", "successful_responses": "successful_response", "unanswered_child_bids": "unanswered_bid", "unanswered_adult_prompts": "unanswered_prompt"}
    totals = turn_blocks(within, keys, p).groupBy(*keys).agg(F.sum("turns").alias("total_turns"), *[F.count_if(F.col("category") == k).alias(n) for n, k in kinds.items()])
    filled = own.distinct().join(totals, keys, "left").fillna(0)
    return filled.withColumn("turns_per_minute", F.coalesce(F.try_divide(F.col("total_turns") * 60, F.col("segment_end") - F.col("segment_start")), F.lit(0.0)))

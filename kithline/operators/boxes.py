"""Matching detections to true boxes, and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.scalars import iou

BOX = ("x1", "y1", "x2", "y2")


def best_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Every prediction (frame_id, pred_id, conf, box) with the true box (frame_id, gt_id, box) of its frame that it overlaps most, and that iou; nulls without one.

    Of equal overlaps the smaller gt_id counts.
    """
    t = truth.select("frame_id", "gt_id", *[F.col(c).alias(f"t_{c}") for c in BOX])
    scored = predictions.join(t, "frame_id", "left").withColumn("iou", iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"t_{c}") for c in BOX)))
    best = F.max(F.when(F.col("gt_id").isNotNull(), F.struct("iou", (-F.col("gt_id")).alias("g")))).alias("best")
    found = scored.groupBy("frame_id", "pred_id").agg(F.first("conf").alias("conf"), best)
    return found.select("frame_id", "pred_id", "conf", (-F.col("best.g")).alias("gt_id"), "best.iou")


def match(predictions: DataFrame, truth: DataFrame, least_iou: float) -> DataFrame:
    """frame_id, tp, fp, fn. Each prediction claims its best true box; a true box claimed by several counts once.

    No second choice is made, so the number of true boxes claimed at least_iou
    or better is the number of hits, whatever the order.
    """
    claimed = best_truth(predictions, truth).groupBy("frame_id").agg(F.count("*").alias("n_pred"), F.count_distinct(F.when(F.col("iou") >= least_iou, F.col("gt_id"))).alias("tp"))
    there = truth.groupBy("frame_id").agg(F.count("*").alias("n_gt"))
    both = there.join(claimed, "frame_id", "full").fillna(0)
    return both.select("frame_id", F.col("tp"), (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))


def scores(tp, fp, fn, smoothing: float = 1e-8):
    """Precision, recall and F1 columns of counts."""
    p, r = tp / (tp + fp + smoothing), tp / (tp + fn + smoothing)
    return p, r, 2 * p * r / (p + r + smoothing)


def threshold_sweep(predictions: DataFrame, truth: DataFrame, thresholds: list[float], least_iou: float = 0.5) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of predictions at least that confident.

    Overlaps are computed once; a hit at a threshold is a true box whose most
    confident claimant reaches it.
    """
    spread = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    best = best_truth(predictions, truth)
    hit = F.when(F.col("iou") >= least_iou, F.struct("frame_id", "gt_id"))
    at = best.select("*", spread).filter(F.col("conf") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("n_pred"), F.count_distinct(hit).alias("tp"))
    base = truth.agg(F.count("*").alias("n_gt")).select("n_gt", spread)
    counts = base.join(at, "threshold", "left").fillna(0).select("threshold", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    p, r, f1 = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the greatest F1; of equals the smallest threshold."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def error_frames(matches: DataFrame) -> DataFrame:
    """frame_id and kind (false_positive, false_negative) of frames with such errors."""
    kinds = F.array(F.when(F.col("fp") > 0, F.lit("false_positive")), F.when(F.col("fn") > 0, F.lit("false_negative")))
    return matches.select("frame_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def keep_classes(predictions: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    return predictions.filter(F.col("class_id").isin(*classes))


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def last_of_window(frames: DataFrame, width: int, stride: int) -> DataFrame:
    """video_id, window, frame for sliding windows of ``width`` frames every ``stride``, and one that ends at the last frame."""
    w = Window.partitionBy("video_id").orderBy("frame")
    n = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    tail = F.greatest(F.col("n") - width, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), tail, F.lit(stride).cast("long")), F.array(tail)))
    windows = n.select("video_id", F.explode(starts).alias("first")).select("video_id", "first", (F.col("first") + width - 1).alias("last"), F.explode(F.sequence("first", F.col("first") + width - 1)).alias("place"))
    placed = frames.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return placed.join(windows, ["video_id", "place"]).select("video_id", F.col("first").alias("window"), "place", "frame", (F.col("place") == F.col("last")).alias("is_last"))


def window_ends(frames: DataFrame, width: int, stride: int) -> DataFrame:
    """video_id, frame of the last frames of sliding windows that fall on the stride counted from the first window's end; others are left out."""
    last = last_of_window(frames, width, stride).filter("is_last")
    return last.filter(F.col("place") % stride == (width - 1) % stride).select("video_id", "frame").distinct()

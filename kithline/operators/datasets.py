"""Construction of training sets from annotations and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.scalars import AGE_CLASSES, lookup


def visible_annotations(annotations: DataFrame, images: DataFrame, videos: DataFrame, categories: list[int], *, distinct: bool = True, names: list[str] | None = None) -> DataFrame:
    """Annotations that aren't outside the frame, of some categories, with their image's and video's names; names: of these videos only."""
    kept = annotations.filter((F.col("outside") == 0) & F.col("category_id").isin(categories))
    i = images.select("video_id", F.col("frame_id").alias("image_id"), "file_name")
    v = videos.select(F.col("id").alias("video_id"), F.col("file_name").alias("video_name"))
    v = v.filter(F.col("video_name").isin(names)) if names else v
    found = kept.join(i, ["video_id", "image_id"]).join(v, "video_id")
    return found.distinct() if distinct else found


def noisy_frames(annotations: DataFrame, strict: bool = False) -> DataFrame:
    """Frames (video_id, image_id) with an annotation of category -1; strict: only those with no other."""
    n = annotations.groupBy("video_id", "image_id").agg(F.count_if(F.col("category_id") == -1).alias("noise"), F.count_if(F.col("category_id") != -1).alias("others"))
    return n.filter((F.col("noise") > 0) & ((F.col("others") == 0) | F.lit(not strict))).select("video_id", "image_id")


def shift_frames(annotations: DataFrame, exceptions: DataFrame) -> DataFrame:
    """annotations with frame moved by the shift of their video's exception (video_name, start_frame, shift) from its start on; exceptions are few, one for a video."""
    joined = annotations.join(F.broadcast(exceptions.select("video_name", "start_frame", "shift")), "video_name", "left")
    moved = F.when(F.col("frame") >= F.col("start_frame"), F.col("frame") + F.col("shift")).otherwise(F.col("frame"))
    return joined.withColumn("frame", moved).drop("start_frame", "shift")


def is_sampled(frame: str, step: int, start: str | None = None, own_step: str | None = None) -> Column:
    """Whether a frame is one of every step-th; from column ``start`` on the count begins anew, and column own_step overrides step. Nulls mean no exception."""
    f = F.col(frame)
    by = F.coalesce(F.col(own_step), F.lit(step)) if own_step else F.lit(step)
    if start is None:
        return f % by == 0
    s = F.col(start)
    return F.when(s.isNotNull() & (f >= s), (f - s) % by == 0).otherwise(f % by == 0)


def age_class(age: Column, scheme: str) -> Column:
    """The class of an age group under a scheme of AGE_CLASSES; null for others, which are skipped."""
    return lookup(age, AGE_CLASSES[scheme])


def yolo_lines(boxes: DataFrame, *, keep_duplicates: bool = True) -> DataFrame:
    """file_name and content: its lines ``class cx cy w h`` in order, one line for equal boxes unless keep_duplicates."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("cx", "cy", "w", "h")])
    lines = F.collect_list(line) if keep_duplicates else F.collect_set(line)
    return boxes.groupBy("file_name").agg(F.concat_ws("\n", F.sort_array(lines)).alias("content"))


def class_presence(images: DataFrame, labels: DataFrame, classes: list[int]) -> DataFrame:
    """file_name, has_annotation and class_k (0 or 1) for every image, from labels (file_name, class_id)."""
    flags = labels.groupBy("file_name").agg(*[F.max((F.col("class_id") == k).cast("int")).alias(f"class_{k}") for k in classes]).withColumn("has_annotation", F.lit(1))
    return images.select("file_name").join(flags, "file_name", "left").fillna(0)


def inventory(frames: DataFrame, labels: DataFrame, noisy: DataFrame, step: int) -> DataFrame:
    """video_id, frame, kind: positive if the frame has labels, negative if it is sampled and not noisy; all others are left out."""
    pos = labels.select("video_id", "frame").distinct().withColumn("p", F.lit(True))
    bad = noisy.select("video_id", "frame").distinct().withColumn("b", F.lit(True))
    joined = frames.join(pos, ["video_id", "frame"], "left").join(bad, ["video_id", "frame"], "left")
    kind = F.when(F.col("p"), "positive").when((F.col("frame") % step == 0) & F.col("b").isNull(), "negative")
    return joined.select("video_id", "frame", kind.alias("kind")).filter("kind is not null")


def early_split(frames: DataFrame, minutes: float, fps: int = 30, ratio: float = 0.8) -> DataFrame:
    """Frames of the first minutes with split: train up to ratio of the video's last such frame, then val."""
    early = frames.filter(F.col("frame") <= minutes * 60 * fps)
    last = early.groupBy("video_id").agg(F.max("frame").alias("last"))
    return early.join(last, "video_id").withColumn("split", F.when(F.col("frame") <= ratio * F.col("last"), "train").otherwise("val")).drop("last")


def frames_of_subjects(frames: DataFrame, subjects: DataFrame) -> DataFrame:
    """Frames whose child_id is among subjects'."""
    return frames.join(subjects.select("child_id").distinct(), "child_id", "left_semi")


def hard_negatives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted frames without truth, once each."""
    return predicted.select("file_name").distinct().join(truth.select("file_name"), "file_name", "left_anti")


def flag_hard(negatives: DataFrame, hard: DataFrame) -> DataFrame:
    """negatives with is_hard: whether the file is among hard ones."""
    return negatives.join(hard.select("file_name").distinct().withColumn("is_hard", F.lit(True)), "file_name", "left").fillna({"is_hard": False})


def split_report(assigned: DataFrame, classes: list[str]) -> DataFrame:
    """split, groups, images, positives, their share, and the sum of each class, for each split and (null) overall."""
    sums = [F.sum(c).alias(c) for c in classes]
    found = assigned.rollup("split").agg(F.count_distinct("child_id").alias("groups"), F.count("*").alias("images"), F.sum("has_annotation").alias("positives"), *sums)
    return found.withColumn("positive_share", F.try_divide("positives", "images"))


def copy_manifest(assigned: DataFrame, source: str, target: str) -> DataFrame:
    """source and target paths of every image and label file by split; copying is left to a tool for files."""
    def pair(kind: str, suffix: Column):
        return F.struct(F.concat(F.lit(f"{source}/{kind}/"), suffix).alias("source"), F.concat(F.lit(f"{target}/"), F.col("split"), F.lit(f"/{kind}/"), suffix).alias("target"))

    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return assigned.select(F.explode(F.array(pair("images", F.col("file_name")), pair("labels", F.concat(stem, F.lit(".txt"))))).alias("f")).select("f.*")


def first_person_class(annotations: DataFrame) -> DataFrame:
    """annotations with category 11 (body parts) where a person (1) is the camera's wearer (person_ID 1)."""
    return annotations.withColumn("category_id", F.when((F.col("category_id") == 1) & (F.col("person_ID") == 1), 11).otherwise(F.col("category_id")))


def rebuild_annotations(boxes: DataFrame, path: str) -> None:
    """Replaces the annotations at path by boxes of cvat_tracks(), with their person_ID and the camera wearer's class."""
    named = boxes.withColumn("person_ID", F.try_element_at("attributes", F.lit("person_ID")).try_cast("long"))
    first_person_class(named).write.mode("overwrite").parquet(path)


def build_split(images: DataFrame, negatives: DataFrame, mode: str, *, splits: DataFrame | None = None, groups: DataFrame | None = None, seed: int = 42, ratio: float = 1.0) -> DataFrame:
    """file_name, child_id, has_annotation, split of positives and of sampled negatives.

    mode: "fixed" takes splits (child_id, split) as given; "balanced" makes
    them with greedy_split from groups; "retrain" keeps given splits of val and
    test and gives all other children to train. Negatives (file_name, child_id,
    maybe is_hard) fill train and val up to ratio times their positives, hard
    ones first and all of them; test keeps all of its own, as they come in
    practice, but none that is among its positives.
    """
    from kithline.operators.splits import greedy_split, sample_by_quota

    if mode == "balanced":
        splits = greedy_split(groups, "child_id", "class_0", "class_1", "positives", "total")
    elif mode == "retrain":
        kept = splits.filter("split <> 'train'")
        splits = images.select("child_id").distinct().join(kept, "child_id", "left").fillna({"split": "train"})
    elif mode != "fixed":
        raise ValueError(f"unknown mode {mode}")
    pos = images.filter("has_annotation = 1").join(splits, "child_id")
    quota = pos.groupBy("split").agg(F.floor(F.count("*") * ratio).alias("quota"))
    every = negatives.join(splits, "child_id")
    neg = every.filter("split <> 'test'")
    kept = every.filter("split = 'test'").join(pos.select("file_name"), "file_name", "left_anti").select(*neg.columns)
    hard = F.col("is_hard") if "is_hard" in negatives.columns else None
    drawn = sample_by_quota(neg, quota, "split", "file_name", seed, hard)
    columns = ["file_name", "child_id", "has_annotation", "split"]
    return pos.select(*columns).unionByName(drawn.unionByName(kept).withColumn("has_annotation", F.lit(0)).select(*columns))

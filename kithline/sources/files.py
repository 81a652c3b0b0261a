"""Readers of annotation, speech, label and list files. All take Spark paths or globs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions.scalars import box_of_json, category, clean_number, frame_of_path, frame_suffix, last_number, path_part, supercategory, video_of_frame_name

SPEECH_LABELS = ("OHS", "KCDS", "KCHI")


def _stem(path):
    return F.regexp_replace(path_part(path, 1), r"\.[^.]*$", "")


def speech_rttm(spark: SparkSession, path: str, *, labels: tuple[str, ...] | None = SPEECH_LABELS, strict: bool = True, bad: str = "drop") -> DataFrame:
    """video_name (without suffix), start, end, duration (seconds), speaker of the lines of RTTM files.

    strict: eight tokens or more, the first SPEAKER, numeric times, a positive
    duration; else only eight tokens and readable times are asked for. labels
    None: any. bad "raise": an unreadable time in a line of these labels ends
    the job instead of dropping the line.
    """
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.regexp_replace(F.get(t, F.lit(1)), r"\.[^.]*$", "").alias("video_name"), F.get(t, F.lit(0)).alias("kind"), F.size(t).alias("n"), F.get(t, F.lit(3)).try_cast("double").alias("start"), F.get(t, F.lit(4)).try_cast("double").alias("duration"), F.get(t, F.lit(7)).alias("speaker"))
    rows = rows.filter("n >= 8")
    if bad == "raise":
        wanted = F.col("speaker").isin(*labels) if labels else F.lit(True)
        broken = wanted & (F.col("start").isNull() | F.col("duration").isNull())
        rows = rows.withColumn("start", F.when(broken, F.raise_error(F.lit("unreadable time")).cast("double")).otherwise(F.col("start")))
    rows = rows.filter("start is not null and duration is not null")
    rows = rows.filter("kind = 'SPEAKER' and duration > 0") if strict else rows
    rows = rows.filter(F.col("speaker").isin(*labels)) if labels else rows
    return rows.select("video_name", "start", (F.col("start") + F.col("duration")).alias("end"), "duration", "speaker")


def subjects_csv(spark: SparkSession, path: str) -> DataFrame:
    """video_name, child_id, recording_date, age_at_recording, age_group of a ``;`` CSV with decimal commas and dd.mm.yyyy dates; bad values become null."""
    raw = spark.read.csv(path, sep=";", header=True)
    return raw.select(F.trim("video_name").alias("video_name"), F.trim("child_id").alias("child_id"), F.try_to_date("recording_date", "dd.MM.yyyy").alias("recording_date"), clean_number("age_at_recording").alias("age_at_recording"), F.trim("age_group").alias("age_group"))


def annotation_csv(spark: SparkSession, path: str, *, valid: tuple[str, ...] = ("interacting", "available", "alone")) -> DataFrame:
    """video_name, label, start_time, end_time, ordinal of an annotator's ``;`` CSV: surplus columns and empty rows dropped, texts trimmed, unknown labels dropped.

    ordinal keeps the file's order.
    """
    raw = spark.read.csv(path, sep=";", header=True)
    names = {c.strip(): c for c in raw.columns if c and not c.startswith(("Unnamed", "_c"))}
    wanted = ("video_name", "interaction_type", "start_time_min", "end_time_min")
    missing = [c for c in wanted if c not in names]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    cols = [F.trim(F.col(f"`{names[c]}`")).alias(c) for c in wanted]
    rows = raw.select(*cols, F.monotonically_increasing_id().alias("ordinal")).na.drop("all", subset=list(wanted))
    named = rows.select("video_name", F.lower("interaction_type").alias("label"), F.col("start_time_min").alias("start_time"), F.col("end_time_min").alias("end_time"), "ordinal")
    return named.filter(F.col("label").isin(*valid))


def non_null_columns(df: DataFrame) -> list[str]:
    """Columns with any value, from one aggregation."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c]]


def newest_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the file last modified among those a glob matches."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    best = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]
    if best is None:
        raise FileNotFoundError(path)
    return spark.read.csv(best, header=True, **options)


def ordered_images(spark: SparkSession, path: str, category_id: int = 1) -> DataFrame:
    """image_id and place of a JSON list of predictions of one category: each image once, with the place of its first prediction in the list (from 0).

    Places are in the list's order over several files too, though not without gaps.
    """
    rows = spark.read.schema("image_id string, category_id int").json(path, multiLine=True).withColumn("place", F.monotonically_increasing_id())
    return rows.filter(F.col("category_id") == category_id).groupBy("image_id").agg(F.min("place").alias("place"))


def predicted_images(spark: SparkSession, path: str, category_id: int = 1) -> DataFrame:
    """Distinct image_id of a JSON list of predictions of one category."""
    return ordered_images(spark, path, category_id).select("image_id")


def keyed_labels(spark: SparkSession, path: str) -> DataFrame:
    """video_id, frame_id, file_name, label, value of a JSON map from ``video_frame_file`` to labels."""
    text = spark.read.text(path, wholetext=True)
    maps = text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("key", "labels"))
    k = F.split("key", "_", 3)
    return maps.select(k[0].try_cast("long").alias("video_id"), F.get(k, F.lit(1)).try_cast("long").alias("frame_id"), F.get(k, F.lit(2)).alias("file_name"), F.explode("labels").alias("label", "value"))


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """file_name (without suffix), class_id, cx, cy, w, h of YOLO label files; unreadable lines are dropped."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(_stem(F.col("_metadata.file_path")).alias("file_name"), F.get(t, F.lit(0)).try_cast("int").alias("class_id"), *[F.get(t, F.lit(k)).try_cast("double").alias(n) for k, n in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))])
    return rows.na.drop()


def frame_files(spark: SparkSession, path: str) -> DataFrame:
    """path, video_name, frame of image files (jpg, png in any case), from their names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = _stem(F.col("path"))
    number = F.coalesce(frame_suffix(name), last_number(name))
    return files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select("path", video_of_frame_name(name).alias("video_name"), number.alias("frame"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """name: distinct lines that aren't blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def select_names(df: DataFrame, names: DataFrame | None, key: str = "video_name") -> DataFrame:
    """Rows of the named videos; all without names or with an empty list."""
    if names is None or names.isEmpty():
        return df
    return df.join(names.select(F.col("name").alias(key)), key, "left_semi")


def unprocessed(df: DataFrame, done: DataFrame, key: str = "video_name") -> DataFrame:
    return df.join(done.select(F.col("name").alias(key)), key, "left_anti")


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """child_id and split from a report with lines ``Training IDs: n, [...]``, likewise Validation and Test."""
    text = spark.read.text(path)
    names = {"Training": "train", "Validation": "val", "Test": "test"}
    found = None
    for word, split in names.items():
        ids = F.regexp_extract("value", rf"{word} IDs: \d+, \[(.*?)\]", 1)
        rows = text.select(F.explode(F.split(ids, ",")).alias("child_id"), F.lit(split).alias("split")).select(F.regexp_replace("child_id", r"['\"\s]", "").alias("child_id"), "split").filter("child_id <> ''")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


TRACK = "_label string, box array<struct<_frame:int,_outside:int,_xtl:double,_ytl:double,_xbr:double,_ybr:double,attribute:array<struct<_name:string,_VALUE:string>>>>"


def cvat_tracks(spark: SparkSession, path: str) -> DataFrame:
    """video_name, label, category_id, supercategory, frame, outside, x1..y2 and attributes (map) of every box of CVAT XML files."""
    tracks = spark.read.format("xml").option("rowTag", "track").schema(TRACK).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    tasks = spark.read.format("xml").option("rowTag", "task").schema("name string").load(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("name", r"\.[^.]*$", "").alias("video_name"))
    boxes = tracks.select("file", F.col("_label").alias("label"), F.explode("box").alias("b"))
    attributes = F.map_from_entries(F.transform(F.coalesce("b.attribute", F.array()), lambda x: F.struct(x["_name"].alias("key"), x["_VALUE"].alias("value"))))
    c = category("label")
    return boxes.join(tasks, "file").select("video_name", "label", c.alias("category_id"), supercategory(c).alias("supercategory"), F.col("b._frame").alias("frame"), F.col("b._outside").alias("outside"), F.col("b._xtl").alias("x1"), F.col("b._ytl").alias("y1"), F.col("b._xbr").alias("x2"), F.col("b._ybr").alias("y2"), attributes.alias("attributes"))


def annotation_boxes(annotations: DataFrame) -> DataFrame:
    """annotations with the JSON column bbox as x1..y2; rows whose box can't be read are dropped."""
    return annotations.withColumn("b", box_of_json("bbox")).filter("b is not null").select("*", "b.*").drop("b", "bbox")


def frames_by_path(paths: DataFrame, names: DataFrame, step: int) -> DataFrame:
    """paths (column path) with video_name and frame, of the named videos (column video_name) and every step-th frame.

    The name must be the path's folder as a whole, so no search for it anywhere
    in the path is needed first; paths without a folder or number are left out.
    """
    named = paths.withColumns({"video_name": path_part("path", 2), "frame": frame_of_path("path")})
    return named.filter(F.col("frame") % step == 0).join(names.select("video_name").distinct(), "video_name", "left_semi")


def with_ids(df: DataFrame, videos: DataFrame) -> DataFrame:
    """df with the video_id of its video_name, by videos (video_name, video_id); null for unknown names. Of ids of one name the least counts."""
    return df.join(videos.groupBy("video_name").agg(F.min("video_id").alias("video_id")), "video_name", "left")

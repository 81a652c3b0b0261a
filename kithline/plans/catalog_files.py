"""Queries over files: each writes its fixture from the tables into the shared folder and reads it back with the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kithline import adapters as A
from kithline.functions import scalars as S
from kithline.operators import boxes, datasets, evaluate, intervals, predict, segments, stats
from kithline.params import Params
from kithline.plans import analysis
from kithline.plans.catalog import _BOX_BEST, _FIXED, _METRICS, P, _boxes, _fixed, _images, _r, _seconds, _spans, register
from kithline.sources import files, sinks, versions
from kithline.sources.shared import fresh_path, write_files
from kithline.streaming import online

# Speech


def _rttm(spark, sf_dir, bad: bool = True):
    """A line for each turn; some are comments, of other speakers, too short, or (bad) without a readable duration."""
    k = F.col("conv_id") + F.col("turn")
    label = F.when(k % 7 == 0, "FEM").when(F.col("role") == "user", "KCHI").when(F.col("role") == "assistant", "KCDS").otherwise("OHS")
    length = (F.coalesce(F.length("text"), F.lit(0)) % 12).cast("string")
    line = F.concat_ws(" ", F.when(k % 11 == 0, "NOTE").otherwise("SPEAKER"), F.concat(F.lit("v"), "conv_id", F.lit(".wav")), F.lit("1"), (F.col("turn") * 5).cast("string"), F.when(F.lit(bad) & (k % 13 == 0), "x").otherwise(length), F.lit("<NA>"), F.lit("<NA>"), label, F.lit("<NA>"))
    path = fresh_path(spark, "rttm")
    A.read(spark, sf_dir, "conversations").select(F.when(k % 17 == 0, "short line").otherwise(line).alias("value")).write.text(path)
    return path


_RT = """(SELECT 'v' || conv_id AS video_name, turn * 5.0::DOUBLE AS start, (coalesce(length(text), 0) % 12)::DOUBLE AS duration, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'FEM' WHEN role = 'user' THEN 'KCHI' WHEN role = 'assistant' THEN 'KCDS' ELSE 'OHS' END AS speaker,
    (conv_id + turn) % 11 = 0 AS note, (conv_id + turn) % 13 = 0 AS bad FROM conversations WHERE (conv_id + turn) % 17 <> 0)"""


@register(f'SELECT video_name, start, start + duration AS "end", duration, speaker FROM {_RT} WHERE NOT note AND NOT bad AND duration > 0 AND speaker <> \'FEM\'')
def speech_file(spark, sf_dir):
    return files.speech_rttm(spark, _rttm(spark, sf_dir))


@register(f'SELECT video_name, start, start + duration AS "end", speaker FROM {_RT} WHERE speaker IN (\'KCDS\', \'OHS\')')
def adult_speech_file(spark, sf_dir):
    return files.speech_rttm(spark, _rttm(spark, sf_dir, bad=False), labels=("KCDS", "OHS"), strict=False, bad="raise").drop("duration")


@register(f"SELECT video_name, start, duration, speaker FROM {_RT} WHERE NOT bad")
def all_speakers_file(spark, sf_dir):
    return files.speech_rttm(spark, _rttm(spark, sf_dir), labels=None, strict=False).drop("end")


@register("SELECT video_id, frame, has_kchi FROM speech WHERE has_kchi = 1", "speech")
def child_speech_frames(spark, sf_dir):
    from kithline.operators import observations

    return observations.speech(A.audio(spark, sf_dir)).filter("has_kchi = 1").select("video_id", "frame", "has_kchi")


# Annotations


def _cvat(spark, sf_dir):
    """An XML file for each nation with a track and a box for each of its customers."""
    k = F.col("c_custkey")
    label = F.get(F.array(*[F.lit(x) for x in ("person", "face", "book", "odd", "noise")]), (k % 5).cast("int"))
    box = F.format_string('<track label="%s"><box frame="%d" outside="%d" xtl="%d" ytl="1" xbr="%d" ybr="12.5"><attribute name="person_ID">%d</attribute></box></track>', label, k * 10, (k % 7 == 0).cast("int"), k % 100, k % 100 + 10, k % 3)
    content = F.concat(F.lit("<annotations><meta><task><name>n"), "c_nationkey", F.lit(".mp4</name></task></meta>"), F.array_join(F.sort_array(F.collect_list(box)), ""), F.lit("</annotations>"))
    path = fresh_path(spark, "cvat")
    write_files(A.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(content.alias("content")).select(F.col("c_nationkey").cast("string").alias("file_name"), "content"), path, ".xml")
    return files.cvat_tracks(spark, f"{path}/*.xml")


_CATEGORY = "CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 3 ELSE -1 END"


@register(f"SELECT 'n' || c_nationkey AS video_name, ['person', 'face', 'book', 'odd', 'noise'][c_custkey % 5 + 1] AS label, {_CATEGORY} AS category_id, ['person', 'face', 'object', 'noise', 'noise'][c_custkey % 5 + 1] AS supercategory, c_custkey * 10 AS frame, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS outside, (c_custkey % 100)::DOUBLE AS x1, 1.0::DOUBLE AS y1, (c_custkey % 100 + 10)::DOUBLE AS x2, 12.5::DOUBLE AS y2 FROM customer")
def cvat_boxes(spark, sf_dir):
    return _cvat(spark, sf_dir).drop("attributes")


@register(f"SELECT 'n' || c_nationkey AS video_name, c_custkey * 10 AS frame, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 3 = 1 THEN 11 ELSE {_CATEGORY} END AS category_id, c_custkey % 3 AS person_id FROM customer")
def rebuilt_annotations(spark, sf_dir):
    path = fresh_path(spark, "annotations")
    datasets.rebuild_annotations(_cvat(spark, sf_dir), path)
    return spark.read.parquet(path).select("video_name", "frame", "category_id", F.col("person_ID").alias("person_id"))


@register("SELECT 'v' || c_custkey AS video_name, 'c' || c_custkey % 40 AS child_id, CASE WHEN c_custkey % 6 > 0 THEN CAST(make_date(2000 + (c_custkey % 20)::INT, 1 + (c_custkey % 12)::INT, 1 + (c_custkey % 28)::INT) AS VARCHAR) END AS recording_date, CASE WHEN c_custkey % 5 > 0 THEN round(c_custkey % 9 + (c_custkey % 10) / 10, 6) END AS age_at_recording, c_mktsegment AS age_group FROM customer")
def subjects_file(spark, sf_dir):
    k = F.col("c_custkey")
    date = F.when(k % 6 == 0, "unknown").otherwise(F.format_string("%02d.%02d.%d", k % 28 + 1, k % 12 + 1, k % 20 + 2000))
    age = F.when(k % 5 == 0, "x").otherwise(F.concat((k % 9).cast("string"), F.lit(","), (k % 10).cast("string")))
    path = fresh_path(spark, "subjects")
    sinks.write_csv(A.read(spark, sf_dir, "customer").select(F.concat(F.lit("v"), k).alias("video_name"), F.concat(F.lit("c"), k % 40).alias("child_id"), date.alias("recording_date"), age.alias("age_at_recording"), F.col("c_mktsegment").alias("age_group")), path, ";")
    got = files.subjects_csv(spark, path)
    return got.select("video_name", "child_id", F.col("recording_date").cast("string").alias("recording_date"), *_r("age_at_recording"), "age_group")


@register("""SELECT 'v' || conv_id AS video_id, CASE role WHEN 'user' THEN 'interacting' ELSE 'alone' END AS label, start, CASE WHEN turn % 4 = 3 THEN start ELSE start + 4 END AS "end" FROM (SELECT *, CASE WHEN turn % 5 = 4 THEN 0 ELSE turn % 60 * 60 + turn % 50 END::DOUBLE AS start FROM conversations WHERE role IN ('user', 'assistant') AND (conv_id + turn) % 9 > 0)""")
def annotation_spans(spark, sf_dir):
    k, t = F.col("conv_id") + F.col("turn"), F.col("turn")
    there = k % 9 > 0
    start = F.when(t % 5 == 4, "?").otherwise(F.format_string("%02d:%02d", t % 60, t % 50))
    end = F.when(t % 4 == 3, "later").otherwise(F.when(t % 5 == 4, "4").otherwise(F.format_string("%02d:%02d", t % 60, t % 50 + 4)))
    kind = F.when(F.col("role") == "user", " Interacting").when(F.col("role") == "assistant", "ALONE ").otherwise("unsure")
    columns = [F.when(there, c).alias(n) for c, n in ((F.concat(F.lit("v"), "conv_id"), "video_name"), (kind, "interaction_type"), (start, "start_time_min"), (end, "end_time_min"))]
    path = fresh_path(spark, "spans")
    sinks.write_csv(A.read(spark, sf_dir, "conversations").select(*columns, F.lit(None).cast("string").alias("Unnamed: 4")), path, ";")
    got = files.annotation_csv(spark, path).withColumnRenamed("video_name", "video_id")
    return evaluate.label_spans(got).select("video_id", "label", "start", "end")


@register("SELECT unnest(['p_partkey', 'p_name']) AS name")
def columns_with_values(spark, sf_dir):
    p = A.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit(None).cast("string").alias("empty"))
    return spark.createDataFrame([(c,) for c in files.non_null_columns(p)], "name string")


@register("SELECT r_regionkey::VARCHAR AS key, r_name AS name FROM region")
def newest_file(spark, sf_dir):
    path = fresh_path(spark, "newest")
    for k, (table, key, name) in enumerate((("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"))):
        sinks.write_csv(A.read(spark, sf_dir, table).select(F.col(key).alias("key"), F.col(name).alias("name")).coalesce(1), f"{path}/{k}")
    return files.newest_csv(spark, f"{path}/*/*.csv")


# JSON, labels, frames, lists


@register("SELECT 'i' || p_size AS image_id, min(n) - 1 AS place FROM (SELECT p_size, p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part) WHERE p_partkey % 2 = 1 GROUP BY 1")
def predicted_images_file(spark, sf_dir):
    one = F.struct("p_partkey", F.concat(F.lit("i"), "p_size").alias("image_id"), (F.col("p_partkey") % 2).cast("int").alias("category_id"))
    path = fresh_path(spark, "predictions")
    write_files(A.read(spark, sf_dir, "part").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("content")).select(F.lit("all").alias("file_name"), "content"), path, ".json")
    return files.ordered_images(spark, f"{path}/*.json")


@register("SELECT s_suppkey AS video_id, s_suppkey * 10 AS frame_id, 'img_' || s_suppkey || '.jpg' AS file_name, unnest(['child', 'adult']) AS label, unnest([s_suppkey % 2, s_suppkey % 3]) AS value FROM supplier")
def keyed_labels_file(spark, sf_dir):
    k = F.col("s_suppkey")
    entry = F.format_string('"%d_%d_img_%d.jpg": {"child": %d, "adult": %d}', k, k * 10, k, k % 2, k % 3)
    path = fresh_path(spark, "keyed")
    write_files(A.read(spark, sf_dir, "supplier").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("content")).select(F.lit("labels").alias("file_name"), "content"), path, ".json")
    return files.keyed_labels(spark, f"{path}/*.json")


@register("SELECT DISTINCT 'img_' || l_suppkey AS file_name, l_linenumber % 2 AS class_id, round(l_discount, 6) AS cx, round(l_tax, 6) AS cy, 0.5::DOUBLE AS w, 0.25::DOUBLE AS h FROM lineitem")
def yolo_label_files(spark, sf_dir):
    b = A.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("img_"), "l_suppkey").alias("file_name"), (F.col("l_linenumber") % 2).alias("class_id"), F.col("l_discount").alias("cx"), F.col("l_tax").alias("cy"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    path = fresh_path(spark, "labels")
    sinks.write_labels(datasets.yolo_lines(b, keep_duplicates=False), path)
    return files.yolo_labels(spark, f"{path}/*.txt").select("file_name", "class_id", *_r("cx", "cy", "w", "h"))


@register("SELECT 'v_' || s_suppkey % 10 AS video_name, s_suppkey AS frame, row_number() OVER (PARTITION BY s_suppkey % 10 ORDER BY s_suppkey) AS place, s_suppkey AS frame_of_path FROM supplier")
def frame_files_in_order(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("s_suppkey")
    path = fresh_path(spark, "frames")
    names = F.format_string("v_%d/v_%d_%06d", k % 10, k % 10, k)
    write_files(A.read(spark, sf_dir, "supplier").select(names.alias("file_name"), F.lit("x").alias("content")), path, ".jpg")
    write_files(spark.range(1).select(F.lit("notes").alias("file_name"), F.lit("x").alias("content")), path, ".txt")
    got = files.frame_files(spark, path)
    return got.select("video_name", "frame", F.row_number().over(Window.partitionBy("video_name").orderBy("frame")).alias("place"), S.frame_of_path("path").alias("frame_of_path"))


def _processed(spark, sf_dir):
    """The list of processed videos, grown in two runs that overlap."""
    path = fresh_path(spark, "processed")
    names = A.videos(spark, sf_dir).select("video_id", F.concat(F.lit(" "), "video_name").alias("name"))
    sinks.mark_processed(names.filter("video_id % 3 = 0"), path)
    sinks.mark_processed(names.filter("video_id % 6 < 2"), path)
    return files.name_list(spark, path)


@register("SELECT video_id, video_name FROM vid WHERE video_id % 3 = 0 OR video_id % 6 < 2", "vid")
def selected_videos(spark, sf_dir):
    return files.select_names(A.videos(spark, sf_dir), _processed(spark, sf_dir)).select("video_id", "video_name")


@register("SELECT video_id, video_name FROM vid WHERE video_id % 3 <> 0 AND video_id % 6 >= 2", "vid")
def unprocessed_videos(spark, sf_dir):
    return files.unprocessed(A.videos(spark, sf_dir), _processed(spark, sf_dir)).select("video_id", "video_name")


# Splits


def _split_file(spark, sf_dir):
    assigned = _fixed(spark, sf_dir).select("child_id", "split").distinct()
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("child_id")), lambda c: F.concat(F.lit("'"), c.cast("string"), F.lit("'"))), ", ")
    word = F.when(F.col("split") == "train", "Training").when(F.col("split") == "val", "Validation").otherwise("Test")
    path = fresh_path(spark, "split")
    assigned.groupBy("split").agg(F.count("*").alias("n"), ids.alias("ids")).select(F.concat(word, F.lit(" IDs: "), "n", F.lit(", ["), "ids", F.lit("]")).alias("value")).write.text(path)
    return files.split_file(spark, path).withColumn("child_id", F.col("child_id").cast("long"))


@register(f"SELECT DISTINCT o_custkey % 97 AS child_id, {_FIXED} AS split FROM orders")
def split_file_ids(spark, sf_dir):
    return _split_file(spark, sf_dir)


def _negatives(spark, sf_dir):
    return _images(spark, sf_dir).filter("has_annotation = 0").select("file_name", "child_id", F.endswith("file_name", F.lit("3.jpg")).alias("is_hard"))


_IMG = f"SELECT o_custkey % 97 AS c, o_orderkey % 10 = 3 AS hard, o_orderstatus <> 'O' AS pos, {_FIXED} AS s FROM orders"
_COUNTS = "SELECT split, CAST(has_annotation AS INTEGER) AS has_annotation, n, hard FROM (SELECT s AS split, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q, count(*) FILTER (NOT pos AND hard) AS h FROM img GROUP BY s), LATERAL (SELECT unnest([1, 0]) AS has_annotation, unnest([p, CASE WHEN split = 'test' THEN q ELSE least(q, greatest({quota}, h)) END]) AS n, unnest([NULL, h]) AS hard)"


def _built(dataset, negatives):
    hard = F.count_if(F.coalesce("is_hard", F.lit(False)))
    got = dataset.join(negatives.select("file_name", "is_hard"), "file_name", "left").groupBy("split", "has_annotation").agg(F.count("*").alias("n"), hard.alias("h"))
    return got.filter("n > 0").select("split", "has_annotation", "n", F.when(F.col("has_annotation") == 0, F.col("h")).alias("hard"))


@register(f"WITH img AS ({_IMG}) " + _COUNTS.format(quota="p"))
def fixed_dataset(spark, sf_dir):
    neg = _negatives(spark, sf_dir)
    return _built(datasets.build_split(_images(spark, sf_dir), neg, "fixed", splits=_split_file(spark, sf_dir)), neg)


@register(f"WITH img AS (SELECT c, hard, pos, CASE WHEN c < 60 OR c % 2 = 1 THEN 'train' ELSE s END AS s FROM ({_IMG})) " + _COUNTS.format(quota="CAST(floor(p * 0.5) AS BIGINT)"))
def retrain_dataset(spark, sf_dir):
    neg = _negatives(spark, sf_dir)
    kept = _split_file(spark, sf_dir).filter("split = 'train' or child_id % 2 = 0")
    return _built(datasets.build_split(_images(spark, sf_dir), neg, "retrain", splits=kept, ratio=0.5), neg)


@register(f"SELECT 'img_' || o_orderkey || '.jpg' AS file_name FROM orders WHERE o_orderstatus = 'O' AND {_FIXED} = 'test'")
def test_negatives(spark, sf_dir):
    built = datasets.build_split(_images(spark, sf_dir), _negatives(spark, sf_dir), "fixed", splits=_split_file(spark, sf_dir))
    return built.filter("split = 'test' and has_annotation = 0").select("file_name")


@register("SELECT child_id, ['train', 'val'] AS splits FROM (SELECT DISTINCT o_custkey % 97 AS child_id FROM orders) WHERE child_id % 10 = 0".replace("['train', 'val'] AS splits", "'train,val' AS splits"))
def split_overlap(spark, sf_dir):
    from kithline.operators.splits import overlap_check

    ids = _images(spark, sf_dir).select("child_id").distinct()
    assigned = ids.withColumn("split", F.lit("train")).union(ids.filter("child_id % 10 = 0").withColumn("split", F.lit("val")))
    return overlap_check(assigned, "child_id").select("child_id", F.array_join("splits", ",").alias("splits"))


@register("SELECT 'img_' || o_orderkey || '.jpg' AS file_name, o_orderkey % 10 = 3 AS is_hard FROM orders WHERE o_orderstatus = 'O'")
def hard_flags(spark, sf_dir):
    neg = _negatives(spark, sf_dir)
    return datasets.flag_hard(neg.select("file_name"), neg.filter("is_hard").select("file_name"))


# Sinks


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'seed' END AS name FROM customer")
def seeded(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    seed = c.select("id", F.lit("seed").alias("name"))
    return sinks.insert_missing(c.filter("id % 2 = 0"), seed.union(seed), "id")


@register("SELECT kind, video_id, count(*) + count(*) FILTER (detection_id % 2 = 0) AS n FROM det GROUP BY ALL", "det")
def appended_detections(spark, sf_dir):
    d, path = A.detections(spark, sf_dir), fresh_path(spark, "detections")
    sinks.append(d, path)
    sinks.append(d.filter("detection_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("kind", "video_id").agg(F.count("*").alias("n"))


@register("SELECT video_id, frame, CASE WHEN video_id % 2 = 0 THEN 1 - has_kchi ELSE has_kchi END AS has_kchi FROM aud WHERE video_id % 2 = 1 OR (frame % 20 = 0 AND video_id % 6 > 0)", "aud")
def replaced_videos(spark, sf_dir):
    """The second run covers every second video and has no row for every sixth, which it so empties; a run that was stopped before its manifest changes nothing."""
    a, path = A.audio(spark, sf_dir).select("video_id", "frame", "has_kchi"), fresh_path(spark, "audio")
    versions.replace(a, path, "video_id")
    again = a.filter("video_id % 2 = 0").select("video_id").distinct()
    rows = a.filter("video_id % 2 = 0 and frame % 20 = 0 and video_id % 6 > 0").withColumn("has_kchi", 1 - F.col("has_kchi"))
    for _ in range(2):  # a repeated run changes nothing
        versions.replace(rows, path, "video_id", again)
    versions.stage(a.withColumn("has_kchi", F.lit(7)), path, "video_id")
    return versions.read(spark, path, "video_id").select("video_id", "frame", "has_kchi")


@register("SELECT l_linestatus || l_returnflag AS run_id, CAST(max(l_linenumber) AS INTEGER) AS fps, round(avg(l_discount), 6) AS proximity FROM lineitem GROUP BY ALL")
def run_records(spark, sf_dir):
    """A run for each status and flag of the line items, with parameters that their figures give."""
    path, li = fresh_path(spark, "runs"), A.read(spark, sf_dir, "lineitem")
    runs = li.groupBy(F.concat("l_linestatus", "l_returnflag").alias("run_id")).agg(F.max("l_linenumber").cast("int").alias("fps"), F.round(F.avg("l_discount"), 6).alias("proximity"))
    for r in runs.collect():  # a row for each pair of codes
        sinks.append(sinks.run_record(spark, r["run_id"], Params().but(fps=r["fps"], proximity=float(r["proximity"]))), path)
    return spark.read.parquet(path).select("run_id", F.get_json_object("params", "$.fps").cast("int").alias("fps"), F.get_json_object("params", "$.proximity").cast("double").alias("proximity"))


@register(f"SELECT label AS scope, unnest(['precision', 'recall', 'f1']) AS metric, unnest([round(precision, 6), round(recall, 6), round(f1, 6)]) AS value FROM ({_METRICS})", "sec", "gts")
def metrics_report(spark, sf_dir):
    m = evaluate.class_metrics(_seconds(spark, sf_dir), _spans(spark, sf_dir)[0])
    return sinks.metric_rows(m, "label", ["precision", "recall", "f1"]).select("scope", "metric", *_r("value"))


@register("SELECT count(*) AS n_rows, 0::BIGINT AS inversions, 0::BIGINT AS overlaps FROM st", "st")
def sorted_states(spark, sf_dir):
    path = fresh_path(spark, "sorted")
    sinks.write_sorted(analysis.states(spark, sf_dir, P).select("video_id", "frame", "state"), path, ["video_id", "frame"])
    return sinks.order_report(spark, path, ["video_id", "frame"])


@register("SELECT count(*) AS n_rows, 0::BIGINT AS inversions, 0::BIGINT AS overlaps FROM seg", "seg")
def sorted_segments(spark, sf_dir):
    path = fresh_path(spark, "sorted")
    sinks.write_sorted(segments.segment(analysis.states(spark, sf_dir, P), P), path, ["video_id", "segment_start"])
    return sinks.order_report(spark, path, ["video_id", "segment_start"])


_TRIALS = "SELECT l_suppkey AS trial, round(avg(l_discount), 6) AS macro_f1, round(avg(l_tax), 6) AS micro_f1, count(*) AS n FROM lineitem GROUP BY 1"


@register(f"SELECT trial, macro_f1, micro_f1, n, 'best' AS kind FROM (SELECT * FROM ({_TRIALS}) ORDER BY macro_f1 DESC, micro_f1 DESC, trial LIMIT 1) UNION ALL SELECT trial, macro_f1, micro_f1, n, 'all' FROM ({_TRIALS})")
def saved_trials(spark, sf_dir):
    t = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial")).agg(F.round(F.avg("l_discount"), 6).alias("macro_f1"), F.round(F.avg("l_tax"), 6).alias("micro_f1"), F.count("*").alias("n"))
    path = fresh_path(spark, "trials")
    sinks.save_trials(t, path)
    kinds = [spark.read.schema(t.schema).json(f"{path}/{k}").withColumn("kind", F.lit(k)) for k in ("best", "all")]
    return kinds[0].unionByName(kinds[1])


# Columns, joins, lists


@register("SELECT l_orderkey AS id, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS x1, l_linenumber AS y1, CAST(l_quantity AS INTEGER) + 5 AS x2, l_linenumber + 7 AS y2 FROM lineitem WHERE l_linenumber % 4 < 3")
def json_boxes(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    box = F.when(k % 4 == 3, "[1, 2]").otherwise(F.format_string("[%d, %d.4, %d, %d]", q, k, q + 5, k + 7))
    return files.annotation_boxes(A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), k.alias("line"), box.alias("bbox"))).select("id", "line", "x1", "y1", "x2", "y2")


@register("SELECT video_name, detection_id, CASE WHEN v.video_id % 40 = 1 AND v.video_id < 100 AND frame >= 500 THEN frame + 30 ELSE frame END AS frame FROM det d JOIN vid v USING (video_id)", "det", "vid")
def shifted_frames(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("video_id", "video_name")
    exceptions = v.filter("video_id % 40 = 1 and video_id < 100").select("video_name", F.lit(500).alias("start_frame"), F.lit(30).alias("shift"))
    return datasets.shift_frames(A.detections(spark, sf_dir).join(v, "video_id"), exceptions).select("video_name", "detection_id", "frame")


@register("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 END AS face_class, CASE WHEN c_custkey % 5 < 4 THEN 0 END AS only_class FROM customer")
def age_classes(spark, sf_dir):
    age = F.get(F.array(*[F.lit(a) for a in ("infant", "child", "teen", "adult", "other")]), (F.col("c_custkey") % 5).cast("int"))
    return A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), datasets.age_class(age, "face_binary").alias("face_class"), datasets.age_class(age, "face_only").alias("only_class"))


@register("SELECT video_id, frame FROM grid WHERE video_id % 40 IN (3, 5)", "grid")
def frames_of_some_children(spark, sf_dir):
    from kithline.operators import grid

    v = A.videos(spark, sf_dir).select("video_id", "child_id")
    frames = grid.dense_grid(A.videos(spark, sf_dir), P).join(v, "video_id")
    return datasets.frames_of_subjects(frames, v.filter("video_id % 40 in (3, 5)")).select("video_id", "frame")


@register("SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_partkey % 80 = 73")
def books_only(spark, sf_dir):
    p = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 80).alias("class_id"))
    return boxes.keep_classes(p, S.BOOK_CLASSES).select("id", "line")


@register("SELECT g.video_id, g.frame, s.state, seg.interaction_type FROM (SELECT video_id, frame + 7 AS frame, CAST(round_even(CAST(frame + 7 AS DOUBLE) / 30, 0) * 10 AS BIGINT) AS o FROM grid) g LEFT JOIN st s ON s.video_id = g.video_id AND s.frame = g.o LEFT JOIN seg ON seg.video_id = g.video_id AND g.o BETWEEN seg.segment_start AND seg.segment_end AND seg.segment_start % 10 < 10", "grid", "st", "seg")
def overlay_lookup(spark, sf_dir):
    from kithline.operators import grid

    found = analysis.states(spark, sf_dir, P).select("video_id", "frame", "state")
    shown = grid.dense_grid(A.videos(spark, sf_dir), P).withColumn("frame", F.col("frame") + 7)
    return intervals.overlay(shown, found, segments.segment(found, P), P).select("video_id", "frame", "state", "interaction_type")


@register("SELECT s_suppkey AS id, 'v_' || s_suppkey % 10 AS video_name, s_suppkey * 5 AS frame FROM supplier WHERE s_suppkey % 10 IN (1, 2) AND s_suppkey * 5 % 30 = 0 AND s_suppkey % 4 > 0")
def frames_by_path(spark, sf_dir):
    k = F.col("s_suppkey")
    folder = F.concat(F.lit("v_"), k % 10, F.when(k % 4 == 0, "0").otherwise(""))
    paths = A.read(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("/data/"), folder, F.format_string("/x_%06d.jpg", k * 5)).alias("path"))
    names = spark.createDataFrame([("v_1",), ("v_2",)], "video_name string")
    return files.frames_by_path(paths, names, 30).select("id", "video_name", "frame")


@register("SELECT k AS frame, truth, estimate, \"group\" FROM (SELECT l_orderkey AS k, arg_min(l_quantity, (l_linenumber, l_quantity, l_returnflag)) AS truth, arg_min(l_returnflag, (l_linenumber, l_quantity, l_returnflag)) AS \"group\" FROM lineitem GROUP BY 1) JOIN (SELECT o_orderkey AS k, o_totalprice AS estimate FROM orders WHERE o_orderkey % 3 > 0) USING (k)")
def truth_and_estimate(spark, sf_dir):
    t = A.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("truth"), F.col("l_returnflag").alias("group"), F.col("l_linenumber").alias("ordinal"))
    e = A.read(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("estimate"), F.lit(0).alias("ordinal"))
    return stats.truth_and_estimate(t, e.union(e), "frame", "estimate").select("frame", "truth", "estimate", "group")


@register("SELECT detection_id, video_name FROM det JOIN vid USING (video_id) WHERE video_id % 5 < 4", "det", "vid")
def ids_of_names(spark, sf_dir):
    v = A.videos(spark, sf_dir).select("video_id", "video_name")
    named = A.detections(spark, sf_dir).join(v, "video_id").select("detection_id", "video_name")
    found = files.with_ids(named, v.filter("video_id % 5 < 4"))
    return found.filter("video_id is not null").select("detection_id", "video_name")


@register("SELECT DISTINCT a.image_id, a.category_id, 'v_' || a.video_id AS video_name FROM (SELECT l_orderkey % 50 AS video_id, l_orderkey AS image_id, CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_partkey % 11 + 1 END AS INTEGER) AS category_id, l_linenumber % 5 = 0 AS outside FROM lineitem) a JOIN orders o ON o.o_orderkey = a.image_id WHERE NOT outside AND category_id IN (1, 10) AND a.video_id IN (3, 4)")
def truth_of_videos(spark, sf_dir):
    from kithline.plans.catalog import _annotations

    o = A.read(spark, sf_dir, "orders")
    images = o.select((F.col("o_orderkey") % 50).alias("video_id"), F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("img_"), "o_orderkey").alias("file_name"))
    videos = spark.range(50).select("id", F.concat(F.lit("v_"), "id").alias("file_name"))
    found = datasets.visible_annotations(_annotations(spark, sf_dir), images, videos, [1, 10], names=["v_3", "v_4"])
    return found.select("image_id", "category_id", "video_name").distinct()


# Thresholds, tops, windows

_TAU = [round(0.1 + 0.05 * k, 2) for k in range(17)]
_SWEEP = f"""SELECT threshold, tp, fp, fn, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM (SELECT threshold, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM (SELECT t.threshold, (SELECT count(*) FROM det WHERE kind = 'face') AS n_gt, count(pred_id) AS n_pred,
    count(DISTINCT CASE WHEN iou >= 0.5 THEN (video_id, frame, gt_id) END) AS tp FROM (SELECT unnest({_TAU})::DOUBLE AS threshold) t LEFT JOIN ({_BOX_BEST}) b ON b.conf >= t.threshold GROUP BY t.threshold))"""
_SWEPT = f"SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-8), 6) AS f1 FROM ({_SWEEP})"


@register(_SWEPT, "det")
def swept_thresholds(spark, sf_dir):
    return boxes.threshold_sweep(*_boxes(spark, sf_dir), thresholds=_TAU).select(*_r("threshold"), "tp", "fp", "fn", *_r("precision", "recall", "f1"))


@register(f"SELECT threshold, f1 FROM ({_SWEPT}) ORDER BY f1 DESC, threshold LIMIT 1", "det")
def chosen_threshold(spark, sf_dir):
    swept = boxes.threshold_sweep(*_boxes(spark, sf_dir), thresholds=_TAU).select(*_r("threshold", "f1"))
    return boxes.best_threshold(swept)


@register(f"SELECT video_id, frame, unnest(list_filter([CASE WHEN fp > 0 THEN 'false_positive' END, CASE WHEN fn > 0 THEN 'false_negative' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT video_id, frame, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn FROM (SELECT video_id, frame, count(*) AS n_gt FROM det WHERE kind = 'face' GROUP BY ALL) FULL JOIN (SELECT video_id, frame, count(*) AS n_pred, count(DISTINCT CASE WHEN iou >= 0.5 THEN gt_id END) AS tp FROM ({_BOX_BEST}) GROUP BY ALL) USING (video_id, frame))", "det")
def frames_with_errors(spark, sf_dir):
    return boxes.error_frames(boxes.match(*_boxes(spark, sf_dir), least_iou=0.5)).select("frame_id.*", "kind")


@register("SELECT video_id, max_frame FROM vid ORDER BY max_frame DESC, video_id LIMIT 5", "vid")
def top_videos(spark, sf_dir):
    return boxes.top_n(A.videos(spark, sf_dir).select("video_id", "max_frame"), "max_frame", 5, "video_id")


@register("SELECT count(*) AS videos, sum(max_frame) AS frames, round(sum(max_frame) / 30, 6) AS seconds FROM vid", "vid")
def total_duration(spark, sf_dir):
    return stats.total_duration(A.videos(spark, sf_dir), "max_frame", P.fps).select("videos", "frames", *_r("seconds"))


@register("""SELECT video_id, speaker, min(s) AS start, max(e) AS "end", arg_min(turn, (s, e, turn)) AS turn FROM (SELECT *, sum(st) OVER (PARTITION BY video_id, speaker ORDER BY s, e, turn ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id, speaker ORDER BY s, e, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS st FROM snip)) GROUP BY video_id, speaker, i""", "snip")
def merged_vocalizations_first_row(spark, sf_dir):
    return intervals.merge_overlaps(A.snippets(spark, sf_dir), ["video_id", "speaker"], keep=["turn"])


@register("SELECT g.video_id, g.sec AS second, coalesce(a.label, 'unannotated') AS a, coalesce(b.label, 'unannotated') AS b FROM (SELECT video_id, unnest(range(n)) AS sec FROM (SELECT video_id, CAST(floor(least(x, y)) AS BIGINT) AS n FROM (SELECT video_id, max(e) AS x FROM gts GROUP BY 1) JOIN (SELECT video_id, max(e) AS y FROM prs GROUP BY 1) USING (video_id))) g LEFT JOIN pg a USING (video_id, sec) LEFT JOIN ppw b USING (video_id, sec)".replace("ppw", "(SELECT video_id, sec, max_by(label, o) AS label FROM (SELECT video_id, label, o, unnest(range(CAST(round_even(s, 0) AS BIGINT), CAST(round_even(e, 0) AS BIGINT) + 1)) AS sec FROM prs) GROUP BY 1, 2)").replace("LEFT JOIN pg a", "LEFT JOIN (SELECT video_id, sec, max_by(label, o) AS label FROM (SELECT video_id, label, o, unnest(range(CAST(round_even(s, 0) AS BIGINT), CAST(round_even(e, 0) AS BIGINT) + 1)) AS sec FROM gts) GROUP BY 1, 2) a"), "gts", "prs")
def rater_seconds(spark, sf_dir):
    return evaluate.rater_seconds(*_spans(spark, sf_dir))


@register("SELECT video_id, frame FROM (SELECT video_id, frame, n, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k FROM grid JOIN (SELECT video_id, count(*) AS n FROM grid GROUP BY 1) USING (video_id)) WHERE k % 3 = 0 AND k >= 3 AND n >= 4", "grid")
def kept_window_ends(spark, sf_dir):
    from kithline.operators import grid

    return boxes.window_ends(grid.dense_grid(A.videos(spark, sf_dir), P), 4, 3).select("video_id", "frame")


@register("SELECT video_id, CAST(floor(k / 16) AS BIGINT) AS sequence, count(*) AS size, 16 AS n_features, 16 AS n_labels, (sum(has_kchi) - 100 * (16 - count(*)))::BIGINT AS labels FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k FROM fr) GROUP BY ALL", "fr")
def padded_label_sums(spark, sf_dir):
    f = analysis.frames(spark, sf_dir, P).select("video_id", "frame", F.array("presence_conf", "face_conf").alias("features"), "has_kchi")
    found = predict.padded_sequences(f, "features", "has_kchi", 16)
    return found.select("video_id", F.col("sequence").cast("long").alias("sequence"), "size", F.size("features").alias("n_features"), F.size("labels").alias("n_labels"), F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + x).alias("labels"))


# Hooks, orchestration, streams


def _brightness():
    """A stand-in for a detector: confidence from the frame's number."""
    return lambda batch: batch.assign(conf=(batch["frame"] % 70) / 70.0)[["video_id", "frame", "conf"]]


@register("SELECT video_id, frame, round(frame % 70 / 70, 6) AS conf FROM grid WHERE frame % 20 = 0", "grid")
def detected(spark, sf_dir):
    from kithline.operators import grid

    found = predict.detect(grid.dense_grid(A.videos(spark, sf_dir), P), _brightness, "video_id long, frame long, conf double", step=20)
    return found.select("video_id", "frame", *_r("conf"))


@register("SELECT video_id, frame, has_kchi, round(presence_conf, 6) AS presence_conf FROM fr WHERE video_id % 7 = 0", "fr")
def frames_of_some_videos(spark, sf_dir):
    some = A.videos(spark, sf_dir).filter("video_id % 7 = 0")
    return analysis.frames(spark, sf_dir, P, videos=some).select("video_id", "frame", "has_kchi", *_r("presence_conf"))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def ingested(spark, sf_dir):
    """Two runs of one stream with a checkpoint: the second takes up only what is new."""
    path, e = fresh_path(spark, "stream"), A.read(spark, sf_dir, "events").select("event_id", "event_type")
    for part in (0, 1):
        sinks.append(e.filter(F.col("event_id") % 2 == part), f"{path}/in")
        q = online.file_stream(spark, f"{path}/in", "event_id long, event_type string").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("event_type").agg(F.count("*").alias("n"))

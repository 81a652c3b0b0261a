"""Readers on small files of their formats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kithline.params import Params
from kithline.sources import files, sinks, versions


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rttm(spark, tmp_path):
    text = "SPEAKER v1.wav 1 0.5 1.0 <NA> <NA> KCHI <NA>\nSPEAKER v1.wav 1 x 1.0 <NA> <NA> KCHI <NA>\nSPEAKER v1 1 2 0 <NA> <NA> OHS <NA>\nOTHER v1 1 2 1 <NA> <NA> KCDS\nshort line\n\nSPEAKER v1 1 3 1 <NA> <NA> FEM <NA>\n"
    path = put(tmp_path, "a.rttm", text)
    assert rows(files.speech_rttm(spark, path)) == [("v1", 0.5, 1.5, 1.0, "KCHI")]
    assert rows(files.speech_rttm(spark, path, labels=("KCDS", "OHS"), strict=False).select("start", "speaker")) == [(2.0, "KCDS"), (2.0, "OHS")]
    assert files.speech_rttm(spark, path, labels=None, strict=False).count() == 4


def test_subjects(spark, tmp_path):
    path = put(tmp_path, "s.csv", "video_name;child_id;recording_date;age_at_recording;age_group\nv1; 7 ;03.02.2020;3,5;a\nv2;8;bad;x;b\n")
    got = files.subjects_csv(spark, path).collect()
    assert [(r["child_id"], str(r["recording_date"]), r["age_at_recording"]) for r in got] == [("7", "2020-02-03", 3.5), ("8", "None", None)]


def test_annotations(spark, tmp_path):
    path = put(tmp_path, "g.csv", "video_name;interaction_type;start_time_min;end_time_min;Unnamed: 4\nv1; Interacting ;00:00;01:30;\n;;;;\nv1;odd;0;1;\nv1;alone;01:30;x;\n")
    got = files.annotation_csv(spark, path).orderBy("ordinal").collect()
    assert [(r["label"], r["start_time"], r["end_time"]) for r in got] == [("interacting", "00:00", "01:30"), ("alone", "01:30", "x")]
    with pytest.raises(ValueError, match="missing"):
        files.annotation_csv(spark, put(tmp_path, "h.csv", "a;b\n1;2\n"))


def test_columns_with_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b int")
    assert files.non_null_columns(df) == ["a"]


def test_newest(spark, tmp_path):
    import os

    for k, name in enumerate(("b.csv", "a.csv")):
        os.utime(put(tmp_path, f"n/{name}", f"x\n{k}\n"), (1e9 + k, 1e9 + k))
    assert rows(files.newest_csv(spark, str(tmp_path / "n/*.csv"))) == [("1",)]
    with pytest.raises(Exception):  # noqa: B017
        files.newest_csv(spark, str(tmp_path / "none/*.csv")).count()


def test_json(spark, tmp_path):
    path = put(tmp_path, "p.json", '[{"image_id": "a", "category_id": 1}, {"image_id": "a", "category_id": 1}, {"image_id": "b", "category_id": 2}]')
    assert rows(files.predicted_images(spark, path)) == [("a",)]
    keyed = put(tmp_path, "k.json", '{"1_20_v_1.jpg": {"child": 1, "adult": 0}}')
    assert rows(files.keyed_labels(spark, keyed)) == [(1, 20, "v_1.jpg", "adult", 0), (1, 20, "v_1.jpg", "child", 1)]


def test_yolo(spark, tmp_path):
    put(tmp_path, "y/v_000010.txt", "0 0.5 0.5 0.1 0.2\nbad\n")
    put(tmp_path, "y/v_000020.txt", "")
    assert rows(files.yolo_labels(spark, str(tmp_path / "y"))) == [("v_000010", 0, 0.5, 0.5, 0.1, 0.2)]


def test_frame_files(spark, tmp_path):
    for name in ("f/v_1/v_1_000010.jpg", "f/v_1/v_1_000020.PNG", "f/v_1/notes.txt"):
        put(tmp_path, name, "x")
    assert rows(files.frame_files(spark, str(tmp_path / "f")).select("video_name", "frame")) == [("v_1", 10), ("v_1", 20)]


def test_lists(spark, tmp_path):
    names = files.name_list(spark, put(tmp_path, "l.txt", "a\n\n b \na\n"))
    df = spark.createDataFrame([("a",), ("c",)], "video_name string")
    assert rows(names) == [("a",), ("b",)]
    assert rows(files.select_names(df, names)) == [("a",)]
    assert rows(files.select_names(df, names.limit(0))) == [("a",), ("c",)]
    assert rows(files.unprocessed(df, names)) == [("c",)]


def test_split_file(spark, tmp_path):
    path = put(tmp_path, "split.txt", "Training IDs: 2, ['id1', 'id2']\nValidation IDs: 1, ['id3']\nTest IDs: 0, []\n")
    assert rows(files.split_file(spark, path)) == [("id1", "train"), ("id2", "train"), ("id3", "val")]


def test_cvat(spark, tmp_path):
    xml = '<annotations><meta><task><name>v1.mp4</name></task></meta><track label="face"><box frame="3" outside="0" xtl="1" ytl="2" xbr="3" ybr="4"><attribute name="Age">adult</attribute></box><box frame="4" outside="1" xtl="1" ytl="2" xbr="3" ybr="4"/></track><track label="odd"><box frame="5" outside="0" xtl="0" ytl="0" xbr="1" ybr="1"/></track></annotations>'
    got = {r["frame"]: r for r in files.cvat_tracks(spark, put(tmp_path, "x/a.xml", xml)).collect()}
    assert set(got) == {3, 4, 5} and got[3]["video_name"] == "v1" and got[3]["attributes"] == {"Age": "adult"}
    assert (got[3]["category_id"], got[5]["category_id"], got[5]["supercategory"]) == (10, -1, "noise")


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "k string, v int, o int")
    new = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("c", 4, 0), (None, 5, 0)], "k string, v int, o int")
    assert rows(sinks.upsert(old, new, "k", "o").select("k", "v")) == [("a", 3), ("b", 1), ("c", 4)]
    assert rows(sinks.insert_missing(old, new.filter("k is not null").dropDuplicates(["k"]), "k").select("k")) == [("a",), ("b",), ("c",)]


def test_partitioned_write_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 1), (2, 2)], "video_id long, v int")
    sinks.write_videos(df, path)
    sinks.write_videos(df.filter("video_id = 2").withColumn("v", F.lit(9)), path)
    assert rows(spark.read.parquet(path).select("video_id", "v")) == [(1, 1), (2, 9)]


def test_records(spark, tmp_path):
    assert '"fps": 30' in sinks.run_record(spark, "r", Params()).first()["params"]
    df = spark.createDataFrame([("x", 0.5, 1)], "label string, f1 double, n int")
    assert rows(sinks.metric_rows(df, "label", ["f1", "n"])) == [("x", "f1", 0.5), ("x", "n", 1.0)]
    sinks.mark_processed(spark.createDataFrame([("a",)], "name string"), str(tmp_path / "done"))
    assert rows(files.name_list(spark, str(tmp_path / "done"))) == [("a",)]


def test_versioned_commits(spark, tmp_path):
    """Commits replace whole keys, empty those that they cover without rows, and can't be seen before they are published."""
    path, schema = str(tmp_path), "video_id long, v int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    now = lambda at=None: sorted(map(tuple, versions.read(spark, path, "video_id", at).collect()))
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "video_id")
    assert versions.replace(rows((1, 1), (1, 2), (2, 3), (None, 9)), path, "video_id") == 0
    staged = versions.stage(rows((1, 7)), path, "video_id")  # stopped before its manifest
    assert now() == [(1, 1), (1, 2), (2, 3)]
    assert versions.replace(rows((3, 4), (2, 5)), path, "video_id", rows((1, 0), (2, 0)).select("video_id")) == 1
    assert now() == [(2, 5), (3, 4)] and now(0) == [(1, 1), (1, 2), (2, 3)]
    versions.replace(rows((3, 4), (2, 5)), path, "video_id")
    assert now() == [(2, 5), (3, 4)]
    (tmp_path / "manifests/3").mkdir()  # a manifest whose writing was stopped
    assert versions.version(spark, path) == 2 and now() == [(2, 5), (3, 4)]
    assert versions.publish(spark, path, "video_id", staged) == 4 and now() == [(1, 7), (2, 5), (3, 4)]
    versions.replace(rows(), path, "video_id", rows((2, 0), (3, 0)).select("video_id"))
    assert now() == [(1, 7)]
    assert len(versions.vacuum(spark, path)) == 4 and now() == [(1, 7)]
    versions.replace(rows(), path, "video_id", rows((1, 0)).select("video_id"))
    assert now() == [] and versions.read(spark, path, "video_id").columns == ["video_id", "v"]
    versions.vacuum(spark, path)
    assert now() == []

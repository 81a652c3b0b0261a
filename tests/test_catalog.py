"""Every query with SQL against DuckDB at the smallest scale; the others must run."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from kithline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple("" if v is None else (f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in row)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(key([r[c] for c in columns]) for r in got.collect())
    if name not in catalog.ORACLE_SQL:
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(key([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert rows == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_segments_tile(spark):
    """Segments of a video never overlap and leave no frame out between the first and the last."""
    rows = catalog.QUERIES["interaction_segments"](spark, SF).orderBy("video_id", "segment_start").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a["video_id"] == b["video_id"]:
            assert b["segment_start"] - a["segment_end"] in (1, 10) and a["interaction_type"] != b["interaction_type"]


def test_confusion_total(spark):
    n = catalog.QUERIES["evaluated_seconds"](spark, SF).filter("pred is not null").count()
    assert sum(r["n"] for r in catalog.QUERIES["confusion_matrix"](spark, SF).collect()) == n


def test_splits_are_disjoint(spark):
    from kithline.operators.splits import overlap_check

    assert overlap_check(catalog.QUERIES["balanced_split"](spark, SF), "child_id").count() == 0


def test_whole_boxes(spark, tmp_path):
    """Boxes of other videos at the same frame number never meet, and no video or frame is left out."""
    from datetime import datetime, timedelta

    rows = [(k, 50 + 7 * (k % 9), "purchase" if k % 3 else "signup", 10.0 * (k % 11), datetime(2024, 1, 1) + timedelta(hours=3 * (k // 20))) for k in range(120)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    box = lambda k, by: (k * 37 % 1800 + by, k * 53 % 900, k * 37 % 1800 + 10 + k * 7 % 400 + by, k * 53 % 900 + 10 + k * 11 % 380)
    faces = {k: (u, k // 20 * 10, box(k, 0)) for k, u, kind, _, _ in rows if kind == "purchase"}

    def iou(p, q):
        i = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return i / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - i)

    want = {}
    for k, u, *_ in rows:
        near = [(iou(box(k, k % 5 * 20), b), -g) for g, (v, f, b) in faces.items() if (v, f) == (u, k // 20 * 10)]
        best = max(near, default=None)
        want[k] = (u, k // 20 * 10, best and -best[1], best and pytest.approx(best[0], abs=1e-6))
    got = catalog.QUERIES["best_true_box"](spark, str(tmp_path)).collect()
    assert {r["pred_id"]: (r["video_id"], r["frame"], r["gt_id"], r["iou"]) for r in got} == want and len(got) == len(rows)
    matches = catalog.QUERIES["box_matches"](spark, str(tmp_path)).collect()
    assert sum(r["tp"] + r["fn"] for r in matches) == len(faces) and len(matches) == len({w[:2] for w in want.values()})
    assert {r["video_id"] for r in matches} == {r[1] for r in rows}


@pytest.mark.parametrize("name, column", [("sliding_windows", "video_id"), ("label_files", "file_name"), ("class_presence", "file_name"), ("hard_negatives", "file_name")])
def test_whole_tables(spark, name, column):
    """The query covers all keys of the tables."""
    from kithline import adapters as A

    d = A.detections(spark, SF)
    file = F.concat_ws("", F.lit("f"), "video_id", F.lit("_"), "frame").alias("file_name")
    keys = {
        "sliding_windows": A.videos(spark, SF).select("video_id"),
        "label_files": A.read(spark, SF, "lineitem").select(F.concat_ws("", F.lit("img_"), "l_orderkey").alias("file_name")),
        "class_presence": d.select(F.concat_ws("", F.lit("f"), "video_id").alias("file_name")),
        "hard_negatives": d.groupBy("video_id", "frame").agg(F.count_if(F.col("kind") == "face").alias("n")).filter("n = 0").select(file),
    }[name].distinct()
    got = catalog.QUERIES[name](spark, SF)
    if name == "class_presence":
        got = got.filter("has_annotation = 1")
    got = got.select(column).distinct()
    assert got.exceptAll(keys).count() == 0 and keys.exceptAll(got).count() == 0

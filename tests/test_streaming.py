"""Streams against their batch forms: late and repeated rows, silent videos, stopped runs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithline.operators import features, predict, sessions
from kithline.params import Params
from kithline.streaming import online

P = Params()
T0 = datetime(2024, 1, 1)
MS = 100.0  # of event time for each frame number
ROW = "video_id long, frame long, ts timestamp, presence_conf double, proximity double, face_conf double, has_kchi int, has_cds int, has_ohs int"


def drain(df, path, spark):
    """Runs the query on what there is, from where its checkpoint stands, and returns all it has written so far."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(df.schema).parquet(f"{path}/out").collect()


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def frames(seed, videos=6, n=140):
    """Dense frames of videos that begin at different times, with speech, faces and nulls."""
    rng, out = random.Random(seed), []
    for v in range(videos):
        mood = rng.random()
        for k in range(rng.randrange(5, n)):
            mood = rng.random() if rng.random() < 0.1 else mood
            flag = lambda: None if rng.random() < 0.03 else int(rng.random() < mood)
            out.append((v, 10 * k, at(v * 3000 + 10 * k * MS), rng.choice([None, 0.0, 0.35, 0.41, 0.9]), rng.choice([None, 0.3, 0.7]), rng.choice([0.0, 0.65, None]), flag(), flag(), flag()))
    return out


def put(spark, rows, path, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def clock(ms):
    return [(None, None, at(ms), *[None] * 6)]


def filled(spark, rows):
    return spark.createDataFrame(rows, ROW).fillna(0, ["has_kchi", "has_cds", "has_ohs"]).fillna(0.0, ["presence_conf", "face_conf"])


def test_bouts_of_shuffled_files(spark, tmp_path):
    """Five files in no order, one of them twice, nulls: as the batch form has it; nothing stays in the state."""
    rows = frames(1)
    shuffled = random.Random(2).sample(rows, len(rows))
    src = str(tmp_path / "src")
    for part in [*[shuffled[k::5] for k in range(5)], shuffled[1::5], [(None, 10, at(0), *[None] * 6), (1, None, at(0), *[None] * 6), (1, 10, None, *[None] * 6)], clock(10**8)]:
        put(spark, part, src)
    stream = online.online_bouts(online.file_stream(spark, src, ROW, maxFilesPerTrigger="1"), P, MS, late="1 hour")
    state = online.drain(stream, str(tmp_path / "c"))
    got = sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{tmp_path}/c/out").collect()))
    want = sorted(map(tuple, sessions.bouts(sessions.speech_islands(filled(spark, rows), P), P).collect()))
    assert got == want and len(want) > 3
    assert [s["numRowsTotal"] for s in state] == [0]


def test_bouts_end_without_end_rows(spark, tmp_path):
    """A video that falls silent gives its bout once the watermark is a gap past it, while others go on, over two runs; a late row changes nothing."""
    flags = lambda v, f, kchi, cds: (v, f, at(f * MS), None, None, None, kchi, cds, 0)
    src, path = str(tmp_path / "src"), str(tmp_path / "c")
    put(spark, [flags(1, 0, 1, 0), flags(1, 20, 0, 1), flags(2, 0, 1, 0)], src)
    put(spark, [flags(2, 100, 0, 1)], src)
    stream = lambda: online.online_bouts(online.file_stream(spark, src, ROW, maxFilesPerTrigger="1"), P, MS, late="1 second")
    online.drain(stream(), path)
    assert spark.read.schema(stream().schema).parquet(f"{path}/out").count() == 0
    put(spark, [flags(2, 350, 1, 0)], src)  # 240 frames after video 1's last
    online.drain(stream(), path)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect()) == [(1, 0, 20), (2, 0, 100)]
    put(spark, [flags(1, 30, 1, 0), flags(2, 2000, 0, 0)], src)  # the first is late
    state = online.drain(stream(), path)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/out").collect()) == [(1, 0, 20), (2, 0, 100)]
    assert [s["numRowsTotal"] for s in state] == [0]


@pytest.mark.parametrize("p", [P, P.but(presence_sec=2.5, short_memory_sec=0.0, long_memory_sec=3.0, sustained_sec=2.0)])
def test_features_of_shuffled_files(spark, tmp_path, p):
    rows = frames(3)
    shuffled = random.Random(4).sample(rows, len(rows))
    src = str(tmp_path / "src")
    for part in [*[shuffled[k::5] for k in range(5)], shuffled[2::5], clock(10**8)]:
        put(spark, part, src)
    stream = online.online_features(online.file_stream(spark, src, ROW, maxFilesPerTrigger="1"), p, idle=60, late="1 hour")
    state = online.drain(stream, str(tmp_path / "c"))
    key = lambda df: sorted((r["video_id"], r["frame"], round(r["presence_score"], 9), r["seen_recently"], r["sustained_kcds"], r["sustained_ohs"]) for r in df.collect())
    assert key(spark.read.schema(stream.schema).parquet(f"{tmp_path}/c/out")) == key(features.window_features(filled(spark, rows), p))
    assert [s["numRowsTotal"] for s in state] == [0]


def test_features_come_before_a_video_ends(spark, tmp_path):
    """A frame is given out once those behind it that its windows need are past the watermark."""
    src, path = str(tmp_path / "src"), str(tmp_path / "c")
    put(spark, [(1, 10 * k, at(10 * k * MS), 0.5, None, 0.0, 0, 0, 0) for k in range(20)], src)
    put(spark, [(1, 10 * k, at(10 * k * MS), 0.5, None, 0.0, 0, 0, 0) for k in range(20, 22)], src)
    stream = online.online_features(online.file_stream(spark, src, ROW, maxFilesPerTrigger="1"), P, idle=3600, late="0 seconds")
    state = online.drain(stream, path)
    behind = (P.window(P.short_memory_sec) - 1) // 2
    assert sorted(r["frame"] for r in spark.read.parquet(f"{path}/out").collect()) == [10 * k for k in range(22 - behind)]
    assert state[0]["numRowsTotal"] > 0


def test_presence_windows_and_late_rows(spark, tmp_path):
    """Sliding means of event time; a row behind the watermark is left out, nulls count but don't weigh."""
    schema = "ts timestamp, video_id long, presence_conf double"
    src = str(tmp_path / "src")
    put(spark, [(at(0), 1, 0.2), (at(1500), 1, 0.6), (at(1500), 1, None), (None, 1, 0.9)], src, schema)
    for ms in (60_000, 61_000):  # the watermark of the batch before holds
        put(spark, [(at(ms), 1, 0.5)], src, schema)
    put(spark, [(at(500), 1, 1.0), (at(90_000), None, 0.1)], src, schema)
    found = online.presence_windows(online.file_stream(spark, src, schema, maxFilesPerTrigger="1"))
    got = drain(found.select("video_id", F.unix_millis("start").alias("start"), F.round("score", 6).alias("score"), "n"), str(tmp_path / "c"), spark)
    first = min(r["start"] for r in got)
    early = sorted((r["start"] - first, r["score"], r["n"]) for r in got if r["video_id"] == 1 and r["start"] - first < 10_000)
    assert early == [(0, 0.2, 1), (1000, 0.4, 3), (2000, 0.6, 2)]


def test_sessions_and_resume(spark, tmp_path):
    schema = "ts timestamp, video_id long, speaker string"
    src = str(tmp_path / "src")
    put(spark, [(at(1000 * s), 1, "KCHI") for s in (0, 1, 10)] + [(at(100_000), 1, "KCHI"), (None, 1, "KCHI")], src, schema)
    s = online.speech_sessions(online.file_stream(spark, src, schema))
    assert sorted(r["n"] for r in drain(s, str(tmp_path / "c"), spark)) == [1, 2]
    put(spark, [(at(500_000), 1, "KCHI")], src, schema)
    put(spark, [(at(1_000), 1, "KCHI"), (at(900_000), None, None)], src, schema)  # the first is late
    again = drain(online.speech_sessions(online.file_stream(spark, src, schema, maxFilesPerTrigger="1")), str(tmp_path / "c"), spark)
    assert sorted(r["n"] for r in again) == [1, 1, 1, 2]


def test_ingest_counts_late_and_repeated_rows(spark, tmp_path):
    """A file that comes twice changes nothing; late rows are set aside; a batch that runs again leaves the same rows."""
    path, schema = str(tmp_path), "id long, ts timestamp, v string"
    batches = [
        [(1, at(0), "a"), (2, at(1000), "b"), (2, at(500), "first of two"), (None, at(0), "x"), (None, at(0), "x")],
        [(1, at(0), "a"), (2, at(1000), "b"), (3, at(20_000), "c"), (4, None, "no time")],
        [(5, at(9_999), "too late"), (5, at(10_000), "late"), (5, at(10_001), "in time"), (3, at(20_000), "c")],
    ]
    for again in (False, True):
        for k, rows in enumerate(batches):
            online.ingest(spark.createDataFrame(rows, schema), k, path, "id", 10.0)
            if not again and k == 1:
                online.ingest(spark.createDataFrame(rows, schema), k, path, "id", 10.0)
    read = lambda name: sorted(r["v"] for r in spark.read.parquet(f"{path}/{name}").collect())
    assert read("accepted") == ["a", "c", "first of two", "in time", "x", "x"]
    assert read("repeated") == ["a", "b", "b", "c"]
    assert read("late") == ["late", "no time", "too late"]


def test_detector_stopped_between_insert_and_log(spark, tmp_path, monkeypatch):
    """Each detection once, wherever a run stops; a video that comes again is skipped; names without id are set aside."""
    src, path, schema = str(tmp_path / "src"), str(tmp_path / "d"), "video_name string, frame long"
    ids = spark.createDataFrame([("a", 1), ("b", 2), ("b", 7), ("c", 3), (None, 9)], "video_name string, video_id long")
    for name in ("a", "b"):
        put(spark, [(name, f) for f in range(0, 60, 5)] + [("nobody", 0), (None, 0)], src, schema)
    stream = lambda: online.file_stream(spark, src, schema, maxFilesPerTrigger="1")
    model = lambda: lambda rows: pd.DataFrame({"video_id": rows["video_id"], "frame": rows["frame"]})
    real, calls = predict.log_videos, []

    def stops(batch, batch_id, where):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("stopped")
        real(batch, batch_id, where)

    monkeypatch.setattr(predict, "log_videos", stops)
    run = lambda: predict.detect_stream(stream(), path, ids, model, "video_id long, frame long")
    with pytest.raises(Exception, match="stopped"):
        run()
    found = lambda: sorted(map(tuple, predict.detections(spark, path, "video_id long, frame long").collect()))
    assert found() == [(1, f) for f in range(0, 60, 10)]  # what wasn't logged doesn't count
    put(spark, [("a", f) for f in range(0, 60, 5)], src, schema)
    put(spark, [("c", 0), ("c", 5)], src, schema)
    run()
    assert calls == [0, 1, 1, 2, 3]
    assert found() == sorted([(v, f) for v in (1, 2) for f in range(0, 60, 10)] + [(3, 0)])
    assert {r["video_name"] for r in spark.read.parquet(f"{path}/unknown").collect()} == {"nobody", None}


def test_window_features_of_one_video():
    empty = pd.DataFrame({c: pd.Series(dtype="float64") for c in ("frame", *online.MEASURED)})
    assert len(features.window_features_of(empty, P)) == 0


def test_videos_of_one_group(spark, tmp_path):
    """Videos that share a group, and large ids beside rows without video, keep their own bouts and windows."""
    big = 1 << 60
    rows = [(big + r[0], *r[1:]) for r in frames(5)]
    shuffled = random.Random(6).sample(rows, len(rows))
    src = str(tmp_path / "src")
    for part in [shuffled[::2] + clock(0), shuffled[1::2], clock(10**8)]:
        put(spark, part, src)
    stream = online.file_stream(spark, src, ROW, maxFilesPerTrigger="1")
    for name, operator, want in (
        ("b", lambda s: online.online_bouts(s, P, MS, late="1 hour", groups=2), sessions.bouts(sessions.speech_islands(filled(spark, rows), P), P)),
        ("f", lambda s: online.online_features(s, P, late="1 hour", groups=2).select("video_id", "frame", "seen_recently", "sustained_kcds"), features.window_features(filled(spark, rows), P).select("video_id", "frame", "seen_recently", "sustained_kcds")),
    ):
        state = online.drain(operator(stream), f"{tmp_path}/{name}")
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}/out").collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) > 3
        assert [s["numRowsTotal"] for s in state] == [0]


@pytest.mark.parametrize("operator", [lambda s: online.online_bouts(s, P, MS, late="1 hour", groups=3), lambda s: online.online_features(s, P, late="1 hour", groups=3)])
def test_state_rows_do_not_grow_with_frames(spark, tmp_path, operator):
    """What a batch leaves in the state store is a value and a time for each group, however many frames wait."""
    src = str(tmp_path / "src")
    put(spark, [(v, 10 * k, at(10 * k * MS), 0.5, None, 0.0, 1, 1, 0) for v in range(20) for k in range(50)], src)
    state = online.drain(operator(online.file_stream(spark, src, ROW)), str(tmp_path / "c"))
    assert state[0]["numRowsTotal"] <= 6

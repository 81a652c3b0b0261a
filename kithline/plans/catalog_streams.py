"""Queries over streams: each deals a table's rows into files that come one by one, and runs an operator over them with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline import adapters as A
from kithline.operators import predict
from kithline.operators.grid import dense_grid
from kithline.plans import analysis
from kithline.plans.catalog import P, _r, register
from kithline.sources import sinks
from kithline.sources.shared import fresh_path, written
from kithline.streaming import online

#: Milliseconds of event time from one frame number to the next: three hours for a step of ten.
FRAME_MS = 1_080_000.0
FILES = 5
#: The example's frames are shuffled over all files, so rows are waited for as long as the tables last.
LATE, IDLE_SECONDS = "400 days", 30 * 86_400.0


def deal(rows: DataFrame, path: str, parts: list[Column], run: Callable[[DataFrame], object]) -> DataFrame:
    """For each condition of parts, in their order, writes rows' files under path/in and runs the stream of that folder, which is returned, on what is new."""
    for part in parts:
        sinks.append(rows.filter(part), f"{path}/in")
        stream = online.file_stream(rows.sparkSession, f"{path}/in", online.ddl(rows))
        run(stream)
    return stream


def _timed_frames(spark, sf_dir) -> DataFrame:
    """Integrated frames with ts, and a row without video that is years later, as time goes on in a stream."""
    f = written(analysis.frames(spark, sf_dir, P), "frames")
    rows = f.select("video_id", "frame", F.timestamp_millis((F.col("frame") * int(FRAME_MS) + 1_704_067_200_000).cast("long")).alias("ts"), *online.MEASURED, "has_kchi")
    clock = spark.range(1).select(*[F.lit(None).cast(x.dataType).alias(x.name) if x.name != "ts" else F.timestamp_millis(F.lit(2_524_608_000_000)).alias("ts") for x in rows.schema.fields])
    return rows.unionByName(clock)


def _shuffled() -> list[Column]:
    by_hash = F.pmod(F.xxhash64("video_id", "frame"), F.lit(FILES))
    return [F.col("video_id").isNotNull() & (by_hash == k) for k in range(FILES)] + [F.col("video_id").isNull()]


def _drained(spark, sf_dir, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    path = fresh_path(spark, "stream")
    stream = deal(_timed_frames(spark, sf_dir), path, _shuffled(), lambda rows: online.drain(operator(rows), path))
    return spark.read.schema(operator(stream).schema).parquet(f"{path}/out")


@register("SELECT video_id, a AS start, b AS \"end\" FROM bouts", "bouts")
def streamed_bouts(spark, sf_dir):
    """Bouts of frames that come in five files in no order."""
    return _drained(spark, sf_dir, lambda s: online.online_bouts(s, P, FRAME_MS, LATE))


@register("SELECT video_id, frame, round(presence_score, 6) AS presence_score, seen_recently, sustained_kcds, sustained_ohs FROM feat", "feat")
def streamed_features(spark, sf_dir):
    """Row windows of frames that come in five files in no order."""
    found = _drained(spark, sf_dir, lambda s: online.online_features(s, P, IDLE_SECONDS, LATE))
    return found.select("video_id", "frame", *_r("presence_score"), "seen_recently", "sustained_kcds", "sustained_ohs")


_LATE_DAYS = 20


@register(
    f"""WITH f AS (SELECT event_id, event_type, ts, event_id % {FILES} AS k FROM events UNION ALL SELECT event_id, event_type, ts, {FILES} FROM events WHERE event_id % {FILES} = 1),
    m AS (SELECT k, max(ts) AS high FROM f GROUP BY k), w AS (SELECT a.k, max(b.high) - INTERVAL {_LATE_DAYS} DAY AS mark FROM m a LEFT JOIN m b ON b.k < a.k GROUP BY a.k),
    o AS (SELECT event_type, CASE WHEN ts <= mark THEN 'late' WHEN k = {FILES} THEN 'repeated' ELSE 'accepted' END AS outcome FROM f JOIN w USING (k)) SELECT outcome, event_type, count(*) AS n FROM o GROUP BY ALL"""
)
def ingested_events(spark, sf_dir):
    """Five files that each span all of time, and the second one again: what is accepted, repeated and too late, counted."""
    path, e = fresh_path(spark, "stream"), A.read(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    rows = e.select("event_id", "event_type", F.timestamp_micros(micros).alias("ts"))
    own = F.col("event_id") % FILES
    deal(rows, path, [own == k for k in (*range(FILES), 1)], lambda stream: online.ingest_stream(stream, path, "event_id", _LATE_DAYS * 86_400.0))
    kinds = [spark.read.schema(online.ddl(rows)).parquet(f"{path}/{name}").select(F.lit(name).alias("outcome"), "event_type") for name in ("accepted", "repeated", "late")]
    return kinds[0].union(kinds[1]).union(kinds[2]).groupBy("outcome", "event_type").agg(F.count("*").alias("n"))


DETECTION = "video_id long, frame long, conf double"


def _load() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in for a model: one detection a frame."""
    return lambda rows: pd.DataFrame({"video_id": rows["video_id"], "frame": rows["frame"], "conf": rows["frame"] % 100 / 100})


@register("SELECT video_id, frame, round((frame % 100) / 100, 6) AS conf FROM grid JOIN vid USING (video_id) WHERE frame % 20 = 0", "grid", "vid")
def detected_stream(spark, sf_dir):
    """A detector over frames of named videos; the first file's videos come again and are skipped, and a name without id finds nothing."""
    path, videos = fresh_path(spark, "detector"), A.videos(spark, sf_dir)
    rows = written(dense_grid(videos, P).join(videos.select("video_id", "video_name"), "video_id").select("video_name", "frame"), "named-frames")
    rows = rows.union(spark.createDataFrame([("nobody", 0)], "video_name string, frame long"))
    own = F.pmod(F.xxhash64("video_name"), F.lit(3))
    deal(rows, path, [own == 0, own == 1, own == 0, own == 2], lambda stream: predict.detect_stream(stream, path, videos.select("video_name", "video_id"), _load, DETECTION, step=20))
    return predict.detections(spark, path, DETECTION).select("video_id", "frame", *_r("conf"))

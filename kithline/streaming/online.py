"""Streaming forms: resumable ingest, event-time de-duplication, speech sessions, bouts and row windows with timers.

Spark's stateful operators hold a batch's rows against the watermark of the
batch before and drop those at or before it, uncounted by key; ``ingest`` holds
them against all batches before, sets the late ones aside and counts them.

Bouts and row windows hold a video's rows until the watermark has passed them,
as only then their order is known, and set a timer for the time by which the
video must have gone on. A video that falls silent so ends by itself, and
nothing of it stays in the state store. Videos are dealt into groups by hash:
a group's new rows are one value in the state store, and all its videos are
worked on together, so neither calls nor values grow with a video's rows. Both
need a state store that keeps its rows on disk (``stored_on_disk``).
"""

from __future__ import annotations

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kithline.operators.features import window_features_of
from kithline.params import Params
from kithline.sources import sinks


def file_stream(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """New Parquet files of a folder; the query's checkpoint remembers which were read, so a stopped run goes on where it was."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


@contextlib.contextmanager
def stored_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, own)


def drain(stream: DataFrame, path: str) -> list[dict]:
    """Runs stream on all there is, from where path/state stands, appending its rows to path/out; the state operators' last figures."""
    with stored_on_disk(stream.sparkSession):
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    return [dict(o) if isinstance(o, dict) else o.jsonValue for o in (last["stateOperators"] if last else [])]


def speech_sessions(speech: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """video_id, speaker, start, end, n of runs of one speaker's utterances (column ts) with gaps under ``gap``.

    Utterances of one null video or speaker are a group of their own; those
    without ts are left out. Rows that come late are left out (see ``ingest``).
    """
    s = speech.filter("ts is not null").withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "video_id", "speaker").agg(F.count("*").alias("n"))
    return s.select("video_id", "speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def presence_windows(frames: DataFrame, width: str = "2 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """video_id, start, score, n: mean presence over sliding windows of event time; nulls count in n, not in the mean; late rows and rows without ts are left out."""
    s = frames.filter("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "video_id").agg(F.avg("presence_conf").alias("score"), F.count("*").alias("n"))
    return s.select("video_id", F.col("w.start").alias("start"), "score", "n")


# Ingest: late rows and repeated ones


def ingest(batch: DataFrame, batch_id: int, path: str, key: str, late_seconds: float) -> None:
    """A micro-batch (foreachBatch) of rows with ``ts`` and ``key``, dealt into path/accepted, path/late and path/repeated by batch.

    The watermark is the latest ts of the batches before, less late_seconds. A
    row at or before it, or without ts, is late. Of rows of one key within
    the watermark's horizon the first by ts (then by a hash of all columns) is accepted, the others are
    repeated; rows without key are all accepted. What a batch writes is
    replaced if it runs again, so a restarted query leaves the same rows.
    """
    spark = batch.sparkSession
    high = sinks.read_or_empty(spark, f"{path}/high", "ts timestamp, batch long").filter(F.col("batch") < batch_id).agg(F.max("ts")).first()[0]
    mark = F.lit(high).cast("timestamp") - F.make_dt_interval(secs=F.lit(late_seconds))
    rows = batch.withColumn("late", F.col("ts").isNull() | (F.coalesce(F.col("ts") <= mark, F.lit(False))))
    rows.persist()
    try:
        on_time = rows.filter("not late").drop("late")
        known = sinks.read_or_empty(spark, f"{path}/accepted", f"{ddl(batch)}, batch long").filter((F.col("batch") < batch_id) & F.coalesce(F.col("ts") > mark, F.lit(True)))
        place = F.row_number().over(Window.partitionBy(key).orderBy("ts", F.xxhash64(*on_time.columns)))
        first = on_time.withColumn("place", F.when(F.col(key).isNull(), 1).otherwise(place)).join(known.select(F.col(key).alias("_known")).distinct(), F.col(key) == F.col("_known"), "left")
        accepted = (F.col("place") == 1) & F.col("_known").isNull()
        for name, part in (("accepted", first.filter(accepted)), ("repeated", first.filter(~accepted)), ("late", rows.filter("late"))):
            part.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        rows.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{path}/high/batch={batch_id}")
    finally:
        rows.unpersist()


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def ingest_stream(stream: DataFrame, path: str, key: str, late_seconds: float) -> None:
    """All there is of stream through ``ingest``, from where path/state stands."""
    q = stream.writeStream.foreachBatch(lambda b, k: ingest(b, k, path, key, late_seconds)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


class _Grouped(StatefulProcessor):
    """Rows of a group of videos, held as blocks of one NumPy type.

    New rows are appended as a block and nothing is read until the time at
    which a row of the group can change what is known. ``advance`` then gets
    all that is held and the watermark, and gives what is known now, what is
    still held and the time at which that can change (null: nothing is held).
    """

    held: np.dtype

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getListState("blocks", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def placed(self, rows: pd.DataFrame) -> np.ndarray:
        """The rows of held's type that a table of new rows, all with video and frame, stands for; with times ``ms``."""
        raise NotImplementedError

    def advance(self, rows: np.ndarray, mark: int) -> tuple[pd.DataFrame, np.ndarray, float | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for table in rows:
            new = self.placed(table[table["placed"].to_numpy(bool)])
            if len(new):
                self.blocks.appendValue((new.tobytes(),))
                ms = math.ceil(new["ms"].min())
                first = ms if first is None else min(ms, first)
        if first is not None and (not self.due.exists() or first < self.due.get()[0]):
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] > mark:
            return  # an earlier timer
        out, keep, due = self.advance(np.frombuffer(b"".join(bytes(r[0]) for r in self.blocks.get()), self.held), mark)
        if due is None:
            self.blocks.clear()
            self.due.clear()
        else:
            self.blocks.put([(keep.tobytes(),)])
            self._wake(max(math.ceil(due), mark + 1))
        if len(out):
            yield out

    def _wake(self, ms: int) -> None:
        self.due.update((ms,))
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


#: Groups that the videos of a stream are dealt into by hash; a group's rows are held and given out together.
GROUPS = 4096


def _grouped(frames: DataFrame, late: str, groups: int, columns: list[Column]):
    """frames with ts, by group: columns, video_id, frame, ms (exact) and whether the row has a video and a frame."""
    known = F.col("video_id").isNotNull() & F.col("frame").isNotNull()
    keys = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("video_id", "frame")]
    group = F.pmod(F.xxhash64("video_id"), F.lit(groups)).alias("group")
    rows = frames.filter("ts is not null").select(group, *keys, known.alias("placed"), (F.unix_micros("ts") / 1000).alias("ms"), "ts", *columns)
    return rows.withWatermark("ts", late).groupBy("group")


# Bouts

BOUT = "video_id long, start long, end long"
KINDS = ("has_kchi", "has_cds")


class _Bouts(_Grouped):
    """Speech frames of videos to bouts. Frames wait for the watermark, islands for those that began before them, and the running bout for its longest gap.

    A held row is a frame or an island of one kind, or a running bout with the kinds it holds as bits (RUN and more).
    """

    RUN = 4
    held = np.dtype([("video", "<i8"), ("ms", "<f8"), ("kind", "<i8"), ("start", "<i8"), ("end", "<i8")])

    def __init__(self, p: Params, frame_ms: float):
        self.p, self.frame_ms = p, frame_ms
        self.turn, self.same = p.turn_gap_sec * p.fps, p.same_gap_sec * p.fps

    def placed(self, rows: pd.DataFrame) -> np.ndarray:
        parts = []
        for kind, flag in enumerate(KINDS):
            own = rows[rows[flag] == 1]
            part = np.zeros(len(own), self.held)
            part["video"], part["ms"], part["kind"] = own["video_id"], own["ms"], kind
            part["start"] = part["end"] = own["frame"]
            parts.append(part)
        return np.concatenate(parts)

    def advance(self, rows: np.ndarray, mark: int) -> tuple[pd.DataFrame, np.ndarray, float | None]:
        step, longest = self.p.step, max(self.turn, self.same)
        videos, at, own = np.unique(rows["video"], return_index=True, return_inverse=True)
        zero = rows["ms"][at] - rows["start"][at] * self.frame_ms  # the time of frame 0
        seen = (mark - zero) // self.frame_ms if mark > 0 else np.full(len(zero), -1.0)  # all frames up to this one are there
        running = rows["kind"] >= self.RUN
        waits = ~running & (rows["start"] > seen[own])
        waiting, islands = rows[waits], self._islands(rows[~running & ~waits])
        own = np.searchsorted(videos, islands["video"])
        growing = islands["end"] + step > seen[own]
        behind = np.cumsum(growing)  # of an earlier start in its video one is growing, or it is itself
        first = np.searchsorted(own, np.arange(len(videos)))
        before = np.append(0, behind)[first]
        over = behind == before[own]
        left = np.bincount(own[~over], minlength=len(videos)) > 0
        runs = {r[0]: [r[3], r[4], bool(r[2] & 1), bool(r[2] & 2)] for r in rows[running].tolist()}
        out: list[tuple] = []
        for video, _, kind, start, end in islands[over].tolist():
            run = runs.get(video)
            if run is not None and start - run[1] <= (self.same if run[2 + kind] else self.turn):
                run[1], run[2 + kind] = end, True
                continue
            self._close(out, video, run)
            runs[video] = [start, end, kind == 0, kind == 1]
        due, keep = [zero[np.searchsorted(videos, waiting["video"])] + waiting["start"] * self.frame_ms, (zero[own] + (islands["end"] + step) * self.frame_ms)[growing]], []
        for video, run in runs.items():
            k = int(np.searchsorted(videos, video))
            if not left[k] and seen[k] >= run[1] + longest:
                self._close(out, video, run)
                continue
            keep.append((video, zero[k] + run[0] * self.frame_ms, self.RUN + run[2] + 2 * run[3], run[0], run[1]))
            if not left[k]:
                due.append([zero[k] + (run[1] + longest) * self.frame_ms])
        found = pd.DataFrame(out, columns=["video_id", "start", "end"])
        times = np.concatenate(due)
        return found, np.concatenate([np.array(keep, self.held), islands[~over], waiting]), times.min() if len(times) else None

    def _islands(self, pieces: np.ndarray) -> np.ndarray:
        """Pieces (frames, islands) of one kind that are at most a step apart as one, by video, start and kind."""
        pieces = pieces[np.lexsort((pieces["end"], pieces["start"], pieces["kind"], pieces["video"]))]
        if not len(pieces):
            return pieces
        apart = (pieces["video"][1:] != pieces["video"][:-1]) | (pieces["kind"][1:] != pieces["kind"][:-1]) | (pieces["start"][1:] - pieces["end"][:-1] > self.p.step)
        begins = np.flatnonzero(np.append(True, apart))
        islands = pieces[begins]
        islands["end"] = np.maximum.reduceat(pieces["end"], begins)
        return islands[np.lexsort((islands["kind"], islands["start"], islands["video"]))]

    @staticmethod
    def _close(out: list[tuple], video: int, run: list | None) -> None:
        if run is not None and run[2] and run[3]:
            out.append((video, run[0], run[1]))


def online_bouts(frames: DataFrame, p: Params, frame_ms: float, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """Turn-taking bouts (video_id, start, end) of a stream of frames (video_id, frame, ts, has_kchi, has_cds), each as soon as no row can change it.

    Equal to ``sessions.bouts`` over the islands of the rows that weren't late,
    in whatever order they come; repeated rows change nothing. ts must be a
    video's time of frame 0 plus frame_ms for each frame. Rows without ts are
    left out, those without video or frame only move time on; null flags are 0.
    """
    rows = _grouped(frames, late, groups, [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in KINDS])
    return rows.transformWithStateInPandas(_Bouts(p, frame_ms), BOUT, "append", "EventTime")


# Row windows

FEATURES = "presence_score double, seen_recently boolean, sustained_kcds boolean, sustained_ohs boolean"
MEASURED = ("presence_conf", "proximity", "face_conf", "has_cds", "has_ohs")


class _RowWindows(_Grouped):
    """The last frames of videos in order, and those that wait for the watermark or for the frames behind them."""

    held = np.dtype([("video", "<i8"), ("ms", "<f8"), ("frame", "<i8"), *[(c, "<f8") for c in MEASURED], ("done", "?")])

    def __init__(self, p: Params, idle_ms: int):
        self.p, self.idle_ms = p, idle_ms
        widths = [p.window(s) for s in (p.presence_sec, p.short_memory_sec, p.long_memory_sec)]
        self.before = max([w // 2 for w in widths] + [p.window(p.sustained_sec) - 1])
        self.behind = max(0, *[(w - 1) // 2 for w in widths])

    def placed(self, rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), self.held)
        new["video"] = rows["video_id"]
        for c in ("ms", "frame", *MEASURED):
            new[c] = rows[c]
        return new

    def advance(self, rows: np.ndarray, mark: int) -> tuple[pd.DataFrame, np.ndarray, float | None]:
        videos, own = np.unique(rows["video"], return_inverse=True)
        last = np.full(len(videos), -np.inf)
        np.maximum.at(last, own, rows["ms"])
        over = last + self.idle_ms <= mark  # such a video has ended
        waits = rows["ms"] > mark
        waiting, known = rows[waits], rows[~waits]
        known = known[np.lexsort((known["frame"], known["video"]))]  # in a stable order: of a repeated frame the first that came
        known = known[np.append(True, (known["video"][1:] != known["video"][:-1]) | (known["frame"][1:] != known["frame"][:-1]))[: len(known)]]
        own = np.searchsorted(videos, known["video"])
        sizes = np.bincount(own, minlength=len(videos))
        place = np.arange(len(known)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        full = np.where(over, sizes, np.maximum(0, sizes - self.behind))[own]
        out = window_features_of(pd.DataFrame({c: known[c] for c in ("frame", *MEASURED)}), self.p, known["video"])
        out.insert(0, "video_id", known["video"])
        out = out[(place < full) & ~known["done"]]
        known["done"] |= place < full
        keep = np.concatenate([known[(place >= full - self.before) & ~over[own]], waiting])
        due = np.concatenate([waiting["ms"], last[~over] + self.idle_ms])
        return out, keep, due.min() if len(due) else None


def online_features(frames: DataFrame, p: Params, idle: float = 60.0, late: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """video_id, frame and the features of ``features.window_features`` of a stream of frames, each once its following rows are there.

    A video ends when the watermark is ``idle`` seconds past its last frame;
    its windows are then cut there as they are in the batch form. The rows that weren't late give what
    the batch form gives for them; of rows that repeat a frame the first that
    came counts. Rows without ts are left out, those without video or frame only
    move time on; null flags and confidences are 0, a null proximity is none.
    """
    rows = _grouped(frames, late, groups, [F.col(c).cast("double").alias(c) if c == "proximity" else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in MEASURED])
    return rows.transformWithStateInPandas(_RowWindows(p, int(idle * 1000)), f"video_id long, frame long, {FEATURES}", "append", "EventTime")

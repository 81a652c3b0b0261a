"""Temporal features over each video's frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.params import Params


def _frames() -> Window:
    return Window.partitionBy("video_id").orderBy("frame")


def centred(value: Column, width: int, how=F.max) -> Column:
    """An aggregate over a centred window of ``width`` rows, cut at the ends; an even one reaches one row further back. 0 rows: 0."""
    if width <= 0:
        return F.lit(0)
    return how(value).over(_frames().rowsBetween(-(width // 2), (width - 1) // 2))


def sustained(flag: str, width: int, share: float) -> Column:
    """Whether a 0/1 flag holds in ``share`` of the last ``width`` rows; false until there are so many."""
    rows = _frames().rowsBetween(1 - width, 0)
    return (F.count("*").over(rows) == width) & (F.sum(flag).over(rows) >= share * width)


def anchored(p: Params) -> Column:
    """1 if a frame's face is close or sure enough to be remembered for long."""
    return (F.coalesce(F.col("proximity") > p.anchor_proximity, F.lit(False)) | (F.col("face_conf") > p.anchor_face)).cast("int")


def window_features(frames: DataFrame, p: Params) -> DataFrame:
    """presence_score, seen_recently, sustained_kcds, sustained_ohs. All windows share one exchange and sort."""
    anchor = anchored(p)
    score = centred(F.col("presence_conf"), p.window(p.presence_sec), F.avg)
    long_memory = centred(anchor, p.window(p.long_memory_sec)) == 1
    short_memory = centred(F.col("presence_conf"), p.window(p.short_memory_sec)) >= p.instant_confidence
    width = p.window(p.sustained_sec)
    return frames.withColumns({"presence_score": score, "seen_recently": long_memory | short_memory, "sustained_kcds": sustained("has_cds", width, p.kcds_share), "sustained_ohs": sustained("has_ohs", width, p.ohs_share)})


def window_features_of(frames: pd.DataFrame, p: Params, videos: np.ndarray | None = None) -> pd.DataFrame:
    """frame and the four features of frames in order, as ``window_features`` has them; for streams, whose windows can't count rows.

    videos: each row's video, the rows of one standing together; without it they are of one video.
    """
    n = len(frames)
    place = np.arange(n)
    begins = np.flatnonzero(np.append(True, videos[1:] != videos[:-1])[:n]) if videos is not None else np.zeros(min(n, 1), np.int64)
    sizes = np.diff(np.append(begins, n))
    first, end = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)

    def over(how: np.ufunc, values: np.ndarray, back: int, ahead: int) -> np.ndarray:
        spans = np.stack([np.maximum(first, place - back), np.minimum(end, place + ahead + 1)], axis=1)
        return how.reduceat(np.append(values, 0.0), spans.ravel())[::2] if n else values

    def centre(how: np.ufunc, values: np.ndarray, seconds: float) -> np.ndarray:
        width = p.window(seconds)
        return over(how, values, width // 2, (width - 1) // 2) if width > 0 else values * 0

    def held(flag: str, share: float) -> np.ndarray:
        width = p.window(p.sustained_sec)
        if width <= 0:
            return np.full(n, share <= 0)
        return (place - first + 1 >= width) & (over(np.add, frames[flag].to_numpy("float64"), width - 1, 0) >= share * width)

    presence = frames["presence_conf"].to_numpy("float64")
    anchor = ((frames["proximity"] > p.anchor_proximity) | (frames["face_conf"] > p.anchor_face)).to_numpy("float64")
    seen = (centre(np.maximum, anchor, p.long_memory_sec) == 1) | (centre(np.maximum, presence, p.short_memory_sec) >= p.instant_confidence)
    width = p.window(p.presence_sec)
    rows = np.maximum(1, np.minimum(end, place + (width - 1) // 2 + 1) - np.maximum(first, place - width // 2))
    return pd.DataFrame({"frame": frames["frame"].to_numpy("int64"), "presence_score": centre(np.add, presence, p.presence_sec) / rows, "seen_recently": seen, "sustained_kcds": held("has_cds", p.kcds_share), "sustained_ohs": held("has_ohs", p.ohs_share)})

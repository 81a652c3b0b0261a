"""Change-point smoothing of frame states.

Change points of a video's presence score come from penalised least squares
with pruning (PELT; Killick, Fearnhead and Eckley 2012), in numpy, one video at
a time: the one operator here whose recurrence built-in functions can't state.
The vote within each regime is a plain aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kithline.params import ALONE, AVAILABLE, INTERACTING, Params


def change_points(signal: np.ndarray, penalty: float, least: int = 2, jump: int = 5) -> list[int]:
    """Ends of the regimes of a signal, the last being its length; regimes begin at multiples of jump and hold ``least`` values or more."""
    n = len(signal)
    if n == 0:
        return []
    s, q = np.concatenate([[0.0], np.cumsum(signal)]), np.concatenate([[0.0], np.cumsum(signal**2)])
    ends = [t for t in range(0, n, jump) if t >= least] + [n]
    best, came_from = {0: 0.0}, {}
    open_starts = [0]
    for t in ends:
        starts = np.array([u for u in open_starts if t - u >= least], dtype=np.int64)
        if not len(starts):
            continue
        cost = q[t] - q[starts] - (s[t] - s[starts]) ** 2 / (t - starts)
        total = np.array([best[u] for u in starts]) + cost + penalty
        k = int(total.argmin())
        best[t], came_from[t] = float(total[k]), int(starts[k])
        dead = {int(u) for u, v in zip(starts, total, strict=True) if v > best[t] + penalty}
        open_starts = [u for u in open_starts if u not in dead] + [t]
    if n not in came_from:
        return [n]
    out, t = [], n
    while t:
        out.append(t)
        t = came_from[t]
    return out[::-1]


def regimes(frames: DataFrame, p: Params) -> DataFrame:
    """frames with ``regime``, numbered from 0 within each video.

    All columns go through the kernel, so frames are evaluated once. A task
    holds one video's frames as an Arrow table (three rows a second of it).
    """
    schema = StructType([*frames.schema.fields, StructField("regime", LongType())])

    def of(video: pa.Table) -> pa.Table:
        video = video.sort_by("frame")
        ends = change_points(video["presence_score"].to_numpy(), p.cpd_penalty)
        regime = np.searchsorted(np.array(ends), np.arange(len(video)), side="right")
        return video.append_column("regime", pa.array(regime, pa.int64()))

    return frames.groupBy("video_id").applyInArrow(of, schema)


def vote(frames: DataFrame, p: Params) -> DataFrame:
    """frames (with regime) and smoothed: each regime's state by the shares of its states and whether any rule fired in it."""
    w = Window.partitionBy("video_id", "regime")
    engaged = F.avg((F.col("state") == INTERACTING).cast("double")).over(w)
    present = F.avg((F.col("state") <= AVAILABLE).cast("double")).over(w)
    fired = F.bool_or(F.col("rule_turn_taking") | F.col("rule_proximity") | F.col("rule_sustained_speech")).over(w)
    state = F.when((fired & (engaged >= p.cpd_interacting_low)) | (engaged >= p.cpd_interacting), INTERACTING).when(present >= p.cpd_presence, AVAILABLE).otherwise(ALONE)
    return frames.withColumn("smoothed", state)

"""The whole analysis as lazy plans: frames, states, segments, evaluation, parameter search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline import adapters
from kithline.functions import scalars
from kithline.operators import changepoint, evaluate, features, observations, segments, sessions
from kithline.operators.classify import classify
from kithline.operators.grid import dense_grid
from kithline.params import AVAILABLE, INTERACTING, Params
from kithline.sources import sinks

#: The columns of integrated frames that a state depends on.
READ = ("presence_conf", "face_conf", "proximity", "has_kchi", "has_cds", "has_ohs")


def frames(spark: SparkSession, sf_dir: str, p: Params | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Integrated observations on the grid; videos: of these only."""
    p = p or Params()
    chosen = adapters.videos(spark, sf_dir)
    chosen = chosen.join(videos.select("video_id"), "video_id", "left_semi") if videos is not None else chosen
    return observations.integrate(dense_grid(chosen, p), adapters.detections(spark, sf_dir), adapters.books(spark, sf_dir), adapters.audio(spark, sf_dir), p)


def states(spark: SparkSession, sf_dir: str, p: Params | None = None) -> DataFrame:
    p = p or Params()
    return classify(frames(spark, sf_dir, p), p)


def smoothed_states(spark: SparkSession, sf_dir: str, p: Params | None = None) -> DataFrame:
    p = p or Params()
    return changepoint.vote(changepoint.regimes(states(spark, sf_dir, p), p), p)


def run(spark: SparkSession, sf_dir: str, p: Params | None = None, smooth: bool = False) -> DataFrame:
    """Segments with subjects, from observations to the end in one plan."""
    p = p or Params()
    found = smoothed_states(spark, sf_dir, p) if smooth else states(spark, sf_dir, p)
    return segments.with_subjects(segments.segment(found, p, "smoothed" if smooth else "state"), adapters.videos(spark, sf_dir))


def trial_states(observed: DataFrame, trials: list[Params], keep: Column | None = None) -> DataFrame:
    """observed (integrated frames) with ``states``: each frame's state under every trial, in their order; keep: of those frames only, which may ask windows by video and frame.

    Stages are grouped by the parameters that they read, and each distinct one
    is evaluated once: windows of every width asked for share one exchange and
    sort, and bouts of every pair of gaps are found together with the pair as
    part of their key. A bout's ends are two rows among its video's frames, and
    running sums tell how many bouts of each pair are open at a frame, so no
    bout is spread over its frames. So neither scans nor exchanges grow with
    the trials.
    """
    made: dict[str, Column] = {}

    def once(name: str, make: Callable[[], Column]) -> Column:
        name = name.replace(".", "p")
        if name not in made:
            made[name] = make()
        return F.col(name)

    gaps = list(dict.fromkeys((p.turn_gap_sec * p.fps, p.same_gap_sec * p.fps) for p in trials))
    first = trials[0]
    if len({(p.fps, p.step) for p in trials}) > 1:
        raise ValueError("trials differ in their frames")
    turn, same = (F.get(F.array(*[F.lit(float(g[k])) for g in gaps]), F.col("pair")) for k in (0, 1))
    islands = sessions.speech_islands(observed, first).withColumn("pair", F.explode(F.array(*[F.lit(k) for k in range(len(gaps))])))
    found = sessions.bouts_by(islands, ["pair", "video_id"], turn, same).filter("`end` >= start and video_id is not null")
    ends = F.array(F.struct(F.col("start").alias("frame"), F.lit(0).alias("side")), F.struct(F.col("end").alias("frame"), F.lit(2).alias("side")))
    edges = found.select("pair", "video_id", F.explode(ends).alias("at")).groupBy("video_id", "at.frame", "at.side").agg(*[F.count_if(F.col("pair") == k).alias(f"edge_{k}") for k in range(len(gaps))])
    # A frame's row stands after the bouts that begin at it and before the end of those that end at it.
    rows = observed.withColumn("side", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    so_far = Window.partitionBy("video_id").orderBy("frame", "side").rowsBetween(Window.unboundedPreceding, 0)
    open_bouts = {f"open_{k}": F.sum(F.when(F.col("side") == 0, F.col(f"edge_{k}")).when(F.col("side") == 2, -F.col(f"edge_{k}"))).over(so_far) > 0 for k in range(len(gaps))}
    covered = rows.withColumns(open_bouts).filter("side = 1").drop("side", *[f"edge_{k}" for k in range(len(gaps))])
    speaks = (F.col("has_kchi") == 1) | (F.col("has_cds") == 1)
    states = []
    nth = once("nth", lambda: F.row_number().over(Window.partitionBy("video_id").orderBy("frame")))

    def windowed(column: str, seconds: float, p: Params, how=F.max) -> Column:
        width = p.window(seconds)
        return once(f"{column}_{how.__name__}_{width}", lambda: features.centred(F.col(column), width, how))

    def held(column: str, p: Params, share: float) -> Column:
        width = p.window(p.sustained_sec)
        return (nth >= width) & (once(f"{column}_{width}", lambda: F.sum(column).over(Window.partitionBy("video_id").orderBy("frame").rowsBetween(1 - width, 0))) >= share * width)

    for p in trials:
        # A remembered frame's confidence is over a limit where the greatest in the window is.
        anchored = [F.coalesce(windowed(c, p.long_memory_sec, p) > limit, F.lit(False)) for c, limit in (("proximity", p.anchor_proximity), ("face_conf", p.anchor_face))]
        long = anchored[0] | anchored[1] if p.window(p.long_memory_sec) > 0 else F.lit(False)
        pair = gaps.index((p.turn_gap_sec * p.fps, p.same_gap_sec * p.fps))
        named = {
            "presence_score": windowed("presence_conf", p.presence_sec, p, F.avg),
            "seen_recently": long | (windowed("presence_conf", p.short_memory_sec, p) >= p.instant_confidence),
            "sustained_kcds": held("has_cds", p, p.kcds_share),
            "sustained_ohs": held("has_ohs", p, p.ohs_share),
            "in_bout": F.coalesce(F.col(f"open_{pair}"), F.lit(False)) & speaks,
        }
        states.append(scalars.state(p, named))
    if keep is not None:
        made["kept"] = keep
    seen = covered.withColumns(made)
    return (seen.filter("kept") if keep is not None else seen).withColumn("states", F.array(*states)).drop(*open_bouts, *made)


def search(observed: DataFrame, truth: DataFrame, trials: list[Params]) -> DataFrame:
    """trial (from 0) and macro scores of each parameter set against second labels (video_id, second, gt), the best first.

    observed (integrated frames) is read twice, for bouts and for states, and
    truth once, however many the trials are; pass written tables
    (sources.shared.written). A second's state is that of its last frame.
    Seconds are counted by label and states before those become a row for
    each trial.
    """
    used = observed.select("video_id", "frame", *READ)
    second = (F.col("frame") / trials[0].fps).cast("long")
    following = F.lead(second).over(Window.partitionBy("video_id").orderBy("frame"))
    labels = trial_states(used, trials, following.isNull() | (following != second)).select("video_id", second.alias("second"), F.concat(*[F.get("states", F.lit(k)).cast("string") for k in range(len(trials))]).alias("states"))
    counted = truth.join(labels, ["video_id", "second"], "left").groupBy("gt", "states").agg(F.count("*").alias("n"))
    each = counted.select("gt", "states", "n", F.explode(F.array(*[F.lit(k) for k in range(len(trials))])).alias("trial"))
    s = F.substring("states", F.col("trial") + 1, F.lit(1)).cast("int")
    pred = F.when(s.isNull(), None).when(s == INTERACTING, "interacting").when(s == AVAILABLE, "available").otherwise("alone")
    counts = each.groupBy("trial", "gt", pred.alias("pred")).agg(F.sum("n").alias("n"))
    return evaluate.macro_metrics(evaluate.class_metrics(counts, keys=["trial"], weight="n"), ["trial"]).orderBy(F.desc("macro_f1"), "trial")


def draw(space: dict[str, list], n: int, seed: int) -> list[dict]:
    """n different points of the grid that space's values span, all if there are fewer; a seed always gives the same ones.

    A point is a number in mixed radix, so no grid is built.
    """
    size = math.prod(len(v) for v in space.values())
    out = []
    for point in random.Random(seed).sample(range(size), min(n, size)):
        own = {}
        for name, values in space.items():
            point, k = divmod(point, len(values))
            own[name] = values[k]
        out.append(own)
    return out


def resumable_search(observed: DataFrame, truth: DataFrame, trials: list[Params], path: str, every: int = 10) -> DataFrame:
    """``search`` over ``every`` trials at a time, each part written under path; parts that a stopped run has written whole are not run again.

    Parts go by number, so a restart must come with the same trials. A part
    whose writing was stopped is written again.
    """
    spark = observed.sparkSession
    for k, lo in enumerate(range(0, len(trials), every)):
        if not sinks.is_written(spark, f"{path}/part={k}"):
            part = search(observed, truth, trials[lo : lo + every])
            part.withColumn("trial", F.col("trial") + lo).write.mode("overwrite").parquet(f"{path}/part={k}")
    return spark.read.parquet(path).drop("part")

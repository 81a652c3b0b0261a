"""Second-by-second evaluation against annotations, and agreement of two raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.scalars import kappa_band, seconds_of_clock

UNCLASSIFIED, UNANNOTATED = "unclassified", "unannotated"


def label_spans(annotations: DataFrame) -> DataFrame:
    """video_id, label, start, end (seconds), ordinal, from clock texts start_time and end_time: an unreadable start is 0, an unreadable end the start."""
    start = F.coalesce(seconds_of_clock("start_time"), F.lit(0.0))
    parsed = annotations.withColumns({"start": start, "end": F.coalesce(seconds_of_clock("end_time"), start)})
    return parsed.select("video_id", F.lower(F.trim("label")).alias("label"), "start", "end", "ordinal")


def paint_seconds(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """video_id, second, label for every second from rint(start) to rint(end) within 0..n-1; where spans meet the one with the greatest ordinal counts.

    lengths: video_id, n. Halves round to even.
    """
    first, last = F.rint("start").cast("long"), F.least(F.rint("end").cast("long"), F.col("n") - 1)
    valid = spans.join(lengths, "video_id").withColumns({"first": F.greatest(first, F.lit(0)), "last": last}).filter("first <= last")
    cells = valid.select("video_id", "label", "ordinal", F.explode(F.sequence("first", "last")).alias("second"))
    return cells.groupBy("video_id", "second").agg(F.max_by("label", "ordinal").alias("label"))


def video_seconds(spans: DataFrame, extra: int = 1) -> DataFrame:
    """video_id and n, the whole seconds up to the last end, plus extra."""
    return spans.groupBy("video_id").agg((F.floor(F.max("end")) + extra).cast("long").alias("n"))


def second_table(truth: DataFrame, predicted: DataFrame, margin: int = 30) -> DataFrame:
    """video_id, second, gt, pred for every annotated second of videos in both, margins left out; videos shorter than both margins have none."""
    lengths = video_seconds(truth).filter(F.col("n") >= 2 * margin).join(predicted.select("video_id").distinct(), "video_id", "left_semi")
    gt, pred = paint_seconds(truth, lengths), paint_seconds(predicted, lengths)
    inner = gt.join(lengths, "video_id").filter((F.col("second") >= margin) & (F.col("second") < F.col("n") - margin))
    return inner.select("video_id", "second", F.col("label").alias("gt")).join(pred.select("video_id", "second", F.col("label").alias("pred")), ["video_id", "second"], "left")


def second_export(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """video_id, second, gt, pred for every second of a video, absent labels spelled out."""
    lengths = video_seconds(truth)
    grid = lengths.filter("n > 0").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("second"))
    gt, pred = (paint_seconds(s, lengths).withColumnRenamed("label", c) for s, c in ((truth, "gt"), (predicted, "pred")))
    return grid.join(gt, ["video_id", "second"], "left").join(pred, ["video_id", "second"], "left").fillna({"gt": UNANNOTATED, "pred": UNCLASSIFIED})


def rater_seconds(a: DataFrame, b: DataFrame) -> DataFrame:
    """video_id, second, a, b for every second that lies before the earlier of two raters' last ends, in videos that both rated; absent labels spelled out."""
    ends = a.groupBy("video_id").agg(F.max("end").alias("x")).join(b.groupBy("video_id").agg(F.max("end").alias("y")), "video_id")
    lengths = ends.select("video_id", F.floor(F.least("x", "y")).cast("long").alias("n")).filter("n > 0")
    grid = lengths.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("second"))
    own, other = (paint_seconds(s, lengths).withColumnRenamed("label", c) for s, c in ((a, "a"), (b, "b")))
    return grid.join(own, ["video_id", "second"], "left").join(other, ["video_id", "second"], "left").fillna(UNANNOTATED, ["a", "b"])


def confusion(seconds: DataFrame) -> DataFrame:
    """gt, pred, n and the share of gt's classified seconds; seconds without prediction are left out."""
    n = seconds.filter("pred is not null").groupBy("gt", "pred").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gt")))


def class_metrics(seconds: DataFrame, classes: DataFrame | None = None, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """label, precision, recall, f1, support; an unpredicted second counts against recall.

    classes (column label) adds classes that no evaluated second holds, with
    zeros. One aggregation over both roles of a label. keys: for each of these
    (and without classes); weight: the column that says how many seconds a row stands for.
    """
    keys, zero, times = keys or [], F.lit(0).cast("long"), F.col(weight) if weight else F.lit(1).cast("long")
    hit = F.when(F.col("gt") == F.col("pred"), times).otherwise(zero)
    roles = seconds.select(*keys, F.explode(F.array(F.struct(F.col("gt").alias("label"), times.alias("is_gt"), zero.alias("is_pred"), hit.alias("tp")), F.struct(F.col("pred").alias("label"), zero.alias("is_gt"), times.alias("is_pred"), zero.alias("tp")))).alias("r")).select(*keys, "r.*")
    sums = roles.filter("label is not null").groupBy(*keys, "label").agg(F.sum("is_gt").alias("support"), F.sum("is_pred").alias("predicted"), F.sum("tp").alias("tp"))
    full = classes.select("label").distinct().join(sums, "label", "left").fillna(0) if classes is not None else sums.filter("support > 0")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return full.select(*keys, "label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def macro_metrics(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Unweighted means over all classes, of each of keys."""
    return metrics.groupBy(*(keys or [])).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def accuracy(seconds: DataFrame) -> DataFrame:
    """scope (overall, video, class), its name, seconds and accuracy, in one pass over grouping sets."""
    right = F.coalesce((F.col("gt") == F.col("pred")).cast("long"), F.lit(0))
    found = seconds.withColumn("right", right).groupingSets([[], ["video_id"], ["gt"]], "video_id", "gt").agg(F.grouping_id().alias("g"), F.count("*").alias("seconds"), F.sum("right").alias("right"))
    scope = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "video").otherwise("class")
    return found.select(scope.alias("scope"), F.coalesce(F.col("video_id").cast("string"), "gt", F.lit("all")).alias("name"), "seconds", (F.col("right") / F.col("seconds")).alias("accuracy"))


def error_runs(seconds: DataFrame) -> DataFrame:
    """video_id, gt, pred, start, end, seconds of runs of equal errors; a missing prediction is "unclassified"."""
    wrong = seconds.withColumn("pred", F.coalesce("pred", F.lit(UNCLASSIFIED))).filter("gt <> pred")
    w = Window.partitionBy("video_id", "gt", "pred").orderBy("second")
    runs = wrong.withColumn("run", F.col("second") - F.row_number().over(w)).groupBy("video_id", "gt", "pred", "run").agg(F.min("second").alias("start"), F.max("second").alias("end"))
    return runs.drop("run").withColumn("seconds", F.col("end") - F.col("start") + 1)


def cohen_kappa(rated: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, agreement, kappa and its band, over seconds that both raters (a, b) labelled.

    Counts go through one small table of label pairs. Kappa is null where
    chance agreement is certain.
    """
    keys = keys or []
    pairs = rated.filter("a is not null and b is not null").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    roles = pairs.select(*keys, "n", F.explode(F.array(F.struct(F.lit("a").alias("rater"), F.col("a").alias("label")), F.struct(F.lit("b").alias("rater"), F.col("b").alias("label")))).alias("r"))
    marginal = roles.groupBy(*keys, F.col("r.label").alias("label")).agg(F.sum(F.when(F.col("r.rater") == "a", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("r.rater") == "b", F.col("n")).otherwise(0)).alias("nb"))
    chance = marginal.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("products"))
    total = pairs.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    both = total.join(chance, keys) if keys else total.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("products") / (F.col("n") * F.col("n"))
    kappa = F.try_divide(po - pe, 1 - pe)
    return both.select(*keys, "n", po.alias("agreement"), kappa.alias("kappa"), kappa_band(kappa).alias("band"))

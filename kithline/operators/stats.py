"""Agreement of numeric series, binary metrics and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.sources.shared import written

COARSE, FINE = 16, 16  # a group's values lie in up to COARSE * FINE ranges


def _range(value: str) -> Column:
    """How many of the sorted ``cuts`` lie below the value, found by every FINE-th cut first."""
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(value)))
    coarse = below(F.col("coarse")) * FINE
    return coarse + below(F.slice("cuts", coarse + 1, FINE - 1))


def average_rank(n: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """keys, value and its rank within keys, ties averaged, from a row for each distinct value and how often it occurs (``n``); null keys or values have none.

    However often a value occurs it is one row here. A group's values are
    dealt to ranges by approximate quantiles, ranges are summed before each
    other, and values are ordered within their range only, so no task orders a
    whole group. Ranks are exact wherever the cuts lie. n is read three times:
    pass a written table.
    """
    shares = [k / (COARSE * FINE) for k in range(1, COARSE * FINE)]
    cuts = n.groupBy(*keys).agg(F.percentile_approx(value, shares, 10 * COARSE * FINE).alias("cuts")).withColumn("coarse", F.array(*[F.get("cuts", k * FINE - 1) for k in range(1, COARSE)]))
    ranged = n.join(cuts, keys).withColumn("range", _range(value)).drop("cuts", "coarse")
    sums = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("before"))  # COARSE * FINE rows a group at most
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("before").over(earlier), F.lit(0)))
    w = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(offsets, [*keys, "range"])
    return placed.withColumn(name, F.col("before") + F.sum("n").over(w) - (F.col("n") - 1) / 2).drop("n", "range", "before")


def correlation(a: str, b: str):
    """Pearson's correlation; null if either column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def series_agreement(df: DataFrame, truth: str, estimate: str, group: str) -> DataFrame:
    """group ("all" for all rows), n, pearson, spearman, mae, rmse, r2, bias of two series, by group and overall.

    Both series are ranked together: counts of the distinct (group, series,
    value) are written once, and ranks made from them are written and joined.
    """
    rows = df.filter(F.col(truth).isNotNull() & F.col(estimate).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(truth).cast("double").alias("t"), F.col(estimate).cast("double").alias("e"))
    both = rows.withColumn("group", F.explode(F.array(F.lit("all"), "g"))).drop("g").filter("group is not null")
    series = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in ("t", "e")])
    values = both.select("group", F.explode(series).alias("s")).groupBy("group", "s.series", "s.value").agg(F.count("*").alias("n"))
    ranks = written(average_rank(written(values, "series-values"), "value", ["group", "series"], "rank"), "series-ranks")
    of = {c: ranks.filter(F.col("series") == c).select("group", F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in ("t", "e")}
    ranked = both.join(of["t"], ["group", "t"]).join(of["e"], ["group", "e"])
    error = F.col("e") - F.col("t")
    return ranked.groupBy("group").agg(
        F.count("*").alias("n"),
        correlation("t", "e").alias("pearson"),
        correlation("rt", "re").alias("spearman"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop("t") * F.count("*"))).alias("r2"),
        F.avg(error).alias("bias"),
    )


def binary_metrics(df: DataFrame, classes: dict[str, tuple[str, str]]) -> DataFrame:
    """class, precision, recall, f1, accuracy of 0/1 columns (truth, prediction) for each class; 0 where undefined. One pass over all classes."""
    sums = []
    for name, (t, p) in classes.items():
        tp, fp, fn, n = (F.count_if(c) for c in ((F.col(t) == 1) & (F.col(p) == 1), (F.col(t) == 0) & (F.col(p) == 1), (F.col(t) == 1) & (F.col(p) == 0), F.col(t).isNotNull() & F.col(p).isNotNull()))
        right = F.count_if(F.col(t) == F.col(p))
        sums.append(F.struct(F.lit(name).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), right.alias("right"), n.alias("n")))
    rows = df.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), ratio(F.col("right"), F.col("n")).alias("accuracy"))


def frame_tallies(df: DataFrame) -> DataFrame:
    """For each video: frames, those with a child, an adult, and frames less both (negative if they overlap)."""
    child, adult = F.sum("child"), F.sum("adult")
    return df.groupBy("video_id").agg(F.count("*").alias("n_frames"), child.alias("n_child"), adult.alias("n_adult"), (F.count("*") - child - adult).alias("n_no_person"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def stage_audit(stages: dict[str, DataFrame], key: str) -> DataFrame:
    """stage, n: distinct keys at each stage; and lost: those of the first stage that it lacks."""
    first = next(iter(stages.values())).select(key).distinct()
    rows = []
    for name, df in stages.items():
        own = df.select(key).distinct()
        lost = first.join(own, key, "left_anti").agg(F.count("*").alias("lost"))
        rows.append(own.agg(F.count(key).alias("n")).crossJoin(lost).select(F.lit(name).alias("stage"), "n", "lost"))  # one row each
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def truth_and_estimate(truth: DataFrame, estimates: DataFrame, key: str, estimate: str, order: str = "ordinal") -> DataFrame:
    """truth with the estimate of its key; of rows of one key the first by ``order`` (then by value) counts on either side, and keys without an estimate are left out."""
    first = truth.groupBy(key).agg(F.min(F.struct(order, *[c for c in truth.columns if c not in (key, order)])).alias("t")).select(key, "t.*").drop(order)
    own = estimates.groupBy(key).agg(F.min(F.struct(order, estimate)).alias("e")).select(key, f"e.{estimate}")
    return first.join(own, key, "left").filter(F.col(estimate).isNotNull())


def total_duration(videos: DataFrame, frames: str, fps: int) -> DataFrame:
    """videos, frames and seconds in all."""
    return videos.agg(F.count("*").alias("videos"), F.sum(frames).alias("frames"), (F.sum(frames) / fps).alias("seconds"))

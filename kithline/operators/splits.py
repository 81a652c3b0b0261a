"""Reproducible sampling and balanced splits by group."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def hash_order(key: str | Column, seed: int) -> Column:
    """A random-looking order that depends on key and seed alone, not on partitions."""
    return F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit(seed))


def sample_by_quota(df: DataFrame, quotas: DataFrame, group: str, key: str, seed: int, first: Column | None = None) -> DataFrame:
    """Of each group up to quota rows (quotas: group, quota) in hash order; all if there are fewer. Rows where ``first`` is true come first and all stay.

    Rows are counted over (group, part) for 256 hash parts, and only the part
    that holds the last place is ranked, so no task orders a whole group.
    """
    h = hash_order(key, seed)
    early = F.coalesce(first, F.lit(False)).cast("int") if first is not None else F.lit(0)
    rows = df.withColumns({"_e": early, "_h": h, "_p": F.shiftright(h, 56)})
    parts = rows.groupBy(group, "_e", "_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy(F.desc("_e"), "_p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    placed = rows.join(before, [group, "_e", "_p"]).join(quotas, group)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(group, "_e", "_p").orderBy("_h", key))
    near = placed.filter((F.col("_before") < F.col("quota")) | (F.col("_e") == 1)).withColumn("_place", place)
    return near.filter((F.col("_place") <= F.col("quota")) | (F.col("_e") == 1)).select(*df.columns)


def split_sizes(n: int, ratio: float, least: int) -> dict[str, int]:
    """Groups in each split: the training ratio, the rest halved, and no split under least."""
    train = max(int(n * ratio), least)
    val = max((n - train) // 2, least)
    test = max(n - train - val, least)
    if train + val + test > n:
        train = max(n - val - test, least)
        val = max(n - train - test, least)
    return {"train": train, "val": val, "test": test}


def assign_equal(vectors: list[tuple[tuple[int, int, int, int], int]], *, ratio: float, least: int, class_weight: float, coverage_weight: float) -> list[dict[str, int]]:
    """How many groups of each vector (first class, other class, positives, total; how often it occurs) go to each split, in the order given.

    One group after another goes to the open split that it brings closest to
    the overall share of the first class and to half coverage; of equally close
    ones to the first. Without a coverage_weight, by class alone. Under 3 *
    least groups: none anywhere.
    """
    n = sum(times for _, times in vectors)
    out = [dict.fromkeys(SPLITS, 0) for _ in vectors]
    if n < 3 * least:
        return out
    wanted = split_sizes(n, ratio, least)
    all_first, all_other = (sum(v[k] * times for v, times in vectors) for k in (0, 1))
    target = all_first / (all_first + all_other) if all_first + all_other else 0
    sums = {s: [0, 0, 0, 0] for s in SPLITS}

    def distance(s: str, v: tuple[int, int, int, int]) -> float:
        a, b, pos, tot = (x + y for x, y in zip(sums[s], v, strict=True))
        by_class = abs(a / (a + b) - target) if a + b else 0
        return class_weight * by_class + coverage_weight * (abs(pos / tot - 0.5) if tot else 0)

    open_splits = [s for s in SPLITS if wanted[s] > 0]
    for (v, times), own in zip(vectors, out, strict=True):
        for _ in range(times):
            if not open_splits:
                return out
            best = min(open_splits, key=lambda s: distance(s, v)) if len(open_splits) > 1 else open_splits[0]
            sums[best] = [x + y for x, y in zip(sums[best], v, strict=True)]
            own[best] += 1
            wanted[best] -= 1
            if not wanted[best]:
                open_splits.remove(best)
    return out


def greedy_split(groups: DataFrame, key: str, first_class: str, other_class: str, positives: str, total: str, *, ratio: float = 0.6, least: int = 2, class_weight: float = 0.3, coverage_weight: float = 0.7, by_hash: int | None = None) -> DataFrame:
    """key and split, assigned one group after another to the open split that stays closest to the overall class ratio and to half coverage.

    Groups (a person each) with equal numbers can stand for one another, so
    the driver sees each distinct vector of numbers and how often it occurs,
    and finds how many of its groups go to each split; which of them, their
    hash order says (train first, then val), found by counts of 256 hash
    parts, so no task orders all. By default vectors with most positives come
    first, then by their other numbers; by_hash: in hash order of that seed and by
    class ratio alone. Nulls count as 0. Under 3 * least groups: no rows.
    """
    numbers = [first_class, other_class, positives, total]
    rows = groups.select(key, *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_{k}") for k, c in enumerate(numbers)])
    vector = ["_0", "_1", "_2", "_3"]
    order = [F.xxhash64(*vector, F.lit(by_hash)), *vector] if by_hash is not None else [F.desc("_2"), "_0", "_1", "_3"]
    counts = rows.groupBy(*vector).agg(F.count("*").alias("_times")).orderBy(*order).collect()  # a row for each distinct vector
    weights = (1.0, 0.0) if by_hash is not None else (class_weight, coverage_weight)
    quotas = assign_equal([((r[0], r[1], r[2], r[3]), r[4]) for r in counts], ratio=ratio, least=least, class_weight=weights[0], coverage_weight=weights[1])
    dealt = groups.sparkSession.createDataFrame([(*r[:4], *q.values()) for r, q in zip(counts, quotas, strict=True)], ", ".join(f"{c} long" for c in (*vector, *SPLITS)))
    h = hash_order(key, by_hash or 0)
    parted = rows.withColumns({"_h": h, "_p": F.shiftright(h, 56)})
    parts = parted.groupBy(*vector, "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*vector).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(dealt, vector)
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*vector, "_p").orderBy("_h", key))
    split = F.when(place <= F.col("train"), "train").when(place <= F.col("train") + F.col("val"), "val").when(place <= F.col("train") + F.col("val") + F.col("test"), "test")
    return parted.join(before, [*vector, "_p"]).withColumn("split", split).filter("split is not null").select(key, "split")


def fixed_split(rows: DataFrame, key: str, splits: DataFrame) -> DataFrame:
    """rows with the split that splits (key, split) gives their group; others are left out."""
    return rows.join(splits, key)


def _parted(videos: DataFrame, key: str, duration: str, seed: int) -> DataFrame:
    """videos with their hash, its first 12 bits as the part, and the duration as a decimal, so that sums don't depend on their order (no number: 0)."""
    h = hash_order(key, seed)
    return videos.withColumns({"_h": h, "_p": F.shiftright(h, 52), "_d": F.coalesce(F.col(duration).try_cast("decimal(28,6)"), F.lit(0))})


def split_by_duration(videos: DataFrame, key: str, duration: str, ratio: float, seed: int) -> DataFrame:
    """videos with split train or val: in hash order, train until its share of all durations has reached ratio; val for all if durations sum to 0.

    Durations are summed over 4,096 hash parts, then within each part, so no
    task orders all videos. Null durations count 0.
    """
    rows = _parted(videos, key, duration, seed)
    parts = rows.groupBy("_p").agg(F.sum("_d").alias("_s"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = parts.select("_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))
    own = F.coalesce(F.sum("_d").over(Window.partitionBy("_p").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.try_divide((F.col("_before") + own).cast("double"), F.col("_all").cast("double"))
    return rows.join(F.broadcast(before), "_p").withColumn("split", F.when(share < ratio, "train").otherwise("val")).select(*videos.columns, "split")


def split_by_fit(videos: DataFrame, key: str, duration: str, ratio: float, seed: int) -> DataFrame:
    """videos with split: in hash order, train if the video still fits under ratio of all durations, else val.

    Which videos fit depends on those before. They are found in rounds: of the
    videos after the last place that are no longer than the room left, those up
    to the first that no longer fits are train; then room and place move on.
    A round reads sums of 4,096 hash parts and orders the part in which that
    place falls; the driver keeps a place and a room for each round. Jobs run
    when the split is built. Durations are not negative; those of rows of one
    key are added up.
    """
    rows = _parted(videos, key, duration, seed).filter(F.col(key).isNotNull()).groupBy(key, "_h", "_p").agg(F.sum("_d").alias("_d"))
    room = Decimal(str(ratio)) * (rows.agg(F.sum("_d")).first()[0] or 0)
    taken, after = F.lit(False), F.lit(True)
    w = Window.partitionBy("_p").orderBy("_h", key)
    while True:
        open_ = rows.filter(after & (F.col("_d") <= room))
        left, at = room, None
        for part, s in open_.groupBy("_p").agg(F.sum("_d")).orderBy("_p").collect():
            if s > left:
                at = part
                break
            left -= s
        if at is None:
            taken = taken | (after & (F.col("_d") <= room))
            break
        sums = open_.filter(F.col("_p") == at).withColumn("_s", F.sum("_d").over(w))
        stop = sums.filter(F.col("_s") > left).orderBy("_h", key).select("_h", key, (F.col("_s") - F.col("_d")).alias("used")).first()
        place = F.struct("_h", key)
        last = F.struct(F.lit(stop["_h"]).cast("long").alias("_h"), F.lit(stop[key]).cast(videos.schema[key].dataType).alias(key))
        taken = taken | (after & (F.col("_d") <= room) & (place < last))
        after, room = place > last, left - stop["used"]
    split = rows.select(key, F.when(taken, "train").otherwise("val").alias("split"))
    return videos.join(split, key, "left").fillna({"split": "val"})


def overlap_check(assigned: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return assigned.groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("splits")).filter(F.size("splits") > 1)

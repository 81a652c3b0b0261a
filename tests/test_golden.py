"""Small cases with results worked out by hand."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kithline.functions import scalars as S
from kithline.operators import boxes, datasets, evaluate, features, grid, intervals, observations, segments, sessions, splits, stats
from kithline.operators.classify import classify
from kithline.params import Params
from kithline.plans import analysis

P = Params()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_grid(spark):
    v = spark.createDataFrame([(1, 25), (2, None), (3, -5)], "video_id long, max_frame long")
    assert rows(grid.dense_grid(v, P)) == [(1, 0), (1, 10), (1, 20), (2, 0), (3, 0)]


@pytest.mark.parametrize(("start", "end", "want"), [(0.1, 0.6, [10]), (0.05, 0.25, []), (0.0, 1.0, [0, 10, 20]), (1.0, 1.0, [])])
def test_snippet_frames(spark, start, end, want):
    assert one(spark, grid.snippet_frames(F.lit(start), F.lit(end), P)) == want


def test_containment_is_inclusive(spark):
    box = [(1, 0, 10.0, 10.0, 20.0, 20.0)]
    d = spark.createDataFrame([(7, *box[0])], "detection_id long, video_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame(box, "video_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    assert observations.outside_books(d, b).count() == 0
    assert observations.outside_books(d, b.withColumn("x1", F.col("x1") + 1)).count() == 1


def test_even_window_reaches_further_back(spark):
    df = spark.range(10).select(F.lit(1).alias("video_id"), F.col("id").alias("frame"), F.col("id").alias("v"))
    got = [r["m"] for r in df.withColumn("m", features.centred(F.col("v"), 6)).orderBy("frame").collect()]
    assert got == [min(9, i + 2) for i in range(10)]
    low = [r["m"] for r in df.withColumn("m", features.centred(F.col("v"), 6, F.min)).orderBy("frame").collect()]
    assert low == [max(0, i - 3) for i in range(10)]
    assert one(spark, features.centred(F.lit(1), 0)) == 0


def test_trailing_window_needs_all_rows(spark):
    df = spark.createDataFrame([(1, 10 * i, 1) for i in range(4)], "video_id long, frame long, has_cds int")
    got = [r["s"] for r in df.withColumn("s", features.sustained("has_cds", 3, 0.8)).orderBy("frame").collect()]
    assert got == [False, False, True, True]


def test_islands(spark):
    df = spark.createDataFrame([(1, f, 1) for f in (0, 10, 30)], "video_id long, frame long, flag int")
    assert rows(sessions.islands(df, {"flag": "x"}, P)) == [(1, "x", 0, 10), (1, "x", 30, 30)]


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([("kchi", 0, 10), ("cds", 240, 250)], [(0, 250)]),
        ([("kchi", 0, 10), ("cds", 20, 30), ("kchi", 100, 110)], [(0, 30)]),
        ([("kchi", 0, 100), ("cds", 20, 30)], [(0, 30)]),
        ([("kchi", 0, 10), ("kchi", 20, 30)], []),
        ([("kchi", 0, 10), ("cds", 251, 260)], []),
    ],
)
def test_bouts(spark, parts, want):
    df = spark.createDataFrame([(1, t, a, b) for t, a, b in parts], "video_id long, type string, start long, end long")
    assert rows(sessions.bouts(df, P).select("start", "end")) == want


@pytest.mark.parametrize(("box", "age", "want"), [((0, 0, 5, 0), 0, 0.0), ((0, 0, 700, 700), 0, 1.0), ((0, 0, 10, 10), 0, 0.0), ((0, 0, 100, 100), 7, None), ((0, 0, 300, 20), 1, 1.0)])
def test_proximity(spark, box, age, want):
    assert one(spark, S.proximity(*[F.lit(float(v)) for v in box], F.lit(age))) == want


def test_proximity_between(spark):
    import math

    want = (math.log(10_000) - math.log(308)) / (math.log(458185) - math.log(308))
    assert one(spark, S.proximity(F.lit(0.9), F.lit(0.0), F.lit(100.7), F.lit(100.2), F.lit(0))) == pytest.approx(want)


def frame(spark, **values):
    base = {"in_bout": False, "sustained_kcds": False, "sustained_ohs": False, "seen_recently": False, "presence_score": 0.0, "presence_conf": 0.0, "proximity": None} | values
    return spark.createDataFrame([tuple(base.values())], "in_bout boolean, sustained_kcds boolean, sustained_ohs boolean, seen_recently boolean, presence_score double, presence_conf double, proximity double")


@pytest.mark.parametrize(
    ("values", "rules", "want"),
    [
        ({"sustained_kcds": True, "presence_score": 0.1, "presence_conf": 0.5, "proximity": 0.9}, (1, 2, 3), 1),
        ({"sustained_kcds": True, "presence_score": 0.1}, (1, 2, 3), 3),
        ({"sustained_kcds": True, "presence_score": 0.18}, (1, 2, 3), 1),
        ({"in_bout": True}, (2, 3), 3),
        ({"in_bout": True}, (1,), 1),
        ({"seen_recently": True}, (1, 2, 3), 2),
        ({"sustained_ohs": True, "presence_score": 0.2}, (1, 2, 3), 2),
        ({"presence_conf": 0.9}, (1, 2, 3), 3),
    ],
)
def test_states(spark, values, rules, want):
    assert frame(spark, **values).select(S.state(P.but(rules=rules)).alias("s")).first()["s"] == want


SEGMENT = "video_id long, interaction_type string, segment_start long, segment_end long, start_sec double, end_sec double"


def test_direct_change_leaves_a_sliver(spark):
    df = spark.createDataFrame([(1, "Interacting", 0, 300, 0.0, 10.0), (1, "Available", 310, 900, 310 / 30, 30.0)], SEGMENT)
    got = rows(segments.fill_gaps(df, P).select("interaction_type", "segment_start", "segment_end"))
    assert ("Alone", 301, 309) in got and len(got) == 3
    wide = rows(segments.fill_gaps(df, P.but(gap_stretch_sec=0.34)).select("interaction_type", "segment_start", "segment_end"))
    assert wide == [("Available", 310, 900), ("Interacting", 0, 309)]


def test_coalesce_ignores_gaps(spark):
    df = spark.createDataFrame([(1, "Alone", 0, 300, 0.0, 10.0), (1, "Alone", 1800, 2100, 60.0, 70.0)], SEGMENT)
    assert rows(segments.coalesce_runs(df)) == [(1, "Alone", 0, 2100, 0.0, 70.0)]


def test_no_segments(spark):
    empty = spark.createDataFrame([], "video_id long, frame long, state int")
    assert segments.segment(empty, P).count() == 0


def test_union_length_and_strict_overlap(spark):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in ((0, 2), (1, 3), (3, 4), (6, 7))], "video_id long, start double, end double")
    assert rows(intervals.union_length(df, ["video_id"])) == [(1, 5.0)]
    touching = spark.createDataFrame([(1, 6.0, 9.0)], "video_id long, start double, end double")
    assert intervals.overlap_join(touching, df.filter("start = 3"), "video_id", 2.0).count() == 0
    assert intervals.overlap_join(touching, df.filter("start = 6"), "video_id", 0.5).count() == 1


def test_exposure(spark):
    seg = spark.createDataFrame([(1, "Interacting", 0.0, 10.0), (1, "Alone", 20.0, 20.0)], "video_id long, interaction_type string, start double, end double")
    sp = spark.createDataFrame([(1, 0.0, 2.0, "KCDS"), (1, 1.0, 3.0, "OHS"), (1, 4.0, 9.0, "KCHI")], "video_id long, start double, end double, speaker string")
    got = {(r["interaction_type"], r["exposure_type"]): (r["speech_sec"], r["exposure_share"]) for r in intervals.speech_exposure(seg, sp).collect()}
    assert got == {("Interacting", "TOTAL"): (3.0, 0.3), ("Interacting", "KCDS_ONLY"): (2.0, 0.2), ("Interacting", "OHS_ONLY"): (2.0, 0.2), **{("Alone", k): (0.0, 0.0) for k in ("TOTAL", "KCDS_ONLY", "OHS_ONLY")}}


def test_blocks(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0, "KCHI"), (1, 5.0, 6.0, "KCDS"), (1, 8.0, 9.0, "KCDS")], "video_id long, start double, end double, speaker string")
    assert rows(sessions.turn_blocks(t, ["video_id"], P).select("turns", "category")) == [(0, "unanswered_prompt"), (1, "successful_initiation")]


def test_paint(spark):
    s = spark.createDataFrame([(1, "a", 0.0, 1.5, 0), (1, "b", 2.5, 4.0, 1)], "video_id long, label string, start double, end double, ordinal long")
    n = spark.createDataFrame([(1, 5)], "video_id long, n long")
    assert rows(evaluate.paint_seconds(s, n)) == [(1, k, x) for k, x in enumerate("aabbb")]


def test_metrics_count_unpredicted_seconds(spark):
    s = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "a", None), (1, 2, "b", "a")], "video_id long, second long, gt string, pred string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {r["label"]: tuple(r)[1:] for r in evaluate.class_metrics(s, classes).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 1), "c": (0.0, 0.0, 0.0, 0)}
    assert rows(evaluate.confusion(s).select("gt", "pred", "n")) == [("a", "a", 1), ("b", "a", 1)]
    assert rows(evaluate.error_runs(s)) == [(1, "a", "unclassified", 1, 1, 1), (1, "b", "a", 2, 2, 1)]


def test_kappa_uses_seconds_of_both(spark):
    r = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", None)], "a string, b string")
    got = evaluate.cohen_kappa(r).first()
    assert got["n"] == 3 and got["kappa"] == pytest.approx((2 / 3 - 4 / 9) / (5 / 9)) and got["band"] == "fair to poor"


def test_matching_has_no_second_choice(spark):
    g = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 8.0, 0.0, 18.0, 10.0)], "frame_id long, gt_id long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 1.0, 0.0, 11.0, 10.0)], "frame_id long, pred_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert rows(boxes.match(p, g, 0.5)) == [(1, 1, 1, 1)]
    assert rows(boxes.error_frames(boxes.match(p, g, 0.5))) == [(1, "false_negative"), (1, "false_positive")]
    assert boxes.best_threshold(boxes.threshold_sweep(p, g, [0.1, 0.85, 0.95])).first()["threshold"] == 0.85


def test_noise(spark):
    a = spark.createDataFrame([(1, 1, -1), (1, 1, 10), (1, 2, -1), (1, 3, 10)], "video_id long, image_id long, category_id int")
    assert rows(datasets.noisy_frames(a)) == [(1, 1), (1, 2)]
    assert rows(datasets.noisy_frames(a, strict=True)) == [(1, 2)]


def test_five_groups_are_too_few(spark):
    g = spark.createDataFrame([(k, k, 1, k, 10) for k in range(5)], "child_id long, class_0 long, class_1 long, positives long, total long")
    args = ("child_id", "class_0", "class_1", "positives", "total")
    assert splits.greedy_split(g, *args).count() == 0
    six = g.union(spark.createDataFrame([(5, 5, 1, 5, 10)], g.schema))
    assert {r["split"]: r["count"] for r in splits.greedy_split(six, *args).groupBy("split").count().collect()} == {"train": 2, "val": 2, "test": 2}


@pytest.mark.parametrize(("text", "want"), [("01:30", 90.0), ("1:00:05", 3605.0), ("12.5", 12.5), ("x", None), ("1:2:3:4", None), (None, None), ("", None)])
def test_clock(spark, text, want):
    assert one(spark, S.seconds_of_clock(F.lit(text).cast("string"))) == want


def test_names(spark):
    assert one(spark, S.subject_id(F.lit("a_id123456_1"))) == "123456"
    assert one(spark, S.subject_id(F.lit("a_1"))) is None
    assert one(spark, S.subject_label(F.lit("a_id77_1"))) == "id77"
    assert one(spark, S.last_number(F.lit("a12_b007.x"))) == 7
    assert one(spark, S.last_number(F.lit("none"))) == 0
    assert one(spark, S.frame_suffix(F.lit("v_1_000120.jpg"))) == 120
    assert one(spark, S.frame_of_path(F.lit("/a/b/v_000090.png"))) == 90
    assert one(spark, S.path_part(F.lit("/a/b/c"), 2)) == "b"
    assert one(spark, S.path_part(F.lit("c"), 2)) is None
    assert tuple(one(spark, S.box_of_json(F.lit("[1.9, 2, 3, 4.5]")))) == (1, 2, 3, 4)
    assert one(spark, S.box_of_json(F.lit("[1, 2]"))) is None
    assert one(spark, S.clean_number(F.lit('" 1,5 "'))) == 1.5
    assert one(spark, S.category(F.lit("nonsense"))) == -1
    assert one(spark, S.supercategory(F.lit(12))) == "object"
    assert one(spark, S.kappa_band(F.lit(0.605))) == "substantial"


def test_yolo_round_trip(spark):
    y = S.yolo_of_box(*[F.lit(v) for v in (10.0, 20.0, 110.0, 80.0)], 2304, 1296)
    b = spark.range(1).select(y.alias("y")).select(S.box_of_yolo(F.col("y.cx"), F.col("y.cy"), F.col("y.w"), F.col("y.h"), 2304, 1296).alias("b")).first()["b"]
    assert tuple(b) == pytest.approx((10.0, 20.0, 110.0, 80.0))


def test_sampling_by_quota(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") < 30).alias("hard"))
    q = spark.createDataFrame([(0, 100), (1, 10)], "g long, quota long")
    got = splits.sample_by_quota(df, q, "g", "k", 3, F.col("hard"))
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {0: 100, 1: 15}
    assert got.filter("hard").count() == 30
    again = splits.sample_by_quota(df.repartition(7), q, "g", "k", 3, F.col("hard"))
    assert rows(got) == rows(again)
    assert splits.sample_by_quota(df, q, "g", "k", 4, F.col("hard")).subtract(got).count() > 0


def test_configurations_differ():
    space = {"a": [1, 2, 3], "b": ["x", "y"], "c": [0.1, 0.2]}
    assert len({tuple(d.items()) for d in analysis.draw(space, 50, 1)}) == 12
    many = analysis.draw({f"p{k}": [0, 1, 2] for k in range(26)}, 20, 1)
    assert len({tuple(d.items()) for d in many}) == 20 and many == analysis.draw({f"p{k}": [0, 1, 2] for k in range(26)}, 20, 1)


def plain_greedy(vectors, ratio, least, class_weight, coverage_weight):
    """One group after another, as the rule is stated."""
    n = len(vectors)
    if n < 3 * least:
        return [None] * n
    wanted, held = splits.split_sizes(n, ratio, least), {s: [] for s in splits.SPLITS}
    first, other = sum(v[0] for v in vectors), sum(v[1] for v in vectors)
    target, out = first / (first + other) if first + other else 0, []
    for v in vectors:
        best = None
        for s in splits.SPLITS:
            if len(held[s]) < wanted[s]:
                a, b, pos, tot = (sum(x) for x in zip(*held[s], v, strict=True))
                d = class_weight * (abs(a / (a + b) - target) if a + b else 0) + coverage_weight * (abs(pos / tot - 0.5) if tot else 0)
                if best is None or d < best[0]:
                    best = (d, s)
        held[best[1]].append(v)
        out.append(best[1])
    return out


@pytest.mark.parametrize("by_hash", [None, 42])
def test_greedy_split_equals_the_plain_one(spark, by_hash):
    """Random groups, many of them equal: as many of each vector in each split as one after another gives."""
    for seed, n in ((1, 5), (2, 6), (3, 40), (4, 90)):
        rng = random.Random(seed)
        rows = [(f"p{k}", *(v := (rng.randrange(3), rng.randrange(3), rng.randrange(3))), v[2] + rng.randrange(3)) for k in range(n)]
        df = spark.createDataFrame(rows, "id string, a int, b int, pos int, tot int").repartition(3)
        got = {r["id"]: r["split"] for r in splits.greedy_split(df, "id", "a", "b", "pos", "tot", by_hash=by_hash).collect()}
        order = [tuple(r) for r in df.select("a", "b", "pos", "tot").orderBy(F.xxhash64(*[F.col(c).cast("long") for c in ("a", "b", "pos", "tot")], F.lit(42)) if by_hash else F.desc("pos"), "a", "b", *(["pos"] if by_hash else []), "tot").collect()]
        want = Counter(zip(order, plain_greedy(order, 0.6, 2, *((1.0, 0.0) if by_hash else (0.3, 0.7))), strict=True))
        if n < 6:
            assert got == {}
            continue
        assert Counter(((r[1], r[2], r[3], r[4]), got[r[0]]) for r in rows) == want
        again = splits.greedy_split(df.repartition(7), "id", "a", "b", "pos", "tot", by_hash=by_hash)
        assert {r["id"]: r["split"] for r in again.collect()} == got


def _search_input(spark):
    rng = random.Random(5)
    rows = [(v, 10 * k, rng.choice([0.0, 0.3, 0.45, 0.9]), rng.choice([0.0, 0.55, 0.7]), rng.choice([None, 0.45, 0.75, 0.9]), int(rng.random() < 0.1), int(rng.random() < 0.12), int(rng.random() < 0.1)) for v in range(4) for k in range(240)]
    observed = spark.createDataFrame(rows, "video_id long, frame long, presence_conf double, face_conf double, proximity double, has_kchi int, has_cds int, has_ohs int")
    truth = spark.createDataFrame([(v, s, rng.choice(["interacting", "available", "alone"])) for v in range(5) for s in range(85)], "video_id long, second long, gt string")
    return observed, truth


def test_search_equals_single_trials(spark, tmp_path):
    """All trials at once give what each gives by itself, for gaps of either order; seconds without frames count against recall."""
    observed, truth = _search_input(spark)
    trials = [Params(), Params().but(turn_gap_sec=1.0, same_gap_sec=4.0, presence_sec=2.0), Params().but(long_memory_sec=2.0, anchor_face=0.6, sustained_sec=0.7, kcds_share=0.5), Params().but(rules=(2,), short_memory_sec=0.0, gate=0.5)]
    got = {r["trial"]: r for r in analysis.search(observed, truth, trials).collect()}
    names = {1: "interacting", 2: "available", 3: "alone"}
    for k, p in enumerate(trials):
        last = {}
        for r in classify(observed, p).select("video_id", "frame", "state").orderBy("frame").collect():
            last[r["video_id"], r["frame"] // 30] = names[r["state"]]
        pairs = [(r["gt"], last.get((r["video_id"], r["second"]))) for r in truth.collect()]
        f1 = []
        for label in {g for g, _ in pairs}:
            tp = sum(g == q == label for g, q in pairs)
            f1.append(2 * tp / (sum(g == label for g, _ in pairs) + sum(q == label for _, q in pairs)))
        assert got[k]["macro_f1"] == pytest.approx(sum(f1) / len(f1))
    path = str(tmp_path)
    analysis.resumable_search(observed, truth, trials[:2], path, every=2)
    before = (tmp_path / "part=0/_SUCCESS").stat().st_mtime_ns
    again = {r["trial"]: r for r in analysis.resumable_search(observed, truth, trials, path, every=2).collect()}
    assert again.keys() == got.keys() and all(again[k]["macro_f1"] == pytest.approx(got[k]["macro_f1"]) for k in got)
    assert (tmp_path / "part=0/_SUCCESS").stat().st_mtime_ns == before


def test_search_plan_does_not_grow(spark, tmp_path):
    """Twenty trials take the scans and exchanges of two."""
    observed, truth = _search_input(spark)
    observed.write.parquet(f"{tmp_path}/o")
    observed = spark.read.parquet(f"{tmp_path}/o")
    space = {"turn_gap_sec": [1.0, 4.0, 8.0], "presence_sec": [1.0, 2.0], "gate": [0.1, 0.2, 0.3], "short_memory_sec": [1.0, 2.0]}
    counts = []
    for n in (2, 20):
        plan = analysis.search(observed, truth, [Params().but(**d) for d in analysis.draw(space, n, 3)])._jdf.queryExecution().executedPlan().toString()
        counts.append((plan.count("Exchange "), plan.count("FileScan")))
    assert counts[0] == counts[1] and counts[0][1] == 2


def test_search_spreads_no_bout(spark):
    """A bout of 3 x 10^9 steps costs two rows: frames at both its ends interact, one after it doesn't."""
    last = 3 * 10**10
    observed = spark.createDataFrame([(1, 0, 1, 0), (1, 30, 0, 0), (1, last, 0, 1), (1, last + 30 * 10**10, 1, 0)], "video_id long, frame long, has_kchi int, has_cds int")
    observed = observed.select("*", F.lit(0).alias("has_ohs"), *[F.lit(0.0).alias(c) for c in ("presence_conf", "face_conf", "proximity")])
    p = Params().but(turn_gap_sec=1e9)
    got = {r["frame"]: r["states"] for r in analysis.trial_states(observed, [p, p.but(turn_gap_sec=1.0)]).collect()}
    assert got == {0: [1, 3], 30: [3, 3], last: [1, 3], last + 30 * 10**10: [3, 3]}
    truth = spark.createDataFrame([(1, 0, "interacting"), (1, 1, "alone"), (1, last // 30, "interacting")], "video_id long, second long, gt string")
    assert analysis.search(observed, truth, [p]).first()["macro_f1"] == 1.0


def test_duration_splits(spark):
    v = spark.createDataFrame([(k, 10) for k in range(10)], "id long, d long")
    for split in (splits.split_by_duration, splits.split_by_fit):
        assert split(v, "id", "d", 0.8, 1).filter("split = 'train'").count() == 8


@pytest.mark.parametrize("seed", [1, 2])
def test_duration_splits_in_order(spark, seed):
    """Both splits against a plain pass over the videos in hash order; null durations count 0, and an empty table gives no rows."""
    v = spark.createDataFrame([(f"v{k}", None if k == 7 else k * k % 97 + (k % 5) / 10 + (900 if k % 50 == 0 else 0)) for k in range(400)], "id string, d double")
    order = [(r["id"], r["d"] or 0.0) for r in v.orderBy(splits.hash_order("id", seed), "id").collect()]
    total = sum(d for _, d in order)
    used, before, fit, share = 0.0, 0.0, set(), set()
    for k, d in order:
        if used + d <= 0.6 * total + 1e-9:
            used += d
            fit.add(k)
        if before / total < 0.6:
            share.add(k)
        before += d
    for split, want in ((splits.split_by_fit, fit), (splits.split_by_duration, share)):
        got = split(v, "id", "d", 0.6, seed).collect()
        assert len(got) == 400 and {r["id"] for r in got if r["split"] == "train"} == want
        assert split(v.limit(0), "id", "d", 0.6, seed).count() == 0


def test_ranks_over_ranges(spark):
    """Ranks of more values than ranges, with ties, against pandas."""
    import pandas as pd

    pdf = pd.DataFrame({"g": ["a" if k % 3 else "b" for k in range(3000)], "x": [float(k * 7919 % 1301) ** 1.5 for k in range(3000)]})
    got = stats.average_rank(spark.createDataFrame(pdf).filter("g is not null and x is not null").groupBy("g", "x").agg(F.count("*").alias("n")), "x", ["g"], "r").toPandas()
    want = pdf.assign(r=pdf.groupby("g")["x"].rank()).drop_duplicates()
    both = want.merge(got, on=["g", "x"])
    assert len(both) == len(want) == len(got) and (both["r_x"] == both["r_y"]).all()


def test_ranks_of_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0, "g"), (1.0, 2.0, "g"), (2.0, 3.0, None)], "t double, e double, g string")
    got = {r["group"]: r for r in stats.series_agreement(df, "t", "e", "g").collect()}
    assert set(got) == {"all", "g"} and got["all"]["n"] == 3 and got["all"]["bias"] == pytest.approx(2 / 3)
    assert got["all"]["spearman"] == pytest.approx(0.8660254) and got["g"]["spearman"] is None


def test_unknown_parameter():
    with pytest.raises(ValueError, match="no such"):
        P.but(nonsense=1)


def test_series_agreement_plan(spark, tmp_path):
    """One scan of the table and few exchanges; a value that most rows have is one row where ranks are made."""
    spark.range(20_000).select(F.when(F.col("id") % 10 < 9, 5.0).otherwise(F.col("id") % 97).alias("t"), (F.col("id") % 31).cast("double").alias("e"), (F.col("id") % 3).cast("string").alias("g")).write.parquet(f"{tmp_path}/s")
    found = stats.series_agreement(spark.read.parquet(f"{tmp_path}/s"), "t", "e", "g")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") < 8 and plan.count(f"{tmp_path}/s") <= 1
    pdf = spark.read.parquet(f"{tmp_path}/s").toPandas()
    got = {r["group"]: r["spearman"] for r in found.collect()}
    for g, own in [("all", pdf), *pdf.groupby("g")]:
        assert got[g] == pytest.approx(own["t"].rank().corr(own["e"].rank()))

"""Every query over the domain tables, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline import adapters as A
from kithline.functions import scalars as S
from kithline.operators import boxes, datasets, evaluate, features, grid, intervals, observations, predict, segments, sessions, splits, stats
from kithline.params import Params
from kithline.plans import analysis
from kithline.plans.sql import query
from kithline.sources import shared, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Short least lengths suit the sparse example tables; short margins their short videos.
P = Params(least_interacting_sec=0.0, least_available_sec=0.3, least_alone_sec=1.0, margin_sec=5)


def register(body: str | None = None, *parts: str):
    def of(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if body:
            ORACLE_SQL[fn.__name__] = query(body, *parts)
        return fn

    return of


def _r(*names: str, digits: int = 6):
    return [F.round(F.col(n).cast("double"), digits).alias(n) for n in names]


# Frames: grid, observations, features, states


@register("SELECT video_id, t AS state, n_frames, round(n_frames / sum(n_frames) OVER (PARTITION BY video_id), 6) AS share FROM (SELECT video_id, CASE state WHEN 1 THEN 'Interacting' WHEN 2 THEN 'Available' ELSE 'Alone' END AS t, count(*) AS n_frames FROM st GROUP BY ALL)", "st")
def state_shares(spark, sf_dir):
    return segments.state_shares(analysis.states(spark, sf_dir, P)).select("video_id", "state", "n_frames", *_r("share"))


@register("SELECT video_id, frame FROM grid", "grid")
def dense_grid(spark, sf_dir):
    return grid.dense_grid(A.videos(spark, sf_dir), P)


@register("SELECT video_id, unnest(range(CAST(ceil(floor((s + 0.1) * 30) / 10) * 10 AS BIGINT), CAST(ceil((e - 0.2) * 30) AS BIGINT), 10)) AS frame, CAST(speaker = 'KCHI' AS INTEGER) AS has_kchi, CAST(speaker = 'KCDS' AS INTEGER) AS has_cds, CAST(speaker = 'OHS' AS INTEGER) AS has_ohs FROM snip", "snip")
def snippet_frames(spark, sf_dir):
    s = A.snippets(spark, sf_dir)
    return grid.snippets_to_frames(s.withColumns({"start": F.col("start") + 0.1, "end": F.col("end") - 0.2}), P)


@register("SELECT d.detection_id, d.kind, d.video_id, d.frame, b.x1 AS book_x1 FROM det d JOIN book b ON b.video_id = d.video_id AND b.frame = d.frame AND d.x1 >= b.x1 AND d.y1 >= b.y1 AND d.x2 <= b.x2 AND d.y2 <= b.y2", "det", "book")
def detections_in_books(spark, sf_dir):
    return observations.inside_books(A.detections(spark, sf_dir), A.books(spark, sf_dir)).select("detection_id", "kind", "video_id", "frame", "book_x1")


@register("SELECT detection_id, kind, video_id, frame FROM kept", "kept")
def detections_outside_books(spark, sf_dir):
    return observations.outside_books(A.detections(spark, sf_dir), A.books(spark, sf_dir)).select("detection_id", "kind", "video_id", "frame")


@register("SELECT detection_id, round(proximity, 6) AS proximity FROM near", "near")
def face_proximity(spark, sf_dir):
    kept = observations.outside_books(A.detections(spark, sf_dir), A.books(spark, sf_dir))
    return observations.faces(kept).select("detection_id", *_r("proximity"))


@register("SELECT video_id, frame, last_x1, last_y1, last_x2, last_y2 FROM hull", "hull")
def detection_hull(spark, sf_dir):
    return observations.hull(A.detections(spark, sf_dir))


@register("SELECT video_id, frame, has_kchi, has_cds, has_ohs FROM speech", "speech")
def speech_by_frame(spark, sf_dir):
    return observations.speech(A.audio(spark, sf_dir))


@register("SELECT video_id, frame, round(person_conf, 6) AS person_conf, round(face_conf, 6) AS face_conf, round(proximity, 6) AS proximity, has_book, has_kchi, has_cds, has_ohs, last_x1, last_y1, last_x2, last_y2, round(presence_conf, 6) AS presence_conf FROM fr", "fr")
def integrated_frames(spark, sf_dir):
    f = analysis.frames(spark, sf_dir, P)
    return f.select("video_id", "frame", *_r("person_conf", "face_conf", "proximity"), "has_book", "has_kchi", "has_cds", "has_ohs", "last_x1", "last_y1", "last_x2", "last_y2", *_r("presence_conf"))


@register("SELECT video_id, frame, round(presence_score, 6) AS presence_score, seen_recently, sustained_kcds, sustained_ohs FROM feat", "feat")
def window_features(spark, sf_dir):
    f = features.window_features(analysis.frames(spark, sf_dir, P), P)
    return f.select("video_id", "frame", *_r("presence_score"), "seen_recently", "sustained_kcds", "sustained_ohs")


@register("SELECT video_id, frame, max(CASE WHEN coalesce(proximity > 0.5, false) OR face_conf > 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) = 1 AS remembered FROM fr", "fr")
def long_memory(spark, sf_dir):
    anchor = (F.coalesce(F.col("proximity") > P.anchor_proximity, F.lit(False)) | (F.col("face_conf") > P.anchor_face)).cast("int")
    return analysis.frames(spark, sf_dir, P).select("video_id", "frame", (features.centred(anchor, P.window(3.0)) == 1).alias("remembered"))


@register("SELECT video_id, type, a AS start, b AS \"end\" FROM isl", "isl")
def speech_islands(spark, sf_dir):
    return sessions.speech_islands(observations.speech(A.audio(spark, sf_dir)), P)


@register("SELECT video_id, a AS start, b AS \"end\" FROM bouts", "bouts")
def turn_taking_bouts(spark, sf_dir):
    return sessions.bouts(speech_islands(spark, sf_dir), P)


@register("SELECT video_id, frame FROM marked WHERE in_bout", "marked")
def bout_frames(spark, sf_dir):
    return sessions.mark_bouts(analysis.frames(spark, sf_dir, P), P).filter("in_bout").select("video_id", "frame")


@register("SELECT video_id, frame, state, in_bout AS rule_turn_taking, rule_proximity, sustained_kcds AS rule_sustained_speech, sustained_ohs FROM st", "st")
def frame_states(spark, sf_dir):
    return analysis.states(spark, sf_dir, P).select("video_id", "frame", "state", "rule_turn_taking", "rule_proximity", "rule_sustained_speech", "sustained_ohs")


@register("SELECT video_id, sum(CASE WHEN coalesce(presence_conf >= 0.4 AND proximity >= 0.8, false) THEN 1 ELSE 0 END)::BIGINT AS interacting FROM st GROUP BY video_id", "st")
def rule_ablation(spark, sf_dir):
    got = analysis.states(spark, sf_dir, P.but(rules=(2,)))
    return got.groupBy("video_id").agg(F.sum(F.when(F.col("state") == 1, 1).otherwise(0)).alias("interacting"))


# Segments


@register("SELECT video_id, t AS interaction_type, a AS segment_start, b AS segment_end, round(a / 30, 6) AS start_sec, round(b / 30, 6) AS end_sec FROM rle", "rle")
def state_runs(spark, sf_dir):
    return segments.runs(analysis.states(spark, sf_dir, P), P).select("video_id", "interaction_type", "segment_start", "segment_end", *_r("start_sec", "end_sec"))


@register("SELECT video_id, t AS interaction_type, a AS segment_start, b AS segment_end FROM mrg", "mrg")
def coalesced_runs(spark, sf_dir):
    return segments.coalesce_runs(segments.runs(analysis.states(spark, sf_dir, P), P)).select("video_id", "interaction_type", "segment_start", "segment_end")


@register("SELECT video_id, t AS interaction_type, a AS segment_start, b AS segment_end, round(s, 6) AS start_sec, round(e, 6) AS end_sec FROM fil", "fil")
def filled_gaps(spark, sf_dir):
    merged = segments.coalesce_runs(segments.runs(analysis.states(spark, sf_dir, P), P))
    return segments.fill_gaps(merged, P).select("video_id", "interaction_type", "segment_start", "segment_end", *_r("start_sec", "end_sec"))


@register("SELECT video_id, video_name, child_id, round(age_at_recording, 6) AS age_at_recording, interaction_type, segment_start, segment_end, round(duration_sec, 6) AS duration_sec FROM seg JOIN vid USING (video_id)", "seg", "vid")
def interaction_segments(spark, sf_dir):
    return analysis.run(spark, sf_dir, P).select("video_id", "video_name", "child_id", *_r("age_at_recording"), "interaction_type", "segment_start", "segment_end", *_r("duration_sec"))


@register("SELECT interaction_type, count(*) AS n_segments, round(sum(duration_sec) / 60, 6) AS minutes, round(sum(duration_sec) * 100 / sum(sum(duration_sec)) OVER (), 6) AS percent FROM seg GROUP BY interaction_type", "seg")
def segment_summary(spark, sf_dir):
    return segments.segment_summary(segments.segment(analysis.states(spark, sf_dir, P), P)).select("interaction_type", "n_segments", *_r("minutes", "percent"))


@register("SELECT f.video_id, f.frame, coalesce(bool_or(interaction_type = 'Interacting'), false) AS is_interaction, coalesce(bool_or(interaction_type = 'Alone'), false) AS is_alone, coalesce(bool_or(interaction_type = 'Available'), false) AS is_available FROM st f LEFT JOIN seg s ON s.video_id = f.video_id AND f.frame BETWEEN s.segment_start AND s.segment_end GROUP BY f.video_id, f.frame", "st", "seg")
def frames_in_segments(spark, sf_dir):
    got = analysis.states(spark, sf_dir, P)
    return intervals.frames_in_segments(got.select("video_id", "frame"), segments.segment(got, P), P.step)


@register()
def smoothed_state_shares(spark, sf_dir):
    return segments.state_shares(analysis.smoothed_states(spark, sf_dir, P).select("video_id", F.col("smoothed").alias("state"))).select("video_id", "state", "n_frames", *_r("share"))


@register("SELECT video_id, frame, frame - frame % 10 AS overlay_frame, CAST(round_even(CAST(frame AS DOUBLE) / 30, 0) AS BIGINT) AS second FROM (SELECT video_id, frame + 7 AS frame FROM grid)", "grid")
def overlay_alignment(spark, sf_dir):
    g = grid.dense_grid(A.videos(spark, sf_dir), P).withColumn("frame", F.col("frame") + 7)
    return g.select("video_id", "frame", (F.col("frame") - F.col("frame") % P.step).alias("overlay_frame"), F.rint(F.col("frame") / P.fps).cast("long").alias("second"))


# Intervals and speech


@register("SELECT video_id, t AS interaction_type, s AS start, e AS \"end\", ps AS start_b, pe AS end_b, speaker AS speaker_b FROM ov", "ov")
def overlapping_speech(spark, sf_dir):
    return intervals.overlap_join(A.chat_segments(spark, sf_dir), A.snippets(spark, sf_dir).drop("turn"), "video_id", 7.0)


@register("""SELECT video_id, speaker, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(st) OVER (PARTITION BY video_id, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY video_id, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS st FROM snip)) GROUP BY video_id, speaker, i""", "snip")
def merged_vocalizations(spark, sf_dir):
    return intervals.merge_overlaps(A.snippets(spark, sf_dir), ["video_id", "speaker"])


@register("SELECT video_id, count(*) AS seconds FROM (SELECT DISTINCT video_id, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) FROM snip) GROUP BY video_id", "snip")
def speech_union_seconds(spark, sf_dir):
    return intervals.union_length(A.snippets(spark, sf_dir), ["video_id"]).select("video_id", F.col("seconds").cast("long").alias("seconds"))


@register("SELECT video_id, t AS interaction_type, s AS start, e AS \"end\", exposure_type, round(speech_sec, 6) AS speech_sec, round(CASE WHEN duration_sec > 0 THEN speech_sec / duration_sec ELSE 0 END, 6) AS exposure_share FROM expo", "expo")
def speech_exposure(spark, sf_dir):
    e = intervals.speech_exposure(A.chat_segments(spark, sf_dir), A.snippets(spark, sf_dir))
    return e.select("video_id", "interaction_type", "start", "end", "exposure_type", *_r("speech_sec", "exposure_share"))


def _children(spark, sf_dir):
    ids = A.chat_segments(spark, sf_dir).select("video_id").distinct()
    return ids.select("video_id", (F.col("video_id") % 20).alias("child_id"), F.when(F.col("video_id") % 20 < 18, F.col("video_id") % 20 + 3.5).alias("age_at_recording"))


@register("SELECT video_id % 20 AS child_id, exposure_type, CASE WHEN video_id % 20 < 18 THEN video_id % 20 + 3.5 END::DOUBLE AS age_at_recording, round(sum(speech_sec) / 60, 6) AS speech_minutes, round(sum(duration_sec) / 60, 6) AS recording_minutes, round(sum(speech_sec) / sum(duration_sec), 6) AS exposure_share FROM expo GROUP BY ALL", "expo")
def exposure_by_child(spark, sf_dir):
    e = intervals.speech_exposure(A.chat_segments(spark, sf_dir), A.snippets(spark, sf_dir))
    return intervals.exposure_by_child(e, _children(spark, sf_dir)).select("child_id", "exposure_type", F.col("age_at_recording").cast("double").alias("age_at_recording"), *_r("speech_minutes", "recording_minutes", "exposure_share"))


@register("""SELECT video_id % 20 AS child_id, round(sum(CASE WHEN p IS NULL THEN 0 ELSE p END)::DOUBLE, 6) AS speech_sec, round(sum(d), 6) AS recording_sec, (video_id % 20 + 3.5)::DOUBLE AS age_at_recording FROM
    (SELECT c.video_id, c.s, c.e, c.e - c.s AS d, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(CAST(o.f AS BIGINT), CAST(o.g AS BIGINT))) AS x FROM ov o WHERE o.video_id = c.video_id AND o.s = c.s AND o.e = c.e AND o.speaker = 'KCHI')) AS p FROM (SELECT DISTINCT video_id, s, e FROM chat) c)
    WHERE video_id % 20 < 18 GROUP BY ALL""", "ov", "chat")
def child_speech(spark, sf_dir):
    own = A.snippets(spark, sf_dir).filter("speaker = 'KCHI'")
    found = intervals.child_speech(A.chat_segments(spark, sf_dir), own, _children(spark, sf_dir))
    return found.select("child_id", *_r("speech_sec", "recording_sec"), F.col("age_at_recording").cast("double").alias("age_at_recording"))


@register("SELECT video_id, s AS segment_start, e AS segment_end, CAST(block AS BIGINT) AS block, CAST(turns AS BIGINT) AS turns, CASE WHEN turns > 0 AND first_speaker = 'KCHI' THEN 'successful_initiation' WHEN turns > 0 THEN 'successful_response' WHEN first_speaker = 'KCHI' THEN 'unanswered_bid' ELSE 'unanswered_prompt' END AS category FROM blocks", "blocks")
def turn_blocks(spark, sf_dir):
    own = A.chat_segments(spark, sf_dir).filter("interaction_type = 'Interacting'").select("video_id", F.col("start").alias("segment_start"), F.col("end").alias("segment_end"))
    within = sessions.turns_within(A.snippets(spark, sf_dir).filter("speaker <> 'OHS'"), own)
    return sessions.turn_blocks(within, ["video_id", "segment_start", "segment_end"], P).select("video_id", "segment_start", "segment_end", F.col("block").cast("long").alias("block"), "turns", "category")


@register("""SELECT c.video_id, c.s AS segment_start, c.e AS segment_end, coalesce(sum(turns), 0)::BIGINT AS total_turns, count(*) FILTER (turns > 0 AND first_speaker = 'KCHI') AS successful_initiations, count(*) FILTER (turns > 0 AND first_speaker <> 'KCHI') AS successful_responses,
    count(*) FILTER (turns = 0 AND first_speaker = 'KCHI') AS unanswered_child_bids, count(*) FILTER (turns = 0 AND first_speaker <> 'KCHI') AS unanswered_adult_prompts, round(coalesce(sum(turns), 0) * 60 / (c.e - c.s), 6) AS turns_per_minute
    FROM (SELECT DISTINCT video_id, s, e FROM chat WHERE t = 'Interacting') c LEFT JOIN blocks b ON b.video_id = c.video_id AND b.s = c.s AND b.e = c.e GROUP BY c.video_id, c.s, c.e""", "chat", "blocks")
def turn_summary(spark, sf_dir):
    got = sessions.turn_summary(A.chat_segments(spark, sf_dir), A.snippets(spark, sf_dir), P)
    return got.select("video_id", "segment_start", "segment_end", F.col("total_turns").cast("long").alias("total_turns"), "successful_initiations", "successful_responses", "unanswered_child_bids", "unanswered_adult_prompts", *_r("turns_per_minute"))


# Evaluation


def _spans(spark, sf_dir):
    truth = A.chat_segments(spark, sf_dir).select("video_id", F.lower("interaction_type").alias("label"), "start", "end", F.col("start").cast("long").alias("ordinal"))
    label = F.when(F.col("speaker") == "KCHI", "interacting").when(F.col("speaker") == "KCDS", "available").otherwise("alone")
    return truth, A.snippets(spark, sf_dir).select("video_id", label.alias("label"), "start", "end", F.col("turn").alias("ordinal"))


def _seconds(spark, sf_dir):
    return evaluate.second_table(*_spans(spark, sf_dir), margin=P.margin_sec)


@register("SELECT video_id, sec AS second, label FROM pp", "pp")
def painted_seconds(spark, sf_dir):
    truth, predicted = _spans(spark, sf_dir)
    return evaluate.paint_seconds(predicted, evaluate.video_seconds(truth))


@register("SELECT video_id, second, gt, pred FROM sec", "sec")
def evaluated_seconds(spark, sf_dir):
    return _seconds(spark, sf_dir)


@register("SELECT g.video_id, g.sec AS second, coalesce(a.label, 'unannotated') AS gt, coalesce(b.label, 'unclassified') AS pred FROM (SELECT video_id, unnest(range(n)) AS sec FROM len) g LEFT JOIN pg a USING (video_id, sec) LEFT JOIN pp b USING (video_id, sec)", "len", "pg", "pp")
def second_export(spark, sf_dir):
    return evaluate.second_export(*_spans(spark, sf_dir))


@register("SELECT gt, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gt), 6) AS share FROM sec WHERE pred IS NOT NULL GROUP BY gt, pred", "sec")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_seconds(spark, sf_dir)).select("gt", "pred", "n", *_r("share"))


_METRICS = """SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0) AS f1, support FROM (SELECT DISTINCT label FROM gts) LEFT JOIN
    (SELECT l AS label, count(*) FILTER (gt = l) AS support, count(*) FILTER (pred = l) AS predicted, count(*) FILTER (gt = l AND pred = l) AS tp FROM sec, (SELECT DISTINCT label AS l FROM gts) GROUP BY l) USING (label)"""


@register(f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({_METRICS})", "sec", "gts")
def class_metrics(spark, sf_dir):
    m = evaluate.class_metrics(_seconds(spark, sf_dir), _spans(spark, sf_dir)[0])
    return m.select("label", *_r("precision", "recall", "f1"), F.col("support").cast("long").alias("support"))


@register(f"SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM ({_METRICS})", "sec", "gts")
def macro_metrics(spark, sf_dir):
    return evaluate.macro_metrics(evaluate.class_metrics(_seconds(spark, sf_dir), _spans(spark, sf_dir)[0])).select(*_r("macro_precision", "macro_recall", "macro_f1"))


@register("SELECT CASE WHEN grouping_id(video_id, gt) = 3 THEN 'overall' WHEN grouping_id(video_id, gt) = 1 THEN 'video' ELSE 'class' END AS scope, coalesce(CAST(video_id AS VARCHAR), gt, 'all') AS name, count(*) AS seconds, round(avg(CASE WHEN gt = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM sec GROUP BY GROUPING SETS ((), (video_id), (gt))", "sec")
def accuracy_by_scope(spark, sf_dir):
    return evaluate.accuracy(_seconds(spark, sf_dir)).select("scope", "name", "seconds", *_r("accuracy"))


@register("""SELECT video_id, gt, pred, min(second) AS start, max(second) AS "end", max(second) - min(second) + 1 AS seconds FROM (SELECT video_id, gt, coalesce(pred, 'unclassified') AS pred, second, second - row_number() OVER (PARTITION BY video_id, gt, coalesce(pred, 'unclassified') ORDER BY second) AS g FROM sec WHERE coalesce(pred, 'unclassified') <> gt) GROUP BY video_id, gt, pred, g""", "sec")
def error_runs(spark, sf_dir):
    return evaluate.error_runs(_seconds(spark, sf_dir))


@register("""SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN round((po - pe) / (1 - pe), 2) > 0.8 THEN 'almost perfect' WHEN round((po - pe) / (1 - pe), 2) >= 0.61 THEN 'substantial' WHEN round((po - pe) / (1 - pe), 2) >= 0.41 THEN 'moderate' ELSE 'fair to poor' END AS band
    FROM (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1 ELSE 0 END) AS po, (count(*) FILTER (a = 'alone') * count(*) FILTER (b = 'alone') + count(*) FILTER (a = 'interacting') * count(*) FILTER (b = 'interacting')) / (count(*) * count(*)) AS pe FROM rated WHERE a IS NOT NULL AND b IS NOT NULL)""", "rated")
def rater_kappa(spark, sf_dir):
    return evaluate.cohen_kappa(A.annotators(spark, sf_dir)).select("n", *_r("agreement", "kappa"), "band")


@register("SELECT gt, CASE WHEN gt = 'interacting' THEN 'interacting' ELSE 'not interacting' END AS binary_gt, count(*) AS n FROM sec GROUP BY ALL", "sec")
def binary_labels(spark, sf_dir):
    return _seconds(spark, sf_dir).groupBy("gt", S.binary_label("gt").alias("binary_gt")).agg(F.count("*").alias("n"))


# Boxes


@register("""SELECT detection_id, round((x1 + x2) / 2 / 2304, 6) AS cx, round((y1 + y2) / 2 / 1296, 6) AS cy, round((x2 - x1) / 2304, 6) AS w, round((y2 - y1) / 1296, 6) AS h FROM det""", "det")
def yolo_boxes(spark, sf_dir):
    y = S.yolo_of_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 2304, 1296)
    return A.detections(spark, sf_dir).select("detection_id", y.alias("b")).select("detection_id", "b.*").select("detection_id", *_r("cx", "cy", "w", "h"))


def _boxes(spark, sf_dir):
    """Every detection, shifted by up to 80 pixels, predicts a face; a frame is known by its video and number. Small boxes shifted off their faces are the misses, persons the false alarms."""
    d = A.detections(spark, sf_dir).withColumn("frame_id", F.struct("video_id", "frame"))
    by = F.col("detection_id") % 5 * 20
    truth = d.filter("kind = 'face'").select("frame_id", F.col("detection_id").alias("gt_id"), "x1", "y1", "x2", "y2")
    return d.select("frame_id", F.col("detection_id").alias("pred_id"), "conf", (F.col("x1") + by).alias("x1"), "y1", (F.col("x2") + by).alias("x2"), "y2"), truth


_BOX_IOU = """SELECT p.video_id, p.frame, p.detection_id AS pred_id, p.conf, g.detection_id AS gt_id, greatest(0, least(p.x2 + p.detection_id % 5 * 20, g.x2) - greatest(p.x1 + p.detection_id % 5 * 20, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1)) AS i,
    (p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) AS areas FROM det p LEFT JOIN (SELECT * FROM det WHERE kind = 'face') g USING (video_id, frame)"""
_BOX_BEST = f"SELECT video_id, frame, pred_id, conf, gt_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame, pred_id ORDER BY iou DESC, gt_id) AS r FROM (SELECT *, CASE WHEN gt_id IS NULL THEN NULL WHEN areas - i > 0 THEN i / (areas - i) ELSE 0 END AS iou FROM ({_BOX_IOU}))) WHERE r = 1"


@register(f"SELECT video_id, frame, pred_id, gt_id, round(iou, 6) AS iou FROM ({_BOX_BEST})", "det")
def best_true_box(spark, sf_dir):
    return boxes.best_truth(*_boxes(spark, sf_dir)).select("frame_id.*", "pred_id", "gt_id", *_r("iou"))


@register(f"SELECT video_id, frame, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_gt, 0) - coalesce(tp, 0) AS fn FROM (SELECT video_id, frame, count(*) AS n_gt FROM det WHERE kind = 'face' GROUP BY ALL) FULL JOIN (SELECT video_id, frame, count(*) AS n_pred, count(DISTINCT CASE WHEN iou >= 0.5 THEN gt_id END) AS tp FROM ({_BOX_BEST}) GROUP BY ALL) USING (video_id, frame)", "det")
def box_matches(spark, sf_dir):
    return boxes.match(*_boxes(spark, sf_dir), least_iou=0.5).select("frame_id.*", "tp", "fp", "fn")


@register(f"SELECT round(threshold, 6) AS threshold, tp, n_pred - tp AS fp, n_gt - tp AS fn FROM (SELECT t.threshold, (SELECT count(*) FROM det WHERE kind = 'face') AS n_gt, count(pred_id) AS n_pred, count(DISTINCT CASE WHEN iou >= 0.5 THEN (video_id, frame, gt_id) END) AS tp FROM (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold) t LEFT JOIN ({_BOX_BEST}) b ON b.conf >= t.threshold GROUP BY t.threshold)", "det")
def threshold_sweep(spark, sf_dir):
    return boxes.threshold_sweep(*_boxes(spark, sf_dir), thresholds=[0.1, 0.3, 0.5, 0.7, 0.9]).select(*_r("threshold"), "tp", "fp", "fn")


@register("SELECT video_id, w AS \"window\", w + o AS place, (w + o) * 10 AS frame, o = 3 AS is_last FROM (SELECT video_id, n, unnest(list_distinct(list_append(range(0, greatest(n - 4, 0) + 1, 3), greatest(n - 4, 0)))) AS w FROM (SELECT video_id, count(*) AS n FROM grid GROUP BY 1)) x, (SELECT unnest(range(4)) AS o) WHERE w + o < n", "grid")
def sliding_windows(spark, sf_dir):
    return boxes.last_of_window(grid.dense_grid(A.videos(spark, sf_dir), P), 4, 3)


@register("SELECT DISTINCT 'f' || video_id || '_' || frame AS file_name FROM det WHERE kind = 'person' EXCEPT SELECT 'f' || video_id || '_' || frame FROM det WHERE kind = 'face'", "det")
def hard_negatives(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("video_id").cast("string"), F.lit("_"), F.col("frame").cast("string")).alias("file_name")
    d = A.detections(spark, sf_dir).select("kind", name)
    return datasets.hard_negatives(d.filter("kind = 'person'"), d.filter("kind = 'face'"))


@register("SELECT 'f' || v.video_id AS file_name, coalesce(max(CASE WHEN age_class = 0 THEN 1 ELSE 0 END), 0) AS class_0, coalesce(max(CASE WHEN age_class = 1 THEN 1 ELSE 0 END), 0) AS class_1, CASE WHEN count(d.frame) > 0 THEN 1 ELSE 0 END AS has_annotation FROM vid v LEFT JOIN det d USING (video_id) GROUP BY v.video_id", "vid", "det")
def class_presence(spark, sf_dir):
    name = F.concat(F.lit("f"), F.col("video_id").cast("string")).alias("file_name")
    labels = A.detections(spark, sf_dir).select(name, F.col("age_class").alias("class_id"))
    return datasets.class_presence(A.videos(spark, sf_dir).select(name), labels, [0, 1])


@register("SELECT 'img_' || l_orderkey AS file_name, string_agg(line, chr(10) ORDER BY line) AS content FROM (SELECT DISTINCT l_orderkey, (l_linenumber % 2)::VARCHAR || ' ' || printf('%.6f', l_discount) || ' ' || printf('%.6f', l_tax) || ' 0.500000 0.250000' AS line FROM lineitem) GROUP BY l_orderkey")
def label_files(spark, sf_dir):
    b = A.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("img_"), F.col("l_orderkey").cast("string")).alias("file_name"), (F.col("l_linenumber") % 2).alias("class_id"), F.col("l_discount").alias("cx"), F.col("l_tax").alias("cy"), F.lit(0.5).alias("w"), F.lit(0.25).alias("h"))
    return datasets.yolo_lines(b, keep_duplicates=False)


# Statistics


@register("""SELECT "group", count(*) AS n, round(corr(t, e), 6) AS pearson, round(corr(rt, re), 6) AS spearman, round(avg(abs(e - t)), 6) AS mae, round(sqrt(avg((e - t) * (e - t))), 4) AS rmse, round(avg(e - t), 6) AS bias FROM
    (SELECT *, rank() OVER (PARTITION BY "group" ORDER BY t) + (count(*) OVER (PARTITION BY "group", t) - 1) / 2 AS rt, rank() OVER (PARTITION BY "group" ORDER BY e) + (count(*) OVER (PARTITION BY "group", e) - 1) / 2 AS re FROM
    (SELECT l_quantity AS t, l_quantity * (1 - l_discount) + l_linenumber AS e, unnest(['all', l_returnflag]) AS "group" FROM lineitem)) GROUP BY 1""")
def series_agreement(spark, sf_dir):
    li = A.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("t"), (F.col("l_quantity") * (1 - F.col("l_discount")) + F.col("l_linenumber")).alias("e"), "l_returnflag")
    return stats.series_agreement(li, "t", "e", "l_returnflag").select("group", "n", *_r("pearson", "spearman", "mae"), *_r("rmse", digits=4), *_r("bias"))


@register("""SELECT class, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(ok / n, 6) AS accuracy FROM
    (SELECT 'quality_as_toxic' AS class, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = toxic) AS ok, count(*) AS n FROM labels
    UNION ALL SELECT 'toxic_as_quality', count(*) FILTER (quality = 1 AND toxic = 1), count(*) FILTER (toxic = 0 AND quality = 1), count(*) FILTER (toxic = 1 AND quality = 0), count(*) FILTER (quality = toxic), count(*) FROM labels)""")
def binary_metrics(spark, sf_dir):
    return stats.binary_metrics(A.read(spark, sf_dir, "labels"), {"quality_as_toxic": ("quality", "toxic"), "toxic_as_quality": ("toxic", "quality")}).select("class", *_r("precision", "recall", "f1", "accuracy"))


@register("SELECT video_id, count(*) AS n_frames, sum(CASE WHEN face_conf > 0 THEN 1 ELSE 0 END)::BIGINT AS n_child, sum(CASE WHEN person_conf > 0 THEN 1 ELSE 0 END)::BIGINT AS n_adult, (count(*) - sum(CASE WHEN face_conf > 0 THEN 1 ELSE 0 END) - sum(CASE WHEN person_conf > 0 THEN 1 ELSE 0 END))::BIGINT AS n_no_person FROM fr GROUP BY video_id", "fr")
def frame_tallies(spark, sf_dir):
    f = analysis.frames(spark, sf_dir, P)
    return stats.frame_tallies(f.select("video_id", (F.col("face_conf") > 0).cast("int").alias("child"), (F.col("person_conf") > 0).cast("int").alias("adult")))


@register("SELECT round(max(conf), 6) AS max, round(min(conf), 6) AS min, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std FROM det", "det")
def confidence_distribution(spark, sf_dir):
    return stats.distribution(A.detections(spark, sf_dir), "conf").select(*_r("max", "min", "mean", "std"))


@register("SELECT stage, n, (SELECT count(*) FROM vid) - n AS lost FROM (SELECT 'videos' AS stage, count(*) AS n FROM vid UNION ALL SELECT 'faces', count(DISTINCT video_id) FROM det WHERE kind = 'face' UNION ALL SELECT 'books', count(DISTINCT video_id) FROM book)", "vid", "det", "book")
def stage_audit(spark, sf_dir):
    return stats.stage_audit({"videos": A.videos(spark, sf_dir), "faces": A.detections(spark, sf_dir).filter("kind = 'face'"), "books": A.books(spark, sf_dir)}, "video_id")


# Text functions


@register("""SELECT page_id, CAST(page_id % 60 AS INTEGER) * 60 + CAST(page_id % 59 AS INTEGER) + 0.0::DOUBLE AS mmss, CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id + 0.5 END::DOUBLE AS plain FROM pages""")
def clock_seconds(spark, sf_dir):
    p = A.read(spark, sf_dir, "pages")
    mmss = F.concat_ws(":", (F.col("page_id") % 60).cast("string"), (F.col("page_id") % 59).cast("string"))
    plain = F.when(F.col("page_id") % 3 == 0, F.lit("x")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".5")))
    return p.select("page_id", S.seconds_of_clock(mmss).alias("mmss"), S.seconds_of_clock(plain).alias("plain"))


@register("""SELECT video_id, child_id, 'id' || child_id AS label, video_id AS last_number, 'cam_id' || child_id AS video FROM vid""", "vid")
def name_parts(spark, sf_dir):
    v = A.videos(spark, sf_dir)
    return v.select("video_id", S.subject_id("video_name").alias("child_id"), S.subject_label("video_name").alias("label"), S.last_number("video_name").alias("last_number"), S.video_of_frame_name("video_name").alias("video"))


@register("""SELECT page_id, split_part(url, '/', -1) AS file, CASE WHEN length(url) - length(replace(url, '/', '')) >= 1 THEN split_part(url, '/', -2) END AS folder FROM pages""")
def path_parts(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", S.path_part("url", 1).alias("file"), S.path_part("url", 2).alias("folder"))


@register("SELECT p_partkey, round(p_retailprice, 2) AS price, p_size % 4 AS class_code FROM part WHERE p_size % 4 IS NOT NULL")
def clean_numbers(spark, sf_dir):
    p = A.read(spark, sf_dir, "part")
    dirty = F.concat(F.lit('" '), F.regexp_replace(F.format_string("%.2f", F.col("p_retailprice")), r"\.", ","), F.lit(' "'))
    return p.select("p_partkey", S.clean_number(dirty).alias("price"), (F.col("p_size") % 4).alias("class_code"))


# Datasets and splits


def _annotations(spark, sf_dir):
    """Annotations from line items: part 1 to 12 as category, every ninth as noise, every fifth outside."""
    li = A.read(spark, sf_dir, "lineitem")
    cat = F.when(F.col("l_partkey") % 9 == 0, -1).otherwise((F.col("l_partkey") % 11 + 1).cast("int"))
    return li.select((F.col("l_orderkey") % 50).alias("video_id"), F.col("l_orderkey").alias("image_id"), cat.cast("int").alias("category_id"), (F.col("l_linenumber") % 5 == 0).cast("int").alias("outside"), F.col("l_suppkey").alias("person_ID"))


_ANN = "(SELECT l_orderkey % 50 AS video_id, l_orderkey AS image_id, CAST(CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_partkey % 11 + 1 END AS INTEGER) AS category_id, CAST(l_linenumber % 5 = 0 AS INTEGER) AS outside, l_suppkey AS person_id FROM lineitem)"


@register(f"SELECT DISTINCT a.*, 'img_' || a.image_id AS file_name, 'v_' || a.video_id AS video_name FROM {_ANN} a JOIN orders o ON o.o_orderkey = a.image_id WHERE outside = 0 AND category_id IN (1, 10)")
def visible_annotations(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders")
    images = o.select((F.col("o_orderkey") % 50).alias("video_id"), F.col("o_orderkey").alias("frame_id"), F.concat(F.lit("img_"), F.col("o_orderkey").cast("string")).alias("file_name"))
    videos = spark.range(50).select("id", F.concat(F.lit("v_"), F.col("id").cast("string")).alias("file_name"))
    return datasets.visible_annotations(_annotations(spark, sf_dir), images, videos, [1, 10]).withColumnRenamed("person_ID", "person_id")


@register(f"SELECT DISTINCT video_id, image_id FROM {_ANN} WHERE category_id = -1")
def noisy_frames(spark, sf_dir):
    return datasets.noisy_frames(_annotations(spark, sf_dir))


@register(f"SELECT video_id, image_id FROM {_ANN} GROUP BY ALL HAVING max(category_id) = -1")
def purely_noisy_frames(spark, sf_dir):
    return datasets.noisy_frames(_annotations(spark, sf_dir), strict=True)


@register(f"SELECT category_id, CASE WHEN category_id = 1 AND person_id = 1 THEN 11 ELSE category_id END AS new_category, CASE category_id WHEN 1 THEN 'person' WHEN 2 THEN 'reflection' WHEN 10 THEN 'face' WHEN -1 THEN 'noise' WHEN 11 THEN 'unknown' ELSE 'object' END AS supercategory, count(*) AS n FROM {_ANN} GROUP BY ALL")
def category_rollup(spark, sf_dir):
    a = _annotations(spark, sf_dir).withColumn("old", F.col("category_id"))
    return datasets.first_person_class(a).groupBy(F.col("old").alias("category_id"), F.col("category_id").alias("new_category"), S.supercategory("old").alias("supercategory")).agg(F.count("*").alias("n"))


@register("SELECT video_id, frame, CASE WHEN video_id % 3 = 0 AND frame >= 500 THEN (frame - 500) % CASE WHEN video_id % 2 = 0 THEN 60 ELSE 30 END = 0 ELSE frame % CASE WHEN video_id % 3 = 0 AND video_id % 2 = 0 THEN 60 ELSE 30 END = 0 END AS sampled FROM grid", "grid")
def sampled_frames(spark, sf_dir):
    g = grid.dense_grid(A.videos(spark, sf_dir), P)
    own = g.withColumns({"from": F.when(F.col("video_id") % 3 == 0, 500), "own": F.when((F.col("video_id") % 3 == 0) & (F.col("video_id") % 2 == 0), 60)})
    return own.select("video_id", "frame", datasets.is_sampled("frame", 30, "from", "own").alias("sampled"))


@register("SELECT g.video_id, g.frame, CASE WHEN d.frame IS NOT NULL THEN 'positive' ELSE 'negative' END AS kind FROM grid g LEFT JOIN (SELECT DISTINCT video_id, frame FROM det) d USING (video_id, frame) LEFT JOIN shown s USING (video_id, frame) WHERE d.frame IS NOT NULL OR (g.frame % 30 = 0 AND s.frame IS NULL)", "grid", "det", "shown")
def frame_inventory(spark, sf_dir):
    return datasets.inventory(grid.dense_grid(A.videos(spark, sf_dir), P), A.detections(spark, sf_dir), A.books(spark, sf_dir), 30)


@register("SELECT video_id, frame, CASE WHEN frame <= 0.8 * max(frame) OVER (PARTITION BY video_id) THEN 'train' ELSE 'val' END AS split FROM grid WHERE frame <= 1800", "grid")
def early_split(spark, sf_dir):
    return datasets.early_split(grid.dense_grid(A.videos(spark, sf_dir), P), 1.0)


def _images(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("img_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file_name"), (F.col("o_custkey") % 97).alias("child_id"), (F.col("o_orderstatus") == "F").cast("int").alias("class_0"), (F.col("o_orderstatus") == "P").cast("int").alias("class_1"), (F.col("o_orderstatus") != "O").cast("int").alias("has_annotation"))


def _groups(spark, sf_dir):
    return _images(spark, sf_dir).groupBy("child_id").agg(F.sum("class_0").alias("class_0"), F.sum("class_1").alias("class_1"), F.sum("has_annotation").alias("positives"), F.count("*").alias("total"))


@register("SELECT o_custkey % 97 AS child_id, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS class_0, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS class_1, sum(CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END)::BIGINT AS positives, count(*) AS total FROM orders GROUP BY 1")
def group_coverage(spark, sf_dir):
    return _groups(spark, sf_dir)


@register()
def balanced_split(spark, sf_dir):
    return splits.greedy_split(_groups(spark, sf_dir), "child_id", "class_0", "class_1", "positives", "total")


@register()
def ratio_split(spark, sf_dir):
    return splits.greedy_split(_groups(spark, sf_dir), "child_id", "class_0", "class_1", "positives", "total", by_hash=42)


@register()
def balanced_dataset(spark, sf_dir):
    images = _images(spark, sf_dir)
    negatives = images.filter("has_annotation = 0").select("file_name", "child_id", F.endswith("file_name", F.lit("3.jpg")).alias("is_hard"))
    return datasets.build_split(images, negatives, "balanced", groups=_groups(spark, sf_dir))


_FIXED = "CASE WHEN o_custkey % 97 < 60 THEN 'train' WHEN o_custkey % 97 < 80 THEN 'val' ELSE 'test' END"


def _fixed(spark, sf_dir):
    c = F.col("child_id")
    return _images(spark, sf_dir).withColumn("split", F.when(c < 60, "train").when(c < 80, "val").otherwise("test"))


@register(f"SELECT s AS split, count(DISTINCT c) AS groups, count(*) AS images, sum(p)::BIGINT AS positives, sum(f)::BIGINT AS class_0, round(sum(p) / count(*), 6) AS positive_share FROM (SELECT {_FIXED} AS s, o_custkey % 97 AS c, CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 0 END AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS f FROM orders) GROUP BY ROLLUP (s)")
def split_report(spark, sf_dir):
    return datasets.split_report(_fixed(spark, sf_dir), ["class_0"]).select("split", "groups", "images", "positives", "class_0", *_r("positive_share"))


@register(f"SELECT split, least(count(*), 100) AS n FROM (SELECT {_FIXED} AS split FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def sampled_negatives(spark, sf_dir):
    quota = spark.createDataFrame([(s, 100) for s in splits.SPLITS], "split string, quota long")
    return splits.sample_by_quota(_fixed(spark, sf_dir).filter("has_annotation = 0"), quota, "split", "file_name", 42).groupBy("split").agg(F.count("*").alias("n"))


@register(f"SELECT 'in/' || k || '/' || CASE k WHEN 'images' THEN f || '.jpg' ELSE f || '.txt' END AS source, 'out/' || s || '/' || k || '/' || CASE k WHEN 'images' THEN f || '.jpg' ELSE f || '.txt' END AS target FROM (SELECT {_FIXED} AS s, 'img_' || o_orderkey AS f FROM orders), (SELECT unnest(['images', 'labels']) AS k)")
def copy_manifest(spark, sf_dir):
    return datasets.copy_manifest(_fixed(spark, sf_dir), "in", "out")


@register("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_custkey % 5 = 0")
def upserted(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("name"))
    more = c.filter("c_custkey % 5 = 0").select((-F.col("c_custkey") - 1).alias("id"), F.lit("new").alias("name"))
    return sinks.insert_missing(sinks.upsert(old, new, "id"), more, "id")


@register("SELECT video_id, max_frame, CASE WHEN max_frame > 2385 THEN 'long' ELSE 'short' END AS kind FROM vid", "vid")
def longest_videos(spark, sf_dir):
    return A.videos(spark, sf_dir).select("video_id", "max_frame", F.when(F.col("max_frame") > 2385, "long").otherwise("short").alias("kind"))


@register()
def duration_split(spark, sf_dir):
    return splits.split_by_duration(A.videos(spark, sf_dir).select("video_id", "max_frame"), "video_id", "max_frame", 0.8, 42)


@register()
def fitting_split(spark, sf_dir):
    return splits.split_by_fit(A.videos(spark, sf_dir).select("video_id", "max_frame"), "video_id", "max_frame", 0.8, 42)


#: Three values for every parameter that a frame's state depends on.
SPACE = {
    "turn_gap_sec": [6.0, 8.0, 10.0], "same_gap_sec": [1.0, 1.5, 9.0], "presence_sec": [1.0, 1.5, 2.0], "short_memory_sec": [1.0, 2.0, 3.0], "long_memory_sec": [0.0, 1.0, 2.0], "sustained_sec": [0.7, 1.0, 1.5],
    "kcds_share": [0.6, 0.8, 1.0], "ohs_share": [0.03, 0.3, 0.6], "instant_confidence": [0.3, 0.4, 0.5], "proximity": [0.7, 0.8, 0.9], "gate": [0.1, 0.18, 0.25], "anchor_proximity": [0.4, 0.5, 0.6], "anchor_face": [0.5, 0.6, 0.7],
}
TRIALS = [P.but(**own) for own in analysis.draw(SPACE, 20, 7)]


def _window(seconds: float) -> str:
    width = P.window(seconds)
    return f"{width // 2}, {max(width - 1, 0) // 2}"


def _trial_row(k: int, p: Params) -> str:
    return f"({k}, {p.turn_gap_sec * p.fps}::DOUBLE, {p.same_gap_sec * p.fps}::DOUBLE, {_window(p.presence_sec)}, {_window(p.short_memory_sec)}, {_window(p.long_memory_sec)}, {p.window(p.long_memory_sec)}, {p.window(p.sustained_sec)}, " + ", ".join(f"{v}::DOUBLE" for v in (p.kcds_share, p.ohs_share, p.instant_confidence, p.proximity, p.gate, p.anchor_proximity, p.anchor_face)) + ")"


_SEARCH = (
    query("", "fr", "seq").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", tr(trial, turn, same, pb, pa, sb, sa, lb, la, lw, sw, kc, oh, ic, px, gate, ap, af) AS (VALUES "
    + ", ".join(_trial_row(k, p) for k, p in enumerate(TRIALS))
    + """), gp AS (SELECT DISTINCT turn, same FROM tr),
    fo AS (SELECT turn, same, video_id, n, a AS s, b AS e, type = 'kchi' AS k, type = 'cds' AS c, 1 AS bout FROM seq, gp WHERE n = 1
        UNION ALL SELECT f.turn, f.same, q.video_id, q.n, CASE WHEN j THEN f.s ELSE q.a END, q.b, CASE WHEN j THEN f.k OR q.type = 'kchi' ELSE q.type = 'kchi' END, CASE WHEN j THEN f.c OR q.type = 'cds' ELSE q.type = 'cds' END, f.bout + CASE WHEN j THEN 0 ELSE 1 END
        FROM fo f JOIN seq q ON q.video_id = f.video_id AND q.n = f.n + 1, LATERAL (SELECT q.a - f.e <= CASE WHEN CASE WHEN q.type = 'kchi' THEN f.k ELSE f.c END THEN f.same ELSE f.turn END AS j)),
    bo AS (SELECT turn, same, video_id, min(s) AS a, max_by(e, n) AS b FROM fo GROUP BY turn, same, video_id, bout HAVING bool_or(k) AND bool_or(c)),
    cov AS (SELECT DISTINCT turn, same, video_id, unnest(range(a, b + 1, 10)) AS frame FROM bo WHERE b >= a),
    ft AS (SELECT *, avg(presence_conf) OVER (w ROWS BETWEEN pb PRECEDING AND pa FOLLOWING) AS score, max(presence_conf) OVER (w ROWS BETWEEN sb PRECEDING AND sa FOLLOWING) >= ic OR (lw > 0 AND max(CASE WHEN coalesce(proximity > ap, false) OR face_conf > af THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN lb PRECEDING AND la FOLLOWING) = 1) AS seen,
        count(*) OVER (w ROWS BETWEEN sw - 1 PRECEDING AND CURRENT ROW) = sw AND sum(has_cds) OVER (w ROWS BETWEEN sw - 1 PRECEDING AND CURRENT ROW) >= kc * sw AS long_cds, count(*) OVER (w ROWS BETWEEN sw - 1 PRECEDING AND CURRENT ROW) = sw AND sum(has_ohs) OVER (w ROWS BETWEEN sw - 1 PRECEDING AND CURRENT ROW) >= oh * sw AS long_ohs
        FROM fr, tr WINDOW w AS (PARTITION BY trial, video_id ORDER BY frame)),
    ss AS (SELECT trial, video_id, frame, CASE WHEN ((has_kchi = 1 OR has_cds = 1) AND cov.frame IS NOT NULL) OR (long_cds AND score >= gate) OR coalesce(presence_conf >= ic AND proximity >= px, false) THEN 'interacting' WHEN seen OR (long_ohs AND score >= gate) THEN 'available' ELSE 'alone' END AS state FROM ft LEFT JOIN cov USING (turn, same, video_id, frame)),
    lab AS (SELECT trial, video_id, frame // 30 AS second, max_by(state, frame) AS pred FROM ss GROUP BY ALL),
    tru AS (SELECT video_id, frame // 30 AS second, CASE WHEN has_kchi = 1 THEN 'interacting' WHEN presence_conf > 0.3 THEN 'available' ELSE 'alone' END AS gt FROM fr WHERE frame % 30 = 0),
    pairs AS (SELECT trial, gt, pred FROM tru CROSS JOIN (SELECT trial FROM tr) LEFT JOIN lab USING (trial, video_id, second)),
    cl AS (SELECT trial, label, (SELECT count(*) FROM pairs p WHERE p.trial = l.trial AND gt = label) AS support, (SELECT count(*) FROM pairs p WHERE p.trial = l.trial AND pred = label) AS predicted, (SELECT count(*) FROM pairs p WHERE p.trial = l.trial AND gt = label AND pred = label) AS tp FROM (SELECT DISTINCT trial, gt AS label FROM pairs) l),
    pr AS (SELECT trial, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, tp / support AS r FROM cl)
    SELECT trial, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM pr GROUP BY trial"""
)


def _searched(spark, sf_dir):
    observed = shared.written(analysis.frames(spark, sf_dir, P), "frames")
    truth = observed.filter(F.col("frame") % 30 == 0).select("video_id", (F.col("frame") / 30).cast("long").alias("second"), F.when(F.col("has_kchi") == 1, "interacting").when(F.col("presence_conf") > 0.3, "available").otherwise("alone").alias("gt"))
    return observed, truth


@register(_SEARCH)
def parameter_search(spark, sf_dir):
    return analysis.search(*_searched(spark, sf_dir), TRIALS).select("trial", *_r("macro_precision", "macro_recall", "macro_f1"))


@register(_SEARCH)
def resumed_search(spark, sf_dir):
    """A search stopped after its first ten trials goes on with the others."""
    given, path = _searched(spark, sf_dir), shared.fresh_path(spark, "search")
    analysis.resumable_search(*given, TRIALS[:10], path)
    return analysis.resumable_search(*given, TRIALS, path).select("trial", *_r("macro_precision", "macro_recall", "macro_f1"))


@register("SELECT video_id, CAST(floor(k / 16) AS BIGINT) AS sequence, count(*) AS size, 16 AS n_features, 16 AS n_labels FROM (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame) - 1 AS k FROM grid) GROUP BY ALL", "grid")
def padded_sequences(spark, sf_dir):
    f = analysis.frames(spark, sf_dir, P).select("video_id", "frame", F.array("presence_conf", "face_conf").alias("features"), "has_kchi")
    found = predict.padded_sequences(f, "features", "has_kchi", 16)
    return found.select("video_id", "sequence", "size", F.size("features").alias("n_features"), F.size("labels").alias("n_labels"))


from kithline.plans import catalog_files, catalog_streams  # noqa: E402, F401 (they register their queries here)

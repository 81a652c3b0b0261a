"""Scalar functions as Column expressions: parsing, boxes, labels, proximity, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kithline.params import ALONE, AVAILABLE, INTERACTING, STATE_NAMES, Params

# Fixed values.
CATEGORY_OF_LABEL = {"person": 1, "reflection": 2, "book": 3, "animal": 4, "toy": 5, "kitchenware": 6, "screen": 7, "food": 8, "object": 9, "other_object": 12, "face": 10, "child_body_parts": 11, "voice": 20, "noise": -1}
SUPERCATEGORY_OF_CATEGORY = {1: "person", 2: "reflection", 3: "object", 4: "object", 5: "object", 6: "object", 7: "object", 8: "object", 9: "object", 12: "object", 10: "face", 20: "voice", -1: "noise", 99: "unknown"}
AGE_CLASSES = {
    "face_only": {"infant": 0, "child": 0, "teen": 0, "adult": 0},
    "face_binary": {"infant": 0, "child": 0, "teen": 1, "adult": 1},
    "person_only": {"Inf": 0, "Child": 0, "Teen": 0, "Adult": 0, "Dk": 0},
    "person_binary": {"Inf": 0, "Child": 0, "Teen": 1, "Adult": 1},
}
#: Areas of a close and a far face in pixels and its usual width over height, for children (0) and adults (1).
PROXIMITY_REFERENCES = {0: (458185, 308, 0.965166908563135), 1: (442980, 208, 0.6461352657004831)}
BOOK_CLASSES = (73,)


def lookup(key: Column, table: dict) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None)


def seconds_of_clock(text: str | Column) -> Column:
    """MM:SS, HH:MM:SS or plain seconds as a double; null for anything else."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    parts = F.split(text, ":")
    number = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(F.size(parts) == 2, number[0] * 60 + number[1]).when(F.size(parts) == 3, number[0] * 3600 + F.get(number, F.lit(1)) * 60 + F.get(number, F.lit(2))).when(F.size(parts) == 1, number[0])


def subject_id(name: str | Column) -> Column:
    """The six digits after ``id``, or null."""
    return F.nullif(F.regexp_extract(name, r"id(\d{6})", 1), F.lit(""))


def subject_label(name: str | Column) -> Column:
    """``id`` with the digits that stand between it and an underscore, or null."""
    return F.nullif(F.regexp_extract(name, r"(id\d+)_", 1), F.lit(""))


def last_number(name: str | Column) -> Column:
    """The last run of digits as a long, 0 if there is none or it is too large."""
    runs = F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0))
    return F.coalesce(F.when(F.size(runs) > 0, F.element_at(runs, -1)).try_cast("long"), F.lit(0).cast("long"))


def frame_suffix(name: str | Column) -> Column:
    """The six digits after the last underscore of a frame's file name without its suffix, or null."""
    return F.regexp_extract(name, r"_(\d{6})(\.\w+)?$", 1).try_cast("long")


def path_part(path: str | Column, from_end: int) -> Column:
    """A path's part counted from its end (1: the file); null beyond its start."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def frame_of_path(path: str | Column) -> Column:
    """The number after the last underscore of a path's file name without its suffix, or null."""
    return F.substring_index(F.regexp_replace(path_part(path, 1), r"\.[^.]*$", ""), "_", -1).try_cast("long")


def video_of_frame_name(name: str | Column) -> Column:
    """All but the last underscore-separated token."""
    return F.regexp_replace(name, r"_[^_]*$", "")


def box_of_json(text: str | Column) -> Column:
    """[x1, y1, x2, y2] as a struct of ints; null if there aren't exactly four numbers."""
    found = F.from_json(text, "array<double>")
    whole = (F.size(found) == 4) & F.forall(found, lambda x: x.isNotNull())
    return F.when(whole, F.struct(*[found[k].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]))


def yolo_of_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """A pixel box as centre and size, relative to the frame."""
    return F.struct(((x1 + x2) / 2 / width).alias("cx"), ((y1 + y2) / 2 / height).alias("cy"), ((x2 - x1) / width).alias("w"), ((y2 - y1) / height).alias("h"))


def box_of_yolo(cx: Column, cy: Column, w: Column, h: Column, width: int, height: int) -> Column:
    return F.struct(((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    shared = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def clean_number(text: str | Column) -> Column:
    """A number written with quotes, spaces or a decimal comma, as a double; null for anything else."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, '"', ""), ",", ".")).try_cast("double")


def binary_label(label: str | Column) -> Column:
    """interacting, or not interacting for available and alone; other labels pass through."""
    label = F.col(label) if isinstance(label, str) else label
    return F.coalesce(lookup(F.lower(F.trim(label)), {"interacting": "interacting", "available": "not interacting", "alone": "not interacting"}), label)


def state_name(state: str | Column) -> Column:
    return lookup(F.col(state) if isinstance(state, str) else state, STATE_NAMES)


def category(label: str | Column) -> Column:
    return F.coalesce(lookup(F.col(label) if isinstance(label, str) else label, CATEGORY_OF_LABEL), F.lit(-1))


def supercategory(category_id: str | Column) -> Column:
    return F.coalesce(lookup(F.col(category_id) if isinstance(category_id, str) else category_id, SUPERCATEGORY_OF_CATEGORY), F.lit("unknown"))


def kappa_band(kappa: str | Column) -> Column:
    """Agreement in words, rounded to two decimals first so that no value falls between bands."""
    k = F.round(kappa, 2)
    return F.when(k > 0.80, "almost perfect").when(k >= 0.61, "substantial").when(k >= 0.41, "moderate").otherwise("fair to poor")


def proximity(x1: Column, y1: Column, x2: Column, y2: Column, age_class: Column, tolerance: float = 1.0) -> Column:
    """How close a face is, 0 to 1, by the logarithm of its area between that of a far and a close face; null for other classes.

    A face whose shape is far from the usual one is cut by the frame's edge and counts as closest.
    """
    width, height = (x2.cast("long") - x1.cast("long")), (y2.cast("long") - y1.cast("long"))
    area, shape = width * height, F.when(height != 0, width / height).otherwise(0.0)
    out = F.lit(None).cast("double")
    for k, (close, far, usual) in PROXIMITY_REFERENCES.items():
        between = (F.log(area.cast("double")) - F.log(F.lit(float(far)))) / (F.log(F.lit(float(close))) - F.log(F.lit(float(far))))
        value = F.when(F.abs(shape - usual) > tolerance, 1.0).when(area >= close, 1.0).when(area <= far, 0.0).otherwise(F.least(F.greatest(between, F.lit(0.0)), F.lit(1.0)))
        out = F.when(age_class == k, value).otherwise(out)
    return out


def state(p: Params, features: dict[str, Column] | None = None) -> Column:
    """A frame's state from its features; each of rules 1 (turn taking), 3 (sustained speech) and 2 (proximity) counts only if in p.rules.

    features: those that aren't columns of their own name.
    """
    names = ("presence_score", "in_bout", "sustained_kcds", "seen_recently", "sustained_ohs")
    own = {c: F.col(c) for c in names if c not in (features or {})} | (features or {})
    anchored = F.coalesce(own["presence_score"] >= p.gate, F.lit(False))
    close = F.coalesce((F.col("presence_conf") >= p.instant_confidence) & (F.col("proximity") >= p.proximity), F.lit(False))
    rules = {1: own["in_bout"], 3: own["sustained_kcds"] & anchored, 2: close}
    engaged = F.lit(False)
    for k, fires in rules.items():
        if k in p.rules:
            engaged = engaged | fires
    return F.when(engaged, INTERACTING).when(own["seen_recently"] | (own["sustained_ohs"] & anchored), AVAILABLE).otherwise(ALONE)

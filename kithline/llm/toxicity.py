"""Toxicity: cumulative-link ordinal regression over sparse text features.

Severity grades 0..K-1 are ordered. For a document with features x,
P(grade > k) = sigmoid(w.x - threshold[k]); all thresholds share the weights w
and stay ordered because each is the one before plus a positive step. The
expected severity is the sum of those probabilities over k.

Features are lower-cased words and their first 4, 5 and 6 bytes, hashed: an
insult also shows in the stem of words not seen before. A feature seen n times
in a text weighs 1 + ln n. Only features whose share of rows differs
significantly between grade 0 and the grades above count; tasks find them, so
that few numbers reach the driver, where accelerated proximal gradient descent
over all sampled rows fits their weights with an L1 penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import RollingHash, blocks, map_rows, sample_labelled, scratch, struct, utf8, words_of, written

#: At most so many labelled rows train the model; whole texts of each are used.
SAMPLE_ROWS = 12_000
SLOT_BITS = 20
#: Bytes of the stems that count beside whole words.
STEMS = (4, 5, 6)
#: A text is toxic from this probability of a grade over 0.
TOXIC = 0.2
#: Words: runs of ASCII letters and digits and of everything beyond ASCII.
_IN_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def feature_slots(data: np.ndarray, offsets: np.ndarray, bits: int, hasher: RollingHash) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all words and stems, row by row, and each row's range of them."""
    data = _lower(data)
    starts, ends, ranges = words_of(_IN_WORD[data], offsets)
    prefix, down = hasher.prefix(data), np.uint64(64 - bits)
    kinds = [(hasher.spans(prefix, starts, ends) >> down).astype(np.int64)]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(ranges))
    owners = [rows]
    for n in STEMS:
        long = ends - starts > n
        h = hasher.spans(prefix, starts[long], starts[long] + n) * np.uint64(2 * n + 1)
        kinds.append((h >> down).astype(np.int64))
        owners.append(rows[long])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(kinds)[order], np.searchsorted(owner[order], np.arange(len(offsets)))


def _counted(bits: int, shared):
    """Each text's counts of the features chosen."""

    def of(row: pa.StructArray) -> pa.StructArray:
        hasher, slots, counts = RollingHash(), [], []
        chosen = np.zeros(1 << bits, bool)
        chosen[shared.value] = True
        for lo, hi, data, offsets in blocks(*utf8(row.field("text"))):
            all_slots, ranges = feature_slots(data, offsets, bits, hasher)
            for i in range(hi - lo):
                own = all_slots[ranges[i] : ranges[i + 1]]
                found, n = np.unique(own[chosen[own]], return_counts=True)
                slots.append(found.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
        return struct(slots=pa.array(slots, pa.binary()), counts=pa.array(counts, pa.binary()))

    return of


def telling_slots(sample: DataFrame, bits: int, least_z: float) -> np.ndarray:
    """Slots whose share of rows differs between label 0 and the labels above by least_z standard errors.

    Rows are counted by slot within each task first; what reaches the driver
    are the slots chosen.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hasher = np.zeros((2, 1 << bits), np.int32), RollingHash()
        for batch in batches:
            over = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for lo, hi, data, offsets in blocks(*utf8(batch.column(0))):
                slots, ranges = feature_slots(data, offsets, bits, hasher)
                for i in range(hi - lo):
                    seen[int(over[lo + i]), np.unique(slots[ranges[i] : ranges[i + 1]])] += 1
        some = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(some), 100_000):
            own = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[0, own].astype(np.int64)), pa.array(seen[1, own].astype(np.int64))], names=["slot", "n0", "n1"])

    rows = sample.agg(F.count_if(F.col("label") <= 0).alias("r0"), F.count_if(F.col("label") > 0).alias("r1")).first()
    r0, r1 = max(rows["r0"], 1), max(rows["r1"], 1)
    seen = sample.select("text", "label").mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    pooled = (F.col("n0") + F.col("n1") + 0.5) / (r0 + r1 + 1)
    error = F.sqrt(pooled * (1 - pooled) * (1 / r0 + 1 / r1))
    found = seen.filter(F.abs(F.col("n1") / r1 - F.col("n0") / r0) >= least_z * error).select("slot").toArrow()  # slots, at most
    return np.sort(found["slot"].to_numpy().astype(np.int64))


@dataclass
class OrdinalModel:
    weights: np.ndarray  # of slots with weight
    slots: np.ndarray  # sorted
    thresholds: np.ndarray
    bits: int


def _seen(slots: list[np.ndarray], over: np.ndarray, bits: int) -> np.ndarray:
    """In how many rows each slot occurs, apart for rows where over is 0 and 1."""
    seen = np.zeros((2, 1 << bits), np.int32)
    for s, k in zip(slots, over, strict=True):
        seen[k, s] += 1  # a row's slots are distinct
    return seen


def grade_by_markers(slots: list[np.ndarray], counts: list[np.ndarray], toxic: np.ndarray, bits: int, grades: int) -> np.ndarray:
    """Severity grades of rows that are only labelled toxic or not.

    Markers are features whose document frequency among toxic rows is over ten
    times that among the others. Toxic rows get grades 1 and up by how often
    they use markers, cut at equal parts of the toxic rows with any; toxic
    rows without markers get 1, all others 0.
    """
    seen, n = _seen(slots, toxic, bits), np.maximum(np.bincount(toxic, minlength=2), 1)
    marker = (seen[1] >= 3) & (seen[1] / n[1] > 10 * (seen[0] + 0.5) / n[0])
    used = np.array([c[marker[s]].sum() for s, c in zip(slots, counts, strict=True)])
    known = used[(toxic == 1) & (used > 0)]
    cuts = np.quantile(known, np.arange(1, grades - 1) / (grades - 1)) if len(known) and grades > 2 else np.zeros(0)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, used, side="right"), 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _largest(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, m: int) -> float:
    """The largest eigenvalue of X'X, by power iteration."""
    v, norm = np.ones(m), 0.0
    for _ in range(20):
        v /= np.linalg.norm(v) + 1e-12
        v = np.bincount(column, weights=np.bincount(row, weights=v[column] * value, minlength=n)[row] * value, minlength=m)
        norm = np.linalg.norm(v)
    return float(norm) * 1.1


def train(slots: list[np.ndarray], counts: list[np.ndarray], grade: np.ndarray, *, bits: int = SLOT_BITS, grades: int = 4, rounds: int = 300, rate: float = 0.2, l1: float = 1e-4) -> OrdinalModel:
    """Maximises the likelihood of the grades less an L1 penalty on the weights; thresholds stay ordered."""
    if not sum(map(len, slots)):
        return OrdinalModel(np.zeros(0, np.float32), np.zeros(0, np.int64), np.full(grades - 1, 4.0) + np.arange(grades - 1), bits)
    flat, value = np.concatenate(slots).astype(np.int64), 1 + np.log(np.concatenate(counts))
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    used, column = np.unique(flat, return_inverse=True)
    n = len(grade)
    over = np.maximum([(grade > k).mean() for k in range(grades - 1)], 1e-4)
    first, steps = float(np.log((1 - over[0]) / over[0])), np.log(np.maximum(np.diff(np.log((1 - over) / over)), 0.05))
    w = ahead = np.zeros(len(used))
    pull, t_square = 1.0, np.full(grades - 1, 1e-8)
    size = 4 * n / max(1e-9, _largest(row, column, value, n, len(used)))  # the gradient's Lipschitz bound is a quarter of that
    for _ in range(rounds):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
        z = np.bincount(row, weights=ahead[column] * value, minlength=n)
        above = _sigmoid(z[:, None] - theta)  # P(grade > k)
        p = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        own = np.maximum(p[np.arange(n), grade] - p[np.arange(n), grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        upper, lower = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        g = np.bincount(column, weights=(-(upper - lower) / own / n)[row] * value, minlength=len(used))
        d_theta = np.array([np.sum(np.where(grade == k + 1, upper, 0) / own - np.where(grade == k, lower, 0) / own) / n for k in range(grades - 1)])
        before, w = w, ahead - size * g
        w = np.sign(w) * np.maximum(np.abs(w) - size * l1, 0)
        pull, last = (1 + np.sqrt(1 + 4 * pull * pull)) / 2, pull
        ahead = w + (last - 1) / pull * (w - before)
        gt = np.array([d_theta.sum(), *[d_theta[k + 1 :].sum() * np.exp(steps[k]) for k in range(grades - 2)]])
        t_square += gt * gt
        move = rate * gt / np.sqrt(t_square)
        first, steps = first - move[0], np.maximum(steps - move[1:], -6)
    some = np.flatnonzero(w)
    return OrdinalModel(w[some].astype(np.float32), used[some], first + np.concatenate([[0], np.cumsum(np.exp(steps))]), bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", graded: bool = False, grades: int = 4, id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, held_out: int | None = 2, bits: int = SLOT_BITS, least_z: float = 4.0, **options) -> OrdinalModel:
    """A model from at most sample_rows labelled documents outside the held-out fold.

    graded: the label column holds grades 0..grades-1; else it holds 0 or 1
    and grade_by_markers makes grades of it. Without labelled rows the model
    gives every text the same low severity.
    """
    spark = docs.sparkSession
    with scratch(spark):
        sample = written(sample_labelled(docs, labels, label, rows=sample_rows, id_col=id_col, text=text, held_out=held_out), "toxicity-sample")
        shared = spark.sparkContext.broadcast(telling_slots(sample, bits, least_z))
        rows = map_rows(sample, _counted(bits, shared), "slots binary, counts binary", ["label"]).select("out.*", "row.label").toArrow()
    slots = [np.frombuffer(x, np.int32) for x in rows["slots"].to_pylist()]
    counts = [np.frombuffer(x, np.int32) for x in rows["counts"].to_pylist()]
    y = np.array(rows["label"].to_pylist(), np.int64)
    grade = np.clip(y, 0, grades - 1) if graded or not len(y) else grade_by_markers(slots, counts, (y > 0).astype(np.int64), bits, grades)
    return train(slots, counts, grade, bits=bits, grades=grades, **options)


def score_toxicity(docs: DataFrame, model: OrdinalModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row``, and ``out``: severity (expected grade), p_toxic (grade over 0), grade (the likeliest).

    A null or empty text has no words and gets the severity of the thresholds
    alone. Repeated rows get equal scores; other columns (or those of ``keep``)
    are carried through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(row: pa.StructArray) -> pa.StructArray:
        model, hasher = shared.value, RollingHash()
        weight = np.zeros(1 << model.bits, np.float32)
        weight[model.slots] = model.weights
        totals = []
        for lo, hi, data, offsets in blocks(*utf8(row.field(text))):
            slots, ranges = feature_slots(data, offsets, model.bits, hasher)
            hit = np.flatnonzero(weight[slots])
            owner = np.searchsorted(ranges, hit, side="right") - 1
            pair, n = np.unique(owner * (1 << model.bits) + slots[hit], return_counts=True)
            totals.append(np.bincount(pair >> model.bits, weights=weight[pair & ((1 << model.bits) - 1)] * (1 + np.log(n)), minlength=hi - lo))
        z = np.concatenate(totals) if totals else np.zeros(0)
        above = _sigmoid(z[:, None] - model.thresholds)
        p = -np.diff(np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1), axis=1)
        return struct(severity=pa.array(np.round(above.sum(axis=1), 6)), p_toxic=pa.array(np.round(above[:, 0], 6)), grade=pa.array(p.argmax(axis=1).astype(np.int32)))

    return map_rows(docs.withColumn(text, F.col(text).cast("string")), of, "severity double, p_toxic double, grade int", keep)

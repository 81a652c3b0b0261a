"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors, one for each of its n-grams:
single words, word pairs, the pattern of equal neighbours in word pairs and
triples, and runs of 3 and 4 characters, all hashed into ``slots`` rows. A
softmax layer over that average gives the class. Both layers are trained
together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows whose n-grams the executors have counted.

As the softmax layer is linear, a document's logits are the average of each
n-gram's own logit; scoring therefore looks up one number for each n-gram
instead of a vector, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import RollingHash, blocks, code_points, map_rows, not_space, row_sums, sample_labelled, struct, utf8, words_of

#: At most so many labelled rows train the model; whole texts of each are used.
SAMPLE_ROWS = 3000
SLOT_BITS = 17
DIMENSIONS = 16
#: A text of at least this score is kept.
KEEP = 0.7


def _slot(h: np.ndarray, bits: int, salt: int) -> np.ndarray:
    h = (h + np.uint32(salt)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - bits)


def ngram_slots(data: np.ndarray, offsets: np.ndarray, bits: int, hasher: RollingHash) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the slots of all of them in order, and where each row's begin and end."""
    cp, at = code_points(data, offsets)
    lo, hi = at[:-1], at[1:]
    h = cp * np.uint32(0x01000193)
    for n in (2, 3, 4):
        if len(h) < 2:
            break
        h = (h[:-1] * np.uint32(0x2C1B3C6D)) ^ (cp[n - 1 :] + np.uint32(0x297A2D39))
        if n > 2:
            yield _slot(h, bits, n), lo, hi - n + 1
    starts, ends, ranges = words_of(not_space(cp), at)
    if len(starts):
        prefix = hasher.prefix((cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        w = (hasher.spans(prefix, starts, ends) >> np.uint64(32)).astype(np.uint32)
        lo, hi = ranges[:-1], ranges[1:]
        yield _slot(w, bits, 11), lo, hi
        yield _slot(w[:-1] * np.uint32(31) + w[1:], bits, 12), lo, hi - 1
        same = (w[:-1] == w[1:]).astype(np.uint32)
        yield _slot(same, bits, 13), lo, hi - 1
        yield _slot(same[:-1] * np.uint32(2) + same[1:], bits, 14), lo, hi - 2


def _counted(bits: int):
    def of(row: pa.StructArray) -> pa.StructArray:
        hasher, slots, counts = RollingHash(), [], []
        for lo, hi, data, offsets in blocks(*utf8(row.field("text"))):
            kinds = list(ngram_slots(data, offsets, bits, hasher))
            for i in range(hi - lo):
                own = [s[a[i] : max(a[i], b[i])] for s, a, b in kinds]
                found, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint32), return_counts=True)
                slots.append(found.astype(np.uint32).tobytes())
                counts.append(n.astype(np.float32).tobytes())
        return struct(slots=pa.array(slots, pa.binary()), counts=pa.array(counts, pa.binary()))

    return of


@dataclass
class SubwordModel:
    """lift: each slot's difference of class logits; bias: that of a document without n-grams."""

    lift: np.ndarray
    bias: float
    bits: int


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], *, bits: int = SLOT_BITS, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> SubwordModel:
    """Fits embeddings and a two-class softmax to (slots, counts, label 0 or 1) by SGD with a falling step."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, 2), np.float32)
    labels = np.array([y for _, _, y in examples], np.int64)
    bias = np.log((np.bincount(labels, minlength=2) + 1) / (len(labels) + 2)).astype(np.float32)
    step, steps = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            slots, counts, y = examples[k]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(slots):
                continue
            share = counts / counts.sum()
            vectors = table[slots]
            hidden = share @ vectors
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            # An n-gram's part of the average is small; its vector moves by that part times the number of distinct ones.
            table[slots] -= (lr * min(len(slots), 200.0)) * share[:, None] * back
    lift = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return SubwordModel(lift, float(bias[1] - bias[0]), bits)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, held_out: int | None = 2, **options) -> SubwordModel:
    """A model of label 0 or 1 from at most sample_rows labelled documents outside the held-out fold.

    Without labelled rows the model scores every text 0.5.
    """
    sample = sample_labelled(docs, labels, label, rows=sample_rows, id_col=id_col, text=text, held_out=held_out)
    rows = map_rows(sample, _counted(options.get("bits", SLOT_BITS)), "slots binary, counts binary", ["label"]).select("out.*", "row.label").toArrow()
    examples = [(np.frombuffer(s, np.uint32), np.frombuffer(c, np.float32), int(y > 0)) for s, c, y in zip(rows["slots"].to_pylist(), rows["counts"].to_pylist(), rows["label"].to_pylist(), strict=True)]
    return train(examples, **options)


def score_quality(docs: DataFrame, model: SubwordModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row``, and ``out``: score, the probability of label 1.

    A null or empty text has no n-grams and gets the learned prior. Rows are
    scored alone, so repeated rows get equal scores; other columns (or those of
    ``keep``) are carried through untouched; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(row: pa.StructArray) -> pa.StructArray:
        model, hasher, scores = shared.value, RollingHash(), []
        for lo, hi, data, offsets in blocks(*utf8(row.field(text))):
            total, n = np.zeros(hi - lo), np.zeros(hi - lo, np.int64)
            for slots, a, b in ngram_slots(data, offsets, model.bits, hasher):
                total += row_sums(model.lift[slots], a, b)
                n += np.maximum(b - a, 0)
            scores.append(1 / (1 + np.exp(-(model.bias + total / np.maximum(n, 1)))))
        return struct(score=pa.array(np.round(np.concatenate(scores), 6) if scores else [], pa.float64()))

    return map_rows(docs.withColumn(text, F.col(text).cast("string")), of, "score double", keep)

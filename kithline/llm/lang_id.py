"""Language identification by a bidirectional gated recurrent network over bytes.

Each text is cut into windows of ``WINDOW`` bytes. A forward and a backward
gated recurrent layer read every window; at every byte a softmax over both
states labels that position with a language, and a document's probabilities
are the average over all its positions. Gates are piecewise linear, which
costs less than a sigmoid and trains as well.

The network is trained in numpy by backpropagation through time on windows of
a bounded sample of labelled documents, drawn from each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import blocks, crc_fold, map_rows, one_of_each, struct, utf8

WINDOW = 64
HIDDEN = 8
#: At most so many documents train the network, each with at most so many windows, drawn from all of its text: 8 MB in all.
SAMPLE_ROWS, TEXT_WINDOWS = 2000, 64
#: A language is drawn from at so many times its part, so that its part is reached.
DRAW = 1.5
#: Windows that a task works on at once.
BATCH = 2048
UNKNOWN = "und"


@dataclass
class Layer:
    """One direction. Rows of both: reset gate, update gate, candidate; x: by byte, h: by state."""

    x: np.ndarray
    h: np.ndarray

    @staticmethod
    def new(hidden: int, rng: np.random.Generator) -> Layer:
        x = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        x[: 2 * hidden] = x[: 2 * hidden] * 0.25 + 0.5
        return Layer(x, rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32))

    def forward(self, data: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """States (steps, hidden, windows) for bytes (steps, windows); a masked step leaves the state empty. keep: what training needs."""
        steps, n = data.shape
        k = self.h.shape[1]
        states = np.zeros((steps, k, n), np.float32)
        h, kept = np.zeros((k, n), np.float32), []
        for t in range(steps):
            x, g = self.x.take(data[t], axis=1, mode="clip"), self.h @ h
            gates = x[: 2 * k]
            gates += g[: 2 * k]
            np.clip(gates, 0, 1, out=gates)
            c = gates[:k] * g[2 * k :]
            c += x[2 * k :]
            np.tanh(c, out=c)
            step = h - c
            step *= gates[k:]
            if keep:
                kept.append((h, gates, c, g[2 * k :]))
            np.add(c, step, out=states[t])
            if mask is not None:
                states[t] *= mask[t]
            h = states[t]
        return states, kept

    def backward(self, data: np.ndarray, mask: np.ndarray, kept: list, d_states: np.ndarray) -> Layer:
        """Gradients, given those of the states."""
        steps, k, n = d_states.shape
        dx, dh_weights, carry = np.zeros((steps, 3 * k, n), np.float32), np.zeros_like(self.h), np.zeros((k, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, gates, c, gc = kept[t]
            d = (d_states[t] + carry) * mask[t]
            r, z = gates[:k], gates[k:]
            d_c = d * (1 - z) * (1 - c * c)
            open_gates = (gates > 0) & (gates < 1)
            d_gates = np.concatenate([d_c * gc, d * (h - c)]) * open_gates
            dx[t, : 2 * k], dx[t, 2 * k :] = d_gates, d_c
            d_g = np.concatenate([d_gates, d_c * r])
            dh_weights += d_g @ h.T
            carry = d * z + self.h.T @ d_g
        flat, rows = data.reshape(-1), dx.transpose(1, 0, 2).reshape(3 * k, -1)
        return Layer(np.stack([np.bincount(flat, weights=r, minlength=256) for r in rows]).astype(np.float32), dh_weights)


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Layer
    back: Layer
    out: np.ndarray  # (languages, 2 * hidden)
    bias: np.ndarray
    hidden: int = field(default=HIDDEN)

    def label(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities (steps, languages, windows) at every byte."""
        states, other = self.ahead.forward(data, mask)[0], self.back.forward(data[::-1], None if mask is None else mask[::-1])[0][::-1]
        z = np.matmul(self.out[:, : self.hidden], states)
        z += np.matmul(self.out[:, self.hidden :], other)
        z += self.bias[:, None]
        np.exp(np.clip(z, -60, 60, out=z), out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each row's average probabilities over all its bytes; zero for a row without any."""
        n = np.diff(offsets)
        windows = -(-n // WINDOW)
        row = np.repeat(np.arange(len(n)), windows)
        start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        size = np.minimum(WINDOW, offsets[1:][row] - start)
        total = np.zeros((len(n), len(self.languages)))
        for some, short in ((np.flatnonzero(size == WINDOW), False), (np.flatnonzero(size < WINDOW), True)):
            some = some[np.argsort(size[some], kind="stable")] if short else some
            for lo in range(0, len(some), BATCH):
                w = some[lo : lo + BATCH]
                steps = int(size[w].max())
                at = start[w] + np.arange(steps)[:, None]
                mask = (np.arange(steps)[:, None] < size[w]).astype(np.float32) if short else None
                p = self.label(data[np.minimum(at, len(data) - 1)], mask)
                sums = (p * mask[:, None, :]).sum(axis=0) if short else p.sum(axis=0)
                for c in range(len(self.languages)):
                    total[:, c] += np.bincount(row[w], weights=sums[c], minlength=len(n))
        return total / np.maximum(n, 1)[:, None]


def train(windows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str], *, hidden: int = HIDDEN, epochs: int = 3, batch: int = 256, least_steps: int = 300, most_steps: int = 700, rate: float = 0.01, seed: int = 3) -> LanguageModel:
    """Fits the network to windows (n, WINDOW) of ``sizes`` bytes each, by backpropagation through time and Adam, in least_steps to most_steps steps."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, Layer.new(hidden, rng), Layer.new(hidden, rng), rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32), np.zeros(len(languages), np.float32), hidden)
    if not len(windows):
        return model
    steps = min(most_steps, max(least_steps, epochs * -(-len(windows) // batch)))
    moments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(1, steps + 1):
        own = rng.integers(0, len(windows), batch)
        data, y = windows[own].T, labels[own]
        mask = (np.arange(WINDOW)[:, None] < sizes[own]).astype(np.float32)
        ahead, kept_a = model.ahead.forward(data, mask, True)
        back, kept_b = model.back.forward(data[::-1], mask[::-1], True)
        both = np.concatenate([ahead, back[::-1]], axis=1)
        z = np.matmul(model.out, both) + model.bias[:, None]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(batch)] -= 1
        p *= mask[:, None, :] / mask.sum()
        d_both = np.matmul(model.out.T, p)
        g_a = model.ahead.backward(data, mask, kept_a, d_both[:, :hidden])
        g_b = model.back.backward(data[::-1], mask[::-1], kept_b, d_both[::-1, hidden:])
        pairs = [(model.ahead.x, g_a.x), (model.ahead.h, g_a.h), (model.back.x, g_b.x), (model.back.h, g_b.h), (model.out, np.einsum("tcb,thb->ch", p, both)), (model.bias, p.sum(axis=(0, 2)))]
        norm = np.sqrt(sum(float((g * g).sum()) for _, g in pairs))
        for k, (value, g) in enumerate(pairs):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = moments.get(k, (np.zeros_like(value), np.zeros_like(value)))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moments[k] = m, v
            value -= (rate * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    return model


def drawn_windows(text: bytes, most: int) -> list[bytes]:
    """At most ``most`` of the text's windows of WINDOW bytes (the last may be shorter), in order; which ones depends on the text alone."""
    n = -(-len(text) // WINDOW)
    chosen = range(n) if n <= most else np.sort(np.random.default_rng(xxhash.xxh64_intdigest(text)).choice(n, most, replace=False)).tolist()
    return [text[k * WINDOW : (k + 1) * WINDOW] for k in chosen]


def _windowed(most: int):
    """Batches (key, text, lang) as (key, place, window, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, w) for i, text in enumerate(batch.column(1)) for k, w in enumerate(drawn_windows(text.as_py().encode(), most))]
            row = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([k for _, k, _ in found], pa.int32()), pa.array([w for _, _, w in found], pa.binary()), batch.column(2).take(row)], names=["key", "place", "window", "lang"])

    return run


def stacked(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (n, WINDOW), filled up with zeros, and their sizes."""
    sizes = np.array([len(w) for w in windows], np.int64)
    return np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW), sizes


def parts(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows to take of each language: equal parts of total, but no more than there are; at least one."""
    out, left = {}, total
    for k, (name, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(n, max(1, left // (len(counts) - k)))
        left -= out[name]
    return out


def fit_languages(docs: DataFrame, *, lang: str = "lang", id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, text_windows: int = TEXT_WINDOWS, held_out: int | None = 2, **options) -> LanguageModel:
    """A network from at most sample_rows documents with a language outside the held-out fold, chosen by a hash of their id.

    Every language gives an equal part of the documents, or all it has; more
    languages than sample_rows are refused. Only texts and languages are
    learned from. Tasks cut the texts and draw at most text_windows windows of
    each, from the whole of it, so the driver gets no more than sample_rows *
    text_windows * WINDOW bytes however long the texts are, and training takes
    steps in proportion. Null ids, texts and languages are left out; of rows
    that repeat an id one counts. Without such rows the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("key is not null and lang is not null and text <> ''")
    if held_out is not None:
        rows = rows.filter(crc_fold("key") != held_out)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}  # a row for each language
    if len(counts) > sample_rows:
        raise ValueError(f"{len(counts)} languages can't be learned from {sample_rows} documents")
    wanted = [(name, n, min(1.0, (DRAW * n + 8) / counts[name])) for name, n in parts(counts, sample_rows).items()]
    quotas = F.broadcast(docs.sparkSession.createDataFrame(wanted, "lang string, n long, share double"))
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("key", "lang").join(quotas, "lang").withColumn("place", place).filter("place < share")
    # About DRAW times sample_rows ids, fewer for each language than its part and a half; only these are ordered.
    near = drawn.groupBy("place", "key").agg(F.min(F.struct("lang", "n")).alias("l")).select("key", "l.*").orderBy("place", "key").collect()
    taken: dict[str, int] = {}
    keys = []
    for r in near:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= r["n"]:
            keys.append((r["key"], r["lang"]))
    chosen = docs.sparkSession.createDataFrame(keys[:sample_rows], f"key {rows.schema['key'].dataType.simpleString()}, lang string")
    # Of rows that repeat an id one counts, so these are at most sample_rows.
    texts = one_of_each(rows.join(F.broadcast(chosen), ["key", "lang"], "left_semi").select("key", "text"), chosen).select("key", "text", "lang")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, place int, window binary, lang string"
    got = texts.mapInArrow(_windowed(text_windows), schema).toArrow().sort_by([("key", "ascending"), ("place", "ascending")])  # tasks end in any order
    names = got["lang"].to_pylist()
    languages = sorted(set(names))
    place = {name: k for k, name in enumerate(languages)}
    return train(*stacked(got["window"].to_pylist()), np.array([place[n] for n in names], np.int64), languages, **options)


def predict_languages(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row``, and ``out``: lang_pred and score, its pooled probability.

    lang_pred is ``und`` with score 0 for a null text, one without any letter,
    or if the model knows no language. Rows are labelled alone; other columns
    (or those of ``keep``) are carried through; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(row: pa.StructArray) -> pa.StructArray:
        model, column = shared.value, row.field(text)
        known = [bool(model.languages) and any(map(str.isalpha, t.as_py())) for t in pc.fill_null(column, "")]
        if not model.languages:
            return struct(lang_pred=pa.array([UNKNOWN] * len(row)), score=pa.array(np.zeros(len(row))))
        p = np.concatenate([model.pooled(data, offsets) for _, _, data, offsets in blocks(*utf8(column))] or [np.zeros((0, len(model.languages)))])
        best = p.argmax(axis=1)
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return struct(lang_pred=pa.array(names, pa.string()), score=pa.array(np.round(score, 6)))

    return map_rows(docs.withColumn(text, F.col(text).cast("string")), of, "lang_pred string, score double", keep)

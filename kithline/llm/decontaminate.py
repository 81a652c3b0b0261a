"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of ``window`` consecutive words, or one
shorter window if the item is shorter. A window is a set of shingles of
``shingle`` words at known positions. Since a window counts only if all of it
is there, its necessary prefix is its rarest shingle, by document frequency
over the whole corpus: a document without that shingle cannot hold the window.
The join is on those prefix shingles alone; the shingle's position in the
window then bounds where the window would start and end in the document, and
what is left is compared word for word.

The documents are read twice (frequencies, then the join), however large the
benchmark, and never shuffled. The benchmark's windows travel to the tasks in
blocks of at most ``block_windows``, and a task holds one block and its counts at
a time: it goes through all of them for each batch of documents, whose words
it hashes once. A window's items travel
beside it; one of very many items is shared by all its occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import RollingHash, ascii_lower, blocks, map_rows, scratch, struct, utf8, words_of, written

WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3
#: Windows sent to the tasks at once; 13 words of about 8 bytes and two hashes each, under 64 MB.
BLOCK_WINDOWS = 200_000

_LOWER = ascii_lower()
_IN_WORD = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only) of a text; none for null."""
    return re.findall(WORD, (text or "").encode().lower())


def benchmark_windows(bench: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: ``item`` string, ``words`` (space-joined), one row for each item and window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, found = [], []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = item_words(value)
                for i in range(max(1, len(w) - window + 1) if w else 0):
                    items.append(item)
                    found.append(b" ".join(w[i : i + window]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], names=["item", "words"])

    rows = bench.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.filter("item is not null").mapInArrow(cut, "item string, words string").distinct()


class Block:
    """A bounded set of windows, ready to be joined with texts."""

    def __init__(self, rows: list[tuple[str, str]], shingle: int):
        self.items = sorted({item for item, _ in rows})
        rank = {item: i for i, item in enumerate(self.items)}
        by_window: dict[bytes, list[int]] = {}
        for item, words in rows:
            by_window.setdefault(words.encode(), []).append(rank[item])
        self.windows = sorted(by_window)
        self.owners = [by_window[w] for w in self.windows]
        self.length = np.array([w.count(b" ") + 1 for w in self.windows], np.int64)
        self.size = np.minimum(self.length, shingle)
        hasher, hashes = RollingHash(), []
        for w, k in zip(self.windows, self.size, strict=True):
            h = _word_hashes(hasher, np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0]
            hashes.append(_shingles(hasher, h, int(k)))
        #: All shingles of all windows: their hashes, windows and places.
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        self.keys = np.unique(self.hash)
        self.sizes = np.unique(self.size)

    def choose(self, frequency: np.ndarray) -> None:
        """Keeps each window's necessary prefix: its rarest shingle; frequency goes with keys."""
        f = frequency[np.searchsorted(self.keys, self.hash)]
        order = np.lexsort((self.place, self.hash, f, self.of))
        first = order[np.r_[True, np.diff(self.of[order]) > 0]] if len(order) else order
        first = first[np.argsort(self.hash[first], kind="stable")]
        self.hash, self.of, self.place = self.hash[first], self.of[first], self.place[first]
        self.keys = np.unique(self.hash)


def _word_hashes(hasher: RollingHash, data: np.ndarray, offsets: np.ndarray):
    starts, ends, ranges = words_of(_IN_WORD[data], offsets)
    return hasher.spans(hasher.prefix(data), starts, ends), starts, ends, ranges


def _shingles(hasher: RollingHash, words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return hasher.spans(hasher.prefix(words), at, at + k)


class _Lookup:
    """Which hashes are among sorted keys: a bit table over 20 bits of the hash first, then a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << 20, bool)
        self.table[keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of those that are, and the index of their keys."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(44)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[k] == hashes[at]
        return at[hit], k[hit]


class _Held:
    """Blocks in the tasks: one at a time, and it alone stays if there is no other."""

    def __init__(self, shared: list):
        self.shared, self.ready = shared, {}

    def each(self) -> Iterator[tuple[int, Block, _Lookup]]:
        for i, broadcast in enumerate(self.shared):
            if i not in self.ready:
                block = broadcast.value
                self.ready = {i: (block, _Lookup(block.keys))}
            yield i, *self.ready[i]
            if len(self.shared) > 1:
                vars(broadcast).pop("_value", None)  # what this worker has read of it; its file stays
                self.ready = {}


def _frequencies(docs: DataFrame, text: str, shared: list) -> DataFrame:
    """block, key and n: in how many rows each of the blocks' shingles occurs, over all rows.

    A task gives out its counts of a block before it takes up the next one: at
    the end if there is but one, else for each batch.
    """

    def rows(i: int, own: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(own)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i)), pa.array(some), pa.array(own[some])], names=["block", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, last = RollingHash(), _Held(shared), None
        for batch in batches:
            hashed = _hashed(hasher, batch.column(0), len(shared))
            for i, block, lookup in held.each():
                total = last if last is not None else np.zeros(len(block.keys), np.int64)
                for _, _, _, words, _, _, ranges in hashed:
                    for k in block.sizes:
                        at, key = lookup.find(_shingles(hasher, words, int(k)))
                        row = np.searchsorted(ranges, at, side="right") - 1
                        inside = at + k <= ranges[row + 1]
                        pairs = np.unique(row[inside] * len(block.keys) + key[inside])
                        total += np.bincount(pairs % len(block.keys), minlength=len(block.keys))
                if len(shared) == 1:
                    last = total
                else:
                    yield rows(i, total)
        if last is not None:
            yield rows(0, last)

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "block long, key long, n long").groupBy("block", "key").agg(F.sum("n").alias("n"))


def _hashed(hasher: RollingHash, texts: pa.Array, n_blocks: int):
    """First and end row, lower-cased bytes, word hashes, starts, ends and row ranges of runs of rows; kept for all of a batch if several blocks go over it."""
    runs = ((lo, hi, _LOWER[data], *_word_hashes(hasher, _LOWER[data], offsets)) for lo, hi, data, offsets in blocks(*utf8(texts)))
    return runs if n_blocks == 1 else [(lo, hi, data, words, starts.astype(np.int32), ends.astype(np.int32), ranges) for lo, hi, data, words, starts, ends, ranges in runs]


def _matches(block: Block, lookup: _Lookup, hasher: RollingHash, data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray):
    """Row, first word and window of every occurrence of a window."""
    rows, firsts, found = [], [], []
    for k in block.sizes:
        at, key = lookup.find(_shingles(hasher, words, int(k)))
        lo = np.searchsorted(block.hash, block.keys[key], side="left")
        n = np.searchsorted(block.hash, block.keys[key], side="right") - lo
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, window = np.repeat(at, n), block.of[entry]
        row = np.searchsorted(ranges, at, side="right") - 1
        first = at - block.place[entry]
        # Length and positional bounds: the window lies within the row's words.
        ok = (block.size[window] == k) & (first >= ranges[row]) & (first + block.length[window] <= ranges[row + 1])
        for r, f, w in zip(row[ok].tolist(), first[ok].tolist(), window[ok].tolist(), strict=True):
            span = data[starts[f] : ends[f + int(block.length[w]) - 1]].tobytes()
            if span == block.windows[w] or re.findall(WORD, span) == block.windows[w].split():
                rows.append(r)
                firsts.append(f)
                found.append(w)
    return np.array(rows, np.int64), np.array(firsts, np.int64), np.array(found, np.int64)


def _join(shared: list, text: str):
    """Hit words and items of each row, from all blocks."""

    def of(row: pa.StructArray) -> pa.StructArray:
        hasher = RollingHash()
        hashed = _hashed(hasher, row.field(text), len(shared))
        n_words = np.zeros(len(row), np.int64)
        spans: list[list[list[int]]] = [[] for _ in range(len(row))]
        items: list[set[str]] = [set() for _ in range(len(row))]
        for _, block, lookup in _Held(shared).each():
            for lo, hi, data, words, starts, ends, ranges in hashed:
                rows, firsts, found = _matches(block, lookup, hasher, data, words, starts, ends, ranges)
                n_words[lo:hi] = np.diff(ranges)
                order = np.lexsort((firsts, rows))
                rows, firsts, found = rows[order], firsts[order], found[order]
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    some = slice(cut[i], cut[i + 1])
                    spans[lo + i] = _merged(spans[lo + i] + [[int(f - ranges[i]), int(f - ranges[i] + block.length[w])] for f, w in zip(firsts[some], found[some], strict=True)])
                    for w in set(found[some].tolist()):
                        items[lo + i].update(block.items[o] for o in block.owners[w])
        return struct(n_words=pa.array(n_words), n_hit=pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))), items=pa.array([sorted(x) for x in items], pa.list_(pa.string())))

    return of


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


OUT = "n_words long, n_hit long, spans array<array<long>>, items array<string>"


def find_contamination(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row``, and ``out``: n_words, n_hit, merged spans of hit words, ids of items with occurring windows.

    Null or empty texts have no words and no hits; null item ids and items
    without words are left out; equal windows of several items name all of
    them; repeated rows are judged each on its own; empty tables give no rows,
    or rows without hits. Other columns (or those of ``keep``) are carried
    through untouched.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(bench, item_id, item_text, window).persist()
    n_blocks = max(1, -(-windows.count() // block_windows))
    shared = []
    for i in range(n_blocks):
        part = windows.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == i)
        block = Block([tuple(r) for r in part.collect()], shingle)  # bounded by block_windows, on average
        shared.append(spark.sparkContext.broadcast(block))
    chosen = []
    with scratch(spark):
        counts = written(_frequencies(docs, text, shared), "shingle-counts")
        for i, broadcast in enumerate(shared):
            block, found = broadcast.value, counts.filter(F.col("block") == i).select("key", "n").toArrow()  # of one block
            frequency = np.zeros(len(block.keys), np.int64)
            frequency[found["key"].to_numpy()] = found["n"].to_numpy()
            block.choose(frequency)
            chosen.append(spark.sparkContext.broadcast(block))
            broadcast.destroy()
            del block
    windows.unpersist()
    return map_rows(docs.withColumn(text, F.col(text).cast("string")), _join(chosen, text), OUT, keep)


def is_contaminated(share: int = 20) -> Column:
    """True where hit words are at least one in ``share`` of all words."""
    return (F.col("out.n_hit") > 0) & (F.lit(share) * F.col("out.n_hit") >= F.col("out.n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, share: int = 20, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with docs' own columns."""
    return find_contamination(docs, bench, **options).filter(~is_contaminated(share)).select("row.*")

"""Ranked lexical search by sort-based accumulation.

Items (queries) are taken in blocks of a bounded number of (item, term) pairs.
For each block documents are read once: every text becomes the numbers of its
known terms with their counts, written as a short row. Counts over all
documents give each term's weight. A second pass over the short rows turns
each (term, document) into an impact, repeats it for the items that hold the
term, and adds up by item and document: the arrays are concatenated, their
packed keys radix sorted, and runs summed with reduceat. Each task keeps an
item's best documents in a heap. What tasks kept is dealt into ranges of
(item, score, id), and a rank is the place within the range plus the rows of
the item in the ranges before, so no task gathers all of an item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.common import ascii_lower, blocks, fresh_path, scratch, short_batches, utf8, words_of, written

TOP = 50
#: (item, term) pairs of a block of items, about.
PAIRS = 1 << 18
#: (item, document) impacts added up at once.
CHUNK = 1 << 18
#: Rows of an Arrow batch, so that a worker holds few texts and arrays at once.
BATCH_ROWS = 512

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All terms of UTF-8 rows in order, and each row's range of them."""
    inside = _WORD[data]
    starts, ends, ranges = words_of(inside, offsets)
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(ascii_lower()[data[inside]])), ranges


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys: least digit first, 16 bits at a time (numpy's stable sort of such digits is a radix sort)."""
    order = None
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order


class _Block:
    """A block's items and terms: for each term (in order of terms) the items that hold it."""

    def __init__(self, pairs: pa.Table):
        self.items = pairs.column("item").combine_chunks().unique()
        self.terms = pairs.column("term").combine_chunks().unique().cast(pa.large_string())
        item = pc.index_in(pairs.column("item").combine_chunks(), self.items).to_numpy().astype(np.int64)
        term = pc.index_in(pairs.column("term").combine_chunks().cast(pa.large_string()), self.terms).to_numpy().astype(np.int64)
        order = np.lexsort((item, term))
        self.holders = item[order]
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))


def _postings(terms: pa.Array, id_type: pa.DataType):
    """Rows (id, n, terms, counts) of batches (id, text); rows without a term are left out."""
    value_set = terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in blocks(*utf8(batch.column(1))):
                words, ranges = terms_of(data, offsets)
                size = np.diff(ranges)
                found = pc.index_in(words, value_set=value_set)
                known = found.is_valid().to_numpy(zero_copy_only=False)
                term = found.drop_null().to_numpy().astype(np.uint64)
                row = np.repeat(np.arange(hi - lo), size)[known].astype(np.uint64)
                width = np.uint64(max(1, len(value_set)))
                keys = row * width + term
                keys = keys[radix_order(keys)]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
                count = np.diff(np.r_[first, len(keys)])
                keys = keys[first]
                ends = np.searchsorted(keys // width, np.arange(hi - lo + 1))
                lists = [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(v.astype(np.int32))) for v in (keys % width, count)]
                some = pa.array(size > 0)
                columns = [ids.slice(lo, hi - lo), pa.array(size.astype(np.int64)), *lists]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], names=["id", "n", "terms", "counts"])

    return run


def _impacts(weights: np.ndarray, n_docs: int, all_terms: int, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """w * ((10**9 tf) div (1000 tf + 20 m)) of each posting."""
    if int(n.max(initial=0)) * 50 * n_docs < 1 << 63:
        part = 50 * n * n_docs // all_terms
    else:  # beyond 64 bits
        part = np.array([50 * int(x) * n_docs // all_terms for x in n], np.int64)
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * (50 + part)[row]))


def _best(block: _Block, weights: np.ndarray, n_docs: int, all_terms: int, top: int):
    """Rows (item, id, score): the best documents of each item among the task's postings."""
    holders, at, n_items = block.holders, block.at, len(block.items)

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """Ranges of rows of about CHUNK impacts, one row at least, whose packed keys fit in 16 bits if they can."""
        ends = batch.column(2).offsets.to_numpy()
        terms = batch.column(2).values.to_numpy()
        made = np.concatenate([[0], np.cumsum((at[1:] - at[:-1])[terms])])[ends]
        lo, rows = 0, max(1, (1 << 16) // n_items)
        while lo < len(batch):
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(made, made[lo] + CHUNK, side="right")) - 1))
            yield lo, hi
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(n_items)]
        least = np.zeros(n_items, np.int64)  # a document must reach this score
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([c if not isinstance(c, pa.ListArray) else pa.concat_arrays([c]) for c in batch.columns], names=batch.schema.names)
            all_n = batch.column(1).to_numpy()
            for lo, hi in chunks(batch):
                ends = batch.column(2).offsets.to_numpy()[lo : hi + 1]
                term = batch.column(2).values.to_numpy()[ends[0] : ends[-1]]
                tf = batch.column(3).values.to_numpy()[batch.column(3).offsets[lo].as_py() :][: len(term)].astype(np.int64)
                row = np.repeat(np.arange(hi - lo), np.diff(ends))
                impact = _impacts(weights, n_docs, all_terms, all_n[lo:hi], row, term, tf)
                held = at[term + 1] - at[term]
                ahead = np.cumsum(held) - held
                item = holders[np.arange(held.sum()) - np.repeat(ahead - at[term], held)]
                keys = (np.repeat(row, held) * n_items + item).astype(np.uint64)
                order = radix_order(keys)
                keys, impact = keys[order], np.repeat(impact, held)[order]
                if not len(keys):
                    continue
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                score = np.add.reduceat(impact, first)
                row, item = np.divmod(keys[first].astype(np.int64), n_items)
                some = np.flatnonzero((score > 0) & (score >= least[item]))
                if not len(some):
                    continue
                ids = batch.column(0).slice(lo, hi - lo)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                own = pc.fill_null(ids, 0).to_numpy()
                missing = ~known[row[some]]
                order = np.lexsort((own[row[some]], missing, -score[some], item[some]))
                some = some[order]
                begin = np.flatnonzero(np.r_[True, np.diff(item[some]) != 0])
                place = np.arange(len(some)) - np.repeat(begin, np.diff(np.r_[begin, len(some)]))
                for k in some[place < top]:
                    i, r = int(item[k]), row[k]
                    entry = (int(score[k]), bool(known[r]), -int(own[r]))
                    if len(heaps[i]) < top:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == top:
                        least[i] = heaps[i][0][0]
        rows = [(i, -own if known else None, score) for i, heap in enumerate(heaps) for score, known, own in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([block.items.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "id", "score"])

    return run


def item_terms(items: DataFrame, *, item_col: str, text: str) -> DataFrame:
    """The distinct (item, term) of items with an id; rows of one id are one item."""
    schema = f"item {items.schema[item_col].dataType.simpleString()}, term string"
    pairs = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ranges = terms_of(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), np.diff(ranges)))), words.cast(pa.string())], names=["item", "term"])

    return pairs.mapInArrow(run, schema).distinct()


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", item_text: str = "text", top: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """``item``, ``rank`` (from 1), ``id`` and ``score`` (above 0) of the ``top`` best documents of each item, best first, equal scores by ascending id.

    Scores follow the integer formula of the module's query: a term's weight by
    its document frequency, its occurrences damped by the document's length.
    Null and empty texts have no terms: such documents count nowhere, such
    items find nothing. Items without id are left out; rows that repeat an
    item's id are one item. Documents without id are ranked after others of
    equal score; rows that repeat a document's id are documents of their own.
    Ids must be integers. An empty table gives no rows. Other columns, whatever
    their names, are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    path = fresh_path(spark, "ranked")
    with scratch(spark), short_batches(spark, BATCH_ROWS):
        known = written(item_terms(items, item_col=item_col, text=item_text), "item-terms")
        n_blocks = max(1, math.ceil(known.count() / pairs))
        found = None
        for b in range(n_blocks):
            block = _Block(known.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).toArrow())
            postings = written(own.mapInArrow(_postings(block.terms, pa.int64()), "id long, n long, terms array<int>, counts array<int>"), "postings")
            n_docs, all_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(block.terms), np.int64)
            for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
                df[r["t"]] = r["count"]
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
            if not n_docs or not len(block.items):
                continue
            schema = f"item {known.schema['item'].dataType.simpleString()}, id long, score long"
            best = written(postings.mapInArrow(_best(block, weights, n_docs, all_terms, top), schema), "best")
            found = best if found is None else found.union(best)
        if found is None:
            found = spark.createDataFrame([], f"item {known.schema['item'].dataType.simpleString()}, id long, score long")
        order = [F.col("item"), F.col("score").desc(), F.col("id").asc_nulls_last()]
        dealt = written(found.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
        before = dealt.groupBy("item", "part").count()
        before = before.select("item", "part", (F.sum("count").over(Window.partitionBy("item").orderBy("part")) - F.col("count")).alias("ahead"))
        # Only a range's first rows of an item can be among its best.
        placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("part", "item").orderBy(*order[1:]))).filter(F.col("place") <= top)
        ranked = placed.join(before, ["item", "part"]).withColumn("rank", (F.col("ahead") + F.col("place")).cast("int")).filter(F.col("rank") <= top)
        return written(ranked.select("item", "rank", "id", "score"), "", path)

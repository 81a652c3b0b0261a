"""URL filter by the likelihood ratio of two character Markov models.

Hosts and paths judged by an allow or block rule are the accepted and rejected
URLs. For each class a smoothed variable-order Markov model over the URL's
bytes is counted: the chance of the next byte after a context of k bytes is
interpolated with that after k-1 bytes, down to the uniform chance, each order
weighing as much as its context was seen. Contexts of 0 to ``order`` bytes are
hashed into a fixed number of slots, so the model sent to the tasks has the
same bound on any corpus while its counts take in every rule-judged URL. Where
slots are shared, a context's total is the sum over all bytes that may follow,
so chances always add up to one.

A URL without a rule is scored by the log-likelihood difference per byte. The
threshold is calibrated on a fold of rule-judged URLs that the models have not
seen: where the shares of accepted URLs kept and rejected URLs blocked are
largest together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import blocks, map_rows, struct, utf8

ORDER = 4
SLOT_BITS = 18
#: What may follow a context: 256 bytes and the end mark.
SYMBOLS = 257
#: Weight of the shorter context against each observation of the longer one.
PRIOR = 1.0
#: One in so many rule-judged URLs calibrates the threshold.
CALIBRATION = 5
#: Log-likelihood differences per byte, in bins of this width for calibration.
BIN = 0.01

Rule = tuple[str, str, str]


def url_host(url: str | Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str | Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def matching_rule(host: str, path: str, rules: list[Rule]) -> tuple[Column, Column]:
    """Rule string and action of the longest rule (host, path, action) that fits; nulls without one.

    A rule fits its host and all subdomains if the path begins with the rule's
    path. Of rules of equal length the first in the list wins. Rules are a
    parameter, so their number is bounded.
    """
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in reversed(longest):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, a).otherwise(action)
    return name, action


def _contexts(data: np.ndarray, offsets: np.ndarray, order: int, bits: int):
    """For every byte of every row and each row's end mark: slots of its contexts and of context with byte, by order; rows' ranges."""
    n = np.diff(offsets)
    size = n + order + 1
    at = np.concatenate([[0], np.cumsum(size)])
    x = np.ones(at[-1], np.uint32)  # begin marks
    x[np.repeat(at[:-1] + order, n) + np.arange(len(data)) - np.repeat(offsets[:-1], n)] = data.astype(np.uint32) + 2
    x[at[1:] - 1] = 0
    place = np.repeat(at[:-1] + order, n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    h, contexts, grams = np.zeros(len(place), np.uint32), [], []
    for k in range(order + 1):
        if k:
            h = (h + x[place - k] + np.uint32(1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(13)
        contexts.append(_slot(h + np.uint32(k), bits))
        grams.append(_gram(contexts[-1], x[place], k, bits))
    return contexts, grams, np.concatenate([[0], np.cumsum(n + 1)])


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def _gram(context: np.ndarray, symbol: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The slot of a symbol after a context's slot of order k."""
    return _slot(context.astype(np.uint32) * np.uint32(SYMBOLS + 1) + symbol.astype(np.uint32) + np.uint32(k << 28), bits)


@dataclass
class UrlModel:
    """grams[c, k, slot]: of class c (0 rejected, 1 accepted), symbols after contexts of order k; totals[c, k, slot]: all symbols after a context."""

    grams: np.ndarray
    totals: np.ndarray
    order: int
    bits: int
    threshold: float = -np.inf

    @staticmethod
    def of(counts: np.ndarray, order: int, bits: int) -> UrlModel:
        """From counts[c, j, k, slot] of contexts (j=0) and of contexts with symbols (j=1); only contexts that were seen have a total."""
        totals = np.zeros(counts.shape[:1] + counts.shape[2:])
        for c, k in np.ndindex(*totals.shape[:2]):
            seen = np.flatnonzero(counts[c, 0, k])
            for symbol in (0, *range(2, SYMBOLS + 1)):
                totals[c, k, seen] += counts[c, 1, k, _gram(seen, np.full(len(seen), symbol), k, bits)]
        return UrlModel(counts[:, 1].astype(np.float64), totals, order, bits)

    def chances(self, c: int, contexts: list[np.ndarray], grams: list[np.ndarray]) -> np.ndarray:
        """The chance of each symbol after its contexts, in class c."""
        p = np.full(len(contexts[0]), 1 / SYMBOLS)
        for k in range(self.order + 1):
            total = self.totals[c, k, contexts[k]]
            p = np.where(total > 0, (self.grams[c, k, grams[k]] + PRIOR * p) / (total + PRIOR), p)
        return p

    def difference(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-likelihood of accepted less rejected, divided by the number of bytes and the end mark."""
        contexts, grams, ranges = _contexts(data, offsets, self.order, self.bits)
        logs = [np.log(self.chances(c, contexts, grams)) for c in (0, 1)]
        total = np.concatenate([[0], np.cumsum(logs[1] - logs[0])])
        return np.diff(total[ranges]) / np.maximum(np.diff(ranges), 1)


def _count(judged: DataFrame, order: int, bits: int) -> np.ndarray:
    """Counts of all rows of judged (url, accepted); each task adds up its own first."""
    shape = (2, 2, order + 1, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            accepted = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in blocks(*utf8(batch.column(0))):
                contexts, grams, ranges = _contexts(data, offsets, order, bits)
                c = np.repeat(accepted[lo:hi], np.diff(ranges))
                for k in range(order + 1):
                    for j, slots in ((0, contexts[k]), (1, grams[k])):
                        total[:, j, k] += np.bincount(c * (1 << bits) + slots, minlength=2 << bits).reshape(2, -1)
        flat = total.reshape(-1)
        some = np.flatnonzero(flat)
        for i in range(0, len(some), 100_000):
            own = some[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(flat[own])], names=["slot", "n"])

    found = judged.select("url", "accepted").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the model has slots, at most
    counts = np.zeros(int(np.prod(shape)), np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts.reshape(shape)


def _scored(df: DataFrame, model: UrlModel, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(row: pa.StructArray) -> pa.StructArray:
        scores = [shared.value.difference(data, offsets) for _, _, data, offsets in blocks(*utf8(row.field("url")))]
        return struct(score=pa.array(np.round(np.concatenate(scores), 9) if scores else [], pa.float64()))

    return map_rows(df, of, "score double", keep)


def fit_urls(judged: DataFrame, *, order: int = ORDER, bits: int = SLOT_BITS) -> UrlModel:
    """A model from all rows of judged: url, accepted (boolean). Null urls and judgements are left out.

    Where the calibration fold lacks one of the classes, nothing is blocked.
    """
    known = judged.filter("url is not null and accepted is not null").withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)))
    model = UrlModel.of(_count(known.filter("fold <> 0"), order, bits), order, bits)
    binned = _scored(known.filter("fold = 0").select("url", "accepted"), model, ["accepted"]).select(F.col("row.accepted").alias("accepted"), F.least(F.greatest(F.floor(F.col("out.score") / BIN), F.lit(-2000)), F.lit(2000)).alias("bin"))
    rows = binned.groupBy("bin", "accepted").count().collect()  # two rows for each of 4,001 bins, at most
    n = np.zeros((2, 4002))
    for r in rows:
        n[int(r["accepted"]), r["bin"] + 2000] += r["count"]
    if n.sum(axis=1).min() > 0:
        below = np.concatenate([np.zeros((2, 1)), np.cumsum(n, axis=1)], axis=1) / n.sum(axis=1, keepdims=True)
        gain = below[0] - below[1]
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float((best[len(best) // 2] - 2000) * BIN)  # the middle of equally good thresholds
    return model


def judge_urls(pages: DataFrame, rules: list[Rule], *, url: str = "url", order: int = ORDER, bits: int = SLOT_BITS) -> DataFrame:
    """Every row of pages as ``row``, and ``host``, ``path``, ``rule``, ``score``, ``verdict`` (allow or block).

    A null url, or one without ://, has an empty host and path, fits no rule
    that has a path and is judged by its characters alone. Equal urls get equal
    verdicts; an empty table gives no rows; other columns are carried through.
    """
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url).cast("string").alias("url"))
    parsed = packed.withColumns({"host": url_host("url"), "path": url_path("url")})
    name, action = matching_rule("host", "path", rules)
    ruled = parsed.withColumns({"rule": name, "action": action})
    model = fit_urls(ruled.select("url", (F.col("action") == "allow").alias("accepted")), order=order, bits=bits)
    scored = _scored(ruled, model, ["row", "host", "path", "rule", "action"])
    verdict = F.coalesce("row.action", F.when(F.col("out.score") >= F.lit(model.threshold), "allow").otherwise("block"))
    return scored.select("row.row", "row.host", "row.path", "row.rule", "out.score", verdict.alias("verdict"))

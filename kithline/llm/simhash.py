"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most 4 places differ in at most one
place within at least one of three segments, as three segments with two
differences each would make six. Every distinct fingerprint is therefore
indexed under each of its segments with one bit wiped out (a wildcard): two
segments that differ in one bit share the signature with that bit wiped. As
segments alone are short, a signature also holds part of the other bits. If
the segment differs in one bit, the others differ in at most three places, so
one of four blocks of them is equal; if the segment is equal, at most four
places differ elsewhere, and one of five blocks is equal. That makes 64 x 4
and 3 x 5 signatures of about 31 bits. An equality join on the signature brings
candidates together, and the whole fingerprints are compared.

A signature with very many members is dealt out again under further bits: of
the bits it leaves out at most four differ, so one of five blocks of them is
equal. After two such steps a signature holds 42 bits or more, which bounds
its members by 2**22.

Only distinct fingerprints are joined, so exact copies cost one row. Within a
signature's group, small groups compare all members; larger ones are searched
breadth first, which yields a spanning forest of the links (fewer rows than
members) that joins exactly the members that links join. Connected components
come from alternating large-star and small-star steps, each written to the
shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.common import drop_path, fresh_path, map_rows, scratch, struct, written

SHINGLE = 4
BITS = 4
SEED = 42
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Groups up to this size compare all members with one another.
SMALL = 16
#: Larger groups are dealt out under further bits, twice at most.
HOT = 4096
#: Rows to keep whose ids and hashes are broadcast, at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 1 << 19
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of the bits, about equally wide; every n-th bit, so that neighbouring bits in which a group agrees are spread."""
    return [sum(1 << b for b in bits[i::n]) for i in range(n)]


def masks(level: int = 0) -> list[int]:
    """The bits of which each signature is made; those of a further level are the five narrower ones of each mask before, in its order."""
    if level:
        return [m | more for m in masks(level - 1) for more in _blocks([b for b in range(64) if not m >> b & 1], BITS + 1)]
    out = []
    for first, width in SEGMENTS:
        segment = ((1 << width) - 1) << first
        rest = [b for b in range(64) if not segment >> b & 1]
        out += [segment | block for block in _blocks(rest, BITS + 1)]
        out += [segment & ~(1 << b) | block for b in range(first, first + width) for block in _blocks(rest, BITS)]
    return out


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority vote of the bits of XXH64 over word shingles, repeats included; 0 without words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = [digest(joined, seed)]
    else:
        after = list(accumulate(map((1).__add__, map(len, words))))
        h = [digest(joined[a : b - 1], seed) for a, b in zip([0, *after], after[shingle - 1 :], strict=False)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), CHUNK):
        ones += np.unpackbits(np.array(h[lo : lo + CHUNK], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row`` (of it the columns of keep), and ``out.fp``: its fingerprint as a signed long. Null counts as empty."""

    def of(row: pa.StructArray) -> pa.StructArray:
        texts = pc.fill_null(row.field(text), "").cast(pa.large_binary())
        return struct(fp=pa.array(np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)))

    return map_rows(docs.withColumn(text, F.col(text).cast("string")), of, "fp long", keep)


def signature(level: int) -> Column:
    """The signature of column fp under mask number ``k`` of a level."""
    of = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(level)])
    return F.xxhash64(F.col("fp").bitwiseAND(F.get(of, F.col("k"))), F.col("k"))


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within ``bits`` that connect distinct members just as all such links would."""
    left, a, b = members, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (members[:0], members[:0])


def _links(sig: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal sig."""
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(sig)])
    member = np.repeat(size <= SMALL, size)
    a, b = [], []
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        at = np.flatnonzero(member[:-d] & (sig[d:] == sig[:-d]))
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= bits]
        a.append(fp[at])
        b.append(fp[at + d])
    for i in np.flatnonzero(size > SMALL):
        x, y = forest(fp[begin[i] : begin[i] + size[i]], bits)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Verified links ``a``, ``b`` between distinct fingerprints (column fp): enough of them to join all that links join."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Fingerprints are few bytes and signatures many: spread them before they are multiplied.
    rows = fps.select("fp").repartition(n).select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks()) - 1))).alias("k"))
    found = None
    for level in range(3):
        # What is shuffled is the fingerprint and the signature's number, not the signature.
        dealt = rows.repartition(n, signature(level)).withColumn("sig", signature(level)).sortWithinPartitions("sig")
        got = written(dealt.mapInArrow(_joined(bits, hot if level < 2 else None), "a long, b long, k int"), "links")
        own = got.filter("k < 0").select("a", "b")
        found = own if found is None else found.union(own)
        rows = got.filter("k >= 0").select(F.col("a").alias("fp"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda j: F.col("k") * (BITS + 1) + j)).alias("k"))
        if got.filter("k >= 0").isEmpty():
            break
    return found


def _joined(bits: int, hot: int | None):
    """Links (k = -1) of rows (fp, k, sig) in order of sig; members of groups over hot come back as rows (fp, -, k)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, 0), np.int64)]
        passing = None  # the signature of a group that is known to be hot
        for batch in batches:
            if not len(batch):
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (2, 0, 1)])
            if passing is not None:
                more = int(np.searchsorted(rows[0], passing, side="right"))
                yield _rows(rows[1, :more], rows[1, :more], rows[2, :more])
                rows = rows[:, more:]
                if not rows.shape[1]:
                    continue
                passing = None
            rows = np.concatenate([*held, rows], axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1]))
            yield from groups(rows[:, :last])
            held = [rows[:, last:]]
            if hot is not None and rows.shape[1] - last > hot:
                passing = rows[0, -1]
                yield _rows(rows[1, last:], rows[1, last:], rows[2, last:])
                held = [np.zeros((3, 0), np.int64)]
        yield from groups(np.concatenate(held, axis=1))

    def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        size = np.diff(np.r_[begin, rows.shape[1]])
        cool = np.repeat(size <= (hot or rows.shape[1]), size)
        if not cool.all():
            yield _rows(rows[1, ~cool], rows[1, ~cool], rows[2, ~cool])
            rows = rows[:, cool]
        a, b = _links(rows[0], rows[1].view(np.uint64), bits)
        yield _rows(a.view(np.int64), b.view(np.int64), np.full(len(a), -1))

    return join


def _rows(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k.astype(np.int32))], names=["a", "b", "k"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for every node of edges (a, b), by large and small stars.

    Edges with a null end and loops are left out; without edges there are no
    rows. A centre with very many neighbours streams through one task of two
    numbers a row.
    """
    spark = edges.sparkSession
    base = fresh_path(spark, "components")
    step = _write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{base}/0")
    state = _state(step)
    for k in range(1, rounds + 1):
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        step = _write(small.filter("u <> v").distinct(), f"{base}/{k}")
        now = _state(step)
        drop_path(spark, f"{base}/{k - 1}")
        if now == state:
            roots = step.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(step.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _write(df: DataFrame, path: str) -> DataFrame:
    return written(df, "", path)


def _state(step: DataFrame) -> tuple:
    return tuple(step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _rooted(prints: DataFrame, bits: int, path: str) -> DataFrame:
    """``fp`` and ``root``, the smallest fingerprint of its component, for every distinct fingerprint of prints; written to path."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"three segments find links of up to {BITS} bits")
    spark = prints.sparkSession
    with scratch(spark):
        distinct = written(prints.select("fp").distinct(), "distinct")
        roots = connected_components(links(distinct, bits))
        return written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "", path)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """id_col, ``fp`` and ``component_id`` for every row of docs.

    Fingerprints link at ``bits`` (4 at most) or fewer differing bits;
    component_id is the smallest id reachable over links, the row's own
    included. Null and empty texts share fingerprint 0 and so one component;
    rows with equal texts share a fingerprint; a row without id takes part in
    linking, and its component_id is null only if no linked row has an id. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    prints = written(fingerprints(docs.select(id_col, text), text=text, shingle=shingle, keep=[id_col]).select(F.col(f"row.{id_col}").alias("id"), "out.fp"), "fingerprints")
    path = fresh_path(spark, "components")
    with scratch(spark):
        rooted = _rooted(prints, bits, fresh_path(spark, "roots"))
        least = written(prints.groupBy("fp").agg(F.min("id").alias("least")).join(rooted, "fp").groupBy("root").agg(F.min("least").alias("component_id")), "least-ids")
        of_print = written(rooted.join(least, "root").select("fp", "component_id"), "", path)
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: str | Column) -> Column:
    """A signed long as 16 lowercase hex digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Of each group of near-duplicates one row of docs: that with the smallest id, and of rows that repeat it that whose text has the least hash.

    A row without id stays only if no row of its group has one. Of rows equal
    in id and text one stays; only where some repeat are rows with their texts
    sorted. Null and empty texts are one group. An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    slim = named.select("id", "hash", F.col("row")[text].cast("string").alias("text"))
    path = fresh_path(spark, "kept")
    with scratch(spark):
        prints = written(fingerprints(slim, shingle=shingle, keep=["id", "hash"]).select("row.*", "out.fp"), "fingerprints")
        rooted = _rooted(prints, bits, fresh_path(spark, "roots"))
        rows = prints.groupBy("fp", "id", "hash").agg(F.count("*").alias("n"))
        least = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", "n")).alias("least"))
        kept = written(least.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.id").alias("kept_id"), F.col("least.hash").alias("kept_hash"), F.col("least.n").alias("kept_n")), "", path)
    found = _of(named, kept.filter("kept_n = 1")).select("row.*")
    again = kept.filter("kept_n > 1")
    if again.isEmpty():
        return found
    numbered = _of(named, again).withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash")))
    return found.union(numbered.filter("n = 1").select("row.*"))


def _of(named: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of named that kept names; texts stay where they lie unless kept is too large to be broadcast."""
    few = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    return named.join(few, (F.col("hash") == F.col("kept_hash")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")

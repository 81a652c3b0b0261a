"""What the operators share: the cluster's shared folder, written cuts, and text batches.

Operators that need Python take whole rows packed into one struct column
named ``row`` and return ``row`` with a struct column ``out`` beside it, so a
column of the input can never clash with a result column.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTF-8 bytes worked on at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Bytes of a Parquet row group that is written: a task holds one of what it reads and one of what it writes on the JVM's heap.
ROW_GROUP_BYTES = 1 << 24

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset on one machine; a cluster must set it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _fallback:
        _fallback["dir"] = tempfile.mkdtemp(prefix="kithline-")
    return _fallback["dir"]


#: Of each thread of the driver its own.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What fresh_path() names within is deleted at the end."""
    paths: list[str] = []
    before = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in paths:
            drop_path(spark, path)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kithline/{name}-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(path)
    return path


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and survives a lost executor.

    path: one named before, so that it outlives a scratch() begun since.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Jobs run within get Arrow batches of at most ``rows`` rows; the session's own setting comes back after them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote itself."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(key: str | Column, n: int = 4) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % n


def map_rows(df: DataFrame, fn: Callable[[pa.StructArray], pa.StructArray], out: str | T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (struct of df's columns) and ``out`` (fn's struct for each row); fn gets all columns of a batch as a struct.

    keep: the columns that ``row`` carries on, so that a text nobody asks for
    doesn't travel back from Python. Spark ends an Arrow batch at
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB), so long texts don't
    add up.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kind = T.StructType.fromDDL(out) if isinstance(out, str) else out
    kept = [i for i, c in enumerate(df.columns) if keep is None or c in keep]
    carried = T.StructType([packed.schema["row"].dataType.fields[i] for i in kept])
    schema = T.StructType([T.StructField("row", carried, False), T.StructField("out", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            values = row.flatten()
            own = pa.StructArray.from_arrays([values[i] for i in kept], fields=[row.type.field(i) for i in kept])
            yield pa.RecordBatch.from_arrays([own, fn(row)], names=["row", "out"])

    return packed.mapInArrow(run, schema)


def struct(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets; null is empty."""
    values = pc.fill_null(values, "")
    _, offsets, data = values.buffers()
    wide = pa.types.is_large_string(values.type)
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and len(values) else np.zeros(0, np.uint8)
    return b, o - o[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``most`` bytes, one row at least: first row, end row, bytes, offsets."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def ascii_lower() -> np.ndarray:
    """A byte table that maps A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class RollingHash:
    """64-bit hashes of any spans of a sequence, from one prefix sum of random values times powers of an odd base.

    Arithmetic is modulo 2**64. Equal spans have equal hashes; different spans
    collide with probability near 2**-60, and callers for which that matters
    compare the spans themselves afterwards.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n + 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, b, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """x: bytes, or 64-bit values; the prefix sums, one longer than x."""
        self._grow(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        values = self.values[x] if x.dtype == np.uint8 else x
        np.cumsum(values * self.up[: len(x)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (prefix[ends] - prefix[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def words_of(m: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True in m, never across rows, and each row's range of them."""
    first, last = m.copy(), m.copy()
    if len(m):
        first[1:] &= ~m[:-1]
        last[:-1] &= ~m[1:]
        at = offsets[:-1][offsets[:-1] < len(m)]
        first[at] = m[at]
        at = offsets[1:][offsets[1:] > 0] - 1
        last[at] = m[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of values[lo:hi] for each pair, 0 where hi <= lo."""
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    top = len(c) - 1
    return c[np.minimum(np.maximum(lo, hi), top)] - c[np.minimum(lo, top)]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the row offsets counted in them."""
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32), before[offsets]


#: Words end at these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def not_space(x: np.ndarray) -> np.ndarray:
    return ~((x == 0x20) | ((x >= 0x09) & (x <= 0x0D)))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, *, rows: int, id_col: str, text: str, held_out: int | None = 2) -> DataFrame:
    """At most ``rows`` labelled documents, chosen by a hash of the id, as columns text and label.

    Rows whose crc32(id) modulo 4 is held_out are never among them. A document
    labelled more than once counts with its greatest label; of documents that
    repeat an id the one whose text has the least hash counts. Null ids and
    labels are left out.
    """
    some = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label")).filter("key is not null and label is not null")
    if held_out is not None:
        some = some.filter(crc_fold("key") != held_out)
    some = some.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)
    return one_of_each(docs.select(F.col(id_col).alias("key"), F.col(text).cast("string").alias("text")), some).select("text", "label")


def one_of_each(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (key and more, a bounded number of rows with distinct keys) with the text of its key; of several that of the least hash.

    Hashes are compared first, so that copies of a text don't travel.
    """
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    least = hashed.join(F.broadcast(chosen.select("key")), "key").groupBy("key").agg(F.min("hash").alias("hash"))
    found = hashed.join(F.broadcast(least), ["key", "hash"]).groupBy("key").agg(F.min("text").alias("text"))
    return found.join(F.broadcast(chosen), "key")

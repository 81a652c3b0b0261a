"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, for each partition: a file of ids (little-endian unsigned 16-
or 32-bit, its documents one after another), one of offsets (signed 64-bit:
where each document begins within the partition, and one more for the end) and
one of keys (signed 64-bit document ids). ``index`` is a Parquet table of the
partitions: the name their three files share, their numbers of documents and
ids, and their bases, the prefix sums of those numbers over the partitions
before. A document's place in the whole corpus is its partition's base plus its
offset.

Partitions are ranges of the document id in ascending order. Texts are encoded
where they lie, and ids of two or four bytes are what is shuffled. Every
attempt of a task writes files of its own name; the index names those of the
attempts that counted, and the others are deleted. Files are read by memory
map, or by position where they are not local.
"""

from __future__ import annotations

import bisect
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.llm.common import map_rows, short_batches, struct

#: Stands for a null document id in keys files.
NO_KEY = -(1 << 63)
#: Units whose ids a worker remembers in each of two generations; of pieces it remembers a quarter as many.
MEMORY = 250_000
#: Letters of the Latin alphabets, and marks that may follow a word as a piece of their own.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())
MARKS = ".,;:!?)"

_encoders: dict[tuple, Encoder] = {}


class Memory(dict):
    """Values of a function, remembered in two generations: when the young one is full it becomes the old one, and what is used is young again."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Letters(dict):
    """How the pre-tokenizer spells single letters."""

    def __init__(self, spelled: Callable[[str], list[str]]):
        super().__init__()
        self.spelled = spelled

    def __missing__(self, key: str) -> str:
        self[key] = "".join(self.spelled(key))
        return self[key]


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, equal to those of its ``encode(text, add_special_tokens=False)``.

    The library cuts a text into pieces by the file's pre-tokenizer and gives
    each piece to the file's model on its own. Where that pre-tokenizer is the
    byte-level one and nothing is normalised, a space between two characters
    that are not white space is always such a cut; there the library's own
    pre-tokenizer and model work on the units between those spaces, and the ids
    of units and pieces are remembered. Any other file encodes whole texts.

    added: strings of special tokens in a text become those tokens' ids, as in
    the library's default settings; otherwise they are ordinary text. A text
    that holds the string of a token that counts goes through the library whole.
    """

    def __init__(self, path: str, dtype: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = not added
        t.no_truncation()
        t.no_padding()
        self.dtype, self.code = np.dtype(dtype), {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        if array("H", [1]).tobytes() != b"\1\0" or array(self.code).itemsize != self.dtype.itemsize:
            raise RuntimeError("ids are written as this machine holds them, which must be little-endian")
        if t.get_vocab_size() > 1 << (8 * self.dtype.itemsize):
            raise ValueError(f"ids up to {t.get_vocab_size()} don't fit {dtype}")
        self.added = [x.content for x in t.get_added_tokens_decoder().values() if added or not x.special]
        pre = t.pre_tokenizer
        self.by_units = t.normalizer is None and type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
        self.inner, self.together = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")
        #: Ids of a space and the unit after it; of a piece as the pre-tokenizer spells it.
        self.units, self.pieces = Memory(MEMORY, self._unit), Memory(MEMORY // 4, self._piece)
        #: Ids of what stands between two line ends of a unit.
        self.lines = Memory(MEMORY // 4, self._line)
        self.letters, self.model = Letters(self._spelled), t.model
        if self.by_units:
            self.space, self.same = self._spelled(" a")[0][:-1], False
            # What the shorter way below takes for granted, asked of the library itself.
            self.plain = self._spelled(f" {LETTERS}") == [self.space + self._latin(LETTERS)] and all(self._spelled(f" ab{m}") == [f"{self.space}ab", m] for m in MARKS)
            end = self._spelled("\n")
            self.plain &= self._spelled(LETTERS) == [self._latin(LETTERS)] and all(self._spelled(f"a{m}\nb") == [*f"a{m}", *end, "b"] for m in ["", *MARKS])
            self.same = self._spelled(ascii_letters) == [ascii_letters]
            self.line_end = b"".join(map(self._piece, end))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of dtype."""
        if not self.by_units:
            return [self._whole(t) for t in texts]
        out = []
        for text in texts:
            if any(map(text.__contains__, self.added)):
                out.append(self._whole(text))
            elif not text:
                out.append(b"")
            else:
                first, *rest = text.split(" ") if self._even(text) else self.inner.split(text)
                out.append(self._first(first) + b"".join(map(self.units.__getitem__, rest)))
            self._age()
        return out

    def _even(self, text: str) -> bool:
        """Whether every space of a text that isn't empty stands between two characters that are not white space."""
        return not (text[0].isspace() or text[-1].isspace() or self.together.search(text))

    def _first(self, unit: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self._spelled(unit)))

    def _age(self) -> None:
        for memory in (self.units, self.pieces, self.lines):
            memory.age()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _spelled(self, text: str) -> list[str]:
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _unit(self, unit: str) -> bytes:
        if self.plain and (unit.isascii() or max(unit) <= LETTERS[-1]):
            if unit.isalpha():  # one piece
                return self._piece(self.space + self._latin(unit))
            if unit[-1] in MARKS and unit[:-1].isalpha():  # a word and a mark after it
                return self.units[unit[:-1]] + self.pieces[unit[-1]]
            if "\n" in unit:
                first, *lines = unit.split("\n")
                if not any(not x or x[0].isspace() or x[-1].isspace() for x in (first, *lines)):  # a line end by itself is a piece
                    return self.line_end.join([self.units[first], *map(self.lines.__getitem__, lines)])
        return b"".join(map(self.pieces.__getitem__, self._spelled(f" {unit}")))

    def _line(self, unit: str) -> bytes:
        if unit.isalpha():
            return self._piece(self._latin(unit))
        if unit[-1] in MARKS and unit[:-1].isalpha():
            return self.lines[unit[:-1]] + self.pieces[unit[-1]]
        return b"".join(map(self.pieces.__getitem__, self._spelled(unit)))

    def _latin(self, word: str) -> str:
        if self.same and word.isascii():
            return word
        return "".join(map(self.letters.__getitem__, word))

    def _piece(self, spelled: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()


def encoder(path: str, dtype: str = "<u2", added: bool = False) -> Encoder:
    """This process's encoder for a tokenizer file; what it remembers lasts as long as the process."""
    if (path, dtype, added) not in _encoders:
        _encoders[path, dtype, added] = Encoder(path, dtype, added)
    return _encoders[path, dtype, added]


def encode_column(texts: pa.Array, tokenizer: str, dtype: str = "<u2", end_id: int | None = 2, added: bool = False) -> Iterator[bytes]:
    """The ids of each text of an Arrow array as bytes of dtype, end id last; null is an empty text."""
    enc, end = encoder(tokenizer, dtype, added), b"" if end_id is None else np.array([end_id], dtype).tobytes()
    for t in texts:
        yield enc.encode([t.as_py() or ""])[0] + end


def encoded(docs: DataFrame, tokenizer: str, *, text: str = "text", dtype: str = "<u2", end_id: int | None = 2, added: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as ``row`` (of it the columns of keep), and ``out.ids``: its ids as bytes of dtype, the end id last."""

    def of(row: pa.StructArray) -> pa.StructArray:
        return struct(ids=pa.array(encode_column(row.field(text), tokenizer, dtype, end_id, added), pa.binary()))

    return map_rows(docs.withColumn(text, F.col(text).cast("string")), of, "ids binary", keep)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without means the cluster's default file system, as it does to Spark's readers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


class _Slices:
    """Slices of a file of numbers: by memory map, or by position where the file is not local."""

    def __init__(self, path: str, dtype: str):
        self.dtype = np.dtype(dtype)
        fs, inner = pfs.FileSystem.from_uri(path)
        self.size = fs.get_file_info(inner).size // self.dtype.itemsize
        self.file = self.map = None
        if not isinstance(fs, pfs.LocalFileSystem):
            self.file = fs.open_input_file(inner)
        elif self.size:
            self.map = np.memmap(inner, dtype=self.dtype, mode="r")

    def __getitem__(self, span: slice) -> np.ndarray:
        lo, hi, _ = span.indices(self.size)
        if self.map is not None:
            return self.map[lo:hi]
        if self.file is None or hi <= lo:
            return np.zeros(0, self.dtype)
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def _bounds(docs: DataFrame, id_col: str, text: str, partitions: int | None) -> list[tuple]:
    """Where ranges of (id, text's hash, a random number) begin, about equally full; from those three numbers of each row alone."""
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.rand(5).alias("r"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said outright, or so few bytes would go to one partition
    ranged = keys.repartitionByRange(n, "id", "h", "r")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("id", "h", "r")).alias("k")).collect()  # a row for each partition
    return sorted(_key(*r["k"]) for r in firsts)[1:]


def _key(i: int | None, h: int, r: float) -> tuple:
    return (NO_KEY if i is None else i, h, r)


INDEX = "part int, name string, n_docs long, n_tokens long, doc_base long, token_base long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", end_id: int | None = 2, dtype: str = "<u2", partitions: int | None = None, added: bool = False) -> DataFrame:
    """Writes the folder ``path`` and returns its index: part, name, n_docs, n_tokens, doc_base, token_base.

    A null or empty text is only the end id. Documents stand in ascending order
    of id, null ids first; rows that repeat an id stand beside each other, in
    order of their texts' hash, and may go on in the next partition, so one id
    with very many rows doesn't fill one task. Ids must be whole numbers: a
    text id ends the job with Spark's error of a bad cast. An empty table gives
    an empty index. Other columns are not written. ids must fit dtype: ``<u2``
    below 65,536, else ``<u4``; a larger vocabulary is refused. added: strings
    of the tokenizer's special tokens become their ids, as in the library's
    default settings; otherwise they are ordinary text.
    """
    spark = docs.sparkSession
    path = qualified(spark, path)
    fs, inner = pfs.FileSystem.from_uri(path)
    fs.create_dir(inner, recursive=True)
    bounds = _bounds(docs, id_col, text, partitions)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.rand(5).alias("r"), F.col(text).cast("string").alias("text"))

    def place(row: pa.StructArray) -> pa.StructArray:
        keys = zip(*[row.field(c).to_pylist() for c in ("id", "h", "r")], strict=True)
        part = pa.array([bisect.bisect_right(bounds, _key(*k)) for k in keys], pa.int32())
        return struct(part=part, ids=pa.array(encode_column(row.field("text"), tokenizer, dtype, end_id, added), pa.binary()))

    found = map_rows(rows, place, "part int, ids binary", ["id", "h"]).select("out.part", "row.id", "row.h", "out.ids")
    dealt = found.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("id"), "h")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pfs.FileSystem.from_uri(path)
        width, name, part = np.dtype(dtype).itemsize, uuid.uuid4().hex, None
        keys, lengths, out = array("q"), array("q"), None
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py()
            out = out or fs.open_output_stream(f"{inner}/{name}-ids.bin")
            keys.extend(NO_KEY if k is None else k for k in batch.column(1).to_pylist())
            for ids in batch.column(3):
                lengths.append(len(ids.as_buffer()) // width)
                out.write(ids.as_buffer())
        if out is None:
            return
        out.close()
        for kind, numbers in (("offsets", np.cumsum(np.concatenate([[0], np.array(lengths)]), dtype="<i8")), ("keys", np.array(keys, "<i8"))):
            with fs.open_output_stream(f"{inner}/{name}-{kind}.bin") as f:
                f.write(numbers.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(keys)], pa.int64()), pa.array([sum(lengths)], pa.int64())], names=["part", "name", "n_docs", "n_tokens"])

    with short_batches(spark):
        counts = dealt.mapInArrow(write, "part int, name string, n_docs long, n_tokens long").collect()  # a row for each partition
    counts = sorted((tuple(r) for r in counts), key=lambda r: r[0])
    named = {r[1] for r in counts}
    for f in fs.get_file_info(pfs.FileSelector(inner)):
        if f.base_name.endswith(".bin") and f.base_name.split("-")[0] not in named:
            fs.delete_file(f.path)  # of an attempt that didn't count
    base = np.cumsum([(0, 0), *[r[2:] for r in counts]], axis=0).tolist()
    spark.createDataFrame([(*r, *b) for r, b in zip(counts, base, strict=False)], INDEX).coalesce(1).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str, fn: Callable[[np.ndarray], list], schema: str, *, dtype: str = "<u2") -> DataFrame:
    """id, start (ids of all documents before), n_tokens and fn's columns for every document, read from the files.

    fn gets the ids of one document, end id included, and returns the values of
    schema's columns. A null id comes back as null; a folder without documents
    gives no rows.
    """
    path = qualified(spark, path)
    index = spark.read.schema(INDEX).parquet(f"{path}/index").select("part", "name", "token_base")
    n = index.count()
    names = [c.split()[0] for c in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, offsets, keys = _Slices(f"{path}/{name}-ids.bin", dtype), _Slices(f"{path}/{name}-offsets.bin", "<i8"), _Slices(f"{path}/{name}-keys.bin", "<i8")
                for lo in range(0, keys.size, 4096):
                    some, at = keys[lo : lo + 4096], offsets[lo : lo + 4097]
                    values = [fn(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    first = [pa.array(some, mask=some == NO_KEY), pa.array(base + at[:-1]), pa.array(np.diff(at))]
                    yield pa.RecordBatch.from_arrays([*first, *[pa.array([v[k] for v in values]) for k in range(len(names))]], names=["id", "start", "n_tokens", *names])

    # One task for each partition of the folder.
    spread = index.repartitionById(n, F.col("part") % n) if n > 1 else index
    return spread.mapInArrow(read, f"id long, start long, n_tokens long, {schema}")


def crc32_ids(ids: np.ndarray) -> list[int]:
    return [zlib.crc32(ids.astype("<u4").tobytes())]

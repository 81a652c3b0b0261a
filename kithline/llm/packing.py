"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each at a cost. A document longer than
the longest fills sequences of that length whole; what remains of it, like any
shorter document, is packed. Packing takes the longest pieces first and puts
each into the open bin that it fills best. If none has room, a new bin is
opened, of the length whose cost for each token would be least if the bin were
filled on with the pieces still to come; all lengths are thus weighed against
the same supply. In the end every bin shrinks to the shortest permitted length
that holds its contents.

Documents are encoded and packed where they lie, without a shuffle: a task
packs its rows in groups of a bounded number of pieces and tokens, one after
another, and writes out each group's sequences with their token ids.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.token_files import encode_column

#: Permitted sequence lengths, in tokens.
CAPACITIES = (1024, 2048, 4096, 8192)
#: A sequence of n tokens costs n * (1 + n / ATTENTION): linear layers, and attention over pairs of tokens.
ATTENTION = 32_768
#: A group is packed when it has so many pieces or tokens.
GROUP_PIECES, GROUP_TOKENS = 16_384, 1 << 24
#: Tokens of a batch of sequences.
BATCH_TOKENS = 1 << 20


def cost(capacity: int, attention: float = ATTENTION) -> float:
    return capacity * (1 + capacity / attention)


class _Supply:
    """Counts of pieces still to be placed, by length."""

    def __init__(self, lengths: np.ndarray):
        found, n = np.unique(lengths, return_counts=True)
        found, n = found[found > 0], n[found > 0]  # a piece of length 0 fills nothing
        self.lengths, self.left = found.tolist(), dict(zip(found.tolist(), n.tolist(), strict=True))

    def take(self, length: int) -> None:
        if not length:
            return
        self.left[length] -= 1
        if not self.left[length]:
            self.lengths.pop(bisect_left(self.lengths, length))

    def filled(self, room: int) -> int:
        """How much of room the longest fitting pieces would fill, one after another."""
        total = 0
        at = bisect_right(self.lengths, room) - 1
        while at >= 0:
            length = self.lengths[at]
            n = min(self.left[length], (room - total) // length)
            total += n * length
            at = min(at, bisect_right(self.lengths, room - total)) - 1
        return total


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and each bin's capacity after downsizing. Pieces fit the longest capacity."""
    sizes = sorted(capacities)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room_of: list[int] = []
    held: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    with_room: dict[int, list[int]] = {}
    supply = _Supply(lengths)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        supply.take(length)
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            b = with_room[room].pop()
            if not with_room[room]:
                rooms.pop(at)
                del with_room[room]
        else:
            fits = [c for c in sizes if c >= length]
            room = min(fits, key=lambda c: (cost(c, attention) / max(1, length + supply.filled(c - length)), c))
            b = len(room_of)
            room_of.append(room)
            held.append(0)
        bins[k], offsets[k] = b, held[b]
        held[b] += length
        left = room_of[b] - held[b]
        if left:
            if left not in with_room:
                insort(rooms, left)
                with_room[left] = []
            with_room[left].append(b)
    shrunk = np.array([sizes[bisect_left(sizes, h)] for h in held], np.int64)
    return bins, offsets, shrunk


OUT = "bin long, capacity int, n_tokens int, doc_ids array<{kind}>, piece_starts array<long>, piece_tokens array<int>, ids array<int>"


def pack_ids(encoded: DataFrame, *, capacities: tuple[int, ...] = CAPACITIES, attention: float = ATTENTION, dtype: str = "<u2", group_pieces: int = GROUP_PIECES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Sequences of documents given as columns doc and ids (bytes of dtype), a row for each.

    bin (unique within one run), capacity, n_tokens, and the pieces one after
    another: doc_ids, piece_starts (the piece's first token within its
    document), piece_tokens; ids holds the tokens of all pieces in that order.
    A document without tokens, or with null ids, has no piece. Rows without id,
    and rows that repeat an id, are packed like any other. An empty table gives
    no rows.
    """
    return _packed(encoded.select("doc", "ids"), lambda ids: (x.as_py() for x in ids), capacities, attention, dtype, group_pieces, group_tokens)


def _packed(rows: DataFrame, encode: Callable[[pa.Array], Iterable[bytes | None]], capacities: tuple[int, ...] = CAPACITIES, attention: float = ATTENTION, dtype: str = "<u2", group_pieces: int = GROUP_PIECES, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Sequences of rows (doc, and what encode makes ids of)."""
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    most = max(capacities)
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        docs, starts, parts, tokens = [], [], [], 0
        schema = None

        def made(sequences: list[tuple[int, list[int], list[int], list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            """Batches of sequences: capacity, documents, starts and ids of pieces."""
            nonlocal number
            while sequences:
                n, own = 0, []
                while sequences and (not own or n + sequences[-1][0] <= BATCH_TOKENS):
                    own.append(sequences.pop())
                    n += own[-1][0]
                pieces = np.cumsum([0, *[len(s[1]) for s in own]])
                sizes = [len(x) for s in own for x in s[3]]
                totals = [sum(map(len, s[3])) for s in own]
                columns = [
                    pa.array(np.arange(number, number + len(own))),
                    pa.array([s[0] for s in own], pa.int32()),
                    pa.array(totals, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), pa.array([d for s in own for d in s[1]], schema)),
                    pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), pa.array([x for s in own for x in s[2]], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(pieces, pa.int32()), pa.array(sizes, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *totals]), pa.int32()), pa.array(np.concatenate([x for s in own for x in s[3]]).astype(np.int32))),
                ]
                number += len(own)
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in OUT.split(", ")])

        def packed() -> list[tuple]:
            bins, offsets, sizes = pack(np.array([len(x) for x in parts]), capacities, attention)
            found = [(int(c), [], [], []) for c in sizes]
            for k in np.lexsort((offsets, bins)).tolist():
                _, d, s, x = found[bins[k]]
                d.append(docs[k])
                s.append(starts[k])
                x.append(parts[k])
            return found

        for batch in batches:
            schema, whole = batch.schema.field(0).type, []
            for doc, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.frombuffer(raw or b"", dtype)
                full = len(ids) // most
                for i in range(full):
                    whole.append((most, [doc], [i * most], [ids[i * most : (i + 1) * most]]))
                rest = ids[full * most :]
                if len(rest):
                    docs.append(doc)
                    starts.append(full * most)
                    parts.append(rest.copy())  # the rest of a long document goes
                    tokens += len(rest)
                if len(parts) >= group_pieces or tokens >= group_tokens:
                    yield from made(packed())
                    docs, starts, parts, tokens = [], [], [], 0
                if len(whole) * most >= BATCH_TOKENS:
                    yield from made(whole)
            yield from made(whole)
        if parts:
            yield from made(packed())

    return rows.mapInArrow(run, OUT.format(kind=kind))


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text: str = "text", end_id: int | None = 2, dtype: str = "<u2", added: bool = False, **options) -> DataFrame:
    """Sequences of whole texts, as pack_ids() gives them, encoded by a tokenizer file with end_id after each.

    A null or empty text is its end id alone, or nothing without one. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    return _packed(rows, lambda texts: encode_column(texts, tokenizer, dtype, end_id, added), dtype=dtype, **options)

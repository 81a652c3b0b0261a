"""Chat formatting by token-level assembly.

Each turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Role and text are
encoded separately; the three marks are ids reserved beyond the vocabulary and
spliced in between, so no text can produce them. In the written form a text
could still spell a mark, so ``<`` followed by ``|`` gets a backslash between
the two (and one more where backslashes already stand there); taking one away
restores the text.

Every segment's length is known when it is encoded. Prefix sums of the lengths
within a turn, and of the turns within a conversation, give each turn's place
and the span of tokens under the loss mask: the text of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.common import map_rows, struct
from kithline.llm.token_files import encoder

#: Marks and their ids: the first after a vocabulary of 50,257 (fixed values).
IM_START, IM_SEP, IM_END = 50_257, 50_258, 50_259
MARKS = {IM_START: b"<|im_start|>", IM_SEP: b"<|im_sep|>", IM_END: b"<|im_end|>"}
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    """Adds a backslash wherever ``<``, any backslashes and ``|`` follow one another."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class Decoder:
    """Text of ids, by the tokenizers library and the marks; segments between marks are decoded each on its own, as they were encoded."""

    def __init__(self, path: str):
        self.tokenizer = encoder(path, "<u4").tokenizer

    def text(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def turn(self, ids: list[int]) -> tuple[str, str, int]:
        """Role, text and the written form's number of characters of one turn's ids."""
        sep = ids.index(IM_SEP)
        role, text = self.text(ids[1:sep]), self.text(ids[sep + 1 : -1])
        return role, text, len(role) + len(text) + sum(map(len, MARKS.values()))


def assemble(turns: DataFrame, tokenizer: str, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn, in the conversation's order: conversation, ``place`` (0, 1, ...), ``ids``, ``token_start`` (tokens of the turns before), ``loss_from`` and ``loss_to`` (tokens of the conversation under the loss mask; equal if none).

    Null roles and texts are empty; null turns come first; turns with equal
    numbers are ordered by role and a hash of the text; rows that repeat each
    other are kept; a null conversation is one of its own; an empty table gives
    no rows. Turns are encoded where they lie; what is shuffled by conversation
    is ids, without texts, and no task holds a conversation whole: one of very
    many turns streams through its task, sorted on disk.
    """
    named = turns.select(F.col(conversation).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def of(row: pa.StructArray) -> pa.StructArray:
        enc = encoder(tokenizer, "<u4")
        roles = [np.frombuffer(x, "<u4") for x in enc.encode([escape(x) for x in row.field("role").to_pylist()])]
        texts = [np.frombuffer(x, "<u4") for x in enc.encode([escape(x) for x in row.field("text").to_pylist()])]
        ids, begin, end = [], [], []
        for r, t in zip(roles, texts, strict=True):
            lengths = np.cumsum([1, len(r), 1, len(t), 1])
            ids.append(np.concatenate([[IM_START], r, [IM_SEP], t, [IM_END]]).astype(np.int32))
            begin.append(int(lengths[2]))
            end.append(int(lengths[3]))
        return struct(ids=pa.array(ids, pa.list_(pa.int32())), text_from=pa.array(begin, pa.int64()), text_to=pa.array(end, pa.int64()))

    hashed = named.withColumn("tie", F.xxhash64("text"))
    encoded = map_rows(hashed, of, "ids array<int>, text_from long, text_to long", ["conversation", "turn", "role", "tie"])
    order = Window.partitionBy("conversation").orderBy(F.asc_nulls_first("turn"), "role", "tie")
    flat = encoded.select("row.*", "out.*")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = flat.withColumns({"place": F.row_number().over(order) - 1, "token_start": F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long")})
    learned = F.col("role") == LEARNED_ROLE
    return placed.select("conversation", "place", "ids", "token_start", (F.col("token_start") + F.col("text_from")).alias("loss_from"), (F.col("token_start") + F.when(learned, F.col("text_to")).otherwise(F.col("text_from"))).alias("loss_to"))


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(assembled: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each conversation, read back from its ids and loss spans alone; rows stream, and no conversation is held whole."""
    # The window asks for rows by conversation in order; what assemble() has just dealt so is not dealt again.
    seen = F.row_number().over(Window.partitionBy("conversation").orderBy("place"))
    ordered = assembled.withColumn("seen", seen).select("conversation", "seen", "ids", "token_start", "loss_from", "loss_to")
    kind = assembled.schema["conversation"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, own = Decoder(tokenizer), None
        for batch in batches:
            done = []
            for i in range(len(batch)):
                conversation, seen, start, a, b = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
                ids = batch.column(2)[i].values.to_pylist()
                if seen == 1:
                    done += [own] if own else []
                    own = [conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, written = decoder.turn(ids)
                role, text, sep = unescape(role), unescape(text), ids.index(IM_SEP)
                # The span of the mask is the turn's text or nothing.
                learned = text if (a - start, b - start) == (sep + 1, len(ids) - 1) else unescape(decoder.text(ids[a - start : b - start]))
                own[1] += 1
                own[2].update(f"{role}\n{text}\n".encode())
                own[3] += len(learned)
                own[4].update(learned.encode())
                own[5] += written
            yield _digest_rows(done, batch.schema.field(0).type)
        if own:
            yield _digest_rows([own], batch.schema.field(0).type)

    return ordered.mapInArrow(read, f"conversation {kind}, {DIGEST}")


def _digest_rows(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*[[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows], strict=True)) or [[]] * 6
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conversation", *[c.split()[0] for c in DIGEST.split(", ")]])

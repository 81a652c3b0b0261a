"""Conversation structure repair by cost layers of grammar states.

Role initials of a sound conversation match ``(s?(ua)+)?``, an automaton of
four states: nothing yet, after s, after u, after a. A row may be kept,
given another role, or deleted, and empty rows may be inserted, each at a
cost. For every place between rows, from the end, a word of bitsets holds for
each increasing cost the states from which the rest can be repaired at that
cost or less; layers follow from those of the place behind by shifts and table
steps (the bit-parallel scheme of approximate matching). The first layer that
has the start state is the cost, and a walk over the bits takes the least
letter that keeps within it.

From any state the rest costs at most BAND - 1 more than from any other: one
insertion brings u and a into step, what began without s can delete that s
instead, and an end is reached by two insertions at most. So a word of BAND
layers, relative to the least cost at its place, holds all states, and a
place needs one byte: the number of one of few words. Conversations stream
through their task in order; besides two bytes a row, only digests of the
(role, text) pairs seen are held of the one in hand. A second stream of
the same rows, led by each conversation's audit, makes the repaired text's
digest without gathering it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.common import written

#: States: nothing yet, after s, after u, after a. Those that may end a conversation:
ENDS = 0b1001
#: From each state: what a kept or given role leads to (None: not allowed).
STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that may be inserted or given in each state.
NEXT = ("u", "u", "a", "u")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Layers of a word.
BAND = 8
ROLES = {"u": "user", "a": "assistant"}

_BY_ROLE = {r: tuple((q, to) for q, to in enumerate(to) if to is not None) for r, to in STEP.items()}
_GIVEN = tuple((q, STEP[r][q]) for q, r in enumerate(NEXT))


def _image(steps: tuple, bits: int) -> int:
    """The states from which a step leads into bits."""
    return sum(1 << q for q, to in steps if bits >> to & 1)


_INSERTED = [_image(_GIVEN, b) for b in range(16)]
_KEPT = {r: [_image(s, b) for b in range(16)] for r, s in _BY_ROLE.items()}


def _closed(layers: list[int]) -> list[int]:
    """Layers, cumulative, with what insertions before reach."""
    out: list[int] = []
    for c, bits in enumerate(layers):
        if c:
            bits |= out[c - 1]
        if c >= INSERT:
            bits |= _INSERTED[out[c - INSERT]]
        out.append(bits)
    return out


class _Words:
    """The words met so far, by number, and the steps between them: a row's class leads from one word to another, whose layers begin ``shift`` higher."""

    def __init__(self):
        self.layers: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.end = self._of(_closed([ENDS] + [0] * (BAND + 7)))[0]

    def _of(self, layers: list[int]) -> tuple[int, int]:
        shift = next(c for c, bits in enumerate(layers) if bits)
        word = tuple(layers[shift : shift + BAND])
        if word[-1] != 15:
            raise RuntimeError("a state lies beyond the layers kept")
        if word not in self.number:
            self.number[word] = len(self.layers)
            self.layers.append(word)
        return self.number[word], shift

    def before(self, word: int, kind: int) -> tuple[int, int]:
        """The word before a row of a class, and how many layers higher it begins."""
        found = self.steps.get((word, kind))
        if found is None:
            behind = self.layers[word]
            at = lambda c: behind[min(c, BAND - 1)] if c >= 0 else 0
            role, must_go, extra = _class(kind)
            layers = []
            for c in range(2 * BAND):
                bits = at(c - DELETE)
                if not must_go:
                    bits |= _INSERTED[at(c - REROLE - extra)]
                    if role:
                        bits |= _KEPT[role][at(c - extra)]
                layers.append(bits)
            found = self.steps[word, kind] = self._of(_closed(layers))
        return found


#: A row's class: its initial's place here, plus 4 if truncated; 8 if it must go.
INITIALS = ("", "s", "u", "a")
GONE = 8


def _class(kind: int) -> tuple[str, bool, int]:
    return INITIALS[kind & 3], kind == GONE, TRUNCATED if kind & 4 else 0


def audit(kinds: bytes | bytearray, words: _Words | None = None) -> tuple[int, str]:
    """The least cost of repairing rows of these classes and the least string of edits (D, I, K, R) of that cost."""
    words = words or _Words()
    places = bytearray(len(kinds) + 1)
    places[-1], total = words.end, 0
    for i in range(len(kinds) - 1, -1, -1):
        places[i], shift = words.before(places[i + 1], kinds[i])
        total += shift
    base, state = total, 0  # the cost at which the layers of this place begin
    left = total + next(c for c, bits in enumerate(words.layers[places[0]]) if bits & 1)
    cost, out, i = left, [], 0

    def within(place: int, begins: int, to: int | None, budget: int) -> bool:
        c = budget - begins
        return to is not None and c >= 0 and bool(words.layers[places[place]][min(c, BAND - 1)] >> to & 1)

    while True:
        given = STEP[NEXT[state]][state]
        if i < len(kinds):
            ahead = base - words.before(places[i + 1], kinds[i])[1]
            role, must_go, extra = _class(kinds[i])
            kept = STEP[role][state] if role and not must_go else None
            if within(i + 1, ahead, state, left - DELETE):
                letter, left, i, base = "D", left - DELETE, i + 1, ahead
            elif within(i, base, given, left - INSERT):
                letter, left, state = "I", left - INSERT, given
            elif within(i + 1, ahead, kept, left - extra):
                letter, left, state, i, base = "K", left - extra, kept, i + 1, ahead
            elif not must_go and within(i + 1, ahead, given, left - REROLE - extra):
                letter, left, state, i, base = "R", left - REROLE - extra, given, i + 1, ahead
            else:
                raise RuntimeError("no edit keeps within the cost")
        elif left:
            letter, left, state = "I", left - INSERT, given
        else:
            return cost, "".join(out)
        out.append(letter)


BLANK_CHARS = " \t\n\v\f\r"


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is held of the conversation in hand: a class byte a row, the digests seen, and counts."""

    def __init__(self, key):
        self.key, self.kinds, self.seen = key, bytearray(), set()
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.role: str | None = None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        solid = text.rstrip(BLANK_CHARS)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        fault = "blank" if not solid else "duplicate" if key in self.seen else "truncated" if solid[-1] not in ".!?" else ""
        self.seen.add(key)
        if fault:
            self.count[fault] += 1
        self.count["illegal"] += self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au")
        self.role = role
        initial = INITIALS.index(role[0]) if role and role[0] in "sua" else 0
        self.kinds.append(GONE if fault in ("blank", "duplicate") else initial + 4 * (fault == "truncated"))
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def row(self, words: _Words) -> tuple:
        cost, edits = audit(self.kinds, words)
        return (self.key, self.high - self.low + 1 - self.turns if self.turns else 0, *self.count.values(), cost, edits)


def _plans(conv_type: pa.DataType):
    """A row (conv_id, gaps, counts, cost, audit) for each run of equal conv_id of rows in order; rows that aren't ``there`` only name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now = _Words(), None
        names = ["conv_id", *(c.split()[0] for c in PLAN.split(", "))]

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [conv_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            done = []
            for conv, there, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.key:
                    if now is not None:
                        done.append(now.row(words))
                    now = _Conversation(conv)
                if there:
                    now.add(turn, role, text)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now.row(words)])

    return run


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each leading row's place (its number among the task's) and the digest of its conversation's repaired rows, which follow it in order."""
    plan, edits, at, digest, first = None, "", 0, None, True
    ready: list[tuple] = []
    state = 0

    def line(role: str, text: str) -> None:
        nonlocal first
        digest.update((("" if first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        first = False

    def inserted() -> None:
        """The insertions before the next row."""
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            role = NEXT[state]
            line(ROLES[role], "")
            state, at = STEP[role][state], at + 1

    def over() -> None:
        if plan is not None:
            inserted()
            ready.append((*plan, digest.hexdigest()))

    names: list[str] = []
    for batch in batches:
        plans = batch.column(1)
        leads = plans.is_valid().to_pylist()
        names = [plans.type.field(i).name for i in range(plans.type.num_fields)]
        for i, (conv, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
            if leads[i]:
                over()
                plan = (conv, *plans[i].as_py().values())
                edits, at, digest, first, state = plan[-1], 0, hashlib.sha256(), True, 0
                continue
            inserted()
            letter = edits[at]
            at += 1
            if letter == "K":
                line(role, text)
                state = STEP[role[0]][state]
            elif letter == "R":
                given = NEXT[state]
                line(ROLES[given], text)
                state = STEP[given][state]
        if ready:
            yield _batch(ready, batch.schema.field(0).type, names)
            ready = []
        conv_type = batch.schema.field(0).type
    over()
    if ready:
        yield _batch(ready, conv_type, names)


def _batch(rows: list[tuple], conv_type: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", *names, "repaired_sha256"])


def repair(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """``conv_id``, counts of faults, the least cost, its audit and the repaired rows' digest, for each conversation.

    Rows are taken by turn, nulls first, those of one turn by role and text.
    A null role or text is one space. A row's first fault counts: blank,
    duplicate (role and text of a row before), truncated. A role whose first
    letter isn't s, u or a (or that is empty) can't be kept. ``there``: rows
    for which it is false or null only name their conversation, so that one
    left without rows still has its row: zeros, an empty audit and the empty
    string's digest. Rows of a null conv_id are one conversation. An empty
    table gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    space = F.lit(" ")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.coalesce(there if there is not None else F.lit(True), F.lit(False)).alias("there"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"))
    conv = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = rows.repartition(n, "conv_id").sortWithinPartitions(*order)
    kind = pa.int64() if conv == "bigint" else pa.int32() if conv == "int" else pa.string()
    plans = written(sorted_rows.mapInArrow(_plans(kind), f"conv_id {conv}, {PLAN}"), "repair-plans")
    fields = [c.split()[0] for c in PLAN.split(", ")]
    led = plans.select("conv_id", F.struct(*fields).alias("plan"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    both = led.unionByName(rows.filter("there").select("conv_id", F.lit(None).cast(led.schema["plan"].dataType).alias("plan"), "turn", "role", "text"))
    stream = both.repartition(n, "conv_id").withColumn("follows", F.col("plan").isNull()).sortWithinPartitions("conv_id", "follows", "turn", "role", "text").select("conv_id", "plan", "role", "text")
    return stream.mapInArrow(_digested, f"conv_id {conv}, {PLAN}, repaired_sha256 string")


def damaged(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns with damage by crc32(``conv_id:turn``) % 20: 0 drops a row (``there`` is false), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 gives it role user; nulls are one space."""
    space = F.lit(" ")
    key = F.crc32(F.concat_ws(":", F.coalesce(F.col(conv_id).cast("string"), space), F.coalesce(F.col(turn).cast("string"), space))) % 20
    own = F.coalesce(F.col(text).cast("string"), space)
    changed = F.when(key == 1, "").when(key == 2, F.translate(own, ".!?", "")).otherwise(own)
    roles = F.when(key == 4, "user").otherwise(F.coalesce(F.col(role).cast("string"), space))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), roles.alias("role"), changed.alias("text"), (key != 0).alias("there"), F.when(key == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "there", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")

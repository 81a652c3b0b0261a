"""N-gram Jaccard join with prefix trees.

A document's set holds the 64-bit hashes of its distinct word n-grams, made
into tokens of one global order: rarer classes first (by a sketch of counts
over all documents), within a class by hash. Sets of equal content are one.

Sets that link share tokens within their first ones (a prefix of each), so
prefix tokens alone are shuffled, and those of one set only are dropped. A set
that keeps too few shared prefix tokens to link with anything goes, too, as
most documents do. What is left falls into candidate components, which are
connected over shared prefix tokens; only here whole sets travel, each once.

A component's sets are stored in a trie: paths are tokens in the global order,
so sets with equal beginnings share them. Each set traverses the trie level by
level: a node's overlap with it is counted once for all sets below, and a
subtree goes as soon as what remains of the set or of the longest member below
can't bring the overlap to what even the shortest one needs, or if it holds no
candidate of the set. Candidates share enough prefix tokens with it, where
tokens that are rarest in the component come first, and aren't connected with
it yet; so a component that chance holds together costs little.

A component over LARGE tokens is first linked star-wise, in salted parts each
with a copy of the star's centre, through the same tries. If it isn't whole by
then, its sets are dealt into parts, and each pair of parts is a trie of its
own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.common import RollingHash, ascii_lower, blocks, fresh_path, not_space, scratch, short_batches, utf8, words_of, written
from kithline.llm.simhash import connected_components

SHINGLE = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the sketch, and how many of them travel in one row.
BUCKET_BITS = 18
BUCKETS, PART = 1 << BUCKET_BITS, 1 << 13
#: Bits of a token that hold its class.
CLASS_BITS = 5
#: Tokens of a component that one task holds.
LARGE = 1 << 22
#: Survivors whose keys are broadcast, at most; beyond, both sides are shuffled.
BROADCAST_ROWS = 1 << 19
#: Rows of an Arrow batch of texts, so that a worker holds few sets at once.
BATCH_ROWS = 512
#: Rows of one token held at once.
LONG = 1 << 16
#: Tokens of a trie node, at most, so that a hopeless path is left early.
NODE = 32
#: Candidates' entries are sorted by label anew once a search has passed over so many times as many as there are.
SORT_AFTER = 8


def needed(x: np.ndarray | int, y: np.ndarray | int, percent: int = PERCENT):
    """The least intersection of linked sets of x and y tokens."""
    return -(-percent * (x + y) // (100 + percent))


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """The least intersection of a set of n tokens with any set it links with."""
    return -(-percent * n // 100)


def spare(n: np.ndarray | int):
    """By how many tokens a prefix is longer than one shared token would need: linked sets share so many and one within their prefixes."""
    return n // 20


def prefix_length(n, percent: int = PERCENT):
    return n - least_shared(n, percent) + 1 + spare(n)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class NGrams:
    """The distinct n-gram hashes of texts; a text of fewer words is one n-gram."""

    def __init__(self, size: int, classes: np.ndarray | None = None):
        self.size, self.classes = size, classes
        self.rolling = RollingHash()
        self.odd = np.random.default_rng(11).integers(1, 1 << 63, size + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Sorted tokens of each row."""
        for lo, hi, data, offsets in blocks(*utf8(texts)):
            data = ascii_lower()[data]
            starts, ends, ranges = words_of(not_space(data), offsets)
            words = self.rolling.spans(self.rolling.prefix(data), starts, ends)
            whole = np.zeros(max(0, len(words) - self.size + 1), np.uint64)
            for j in range(self.size):
                whole += words[j : j + len(whole)] * self.odd[j]
            tokens = self.tokens(_mixed(whole))
            for a, b in zip(ranges[:-1], ranges[1:], strict=True):
                if b - a >= self.size:
                    yield np.unique(tokens[a : b - self.size + 1])
                elif b > a:
                    short = (words[a:b] * self.odd[: b - a]).sum(dtype=np.uint64, keepdims=True)
                    yield self.tokens(_mixed(short + self.odd[-1:] * np.uint64(b - a)))
                else:
                    yield tokens[:0]

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Hashes with their class ahead, if classes are known: a fixed order of all n-grams, the rarer first."""
        if self.classes is None:
            return h
        return (self.classes[h >> np.uint64(64 - BUCKET_BITS)] << np.uint64(64 - CLASS_BITS)) | (h >> np.uint64(CLASS_BITS))


def set_key(tokens: np.ndarray) -> int:
    """64 bits of the set's digest: two of a billion different sets are taken for one with a chance of 3 %."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64) ^ np.int64(-(1 << 63))  # keeps the order


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _counted(size: int):
    """Rows (part, counts) of a task's sketch: how many of its sets fall on each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = NGrams(size), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            tokens = np.concatenate([np.zeros(0, np.uint64), *grams.sets(batch.column(0))])
            counts += np.bincount((tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
        parts = [p for p in range(BUCKETS // PART) if counts[p * PART : (p + 1) * PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([counts[p * PART : (p + 1) * PART].tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part: the sums of the rows' counters."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])


def rarity_classes(docs: DataFrame, *, text: str, size: int) -> np.ndarray:
    """The class of each of BUCKETS counters of n-grams over all documents: 0 up to four times the mean, then one more each time that doubles."""
    rows = docs.select(F.col(text).cast("string")).mapInArrow(_counted(size), "part int, counts binary")
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.repartition(BUCKETS // PART, "part").mapInArrow(_added, "part int, counts binary").collect():  # 2 MB whatever the input
        counts[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    usual = max(4 * counts.mean(), 1)
    return np.clip(np.ceil(np.log2(np.maximum(counts, 1) / usual)), 0, (1 << CLASS_BITS) - 1).astype(np.uint64)


def _prints(grams: NGrams, percent: int):
    """Batches (id, hash, text) as (id, hash, key, n, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prefixes = [], [], []
            for s in grams.sets(batch.column(2)):
                keys.append(set_key(s))
                sizes.append(len(s))
                prefixes.append(_signed(s[: prefix_length(len(s), percent)]) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), _lists(prefixes)], names=["id", "hash", "key", "n", "prefix"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Whole runs of equal (token, salt), some at a time, of rows in their order; a run over LONG rows comes in pieces, each with the last row of the one before, and with True."""
    held, pieces = None, False
    for batch in batches:
        if not len(batch):
            continue
        now = {c: batch.column(i).to_numpy() for i, c in enumerate(names)}
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in names}
        token, salt = now["token"], now["salt"]
        begin = int(np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])[-1])
        if pieces and begin:  # the rest of a long run
            end = int(np.flatnonzero((token != token[0]) | (salt != salt[0]))[0])
            yield {c: v[:end] for c, v in now.items()}, True
            now = {c: v[end:] for c, v in now.items()}
            begin, pieces = begin - end, False
        if begin:
            yield {c: v[:begin] for c, v in now.items()}, False
        held = {c: v[begin:] for c, v in now.items()}
        if len(held["token"]) > LONG:
            yield held, True
            held, pieces = {c: v[-1:] for c, v in held.items()}, True
    if held is not None:
        yield held, pieces


def _shared(percent: int):
    """Of rows (token, salt, n, key) in order those whose token a set of a size it may link with has too, with how many have it (long runs and salted ones: no less than a fixed number)."""
    names = ["token", "salt", "n", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, long in _groups(batches, names):
            token, salt, n = g["token"], g["salt"], g["n"].astype(np.int64)
            same = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1])
            near = same & (100 * n[:-1] >= percent * n[1:])  # sizes ascend
            both = np.r_[False, near] | np.r_[near, False] | (salt > 0)
            begin = np.flatnonzero(np.r_[True, ~same])
            size = np.diff(np.r_[begin, len(token)])
            count = np.where(salt > 0, 2 * LONG, np.repeat(np.full(len(size), LONG + 1) if long else size, size))
            yield pa.RecordBatch.from_arrays([*[pa.array(g[c][both]) for c in names], pa.array(count[both])], names=[*names, "df"])

    return run


def _stars(percent: int):
    """Edges (a, b) that connect the sets of each (token, salt) as far as their sizes allow links, and for a salted token (token, key) of its sets' least."""
    names = ["token", "salt", "n", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in _groups(batches, names):
            token, salt, n, key = g["token"], g["salt"], g["n"].astype(np.int64), g["key"]
            joined = np.r_[False, (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (100 * n[:-1] >= percent * n[1:])]
            begin = np.flatnonzero(~joined)
            centre = np.repeat(key[begin], np.diff(np.r_[begin, len(key)]))
            edge = joined & (centre != key)
            salted = ~joined & (salt > 0)
            a = np.r_[centre[edge], key[salted]]
            b = np.r_[key[edge], key[salted]]
            t = np.r_[np.zeros(edge.sum(), np.int64), token[salted]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(t), pa.array(np.r_[np.zeros(edge.sum(), bool), np.ones(salted.sum(), bool)])], names=["a", "b", "token", "salted"])

    return run


class Trie:
    """Sets of tokens in the global order as a tree; a node is a run of tokens, of NODE at most where there are many sets.

    sets: ascending arrays, none empty. Leaves are numbered in the lexical
    order of their sets; ``order`` gives each leaf's place among sets.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.concatenate(self.sets)
        shared = np.zeros(len(sets), np.int64)  # tokens that a leaf has in common with the one before
        for i, (a, b) in enumerate(zip(self.sets, self.sets[1:], strict=False), 1):
            differ = a[: len(b)] != b[: len(a)]
            shared[i] = int(differ.argmax()) if differ.any() else len(differ)
        self.levels: list[dict[str, np.ndarray]] = []
        longest = NODE if len(sets) > NODE else 1 << 62
        parts = [(0, len(sets), 0, 0)]
        while parts:
            rows, below = [], []
            for lo, hi, depth, parent in parts:
                begin = [lo, *(lo + 1 + np.flatnonzero(shared[lo + 1 : hi] <= depth)).tolist(), hi]
                for x, y in zip(begin, begin[1:], strict=False):
                    size = self.size[x:y]
                    end = min(int(min(size[0], shared[x + 1 : y].min(initial=1 << 62))), depth + longest)
                    over = int((size == end).sum())  # these end here; they come first
                    if x + over < y:
                        below.append((x + over, y, end, len(rows)))
                    rows.append((x, y, depth, end, parent, int(size.min()), int(size.max()), over))
            names = ("a", "b", "lo", "hi", "parent", "least", "most", "over")
            self.levels.append({c: np.array(v, np.int64) for c, v in zip(names, zip(*rows, strict=True), strict=True)})
            parts = below

    def linked(self, x: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Leaves that link with x; wanted(a, b) tells for ranges of leaves whether any of them matters, or is an array of those that do, ascending."""
        found, overlap, alive = [np.zeros(0, np.int64)], np.zeros(1, np.int64), np.ones(1, bool)
        for level in self.levels:
            if callable(wanted):
                some = np.flatnonzero(alive[level["parent"]])
                some = some[wanted(level["a"][some], level["b"][some])]
            else:  # found from the leaves: the level's other nodes cost nothing
                node = np.searchsorted(level["a"], wanted, side="right") - 1
                inside = node >= 0
                inside[inside] = wanted[inside] < level["b"][node[inside]]
                wanted, node = wanted[inside], node[inside]
                some = node[np.r_[True, node[1:] != node[:-1]]] if len(node) else node
                some = some[alive[level["parent"][some]]]
            if not len(some):
                break
            a, lo, hi = level["a"][some], level["lo"][some], level["hi"][some]
            length = hi - lo
            ends = np.cumsum(length)
            tokens = self.tokens[np.arange(ends[-1]) + np.repeat(self.at[a] + lo - (ends - length), length)]
            spot = np.searchsorted(x, tokens)
            hits = np.concatenate([[0], np.cumsum(x[np.minimum(spot, len(x) - 1)] == tokens)])
            now = overlap[level["parent"][some]] + hits[ends] - hits[ends - length]
            remains = len(x) - np.searchsorted(x, self.tokens[self.at[a] + hi - 1], side="right")
            for i in np.flatnonzero((level["over"][some] > 0) & (now >= needed(len(x), hi, percent))):
                found.append(np.arange(a[i], a[i] + level["over"][some[i]]))
            hope = now + np.minimum(level["most"][some] - hi, remains) >= needed(len(x), level["least"][some], percent)
            alive, overlap = np.zeros(len(level["a"]), bool), np.zeros(len(level["a"]), np.int64)
            alive[some], overlap[some] = hope, now
        return np.concatenate(found)


class Candidates:
    """An inverted index over the sets' prefixes, in an order by how many of these sets have a token, the fewest first.

    A search passes over entries whose label was the leaf's own when the
    entries were last sorted, so a family that is connected costs nothing.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets], np.int64)
        self.needs = 1 + spare(least_shared(self.size, percent))
        at = np.concatenate([[0], np.cumsum(self.size)])
        _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(seen), np.int64)
        rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
        leaf = np.repeat(np.arange(len(sets)), self.size)
        both = seen[token] > 1  # a set's others come first, and join nothing
        alone = self.size - np.bincount(leaf[both], minlength=len(sets))
        token, leaf = rank[token[both]], leaf[both]
        order = np.lexsort((token, leaf))
        token, leaf = token[order], leaf[order]
        first = at[:-1] - np.concatenate([[0], np.cumsum(alone)])[:-1]
        prefix = np.arange(len(leaf)) - first[leaf] + alone[leaf] < prefix_length(self.size, percent)[leaf]
        self.token, self.leaf = np.unique(token[prefix], return_inverse=True)[1], leaf[prefix]
        self.work = 0

    def sort(self, label: np.ndarray) -> None:
        """Entries by token and label, without tokens that one label alone has; and each leaf's own entries."""
        order = np.lexsort((label[self.leaf], self.token))
        self.token, self.leaf = self.token[order], self.leaf[order]
        own, new = label[self.leaf], np.r_[True, self.token[1:] != self.token[:-1]] if len(self.token) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(self.token)])
        mixed = np.repeat(own[begin] != own[begin + size - 1], size)
        self.token, self.leaf, own, new = self.token[mixed], self.leaf[mixed], own[mixed], new[mixed]
        bounds = []
        for run in (new, new | np.r_[True, own[1:] != own[:-1]] if len(own) else new):
            begin = np.flatnonzero(run)
            size = np.diff(np.r_[begin, len(own)])
            bounds += [np.repeat(begin, size), np.repeat(begin + size, size)]
        lo, hi, own_lo, own_hi = bounds
        order = np.argsort(self.leaf, kind="stable")
        self.at = np.searchsorted(self.leaf[order], np.arange(len(self.size) + 1))
        # The entries that a leaf's entry meets: those of its token before and after its label's.
        self.lo = np.stack([lo[order], own_hi[order]], axis=1)
        self.hi = np.stack([own_lo[order], hi[order]], axis=1)
        self.work = 0

    def of(self, leaf: int, label: np.ndarray, first: int = 0) -> np.ndarray:
        """Leaves from first on, of other labels, that may link with leaf."""
        lo, hi = self.lo[self.at[leaf] : self.at[leaf + 1]].ravel(), self.hi[self.at[leaf] : self.at[leaf + 1]].ravel()
        length = hi - lo
        ends = np.cumsum(length)
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int64)
        self.work += int(ends[-1])
        met = self.leaf[np.arange(ends[-1]) + np.repeat(lo - (ends - length), length)]
        met, n = np.unique(met[(met >= first) & (label[met] != label[leaf])], return_counts=True)
        x, y = self.size[leaf], self.size[met]
        near = (100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)) & (n >= np.maximum(self.needs[leaf], self.needs[met]))
        return met[near]


def linked_within(sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (places in sets) that connect all sets which links connect; sets of equal label count as connected.

    queries: only links of these.
    """
    trie = Trie(sets)
    label = np.unique(labels[trie.order], return_inverse=True)[1]
    members: list[list[int]] = [[] for _ in range(int(label.max()) + 1)]
    for leaf, k in enumerate(label.tolist()):
        members[k].append(leaf)
    near, left, known = Candidates(trie.sets, percent), len(members), 0
    out = []
    for leaf in range(len(sets)) if queries is None else np.argsort(trie.order)[queries].tolist():
        if left == 1:
            break
        if known == 0 or left < known and near.work > SORT_AFTER * len(near.leaf):
            near.sort(label)
            known = left
        some = near.of(leaf, label, leaf + 1 if queries is None else 0)  # those before have looked for this one
        if not len(some):
            continue
        for y in trie.linked(trie.sets[leaf], some, percent).tolist():
            a, b = int(label[leaf]), int(label[y])
            if a != b:
                out.append((trie.order[leaf], trie.order[y]))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                label[members[b]] = a
                members[a] += members[b]
                members[b] = []
                left -= 1
    return out


def _searched(percent: int):
    """Links of each run of equal (part, salt): rows (part, salt, centre, label, key, tokens) in order; with centres, only theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, keys, labels, centres = None, [], [], [], []

        def over() -> pa.RecordBatch:
            found = linked_within(sets, np.array(labels), percent, [i for i, c in enumerate(centres) if c] or None) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found], pa.int64()), pa.array([keys[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            parts, salts, centre, label, key = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i in range(len(batch)):
                if (parts[i], salts[i]) != group:
                    if len(sets) > 1:
                        yield over()
                    group, sets, keys, labels, centres = (parts[i], salts[i]), [], [], [], []
                sets.append((values[offsets[i] : offsets[i + 1]] ^ np.int64(-(1 << 63))).view(np.uint64))
                keys.append(key[i])
                labels.append(label[i])
                centres.append(centre[i])
        if len(sets) > 1:
            yield over()

    return run


def _search(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) within each (part, salt) of rows (part, salt, centre, label, key, tokens)."""
    dealt = rows.select("part", "salt", "centre", "label", "key", "tokens").repartition(n, "part", "salt").sortWithinPartitions("part", "salt")
    return dealt.mapInArrow(_searched(percent), "a long, b long")


def _sets(grams: NGrams):
    """Batches (key, text) as (key, tokens); rows whose text has another set are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [(k, _signed(s)) for k, s in zip(own, grams.sets(batch.column(1)), strict=True) if set_key(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), _lists([s for _, s in found])], names=["key", "tokens"])

    return run


def _links(sets: DataFrame, of: DataFrame, n: int, percent: int, large: int) -> DataFrame:
    """Links (a, b) of sets (key, tokens), by their candidate components of = (key, comp, size)."""
    spark = sets.sparkSession
    one = F.lit(0)
    small = sets.join(of.filter(F.col("size") <= large), "key").select(F.col("comp").alias("part"), one.alias("salt"), F.lit(False).alias("centre"), F.col("key").alias("label"), "key", "tokens")
    found = written(_search(small, n, percent), "links")
    big = of.filter(F.col("size") > large)
    if big.isEmpty():
        return found
    # The least key of each large component is the centre of a star, which goes to every part of it.
    members = sets.join(big.select("key", "comp", F.ceil(F.col("size") / large).cast("int").alias("parts")), "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    members = written(members.withColumnRenamed("comp", "part"), "large")
    centre = F.col("key") == F.col("part")
    copies = members.filter(centre).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stars = members.filter(~centre).unionByName(copies).select("part", "salt", centre.alias("centre"), F.col("key").alias("label"), "key", "tokens")
    star_links = written(_search(stars, n, percent), "star-links")
    # What a star links is connected; the others are labels of their own.
    reached = star_links.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("reached", F.lit(True))
    labelled = members.join(reached, "key", "left").withColumn("label", F.when(F.col("reached"), F.col("part")).otherwise(F.col("key"))).drop("reached")
    open_parts = labelled.filter("label <> part and key <> part").select("part").distinct()
    left = labelled.join(open_parts, "part", "left_semi")
    # Every pair of parts meets in one task: the set goes to all pairs that hold its own.
    k, last = F.col("salt"), F.col("parts") - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda j: F.least(j, k).cast("long") * F.col("parts") + F.greatest(j, k))
    dealt = left.select("part", F.explode(pairs).alias("salt"), F.lit(False).alias("centre"), "label", "key", "tokens")
    return found.union(star_links).union(written(_search(dealt, n, percent), "pair-links"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, large: int = LARGE) -> DataFrame:
    """``id``, ``n`` (distinct n-grams) and ``component_id`` for every row of docs.

    Words end at the six ASCII spaces, A-Z lower-cased. Rows link if the
    intersection of their sets is at least ``percent`` (50 to 100) per cent of
    the union; component_id is the smallest id reachable over links, the row's own
    included. A text of fewer words than ``shingle`` is one n-gram. Null,
    empty and blank texts have no n-gram and link with nothing, not with one
    another either. Rows of equal texts link. A row without id takes part in
    linking; its component_id is null only if no row it reaches has an id.
    An empty table gives no rows. Other columns, whatever their names, are
    ignored. N-grams and sets are told apart by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    path, prints_path = fresh_path(spark, "components"), fresh_path(spark, "prints")
    with scratch(spark):
        with short_batches(spark, BATCH_ROWS):
            grams = NGrams(shingle, rarity_classes(own, text="text", size=shingle))
        hashed = own.select("id", F.xxhash64("text").alias("hash"), "text")
        made = hashed.mapInArrow(_prints(grams, percent), f"id {id_type}, hash long, key long, n int, prefix array<long>")
        with short_batches(spark, BATCH_ROWS):
            wide = written(made, "prefixes")
        prints = written(wide.select("id", "hash", "key", "n"), "", prints_path)
        one_each = wide.filter("n > 0").select("key", "n", "prefix").dropDuplicates(["key"])
        # Tokens of frequent classes are salted, twice as wide for each class.
        level = F.shiftrightunsigned(F.col("token").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 64 - CLASS_BITS).cast("int")
        salt = F.when(level > 0, 1 + F.pmod(F.xxhash64("key"), F.pow(F.lit(2), F.least(level, F.lit(20))).cast("long"))).otherwise(0).cast("int")
        rows = one_each.select("key", "n", F.explode("prefix").alias("token")).select("token", salt.alias("salt"), "n", "key")
        order = ["token", "salt", "n", "key"]
        needs = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 20)

        def dealt(rows: DataFrame) -> DataFrame:
            return rows.select(*order).repartition(n, "token", "salt").sortWithinPartitions(*order)

        schema = "token long, salt int, n int, key long, df long"
        shared = written(dealt(rows).mapInArrow(_shared(percent), schema), "shared")
        some = shared.groupBy("key", "n").count().filter(F.col("count") >= needs).select("key")
        again = dealt(shared.join(some, "key", "left_semi")).mapInArrow(_shared(percent), schema)
        # Of c shared tokens at most c - needs miss in a linked set, so one of the c - needs + 1 rarest doesn't.
        of_key = Window.partitionBy("key")
        ranked = again.withColumns({"c": F.count("*").over(of_key), "place": F.row_number().over(of_key.orderBy("df", "token"))})
        rarest = written(ranked.filter((F.col("c") >= needs) & (F.col("place") <= F.col("c") - needs + 1)).select(*order), "rarest")
        stars = written(dealt(rarest).mapInArrow(_stars(percent), "a long, b long, token long, salted boolean"), "stars")
        # A salted token's parts are connected through its least set.
        least = stars.filter("salted").groupBy("token").agg(F.min("a").alias("m"))
        across = stars.filter("salted").join(least, "token").select("a", F.col("m").alias("b"))
        edges = stars.filter("not salted").select("a", "b").union(across).filter("a <> b").distinct()
        comps = connected_components(written(edges, "edges"))
        of = rarest.select("key", "n").distinct().join(comps.select(F.col("node").alias("key"), F.col("root").alias("comp")), "key")
        sizes = of.groupBy("comp").agg(F.sum("n").alias("size"))
        of = written(of.join(sizes, "comp").select("key", "comp", "size"), "candidates")
        # One row of each set: that with the least id and text.
        first = prints.join(of.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("f"))
        first = written(first.select("key", F.col("f.id").alias("first_id"), F.col("f.hash").alias("first_hash")), "first")
        few = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
        texts = hashed.join(few, (F.col("hash") == F.col("first_hash")) & F.col("id").eqNullSafe(F.col("first_id")))
        with short_batches(spark, BATCH_ROWS):
            sets = written(texts.select("key", "text").mapInArrow(_sets(grams), "key long, tokens array<long>").dropDuplicates(["key"]), "sets")
        roots = connected_components(_links(sets, of, n, percent, large))
        ids = prints.filter("n > 0").groupBy("key").agg(F.min("id").alias("least"))
        rooted = ids.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        rooted = written(rooted, "rooted")
        component = rooted.groupBy("root").agg(F.min("least").alias("component"))
        written(rooted.join(component, "root").select("key", "component"), "", path)
    of_set = spark.read.parquet(path)
    return prints.join(of_set, "key", "left").select("id", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))

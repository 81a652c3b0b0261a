"""Lexical search, conversation repair and the n-gram join against brute force, on odd rows, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kithline.llm import lexical, ngram_join, repair
from kithline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, out string, row string, score double, item string, rank int, id string, n int, key long, component string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ODD = [None, "", " ", "\n\n", "a", "A b", "b a", "one two three four", "one two three four five", "ONE two\tthree four\nfive", "é ñ ü — “x” 　 z", "tab\tvt\x0bff\x0ccr\rnl\n x", LONG, LONG, LONG + " tail", "x " * 300]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "o", "r", 0.5, "i", 1, "d", 2, 3, "c") for k, t in enumerate(ODD)] + [(3, "repeated id", *[None] * 9), (4, "a", *[None] * 9), (None, "no id at all", *[None] * 9), (None, "one two three four five", *[None] * 9)]
    return spark.createDataFrame(rows, WIDE)


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_conversation_repair", "op13_ngram_join"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, top):
    terms = [TERM.findall(lower(t)) for _, t in docs]
    n_docs, all_terms = sum(bool(t) for t in terms), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t))
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(TERM.findall(lower(text)))
    out = []
    for item, query in wanted.items():
        scored = []
        for (doc, _), t in zip(docs, terms, strict=True):
            tf, m = Counter(t), 50 + 50 * len(t) * n_docs // max(all_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in query if tf[x])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(heapq.nsmallest(top, scored), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("pairs, top", [(1 << 18, 50), (3, 2)])
def test_search(spark, odd, pairs, top):
    """One block of items and many; items repeat, one has no id, one no term, one is all documents' words."""
    items = [(1, "ONE two"), (1, "three"), (2, None), (None, "one"), (3, "w1x1 w5x5 a z é"), (4, "Tail x x x"), (5, LONG[:3000])]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lexical.search(odd, spark.createDataFrame(items, "item_id long, text string"), pairs=pairs, top=top)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, top)


def test_search_ties_over_ranges(spark):
    """Hundreds of equal documents: the least ids win, over all tasks and ranges."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("same words here").alias("text")).unionByName(spark.createDataFrame([(10_000 + k, f"other {k}") for k in range(50)], "doc_id long, text string")).repartition(7)
    got = lexical.search(docs, spark.createDataFrame([(1, "words same"), (2, "other 7")], "item_id long, text string"))
    assert [r["id"] for r in got.filter("item = 1").orderBy("rank").collect()] == list(range(50))
    first = got.filter("item = 2").orderBy("rank").collect()
    assert [r["id"] for r in first] == [10_007, *[k for k in range(10_000, 10_050) if k != 10_007]] and [r["rank"] for r in first] == list(range(1, 51))


def test_search_empty(spark, odd):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(odd.limit(0), items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_radix_order():
    rng = np.random.default_rng(5)
    for top in (1, 1 << 10, 1 << 20, 1 << 40, 1 << 63):
        keys = rng.integers(0, top, 1000, dtype=np.uint64)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.uint64))) == 0


# Conversation repair


def brute_repair(rows):
    """(cost, audit, repaired) of damaged rows (role, text) in order, by shortest paths over (place, state)."""
    seen, marked = set(), []
    counts = Counter()
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault))
    initials = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    given = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(marked) and state in ("", "a"):
            return counts, illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        new = given[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, new[0], (*out, (new, ""))))
        if i < len(marked):
            role, text, fault = marked[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*out, (new, text))))
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))


def brute_damage(rows):
    """Damaged rows of each conversation, in order, from (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (turn is not None, turn or 0, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    return {c: sorted(r) for c, r in found.items()}


def want_repairs(rows):
    out = {}
    for conv, own in brute_damage(rows).items():
        turns = [t for known, t, _, _ in own if known]
        counts, illegal, cost, audit, text = brute_repair([(r, t) for *_, r, t in own])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_conversation_repair"](spark, SF).collect()}
    assert got == want_repairs(rows)


def test_repair_odd_rows(spark):
    """Nulls everywhere, repeated turns, unknown and empty roles, long conversations; a conversation whose rows are all dropped."""
    rng = random.Random(7)
    texts = [None, "", " \t", "Yes.", "No", "é!", "　", "What? ", "a\nb.", "x" * 50_000 + "."]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "uncle", "s"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in (None, 1, 2, 3, 4, 5) for _ in range(12)]
    rows += [(6, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(700)]
    gone = next(k for k in range(100, 10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    df = spark.createDataFrame([(*r, True, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, there boolean, plan string, cost int")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(repair.damaged(df), there=F.col("there")).collect()}
    assert got == want_repairs(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_random_classes():
    """Least cost and least audit of short conversations of any classes."""
    rng, words = random.Random(3), repair._Words()
    for _ in range(3000):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", f"Fine {rng.random()}.", f"cut {rng.random()}"])) for _ in range(rng.randrange(10))]
        kinds = bytearray()
        now = repair._Conversation(0)
        for role, text in rows:
            now.add(None, role, text)
        kinds = now.kinds
        assert repair.audit(kinds, words) == brute_repair(rows)[2:4]


def test_repair_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(df), there=F.col("there")).count() == 0


# N-gram join


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows, percent=80):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got_join(df, **more):
    return sorted((tuple(r) for r in ngram_join.near_duplicates(df, **more).collect()), key=str)


def test_join_odd_rows(spark, odd):
    assert got_join(odd) == brute_join([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0


def variants(seed, families, copies, words):
    """Texts in families of nearer and farther copies, around the threshold, with a passage that all share."""
    rng = random.Random(seed)
    out, passage = [], [f"p{i}" for i in range(30)]
    for f in range(families):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            w = [x if rng.random() > rng.choice([0, 0.01, 0.03, 0.06]) else f"n{rng.randrange(10**6)}" for x in base]
            at = rng.randrange(len(w))
            out.append(" ".join(w[:at] + passage * rng.randrange(2) + w[at : len(w) - rng.randrange(words // 8)]))
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("large", [ngram_join.LARGE, 600, 50])
def test_join_variants(spark, large):
    """Components within a task, and those over its bound: stars in salted parts, then pairs of parts."""
    rows = variants(1, 6, 25, 120)
    assert got_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), large=large) == brute_join(rows)


def test_join_of_frequent_words(spark):
    """Documents made of few frequent n-grams, whose tokens are salted, and chains of links."""
    few = " ".join(f"c{i}" for i in range(40))
    rows = [(k, f"{few} {few} own{k // 2} a{k}") for k in range(150)]
    rows += [(1000 + k, " ".join(f"z{i}" for i in range(2 * k, 2 * k + 40))) for k in range(30)]
    assert got_join(spark.createDataFrame(rows, "doc_id long, text string")) == brute_join(rows)


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 90)), dtype=np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 60))):
            b = base[int(rng.integers(4))]
            sets.append(np.unique(np.r_[b[rng.random(len(b)) > rng.choice([0.02, 0.1, 0.3])], rng.integers(0, 1 << 63, int(rng.integers(1, 4)), dtype=np.uint64)]))
        links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))}
        trie = ngram_join.Trie(sets)
        for i, s in enumerate(sets):
            found = {trie.order[y] for y in trie.linked(s, lambda a, b: np.ones(len(a), bool))}
            assert found - {i} == {j for k, j in links if k == i}
        got = ngram_join.linked_within(sets, np.arange(len(sets)))
        assert set(got) <= links


def test_sets_that_chance_connects_are_not_compared(monkeypatch):
    """A component of sets that share frequent tokens and link with none, but for two, costs no search of each set over all."""
    rng = np.random.default_rng(4)
    usual = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sets = [np.unique(np.r_[rng.integers(0, 1 << 63, 36, dtype=np.uint64), rng.choice(usual, 4, replace=False)]) for _ in range(600)]
    sets.append(np.delete(sets[17], 20))
    searched, own = [], ngram_join.Trie.linked
    monkeypatch.setattr(ngram_join.Trie, "linked", lambda self, x, *more: searched.append(1) or own(self, x, *more))
    assert {frozenset(p) for p in ngram_join.linked_within(sets, np.arange(len(sets)))} == {frozenset((17, 600))}
    assert len(searched) <= 5  # before: 600


@pytest.mark.parametrize("after", [0, 8])
def test_links_within_against_all_pairs(monkeypatch, after):
    """Searches with candidates, sorted by label at every leaf or seldom, connect what all links connect."""
    monkeypatch.setattr(ngram_join, "SORT_AFTER", after)
    rng = np.random.default_rng(8)

    def classes(n, links):
        of = list(range(n))
        for a, b in links:
            of = [of[a] if x == of[b] else x for x in of]
        return [of.index(x) for x in of]

    for _ in range(40):
        percent, usual = int(rng.choice([50, 80, 100])), rng.integers(0, 1 << 63, int(rng.choice([30, 2000])), dtype=np.uint64)
        base = [np.unique(rng.choice(usual, int(rng.integers(1, 90)))) for _ in range(4)]
        sets = [np.unique(np.r_[base[k % 4][rng.random(len(base[k % 4])) > rng.choice([0, 0.02, 0.1, 0.3])], rng.choice(usual, 1 + k % 5)]) for k in range(int(rng.integers(2, 50)))]
        links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
        for queries in (None, [int(rng.integers(len(sets)))]):
            labels = rng.integers(0, len(sets), len(sets))
            equal = [(int(np.argmax(labels == x)), k) for k, x in enumerate(labels)]
            got = ngram_join.linked_within(sets, labels, percent, queries)
            wanted = [x for x in links if queries is None or x[0] in queries or x[1] in queries]
            assert set(got) <= links and classes(len(sets), [*got, *equal]) == classes(len(sets), [*wanted, *equal])


def test_least_shared_prefixes():
    """Linked sets share as many prefix tokens as the count filter asks of each."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.sort(rng.choice(10_000, n, replace=False))
        b = np.unique(np.r_[a[rng.random(n) > 0.12], rng.choice(10_000, int(rng.integers(0, max(1, n // 9) + 1)))])
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        both = np.intersect1d(a[: ngram_join.prefix_length(len(a))], b[: ngram_join.prefix_length(len(b))])
        for s in (a, b):
            assert len(both) >= 1 + ngram_join.spare(ngram_join.least_shared(len(s)))

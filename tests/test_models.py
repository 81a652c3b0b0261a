"""Operators against plain Python models on random input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from kithline.operators import changepoint, intervals, sessions
from kithline.params import Params

P = Params()


def model_bouts(parts, turn, same):
    parts = sorted(parts, key=lambda r: (r[1], 0 if r[0] == "kchi" else 1, r[0], r[2]))
    out, run = [], None
    for kind, a, b in parts:
        if run and a - run[1] <= (same if kind in run[2] else turn):
            run = (run[0], b, run[2] | {kind})
        else:
            out.append(run)
            run = (a, b, {kind})
    return sorted((r[0], r[1]) for r in [*out, run] if r and len(r[2]) == 2)


@pytest.mark.parametrize("turn, same", [(240, 45), (45, 240), (100, 100), (60, 0)])
def test_bouts(spark, turn, same):
    rng = random.Random(5)
    data = {v: [(rng.choice(["kchi", "cds"]), a, a + 10 * rng.randint(0, 9)) for a in (10 * rng.randint(0, rng.choice([40, 300, 900])) for _ in range(rng.randint(0, 60)))] for v in range(300)}
    df = spark.createDataFrame([(v, *r) for v, rs in data.items() for r in rs], "video_id long, type string, start long, end long")
    got = {v: [] for v in data}
    for r in sessions.bouts(df, P.but(turn_gap_sec=turn / P.fps, same_gap_sec=same / P.fps)).collect():
        got[r["video_id"]].append((r["start"], r["end"]))
    for v, parts in data.items():
        assert sorted(got[v]) == model_bouts(parts, turn, same), v


@pytest.mark.parametrize("width", [0.7, 3.0, 100.0])
def test_overlap_join(spark, width):
    rng = random.Random(9)
    spans = lambda n: [(k % 3, float(a := rng.randint(0, 50)), float(a + rng.randint(0, 12)), k) for k in range(n)]
    a, b = spans(40), spans(50)
    schema = "video_id long, start double, end double, k long"
    got = intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "video_id", width)
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    assert sorted((r["k"], r["k_b"]) for r in got.collect()) == want


def best_cost(x, penalty, least, jump):
    """Least penalised cost over all allowed cuts, by plain recursion over ends."""
    n = len(x)
    ends = [t for t in range(0, n, jump) if t >= least] + [n]
    best = {0: 0.0}
    for t in ends:
        options = [best[u] + ((x[u:t] - x[u:t].mean()) ** 2).sum() + penalty for u in best if t - u >= least]
        if options:
            best[t] = min(options)
    return best.get(n)


@pytest.mark.parametrize("seed", range(12))
def test_change_points_are_optimal(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 0.3, rng.integers(5, 40)) for m in rng.normal(0, 2, 5)])
    ends = changepoint.change_points(x, 2.0)
    cost = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() + 2.0 for a, b in zip([0, *ends], ends, strict=False))
    assert ends[-1] == len(x)
    assert cost == pytest.approx(best_cost(x, 2.0, 2, 5))


def test_short_signals():
    assert changepoint.change_points(np.zeros(0), 1.0) == []
    assert changepoint.change_points(np.zeros(1), 1.0) == [1]


def test_long_spans_are_filed_in_few_cells(spark):
    """A span of a million seconds beside short ones: some dozens of rows, and the same pairs as without cells."""
    rng = random.Random(8)
    a = [(1, 0.0, 1e6), (1, 500_000.0, 500_000.5), (2, 3.0, 70_000.0)] + [(v, s, s + rng.choice([0.0, 0.1, 1.0, 33.0, 900.0])) for v in (1, 2, 3) for s in (rng.uniform(-50, 2e5) for _ in range(60))]
    b = [(v, s, s + rng.choice([0.0, 0.5, 64.0, 5_000.0])) for v in (1, 2, 4) for s in (rng.uniform(-50, 2e5) for _ in range(60))] + [(1, 5.0, 1.0), (1, None, 2.0)]
    schema = "video_id long, start double, end double"
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = sorted(tuple(r[c] for c in ("video_id", "start", "end", "start_b", "end_b")) for r in intervals.overlap_join(da, db, "video_id", 1.0).collect())
    want = sorted((v, s, e, t, f) for v, s, e in a for w, t, f in b if v == w and t is not None and f >= t and s < f and e > t)
    assert got == want and len(want) > 100
    spans = ("start", "end")
    filed = intervals.filed(da, spans, intervals._levels(db, spans, 1.0), 1.0)
    assert filed.filter("end = 1e6").count() < 50 and filed.groupBy("video_id", "start", "end").count().agg({"count": "max"}).first()[0] < 50

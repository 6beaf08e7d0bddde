"""One-to-one pairing and consolidation by rounds, against the rules walked over lists."""

from __future__ import annotations

import math
import random

import pytest

from trackspark.operators import gates as T
from trackspark.operators import joins as J
from trackspark.operators.kernels import dominant_pairs

EDGES = "g long, l long, r long, c long"


def walk(edges):
    """All pairs by (group, cost, left, right); a pair with a used end is skipped."""
    left, right, won = set(), set(), []
    for g, l, r, c in sorted(edges, key=lambda e: (e[0], e[3], e[1], e[2])):
        if (g, l) not in left and (g, r) not in right:
            left.add((g, l))
            right.add((g, r))
            won.append((g, l, r, c))
    return won


@pytest.mark.parametrize("seed", range(3))
def test_pairs_by_rounds_equal_the_walk(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(3), rnd.randrange(60), rnd.randrange(60), rnd.randrange(40)) for _ in range(1500)]
    edges += edges[:50]  # repeated pairs count once
    got = [tuple(x) for x in J.greedy_nearest(spark.createDataFrame(edges, EDGES), ["g"], None, "l", "r", "c").collect()]
    assert sorted(got) == sorted(walk(edges))


def test_a_chain_that_outlasts_the_rounds(spark):
    """Each pair excludes the next, which is dearer: only one pair in the whole group is dominant at a time."""
    n = 3000
    edges = [(0, i, i, 2 * i) for i in range(n)] + [(0, i + 1, i, 2 * i + 1) for i in range(n)] + [(1, 5, 7, 1)]
    got = [tuple(x) for x in J.greedy_nearest(spark.createDataFrame(edges, EDGES), ["g"], None, "l", "r", "c").collect()]
    assert sorted(got) == sorted(walk(edges))
    falling = [(0, l, r, 9000 - c) for g, l, r, c in edges]
    got = [tuple(x) for x in J.greedy_nearest(spark.createDataFrame(falling, EDGES), ["g"], None, "l", "r", "c").collect()]
    assert sorted(got) == sorted(walk(falling))


def test_no_pairs_and_further_columns(spark):
    assert J.greedy_nearest(spark.createDataFrame([], EDGES), ["g"], None, "l", "r", "c").collect() == []
    df = spark.createDataFrame([(0, 1, 1, 5, "x"), (0, 1, 2, 4, "y"), (0, 2, 2, 6, None)], EDGES + ", note string")
    got = dominant_pairs(df, ["g"], "l", "r", [df.c]).collect()
    assert sorted((x.l, x.r, x.note) for x in got) == [(1, 2, "y")]


@pytest.mark.parametrize("seed", range(2))
def test_predictions_take_the_nearest_unused_truth(spark, seed):
    rnd = random.Random(seed)
    spot = lambda: (rnd.randrange(2), rnd.randrange(25), rnd.randrange(25))
    pred = [("d", *spot(), i, rnd.randrange(5) / 4) for i in range(120)]
    truth = [("d", *spot(), 1000 + i) for i in range(120)]
    want, used = [], set()
    for _, f, x, y, i, s in sorted(pred, key=lambda p: (p[1], -p[5], p[4])):
        free = sorted(((x - u) ** 2 + (y - v) ** 2, t) for _, g, u, v, t in truth if g == f and t not in used and (x - u) ** 2 + (y - v) ** 2 <= 36)
        if free:
            used.add(free[0][1])
            want.append((f, i, free[0][1], free[0][0]))
    got = J.match_truth(spark.createDataFrame(pred, "dataset string, frame_no long, x long, y long, id long, score double"),
                        spark.createDataFrame(truth, "dataset string, frame_no long, x long, y long, id long"), 6)
    assert sorted((r.frame_no, r.pred_id, r.truth_id, r.d2) for r in got.collect()) == sorted(want)


def test_frames_match_in_two_stages_and_leave_the_rest(spark):
    cols = "dataset string, frame_no long, color string, id long, x long, y long"
    prev = spark.createDataFrame([("d", 1, "red", 1, 0, 0), ("d", 1, "red", 2, 50, 0), ("d", 1, "blue", 3, 0, 0), ("d", 1, "green", 4, 0, 0)], cols)
    cur = spark.createDataFrame([("d", 1, "red", 11, 45, 0), ("d", 1, "blue", 13, 900, 0), ("d", 1, "black", 14, 0, 0)], cols)
    got = {(r.prev_id, r.cur_id, r.stage) for r in J.match_frames(prev, cur, 60).collect()}
    assert got == {(2, 11, 1), (3, 13, 2), (1, None, None), (4, None, None), (None, 14, None)}


@pytest.mark.parametrize("seed", range(3))
def test_consolidation_equals_the_walk(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(3), i, rnd.choice(["red", "blue", None]), rnd.choice([None, *[rnd.uniform(0, 1500)] * 9]), rnd.uniform(0, 900),
             rnd.choice([None, 0.0, 40.0, 200.0, float(rnd.randrange(3)) * 100]) if rnd.random() < .05 else float(rnd.randrange(10)) * 20,
             rnd.randrange(9)) for i in range(250)]
    want = {}
    for g in range(3):
        kept = []
        for _, i, color, dist, x, y, hits in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3] is None, r[3] or 0.0, r[1])):
            near = (k for k in kept if color is not None and None not in (y, k[3]) and k[1] == color and math.hypot(k[2] - x, k[3] - y) <= 200.0)
            leader = next(near, None)
            if leader is None:
                kept.append((i, color, x, y))
            lead = (leader or kept[-1])[0]
            top, n = want.get((g, lead), (hits, 0))
            want[g, lead] = (max(top, hits), n + 1)
    df = spark.createDataFrame(rows, "g long, id long, color string, dist double, mx double, my double, hits long")
    assert {(r.g, r.id): (r.hits, r.merged) for r in T.consolidate(df, ["g"]).collect()} == want
